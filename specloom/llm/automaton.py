"""Byte automata: a small regex dialect, subset construction, minimisation.

The dialect: literals, ``\\xNN`` and other escapes, classes, groups,
alternation, ``? * +``, ``{m}``, ``{m,}``, ``{m,n}`` and ``(?i:...)``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np

#: Never part of UTF-8: it separates texts and returns every state to the start.
SEPARATOR = 0xFF


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        c = self.p[self.i]
        self.i += 1
        return c

    def alternatives(self, fold: bool):
        options = [self.sequence(fold)]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence(fold))
        return ("or", options)

    def sequence(self, fold: bool):
        items = []
        while self.peek() and self.peek() not in "|)":
            items.append(self.repeated(fold))
        return ("seq", items)

    def repeated(self, fold: bool):
        node = self.single(fold)
        while (c := self.peek()) and c in "?*+{":
            if c == "{":
                m = re.compile(r"\{(\d+)(,?)(\d*)\}").match(self.p, self.i)
                self.i = m.end()
                low = int(m[1])
                high = int(m[3]) if m[3] else (None if m[2] else low)
            else:
                self.take()
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            tail = [("star", node)] if high is None else [("or", [node, ("seq", [])])] * (high - low)
            node = ("seq", [node] * low + tail)
        return node

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def single(self, fold: bool):
        c = self.take()
        if c == "(":
            if self.p.startswith("?i:", self.i):
                self.i, fold = self.i + 3, True
            elif self.p.startswith("?:", self.i):
                self.i += 2
            node = self.alternatives(fold)
            self.take()
            return node
        if c == "[":
            negated = self.peek() == "^"
            self.i += negated
            found: set[int] = set()
            while self.peek() != "]":
                x = self.escaped() if (c := self.take()) == "\\" else ord(c)
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.take()
                    y = self.escaped() if (c := self.take()) == "\\" else ord(c)
                    found.update(range(x, y + 1))
                else:
                    found.add(x)
            self.take()
            found = set(range(256)) - found - {SEPARATOR} if negated else found
        else:
            found = {self.escaped() if c == "\\" else ord(c)}
        if fold:
            found |= {ord(chr(x).swapcase()) for x in found if x < 128 and chr(x).isalpha()}
        return ("set", frozenset(found))


def parse(pattern: str):
    return _Parser(pattern).alternatives(False)


def mirrored(node):
    kind, body = node
    if kind == "seq":
        return (kind, [mirrored(x) for x in reversed(body)])
    if kind == "or":
        return (kind, [mirrored(x) for x in body])
    return (kind, mirrored(body)) if kind == "star" else node


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        kind, body = node
        if kind == "set":
            self.moves[start].append((body, end := self.state()))
        elif kind == "seq":
            end = start
            for x in body:
                end = self.add(x, end)
        elif kind == "or":
            end = self.state()
            for x in body:
                self.empty[start].append(s := self.state())
                self.empty[self.add(x, s)].append(end)
        else:
            end, inner = self.state(), self.state()
            self.empty[start] += [inner, end]
            self.empty[self.add(body, inner)] += [inner, end]
        return end


@dataclass(frozen=True)
class Automaton:
    """``step[state * classes + byte_class[byte]]`` is the next state; 0 is the start.

    ``accept[state]`` has bit r set where rule r has just matched.
    """

    byte_class: np.ndarray
    step: np.ndarray
    accept: np.ndarray
    classes: int

    @property
    def states(self) -> int:
        return len(self.accept)


def compile_rules(nodes: list, anchored: bool = False) -> Automaton:
    """The minimal automaton of all rules; unanchored, a match may begin anywhere."""
    nfa = _Nfa()
    root = nfa.state()
    finals: dict[int, int] = defaultdict(int)
    for r, node in enumerate(nodes):
        nfa.empty[root].append(s := nfa.state())
        finals[nfa.add(node, s)] |= 1 << r
    sets = sorted({x for moves in nfa.moves for x, _ in moves}, key=sorted)
    groups: dict[tuple, int] = {}
    byte_class = np.zeros(256, np.uint8)
    for b in range(256):
        key = ("separator",) if b == SEPARATOR else tuple(b in x for x in sets)
        byte_class[b] = groups.setdefault(key, len(groups))
    sample = {k: int(np.flatnonzero(byte_class == k)[0]) for k in groups.values()}

    def closed(states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for y in nfa.empty[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return frozenset(seen)

    first = closed([root])
    again = frozenset() if anchored else first
    numbers, order, rows, accepts = {first: 0}, [first], [], []
    for now in order:
        accepts.append(sum({1 << k: 1 for x in now for k in range(len(nodes)) if finals.get(x, 0) >> k & 1}))
        moves = [m for x in now for m in nfa.moves[x]]
        row = []
        for k in range(len(groups)):
            b = sample[k]
            to = again | closed({y for x, y in moves if b in x}) if b != SEPARATOR else (again if anchored else first)
            if to not in numbers:
                numbers[to] = len(order)
                order.append(to)
            row.append(numbers[to])
        rows.append(row)
    return _minimal(byte_class, np.array(rows), np.array(accepts), len(groups))


def _minimal(byte_class, rows, accepts, classes: int) -> Automaton:
    """Moore's refinement: states stay together while all their moves do."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        keys = np.concatenate([block[:, None], block[rows]], axis=1)
        _, refined = np.unique(keys, axis=0, return_inverse=True)
        refined = refined.ravel()
        if refined.max() == block.max():
            break
        block = refined
    lead = [int(np.flatnonzero(block == k)[0]) for k in range(block.max() + 1)]
    names = {b: i for i, b in enumerate(sorted(range(len(lead)), key=lambda b: (b != block[0], lead[b])))}
    rename = np.array([names[b] for b in range(len(lead))])
    step = np.zeros((len(lead), classes), np.int32)
    accept = np.zeros(len(lead), np.int64)
    for b, at in enumerate(lead):
        step[names[b]] = rename[block[rows[at]]]
        accept[names[b]] = accepts[at]
    return Automaton(byte_class, step.ravel(), accept, classes)


def trajectory(machine: Automaton, data: np.ndarray, lanes: int = 4096) -> np.ndarray:
    """The state after every byte of ``data``, as one pass from the start would give.

    The bytes are cut into lanes stepped together, each as if it began at the
    start state; then each lane is redone from the state its predecessor ended
    in, until the two agree, which for these rules is a few bytes.
    """
    n = len(data)
    lanes = max(1, min(lanes, n // 64))
    width = -(-n // lanes)
    classes = np.zeros(lanes * width, np.uint8)
    classes[:n] = machine.byte_class[data]
    table = np.ascontiguousarray(classes.reshape(lanes, width).T)
    states = np.zeros(lanes, np.int32)
    out = np.empty((width, lanes), np.uint16 if machine.states < 65536 else np.int32)
    step, wide = machine.step, machine.classes
    for k in range(width):
        states = step[states * wide + table[k]]
        out[k] = states
    path = np.ascontiguousarray(out.T).ravel()
    for lane in range(1, lanes):
        at = lane * width
        state = int(path[at - 1])
        if state:
            while at < n:
                state = int(step[state * wide + int(classes[at])])
                if int(path[at]) == state:
                    break
                path[at] = state
                at += 1
    return path[:n]

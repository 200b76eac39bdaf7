"""Secret scans by one combined deterministic automaton.

All rules are compiled into one minimal automaton over bytes; a batch of whole
texts, joined by a separator byte, is scanned in a single pass. Where a run of
accepting states of a rule ends, a match of it ends: its start is found by the
rule's mirrored automaton walking back, no further than the rule's last match,
and the expression itself then confirms the span and its least lengths.

Defined results: a null or empty text has no spans; spans are in code points,
end exclusive, by start and then rule order; repeated rows are scanned alike. A
very long text is one block of its own, scanned in lanes, all of it. Extra columns
are not read by ``scan_secrets`` and are passed on by ``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import automaton
from .common import named, release, utf8

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
#: Texts are joined into blocks of about this many bytes for a pass.
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """``scan`` goes into the automaton; ``exact`` has the group whose length counts."""

    kind: str
    scan: str
    exact: str
    group: int
    least: int


#: The first three are the base rules, in the order that spans are listed by.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", r"[0-9a-f]+", 0, 24),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
BASE = ("assign", "access", "hex")


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        nodes = [automaton.parse(r.scan) for r in rules]
        self.machine = automaton.compile_rules(nodes)
        self.back = [automaton.compile_rules([automaton.mirrored(x)], anchored=True) for x in nodes]
        self.exact = [re.compile(r.exact.encode(), re.DOTALL) for r in rules]
        self.any = self.machine.accept != 0
        self.dead = [self._sink(m) for m in self.back]

    @staticmethod
    def _sink(m: automaton.Automaton) -> int:
        """The state that no match leaves, or -1."""
        rows = m.step.reshape(-1, m.classes)
        return next((s for s in range(m.states) if not m.accept[s] and (rows[s] == s).all()), -1)

    def _start(self, rule: int, data: bytes, end: int, least: int) -> int:
        """The leftmost start of a match of the rule that ends at ``end``."""
        m, state, found = self.back[rule], 0, -1
        dead = self.dead[rule]
        for at in range(end - 1, least - 1, -1):
            state = int(m.step[state * m.classes + int(m.byte_class[data[at]])])
            if m.accept[state]:
                found = at
            elif state == dead:
                break
        return found

    def scan(self, texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
        """Spans of each text in code points."""
        out: list[list] = [[] for _ in texts]
        if not texts:
            return out
        data = b"\xff".join(texts) + b"\xff"
        path = automaton.trajectory(self.machine, np.frombuffer(data, np.uint8))
        hits = np.flatnonzero(self.any[path])
        if not len(hits):
            return out
        bits, after = self.machine.accept[path[hits]], self.machine.accept[path[hits + 1]]
        ends = hits + 1
        bounds = np.cumsum([len(x) + 1 for x in texts])
        gone = bits & ~after
        for k in np.flatnonzero(gone):
            end = int(ends[k])
            doc = int(np.searchsorted(bounds, end, "right"))
            first = int(bounds[doc - 1]) if doc else 0
            out[doc].append((int(gone[k]), end - first))
        return [self._spans(texts[d], found) if found else found for d, found in enumerate(out)]

    def _spans(self, text: bytes, found: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        spans = []
        for r, rule in enumerate(self.rules):
            last = 0
            for end in (e for bits, e in found if bits >> r & 1):
                start = self._start(r, text, end, last) if end > last else -1
                m = self.exact[r].match(text, start) if start >= 0 else None
                if not m:
                    continue
                last = m.end()
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    spans.append((m.start(), r, m.end()))
        at = code_points(text, [x for s, _, e in spans for x in (s, e)])
        return [(self.rules[r].kind, at[s], at[e]) for s, r, e in sorted(spans)]


def code_points(text: bytes, places: list[int]) -> dict[int, int]:
    """The code points before each byte offset, counted in one walk over the text."""
    data, out, last, count = np.frombuffer(text, np.int8), {}, 0, 0
    for at in sorted(set(places)):
        # Continuation bytes are 0x80 to 0xBF: below -64 as signed ones.
        count += int(np.count_nonzero(data[last:at] >= -64))
        out[at] = count
        last = at
    return out


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """Built on the driver and broadcast: about a megabyte, fixed by the rules."""
    return Scanner(rules)


def blocks(lengths: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of neighbours with about ``size`` bytes, one text at least."""
    start, total = 0, 0
    for k, n in enumerate(lengths):
        total += int(n)
        if total >= size:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: copies of their texts stay small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def scan_secrets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>): one row for each row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    shared = df.sparkSession.sparkContext.broadcast(scanner(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in parts(batches):
            texts = batch.column(1).to_pylist()
            spans: list = []
            for i, j in blocks(np.array([len(x) for x in texts], np.int64)):
                spans += own.scan(texts[i:j])
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])
        release()

    id_kind = df.select(F.col(named(doc_id))).schema[0].dataType.simpleString()
    return df.select(F.col(named(doc_id)).alias("doc_id"), utf8(text).alias("t")).mapInArrow(run, f"doc_id {id_kind}, spans {SPANS}")


def redact(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with every span of every rule replaced by ``[kind]``; n_chars, where present, follows.

    Overlapping spans of different rules are replaced as one, named by the first.
    """
    at = df.columns.index(text)
    count = df.columns.index("n_chars") if "n_chars" in df.columns else None

    def cut(value: str, spans: list) -> str:
        parts, last = [], 0
        for kind, s, e in spans:
            if s >= last:
                parts += [value[last:s], f"[{kind}]"]
            last = max(last, e)
        return "".join(parts) + value[last:]

    shared = df.sparkSession.sparkContext.broadcast(scanner(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in parts(batches):
            texts = batch.column(at).to_pylist()
            raw = [(x or "").encode("utf-8", "replace") for x in texts]
            spans: list = []
            for i, j in blocks(np.array([len(x) for x in raw], np.int64)):
                spans += own.scan(raw[i:j])
            if any(spans):
                columns = list(batch.columns)
                new = [cut(x, s) if s else x for x, s in zip(texts, spans)]
                columns[at] = pa.array(new, batch.schema.field(at).type)
                if count is not None:
                    sizes = [len(x) if s else n.as_py() for x, s, n in zip(new, spans, columns[count])]
                    columns[count] = pa.array(sizes, batch.schema.field(count).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch
        release()

    return df.mapInArrow(run, df.schema)

"""Byte-level BPE: encoding by a segment tree over adjacent pair ranks.

The leaves of a word's tree hold the rank of each adjacent pair together with
its place, so the root is the leftmost pair of the lowest rank. A merge changes
three leaves and their paths, until the root holds no mergeable pair. Distinct
words new to a worker are encoded side by side, one tree each, level by level
in numpy; long words one by one. A bounded table of known words keeps results.

The vocabulary is read on the driver and broadcast: some MB, fixed by its file.

Defined results: a null text counts as empty and has no tokens; texts are split
at the vocabulary's added tokens first, as the tokenizer does; a file whose added
tokens take blanks along or are sought in normalised text is refused. Repeated
rows are encoded alike, very long texts whole; extra columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, release, utf8

#: The byte-level pattern of public byte-level vocabularies, with Unicode's blanks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same where all characters are below U+0250 or common punctuation: the
#: standard library's engine is the faster one, but has no character properties.
NEAR = "[\x00-\u024f\u2010-\u2027\u20ac]*"
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
NEAR_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Known words that a worker keeps; beyond them it starts anew.
KNOWN_WORDS = 200_000
#: Texts are encoded in groups of about this many characters.
GROUP_CHARS = 1 << 20
NONE = np.int64(1) << 62


def _alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ranks of mergeable pairs as sorted keys, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or any(x.get(flag) for x in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("only plain added tokens without a normalizer are built")
        letters = _alphabet()
        ids = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for word, k in ids.items():
            self.bytes_of[k] = bytes(letters[c] for c in word)
        for word, k in self.added.items():
            self.bytes_of[k] = word.encode()
        single = {b: k for k, b in enumerate(self.bytes_of) if len(b) == 1}
        self.single = np.array([single[b.to_bytes()] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.merged = keys[order], order.astype(np.int64), merged
        self.pairs = {int(k): r for r, k in enumerate(keys.tolist())}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it can't be merged or ``right`` is negative."""
        key = (left << 32) | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.rank[at], NONE)

    def encode_together(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of up to ``size`` bytes, a tree for each, in lockstep."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        size = 1 << max(1, int(lengths.max() - 1).bit_length())
        n = len(words)
        tokens = np.full((n, size), -1, np.int64)
        inside = np.arange(size)[None, :] < lengths[:, None]
        tokens[inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        place = np.arange(size, dtype=np.int64)
        right = np.tile(place + 1, (n, 1))
        left = np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * size), NONE, np.int64)
        rank = np.full((n, size), NONE, np.int64)
        rank[:, :-1] = self.ranks(tokens[:, :-1], tokens[:, 1:])
        tree[:, size:] = np.where(rank < NONE, rank << 32 | place[None, :], NONE)
        for k in range(size.bit_length() - 2, -1, -1):
            a, b = 1 << k, 2 << k
            tree[:, a:b] = np.minimum(tree[:, b : 2 * b : 2], tree[:, b + 1 : 2 * b : 2])
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            i = root & 0xFFFFFFFF
            j = right[rows, i]
            tokens[rows, i] = self.merged[root >> 32]
            tokens[rows, j] = -1
            k = right[rows, j]
            right[rows, i] = k
            inner = k < size
            left[rows[inner], k[inner]] = i[inner]
            follows = np.where(inner, tokens[rows, np.minimum(k, size - 1)], -1)
            h = left[rows, i]
            before = tokens[rows, np.maximum(h, 0)]
            new = self.ranks(tokens[rows, i], follows)
            old = np.where(h >= 0, self.ranks(before, tokens[rows, i]), NONE)
            self._set(tree, rows, size + j, np.full(len(rows), NONE))
            self._set(tree, rows, size + i, np.where(new < NONE, new << 32 | i, NONE))
            at = np.flatnonzero(h >= 0)
            self._set(tree, rows[at], size + h[at], np.where(old[at] < NONE, old[at] << 32 | h[at], NONE))
            rows = rows[tree[rows, 1] < NONE]
        alive = tokens >= 0
        flat, ends = tokens[alive].astype("<u4").tobytes(), (4 * np.cumsum(alive.sum(1))).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends)]

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        tree[rows, leaf] = value
        while len(leaf) and leaf[0] > 1:
            leaf = leaf >> 1
            tree[rows, leaf] = np.minimum(tree[rows, 2 * leaf], tree[rows, 2 * leaf + 1])

    def encode_alone(self, word: bytes) -> bytes:
        """Ids of one long word: the same tree in plain lists."""
        tokens = self.single[np.frombuffer(word, np.uint8)].tolist()
        n, none, pairs, merged = len(tokens), int(NONE), self.pairs, self.merged
        size = 1 << (n - 1).bit_length()
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)

        def value(i: int, k: int) -> int:
            r = pairs.get(tokens[i] << 32 | tokens[k]) if k < n else None
            return none if r is None else r << 32 | i

        def put(i: int, v: int) -> None:
            i += size
            tree[i] = v
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                v = a if a < b else b
                if tree[i] == v:
                    break
                tree[i] = v

        tree[size : size + n - 1] = [value(i, i + 1) for i in range(n - 1)]
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while (root := tree[1]) < none:
            i = root & 0xFFFFFFFF
            j = right[i]
            tokens[i], tokens[j] = int(merged[root >> 32]), -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
            put(j, none)
            put(i, value(i, k))
            if (h := left[i]) >= 0:
                put(h, value(h, i))
        return np.array([t for t in tokens if t >= 0], "<u4").tobytes()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian ids of each word, by size of tree."""
        out: list = [None] * len(words)
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(max(1, (len(w) - 1).bit_length()), []).append(k)
        for bits, which in by.items():
            if bits > 6 and len(which) < 64 or bits > 10:
                for k in which:
                    out[k] = self.encode_alone(words[k]) if len(words[k]) > 1 else self.single[list(words[k])].astype("<u4").tobytes()
                continue
            chunk = max(1, (1 << 20) >> (bits + 1))
            for c in range(0, len(which), chunk):
                part = which[c : c + chunk]
                for k, ids in zip(part, self.encode_together([words[k] for k in part])):
                    out[k] = ids
        return out


class Codec:
    """Whole-text encoding and decoding with a bounded table of known words."""

    def __init__(self, vocabulary: Vocabulary, known: int = KNOWN_WORDS):
        self.v, self.limit = vocabulary, known
        self.known: dict[str, bytes] = {}
        self.words = regex.compile(PATTERN)
        self.near_words, self.near = re.compile(NEAR_PATTERN), re.compile(NEAR)
        special = sorted(vocabulary.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def pieces(self, text: str) -> list[str]:
        findall = self.near_words.findall if self.near.fullmatch(text) else self.words.findall
        if not self.special or not self.special.search(text):
            return findall(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else findall(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > self.limit:
            self.known.clear()
        if not self.known:
            self.known = {w: np.array([k], "<u4").tobytes() for w, k in self.v.added.items()}
        new = [w for w in {w for ws in cut for w in ws} if w not in self.known]
        for w, ids in zip(new, self.v.encode_words([w.encode("utf-8", "replace") for w in new])):
            self.known[w] = ids
        ids_of = self.known.__getitem__
        return [b"".join(map(ids_of, ws)) for ws in cut]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    return Codec(vocabulary(path))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def groups(sizes: list[int], most: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    start = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded binary): ids as little-endian unsigned 32-bit
    integers and the text decoded from them, for each row."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(shared.value)  # known words are this task's only: freed with it
        for batch in batches:
            column = batch.column(1)
            sizes = [len(x.as_buffer()) for x in column]
            for i, j in groups(sizes):
                texts = [x.decode("utf-8", "replace") for x in column.slice(i, j - i).to_pylist()]
                ids = own.encode(texts)
                back = [own.decode(x).encode() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=["doc_id", "ids", "decoded"])
        del own
        release()

    kind = df.select(F.col(named(doc_id))).schema[0].dataType.simpleString()
    return df.select(F.col(named(doc_id)).alias("doc_id"), utf8(text).alias("t")).mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")

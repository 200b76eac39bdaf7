"""Near copies by the Jaccard similarity of their five-word shingles.

MinHash bands gather texts in buckets, the shingle sets of both texts decide: a
pair at similarity 0.8 shares none of the 25 bands of 6 hashes with probability
0.0005. Texts that buckets connect form a group, whose sets are brought together
once. There every text is compared with all members of its buckets that are not
yet in its component and whose sizes allow the threshold, so members of a bucket
are left uncompared only where links found already join them: no link between
components of a bucket is lost, and a bucket of copies costs a comparison each.
A group of more than ``GROUP`` shingles is cut into blocks and each pair of
blocks compared by a task of its own.

Every link that is returned is exact. They are enough to connect each component,
not all pairs inside it.

Defined results: equal word sequences count as one text; null, empty and texts of
fewer than five words have no shingles and are near only their equals; an empty
table has no links; very long texts count whole; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, named, release, utf8
from .simhash import SEED, fingerprint, stars, text_key

WIDTH = 5
THRESHOLD = 0.8
#: Greatest distance of near copies, a hair more for the rounding of doubles.
REACH = 1 - THRESHOLD + 1e-9
BANDS, ROWS = 25, 6
#: Shingles of a text are hashed in blocks of this many.
BLOCK = 1 << 12
#: Shingles of a group that one task compares; a larger group is cut into blocks of this many.
GROUP = 1 << 20
_FACTORS, _OFFSETS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's five-word shingles."""
    words = text.lower().split()
    n = len(words) - WIDTH + 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + WIDTH]), SEED) for i in range(n)], dtype=np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """A hash for each band of a text's least shingle hashes."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), BLOCK):
        mixed = found[k : k + BLOCK, None] * _FACTORS + _OFFSETS
        least = np.minimum(least, mixed.min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def marks(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, fp, k, n, bands): text hash, SimHash, hash of the words, distinct shingles and their bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "fp", "k", "n", "bands"]
        for batch in batches:
            texts = [x.as_py() for x in batch.column(2)]
            sets = [shingles(t) for t in texts]
            fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
            keys = np.array([xxhash.xxh64_intdigest(b" ".join(t.lower().split()), SEED) for t in texts], dtype=np.uint64)
            each = [np.array(bands(s), dtype=np.uint64).view(np.int64) for s in sets]
            columns = [batch.column(0), batch.column(1), pa.array(fps.view(np.int64)), pa.array(keys.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array(each, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    kind = df.select(F.col(named(doc_id))).schema[0].dataType.simpleString()
    rows = df.select(F.col(named(doc_id)).alias("doc_id"), text_key(text).alias("th"), utf8(text).alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, th binary, fp long, k long, n long, bands array<long>")


def buckets(texts: DataFrame) -> DataFrame:
    """(band, k, n, c): members of shared buckets of ``texts(k, n, bands)``, and how many share the bucket."""
    spread = texts.select("k", "n", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    return durable(spread.join(shared, "band"))


def cells(texts: DataFrame) -> DataFrame:
    """(band, k, n, weight): members of shared buckets of ``texts(k, n, bands)``; a member weighs the sizes of its buckets."""
    spread = buckets(texts)
    weights = spread.groupBy("k").agg(F.sum("c").alias("weight"))
    return spread.join(weights, "k").select("band", "k", "n", "weight")


def pivots(members: DataFrame) -> DataFrame:
    """(band, pivot, pn): each bucket's heaviest member, the least k of equals, and its size."""
    return members.groupBy("band").agg(F.max(F.struct("weight", (-F.col("k")).alias("order"), "k", "n")).alias("at")).select("band", F.col("at.k").alias("pivot"), F.col("at.n").alias("pn"))


def first_pairs(members: DataFrame) -> DataFrame:
    """Distinct (a, b): every member b of a bucket beside its pivot a."""
    return members.join(pivots(members), "band").where("k <> pivot").select(F.col("pivot").alias("a"), F.col("k").alias("b")).distinct()


def second_pairs(members: DataFrame, apart: DataFrame) -> DataFrame:
    """Distinct (a, b): pivots of the members that ``apart(a, b, d)`` left outside their bucket's commonest component."""
    roots = stars(apart.where(f"d <= {REACH}").select("a", "b")).withColumnRenamed("node", "k")
    own = members.join(roots, "k", "left").withColumn("c", F.coalesce("root", "k")).drop("root")
    sizes = own.groupBy("band", "c").agg(F.count("*").alias("many"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("many", "c")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    far = pivots(members).join(apart, F.col("pivot") == F.col("a")).select("band", F.col("b").alias("k"), "d")
    own = durable(own.join(mixed.select("band", F.col("top.c").alias("common")), "band").join(far, ["band", "k"], "left").withColumn("d", F.coalesce("d", F.lit(0.0))))
    chosen = own.where("c <> common").groupBy("band").agg(F.max(F.struct("weight", (-F.col("k")).alias("order"), "k", "n", "c", "d")).alias("p"))
    met = own.join(chosen, "band").where(f"c <> p.c AND d > 0 AND abs(d - p.d) <= {REACH} AND least(n, p.n) >= {THRESHOLD} * greatest(n, p.n)")
    return met.select(F.col("p.k").alias("a"), F.col("k").alias("b")).distinct()


def sets(df: DataFrame, texts: DataFrame, asked: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(k, s): the shingle hashes of each asked text, 8 bytes each."""
    wanted = texts.join(asked, "k").select("k", F.col("at.doc_id").alias("at_id"), F.col("at.th").alias("at_th"))
    rows = df.select(F.col(named(doc_id)).alias("own_id"), text_key(text).alias("own_th"), utf8(text).alias("t"))
    rows = rows.join(wanted, (F.col("own_th") == F.col("at_th")) & F.col("own_id").eqNullSafe(F.col("at_id"))).select("k", "t")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(x.as_py()).tobytes() for x in part.column(1)], pa.binary())], names=["k", "s"])
        release()

    # Repeated rows of an asked text: the first of them.
    return rows.mapInArrow(cut, "k long, s binary").groupBy("k").agg(F.first("s").alias("s"))


def distances(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with d, one minus the similarity of their sets."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([np.frombuffer(x.as_py(), np.uint64) for x in batch.column(c)] for c in (2, 3))
            far = [1 - similarity(a, b) for a, b in zip(one, two)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.float64())], names=["a", "b", "d"])
        release()

    second = found.select(F.col("k").alias("b"), F.col("s").alias("sb"))
    first = found.select(F.col("k").alias("a"), F.col("s").alias("sa"))
    return pairs.join(second, "b").join(first, "a").select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long, d double")


def grouped(members: DataFrame, most: int = GROUP) -> DataFrame:
    """(k, bands, part, whole, i, j, block): the tasks that compare each text of ``members(band, k, n)``.

    A group of up to ``most`` shingles is compared whole, along with others of its ``part``. In a larger one
    a text goes to the tasks of its block and each other, (i, j), where only pairs across the blocks count.
    """
    least = members.groupBy("band").agg(F.min("k").alias("a"))
    roots = stars(members.join(least, "band").select("a", F.col("k").alias("b"))).withColumnRenamed("node", "k")
    texts = members.groupBy("k").agg(F.first("n").alias("n"), F.collect_list("band").alias("bands"))
    texts = durable(texts.join(roots, "k", "left").withColumn("g", F.coalesce("root", "k")).drop("root"))
    sizes = texts.groupBy("g").agg(F.ceil(F.sum("n") / most).cast("int").alias("blocks"))
    parts = max(1, -(-(texts.agg(F.sum("n")).first()[0] or 0) // most))
    whole = F.col("blocks") == 1
    dealt = texts.join(sizes, "g").withColumn("whole", whole).withColumn("part", F.when(whole, F.pmod(F.xxhash64("g"), F.lit(parts))).otherwise(F.col("g")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("k", "bands", "part", "whole", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")


def joining(keys: np.ndarray, found: list[np.ndarray], bands: list[list[int]], block: np.ndarray) -> list[tuple[int, int]]:
    """Links (a, b) that connect the components of texts; of pairs that share a band, across blocks where there are two."""
    n = len(keys)
    sizes = np.array([len(s) for s in found], np.int64)
    ends = np.cumsum(sizes)
    names, ids = np.unique(np.concatenate(found), return_inverse=True)
    own = [ids[e - k : e] for e, k in zip(ends, sizes)]
    held: dict[int, list[int]] = {}
    for x, each in enumerate(bands):
        for band in each:
            held.setdefault(band, []).append(x)
    shared = {band: np.array(x, np.int64) for band, x in held.items() if len(x) > 1}
    across = len(np.unique(block)) > 1
    component, marked, asked, out = np.arange(n), np.zeros(len(names), bool), np.zeros(n, bool), []
    for x in range(n):
        for band in bands[x]:
            if band in shared:
                asked[shared[band]] = True
        met = np.flatnonzero(asked)
        asked[met] = False
        met = met[(met > x) & (component[met] != component[x])]
        if across:
            met = met[block[met] != block[x]]
        met = met[np.minimum(sizes[met], sizes[x]) >= (1 - REACH) * np.maximum(sizes[met], sizes[x])]
        marked[own[x]] = True
        for k in range(0, len(met), 1024):
            part = met[k : k + 1024]
            hits = marked[np.concatenate([own[m] for m in part])]
            both = np.add.reduceat(hits, np.cumsum(sizes[part]) - sizes[part], dtype=np.int64)
            for m in part[1 - both / (sizes[part] + sizes[x] - both) <= REACH].tolist():
                if component[m] != component[x]:
                    component[component == component[m]] = component[x]
                    out.append((int(keys[x]), int(keys[m])))
        marked[own[x]] = False
    return out


def connected(tasks: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): links that connect each component of the texts of ``tasks``, whose sets are ``found(k, s)``."""

    def compare(rows: pa.Table) -> pa.Table:
        keys = rows["k"].to_numpy()
        own = [np.frombuffer(x.as_py(), np.uint64) for x in rows["s"]]
        pairs = joining(keys, own, rows["bands"].to_pylist(), rows["block"].to_numpy())
        release()
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return tasks.join(found, "k").groupBy("part", "whole", "i", "j").applyInArrow(compare, "a long, b long")


def links(df: DataFrame, marked: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b): links between SimHash fingerprints that join texts at the threshold to components."""
    one = F.min(F.struct("doc_id", "th", "fp", "n", "bands")).alias("at")
    texts = durable(marked.where("n > 0").groupBy("k").agg(one).select("k", "at", "at.fp", "at.n", "at.bands"))
    members = buckets(texts)
    both = connected(grouped(members), sets(df, texts, members.select("k").distinct(), doc_id, text))
    named_a, named_b = texts.select(F.col("k").alias("a"), F.col("fp").alias("fa")), texts.select(F.col("k").alias("b"), F.col("fp").alias("fb"))
    return durable(both.join(named_a, "a").join(named_b, "b").where("fa <> fb").select(F.col("fa").alias("a"), F.col("fb").alias("b")).distinct())

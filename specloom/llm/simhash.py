"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint within distance 2r of another shares with it a value at distance
at most r of both. Every distinct fingerprint therefore emits its ball of
radius r (65 variants of 64 bits for r = 1), variants are shuffled, and the
fingerprints meeting at a variant are linked to the least of them: a ball holds
at most 65 of them, all within 2r of each other, so a star loses no component.

Exact copies share a fingerprint and collapse (map side first) before anything
else, so a group of copies of any size costs one fingerprint. Components are
found by alternating large and small stars over links, checkpointed per round.

Defined results: a text without words has fingerprint zero and is linked like
any other; rows with a null id take part but never name a component, which is
null only if all its ids are null; repeated rows each get a result row; a very
long text is hashed whole, in blocks. Extra columns are not read by ``components``
and are passed on, whatever their names, by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, named, nested, release, unnested, utf8

SEED = 42
#: Hashes of a text are counted in blocks of this many.
BLOCK = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats counted."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends)], dtype="<u8")
    counts = np.zeros(2048, np.int64)
    for k in range(0, len(hashes), BLOCK):
        places = hashes[k : k + BLOCK].view(np.uint8).reshape(-1, 8) + _COLUMN
        counts += np.bincount(places.ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


_COLUMN = (np.arange(8, dtype=np.int64) * 256)[None, :]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp long): one row for each row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
        release()

    kind = df.select(F.col(named(doc_id))).schema[0].dataType.simpleString()
    return df.select(F.col(named(doc_id)).alias("doc_id"), utf8(text).alias("t")).mapInArrow(run, f"doc_id {kind}, fp long")


def ball_links(nodes: DataFrame, radius_bits: int = 1) -> DataFrame:
    """Distinct (a, b), b < a, for distinct fingerprints ``fp`` that meet at a variant."""
    if radius_bits != 1:
        raise ValueError("only a half radius of one bit is built")
    flips = F.array(F.lit(0).cast("long"), *[F.expr(f"shiftleft(1L, {k})") for k in range(64)])
    variants = nodes.select("fp", F.explode(flips).alias("flip")).select("fp", F.expr("fp ^ flip").alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    met = variants.select(F.col("fp").alias("a"), least.alias("b")).where("a <> b AND bit_count(a ^ b) <= 2")
    return met.distinct()


def stars(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each component of ``links(a, b)``.

    Alternates large-star and small-star steps until the links stay the same;
    roots themselves are not listed.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = durable(small.where("u <> v").distinct())
    raise RuntimeError("components did not settle")


def rooted(fps: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of ``fps(doc_id, fp)``, linked by ``links(a, b)`` too."""
    nodes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("least_doc")))
    met = ball_links(nodes)
    roots = stars(met.union(links) if links is not None else met)
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_doc", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    return durable(named.join(names, "root").select("fp", "root", "component_id"))


def components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of ``df``."""
    fps = durable(fingerprints(df, doc_id, text, width))
    return fps.join(rooted(fps), "fp").select("doc_id", "fp", "component_id")


def text_key(text: str = "text") -> Column:
    """The SHA-256 of a text, null as empty: equal keys stand for equal texts."""
    return F.unhex(F.sha2(utf8(text), 256))


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text", fps: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """The first row of each component of ``df``: the least id (null last), then the least text key.

    ``fps(doc_id, th, fp)``, th the text's key, and ``links(a, b)`` between fingerprints add other
    near copies to SimHash's. A row is kept by id and text together, so an id stays once for each
    component that it is the first of, and another text under that id is judged by itself. Of
    repeated rows of the kept text that with the least other columns stays. Whole rows are
    shuffled once, by id and text key; all else is narrow.
    """
    if fps is None:
        keyed = df.select(F.struct(F.col(named(doc_id)).alias("doc_id"), text_key(text).alias("th")).alias("at"), F.col(named(text)).alias("text"))
        fps = durable(fingerprints(keyed, "at").select("doc_id.*", "fp"))
    found = fps.join(rooted(fps, links).select("fp", "root"), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    firsts = found.groupBy("root").agg(F.min(order).alias("at")).select(F.col("at.doc_id").alias("kept_id"), F.col("at.th").alias("kept_th"))
    whole = nested(df, F.col(named(doc_id)).alias("own_id"), text_key(text).alias("own_th"))
    kept = whole.join(firsts, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_th") == F.col("kept_th")), "left_semi")
    rest = F.to_json(F.struct(*[F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(df.columns) if c not in (doc_id, text)], F.lit(0).alias("end")))
    one = Window.partitionBy("own_id", "own_th").orderBy(rest)
    return unnested(kept.withColumn("nth", F.row_number().over(one)).where("nth = 1"), df)

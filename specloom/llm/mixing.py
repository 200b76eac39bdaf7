"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every row draws an exponential key whose rate is its quality weight (a smaller
key comes first, so better rows tend to), sources are sorted by key, and sizes
are prefix-summed up to the source's budget. A budget of more than the source
takes complete epochs first and selects for the remaining fraction only.

The prefix sum is two-level: keys are cut into buckets that follow the row
count, rows are summed within (source, bucket), and the few bucket totals are
summed along the source, so no source is ever sorted in one task.

Defined results: a null text has size 0 and is never taken; a null source is a
source of its own, last; rows that agree in key, id and size are interchangeable;
an empty table gives no rows. Draws hash the id (the text where the id is null)
with a seed, so reruns agree. Extra columns, whatever their names, are passed on
by ``mix`` and not read by ``allot``; very long texts are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, named, nested, unnested

#: About so many rows share a bucket of the prefix sum.
BUCKET_ROWS = 4096
#: A table of one row per source is broadcast up to so many rows (a few MB).
BROADCAST_SOURCES = 20_000
#: Beyond them a hot source's rows meet copies of its row under so many salts.
SALTS = 64
SEED = 7


def with_source(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined by ``key`` with a durable ``table`` of one row per source.

    The table is broadcast if its count allows it; else both sides are salted,
    since a shuffle by source alone would send a hot source's rows to one task.
    """
    if table.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(table), key)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", spread).join(salted, [key, "salt"]).drop("salt")


def word_count(text: str = "text") -> Column:
    return F.expr(rf"cast(regexp_count(coalesce(`{text}`, ''), '[^\\x20\\x09-\\x0D]+') as bigint)")


def quality_weight(text: str = "text", size: str = "size") -> Column:
    """Between 0.1 and 1: less for texts with many symbols for their words."""
    return F.expr(f"greatest(0.1D, 1D - (char_length(coalesce(`{text}`, '')) - char_length(translate(coalesce(`{text}`, ''), '#*$%&|<>!', ''))) / greatest({size}, 1))")


def draw_key(doc_id: str = "doc_id", weight: str = "weight", seed: int = SEED, text: str = "text") -> Column:
    """-ln(u) / weight with u from the first 52 bits of md5(seed:id), or of md5(seed:null:md5(text)) without an id."""
    digest = f"cast(conv(substr(md5(concat('{seed}:', coalesce(cast(`{doc_id}` as string), concat('null:', md5(coalesce(cast(`{text}` as string), '')))))), 1, 13), 16, 10) as double)"
    return F.expr(f"-ln(({digest} + 0.5D) / 4503599627370496D) / {weight}")


def source_key(source: str = "source") -> Column:
    """Sorts like the source by code point, null last, and joins null with null."""
    own = F.col(named(source)).cast("string")
    return F.when(own.isNull(), "1").otherwise(F.concat(F.lit("0"), own))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(skey, rows, source_size, target): the water level at which capped shares sum up.

    ``sizes`` has (skey, rows, source_size). Sources in order weigh
    ``weights``, repeating, and share ``share`` of the total; none gets more
    than ``cap`` times its size, the excess going to the others by weight.
    Sorted by cap / weight, a source is capped while its own level, taken with
    all before it capped, reaches its cap. One row for each source.
    """
    every, order = Window.partitionBy(), Window.orderBy("skey")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double"))
    ranked = ranked.withColumn("most", cap * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(every))
    level = Window.orderBy(F.col("most") / F.col("weight"), "skey")
    before = F.coalesce(F.sum("most").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", (F.col("total") - before) / left).withColumn("capped", F.col("most") <= F.col("level") * F.col("weight"))
    ranked = ranked.withColumn("water", F.max(F.when(~F.col("capped"), F.col("level"))).over(every))
    return ranked.select("skey", "rows", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def sized(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, source, skey, size, key) of each row."""
    return _drawn(df.select(F.col(named(doc_id)).alias("doc_id"), F.col(named(source)).alias("source"), source_key(source).alias("skey"), F.col(named(text)).cast("string").alias("t")), seed).select("doc_id", "source", "skey", "size", "key")


def _drawn(rows: DataFrame, seed: int) -> DataFrame:
    """``rows(doc_id, t, ...)`` with size and key."""
    out = rows.withColumn("size", word_count("t")).withColumn("weight", quality_weight("t"))
    return out.withColumn("key", draw_key("doc_id", "weight", seed, "t")).drop("weight")


def allot(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = SEED) -> DataFrame:
    """(doc_id, source, skey, size, key, source_size, target, epochs, selected) of each row.

    ``epochs`` complete copies are taken of every row, one more where
    ``selected``: the prefix of keys whose sizes come nearest the remainder.
    """
    rows = durable(sized(df, doc_id, text, source, seed))
    goals = durable(targets(rows.groupBy("skey").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size")), weights, share, cap))
    cut = with_source(rows, goals, "skey").withColumn("bucket", F.floor(F.col("key") / (1 + F.col("key")) * F.ceil(F.col("rows") / BUCKET_ROWS)))
    inner = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    bucketed = cut.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    sums = cut.groupBy("skey", "bucket").agg(F.sum("size").alias("in_bucket"))
    along = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("skey", "bucket", F.coalesce(F.sum("in_bucket").over(along), F.lit(0)).alias("offset"))
    out = bucketed.join(offsets, ["skey", "bucket"])
    epochs = F.expr("if(source_size = 0, 0, cast(floor(target / source_size) as int))")
    out = out.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    selected = F.expr("size > 0 AND 2 * (offset + within) + size <= 2 * rest")
    return out.select("doc_id", "source", "skey", "size", "key", "source_size", "target", "epochs", selected.alias("selected"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``df`` with each row as often as the mix takes it: none, one or more times.

    The allotment is narrow; of it only each source's epochs and last selected
    (key, id, size) return to the whole rows, which are never shuffled. Rows
    equal in all three are taken alike.
    """
    plan = allot(df, doc_id, text, source, **options)
    last = durable(plan.groupBy("skey").agg(F.first("epochs").alias("epochs"), F.max(F.when(F.col("selected"), F.struct("key", "doc_id", "size"))).alias("last")))
    whole = nested(df, F.col(named(doc_id)).alias("doc_id"), source_key(source).alias("skey"), F.col(named(text)).cast("string").alias("t"))
    whole = with_source(_drawn(whole, options.get("seed", SEED)).drop("t"), last, "skey")
    own = F.struct("key", "doc_id", "size")
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.coalesce((own <= F.col("last")).cast("int"), F.lit(0))).otherwise(0)
    return unnested(whole.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))), df)

"""The ``opN_*`` queries: each applies its operator to a whole table and derives
the digest columns. ``ORACLES`` has DuckDB SQL where SQL can express a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, licenses, media, mixing, quality_classifier, quality_rules, secrets, simhash, toxicity
from .common import crc_bucket, table
from .oracles import ORACLES


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    scored = quality_classifier.classify(table(spark, sf_dir, "documents"), labels, quality_classifier.learnable())
    held_out = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.allot(table(spark, sf_dir, "documents"))
    copies = F.col("epochs") + F.col("selected").cast("int")
    return plan.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", "n_known", F.array_join("licences", ",").alias("licences"), F.array_join("kinds", ",").alias("kinds"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    scored = toxicity.classify(table(spark, sf_dir, "documents"), labels, toxicity.learnable())
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    done = bpe.encode(table(spark, sf_dir, "documents"), path)
    return bpe_digest(done)


def bpe_digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(-7, k, role, "\\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(own, rows.schema))
    out = chat.read_back(chat.format_chats(chat.as_events(rows)))
    said = F.expr("array_join(transform(turns, x -> concat(x.role, '\n', x.text, '\n')), '')")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.audio(table(spark, sf_dir, "documents"))
    payload = F.expr(f"substring(media, {media.HEADER + 1})")
    return out.select(
        "doc_id",
        "n_bytes",
        F.expr(f"cast(octet_length(media) - {media.HEADER} as bigint)").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(media, -16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("n_frames").cast("string"), F.size("segments").cast("string"), F.substring(F.sha2("tensors", 256), 1, 16)).alias("feature"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    joined = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in secrets.BASE]
    digest = F.sha2(F.expr(joined.format(f"filter(spans, x -> x.kind IN ({base}))")), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept")


__all__ = ["ORACLES", "QUERIES"]
QUERIES = {f.__name__: f for f in (op1_quality, op2_mixing, op3_licenses, op4_toxicity, op5_bpe, op6_chat, op7_simhash, op8_media, op9_secrets, op10_quality_rules)}

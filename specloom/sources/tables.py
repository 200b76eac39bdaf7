"""Wide CSV tables, score tables, configuration catalogues and result files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..operators.guards import WaterParam
from ..operators.scoring import COLUMNS, rank_models, upsert_scores


class ConfigError(ValueError):
    """A configuration that is missing or malformed."""


def numbered_columns(columns: list[str], prefix: str) -> list[str]:
    """``prefix<int>`` columns in numeric order."""
    found = [(int(m[1]), c) for c in columns if (m := re.fullmatch(re.escape(prefix) + r"(\d+)", c))]
    return [c for _, c in sorted(found)]


def parse_labels(specs: list[str]) -> dict[str, str]:
    """``OUT=SRC`` or ``NAME`` to output and source names."""
    out = {}
    for s in specs:
        name, _, source = s.partition("=")
        if not name:
            raise ValueError(f"a label needs a name: {s!r}")
        out[name] = source or name
    return out


def read_wide_csv(spark: SparkSession, path: str, prefix: str = "wavelength_", start: float = 190.0, step: float = 1.0, day: str = "DAY_idx", labels: tuple[str, ...] = (), digested_prefix: str | None = None) -> tuple[DataFrame, list[float]]:
    """(sample_id, day_idx, x[, x_digested], labels..., axis) of a wide table."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    waves = numbered_columns(raw.columns, prefix)
    if not waves:
        raise ConfigError(f"no column {prefix}<n> in {path}")
    arrays = [F.array(*[F.col(f"`{c}`").cast("double") for c in waves]).alias("x")]
    if digested_prefix:
        arrays.append(F.array(*[F.col(f"`{c}`").cast("double") for c in numbered_columns(raw.columns, digested_prefix)]).alias("x_digested"))
    named = [F.col(f"`{src}`").cast("double").alias(out) for out, src in parse_labels(list(labels)).items()]
    # A stable id: the row's own content, and which of its repeats it is; rows of a file have no order of their own.
    content = F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns])
    key = F.xxhash64(content, F.row_number().over(Window.partitionBy(content).orderBy(content)))
    out = raw.select(key.alias("sample_id"), F.col(f"`{day}`").cast("int").alias("day_idx"), *arrays, *named)
    return out, [start + step * (int(c[len(prefix) :]) - 1) for c in waves]


def missing_counts(df: DataFrame) -> DataFrame:
    """One row: nulls and NaN of each column, cells for arrays."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        if kind.startswith("array"):
            cols.append(F.sum(F.size(F.filter(c, lambda v: v.isNull() | F.isnan(v)))).alias(f.name))
        else:
            bad = c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()
            cols.append(F.count_if(bad).alias(f.name))
    return df.agg(*cols)


def write_scores(scores: DataFrame, path: str, merge: bool = False) -> None:
    """The ranked score table as one CSV in column order; ``merge`` upserts by lower mape."""
    spark = scores.sparkSession
    body = [c for c in COLUMNS if c != "rank"]
    new = scores.select(*[F.col(f"`{c}`") if c in scores.columns else F.lit(None).cast("double").alias(c) for c in body])
    if merge:
        old = read_scores(spark, path).select(*[F.col(f"`{c}`") for c in body])
        # The old file is replaced, so its few rows are read before it is.
        new = spark.createDataFrame(upsert_scores(old, new).collect(), new.schema)
    ranked = rank_models(new).select(*[F.col(f"`{c}`") for c in COLUMNS])
    ranked.coalesce(1).sortWithinPartitions("rank", "model_type").write.mode("overwrite").csv(path, header=True)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType([StructField(c, StringType() if c == "model_type" else DoubleType()) for c in COLUMNS])
    return spark.read.schema(schema).csv(path, header=True)


def _yaml(path: str) -> dict:
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f) or {}
    except OSError as e:
        raise ConfigError(f"no configuration at {path}") from e


def load_params(path: str) -> dict[str, WaterParam]:
    """Water parameters of a YAML file, with or without a top level ``params``."""
    body = _yaml(path)
    known = set(WaterParam.__dataclass_fields__)
    return {k: WaterParam(name=k, **{a: tuple(map(float, b)) if a == "ranges" else b for a, b in v.items() if a in known and a != "name"}) for k, v in body.get("params", body).items()}


def load_chain(path: str) -> list[dict]:
    body = _yaml(path)
    chain = body.get("chain", body.get("steps")) if isinstance(body, dict) else body
    if not chain:
        raise ConfigError(f"an empty chain in {path}")
    return list(chain)


def load_instrument(path: str) -> dict:
    body = _yaml(path)
    body.setdefault("instrument_id", re.sub(r".*/|\.ya?ml$", "", path))
    return body


def params_table(spark: SparkSession, params: dict[str, WaterParam]) -> DataFrame:
    """The dimension table (param, ranges, bounds...)."""
    rows = [(p.name, list(map(float, p.ranges)), p.lower_bound, p.review_upper, float(p.abs_error_bound), float(p.mape_bound), p.unit, p.theoretical_upper()) for p in params.values()]
    return spark.createDataFrame([tuple(float(v) if isinstance(v, int) else v for v in r) for r in rows], "param string, ranges array<double>, lower_bound double, review_upper double, abs_error_bound double, mape_bound double, unit string, theoretical_upper double")


def result_json(df: DataFrame, id_col: str = "id", millis: float = 0.0) -> DataFrame:
    """(id, json): predictions of a file as one JSON object per id, items in the fixed field order."""
    fields = [c for c in ("id", "TN", "COD", "KMNO", "TUR", "TP", "AN") if c in df.columns]
    items = F.transform(F.array_sort(F.collect_list(F.struct("sample_id", F.struct(*fields).alias("item")))), lambda v: v["item"])
    out = df.groupBy(F.col(id_col).alias("file_id")).agg(items.alias("item"))
    body = F.struct(F.col("file_id").alias("id"), "item", F.lit(float(millis)).alias("time(ms)"))
    return out.select("file_id", F.to_json(body).alias("json"))

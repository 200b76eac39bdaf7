"""ARFF files as tables of spectra.

Lines come from Spark's text reader, so large files split and any store works,
and are parsed where they are read; wavelength columns are found by name on the
driver, from the header alone.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

_NUMBER = re.compile(r"^\s*(?:(?:wavelength|wl|nm|abs|a)[\s_]*)?(\d+(?:\.\d+)?)\s*(?:nm)?\s*$", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""^@attribute\s+('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\S+)\s+(.+?)\s*$""", re.IGNORECASE)


def wavelength(name: str) -> float | None:
    """The wavelength that a column name stands for: ``205``, ``200.5nm``, ``wavelength_200.5``."""
    m = _NUMBER.match(name)
    return float(m[1]) if m else None


def header(lines: Iterator[str]) -> list[tuple[str, bool]]:
    """(name, numeric) of each attribute, up to @data."""
    out = []
    for line in lines:
        if line.strip().lower().startswith("@data"):
            break
        if m := _ATTRIBUTE.match(line.strip()):
            name = m[1][1:-1].replace("\\'", "'") if m[1][0] in "'\"" else m[1]
            out.append((name, m[2].split()[0].lower() in ("numeric", "real", "integer")))
    return out


def values(line: str, numeric: list[bool]) -> tuple | None:
    """One data line; ``?`` is null; comments and blank lines give none."""
    line = line.strip()
    if not line or line.startswith("%"):
        return None
    cells = next(csv.reader(io.StringIO(line), quotechar="'", escapechar="\\", skipinitialspace=True))
    return tuple(None if c.strip() == "?" else (float(c) if n else c.strip()) for c, n in zip(cells, numeric))


def read_arff(spark: SparkSession, path: str, instrument_id: str | None = None, timestamp_col: str | None = None) -> tuple[DataFrame, list[float]]:
    """(table with meta columns and x, axis), wavelengths sorted.

    The text is read by Spark's own reader, so any store it reads will do; only
    the header lines come to the driver.
    """
    lines = spark.read.text(path)
    at = [r.value for r in lines.where(F.lower(F.ltrim("value")).startswith("@attribute")).collect()]
    attributes = header(iter(at))
    names, numeric = [n for n, _ in attributes], [k for _, k in attributes]
    schema = StructType([StructField(n, DoubleType() if k else StringType()) for n, k in attributes])
    data = lines.where(~F.ltrim("value").startswith("@"))

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [v for v in (values(x, numeric) for x in b["value"]) if v]
            yield pd.DataFrame(rows, columns=names)

    table = data.mapInPandas(run, schema)
    waves = sorted((w, n) for n, k in attributes if k and (w := wavelength(n)) is not None)
    meta = [F.col(f"`{n}`") for n in names if n not in {n for _, n in waves}]
    if timestamp_col:
        meta = [F.try_to_timestamp(F.col(f"`{timestamp_col}`")).alias(timestamp_col) if n == timestamp_col else F.col(f"`{n}`") for n in names if n not in {n for _, n in waves}]
    out = table.select(*meta, F.array(*[F.col(f"`{n}`") for _, n in waves]).alias("x"))
    if instrument_id is not None:
        out = out.withColumn("instrument_id", F.lit(instrument_id))
    return out, [w for w, _ in waves]


def read_positional(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, x): first column an integer id, last column ignored."""
    lines = spark.read.text(path).where(~F.ltrim("value").startswith("@") & (F.trim("value") != "") & ~F.ltrim("value").startswith("%"))
    cells = F.split("value", r"\s*,\s*")
    return lines.select(F.try_element_at(cells, F.lit(1)).cast("double").cast("long").alias("sample_id"), F.transform(F.slice(cells, 2, F.size(cells) - 2), lambda v: F.when(v != "?", v.cast("double"))).alias("x"))

"""File sources and sinks over any Hadoop file system: JSON lines, CSV, binary documents, once-only and per-partition writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions.text import csv_safe


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def read_reviews(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV with a header line (and a byte-order mark, which Spark's reader drops)."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def write_safe_csv(df: DataFrame, path: str) -> None:
    """CSV whose text cells cannot start a formula."""
    safe = [csv_safe(F.col(f"`{c}`")).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes]
    df.select(*safe).write.option("header", True).option("escape", '"').csv(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, content, digest, extension`` of files, for parsers that take bytes."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", "length", "content", F.sha2("content", 256).alias("digest"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"))


def round_trip(df: DataFrame, kind: str, path: str) -> DataFrame:
    """Write as ``json`` or ``csv`` and read back with the same schema."""
    if kind == "json":
        df.write.json(path)
        return read_json(df.sparkSession, path, df.schema)
    write_safe_csv(df, path)
    return read_reviews(df.sparkSession, path, df.schema)


def exclusive(df: DataFrame, path: str) -> DataFrame:
    """Write once: an existing folder is an error, ``_SUCCESS`` comes last."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def replace_partitions(df: DataFrame, key: str, path: str) -> DataFrame:
    """Write by ``key``; later writes replace only the keys that they hold."""
    for part in (df, df.where(F.col(key) == 1)):
        part.write.partitionBy(key).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)

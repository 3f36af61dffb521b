"""Record files: strict JSON lines, JSON objects, CSV, atomic reports, traces."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.documents import single_object


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; blank lines are skipped. A line that isn't one JSON object is an error when it is read: a plain
    JSON reader would take a top-level array for several rows."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$"))
    text = F.trim("value")
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    guard = F.when(text.startswith("{") & text.endswith("}"), parsed).otherwise(F.raise_error(F.concat(F.lit("no JSON object: "), F.substring("value", 1, 80))))
    return lines.select(guard.alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Compact lines that keep null fields."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def append_trace(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, mode="append")


def read_json_object(spark: SparkSession, path: str) -> dict:
    """A small configuration or manifest, through Spark's file systems; keys must not repeat."""
    return single_object(spark.read.text(path, wholetext=True).first()[0])


def write_object(spark: SparkSession, value: dict, path: str) -> None:
    """An indented object, keys in order; Spark's committer moves it into place whole."""
    spark.createDataFrame([(json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of one row as an indented object."""
    write_object(df.sparkSession, json.loads(df.toJSON().first()), path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, all texts; a byte order mark is dropped and the columns are required."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def write_csv(df: DataFrame, path: str) -> None:
    if df.isEmpty():
        raise ValueError("no rows to write")
    df.write.mode("overwrite").option("header", True).csv(path)


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to do after an interrupted run."""
    return df.join(done.select(key), key, "left_anti")

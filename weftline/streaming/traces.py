"""Appending traces as they come: a file stream into JSON lines, with a checkpoint that keeps reruns from repeating rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def follow(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def append(stream: DataFrame, out: str, checkpoint: str):
    """Writes what has come so far and ends; called again it writes only what is new."""
    lines = stream.select(F.to_json(F.struct(*stream.columns), {"ignoreNullFields": "false"}).alias("value"))
    return lines.writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

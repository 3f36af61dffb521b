"""Sharding: a Feistel permutation with cycle walking over global row numbers gives each row its shard and slot."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

SHARDS, ROUNDS = 16, 4
#: Multipliers and summands of the rounds; any odd multipliers under 2^31 give a permutation.
KEYS = ((1540483477, 374761393), (668265263, 2246822519), (1274126177, 3266489917), (2024237689, 1442695041))


def widths(rows: int) -> tuple[int, int]:
    """Bits of the left and right half of the least power of two that holds the row numbers, 2 bits at least."""
    bits = max(2, (rows - 1).bit_length())
    return bits // 2, bits - bits // 2


def feistel(x: np.ndarray, left: int, right: int, keys=KEYS) -> np.ndarray:
    """A permutation of [0, 2^(left + right)): unbalanced rounds that add a function of one half to the other."""
    lo, hi = x & ((1 << right) - 1), x >> right
    for i, (a, b) in enumerate(keys):
        if i % 2:
            lo = (lo + (((hi * a + b) >> 7) ^ (hi * 3))) & ((1 << right) - 1)
        else:
            hi = (hi + (((lo * a + b) >> 7) ^ (lo * 3))) & ((1 << left) - 1)
    return (hi << right) | lo


def permuted(x: np.ndarray, rows: int, keys=KEYS) -> np.ndarray:
    """A permutation of [0, rows): walks the cycle of feistel until it comes back under rows. The domain is under 2 * rows (4 at least), so two steps are the mean."""
    left, right = widths(rows)
    out = feistel(x.astype(np.int64), left, right, keys)
    while (far := out >= rows).any():
        out[far] = feistel(out[far], left, right, keys)
    return out


def row_numbers(df: DataFrame, order: list, name: str = "row_number") -> tuple[DataFrame, int]:
    """df with dense numbers from 0 in the given order, and the number of rows.

    Rows are dealt by range and written; the counts of the ranges (one row each) give each range its first
    number. Only rows that are equal in the whole order may swap numbers; they spread over ranges as well.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*order, F.col("__wl_row")]
    df = df.withColumn("__wl_row", F.monotonically_increasing_id())
    dealt = written(df.repartitionByRange(parts, *order).withColumn("__wl_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__wl_part").agg(F.count("*").alias("__wl_n"))
    first = counts.withColumn("__wl_first", F.sum("__wl_n").over(Window.orderBy("__wl_part").rowsBetween(Window.unboundedPreceding, -1)))  # a row per range
    first = F.broadcast(first.select("__wl_part", F.coalesce("__wl_first", F.lit(0)).alias("__wl_first")))  # as many rows as shuffle partitions
    number = F.row_number().over(Window.partitionBy("__wl_part").orderBy(*order)) - 1
    return dealt.withColumn(name, number).join(first, "__wl_part").withColumn(name, F.col(name) + F.col("__wl_first")).drop("__wl_part", "__wl_first", "__wl_row"), dealt.count()


def shard_rows(docs: DataFrame, *, shards: int = SHARDS, keys=KEYS) -> DataFrame:
    """Deals documents into shards that differ by one row at most, in an order that only the row numbers decide.

    docs: doc_id, text of any length, others are ignored. Rows are numbered by doc_id (null first), then by size and checksum of the text;
    the number's image p under the permutation gives shard p mod shards and slot p div shards, so anyone
    who knows the number of rows can compute both from a row number. Null text: size 1, checksum 0, as an
    empty text. Repeated rows are different rows. An empty table gives an empty table.
    """
    slim = docs.select("doc_id", (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
    numbered, rows = row_numbers(slim, [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")])

    @F.pandas_udf("long")
    def image(x: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(np.int64), rows, keys))

    place = numbered.withColumn("place", image(F.col("row_number").cast("long")))
    return place.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))

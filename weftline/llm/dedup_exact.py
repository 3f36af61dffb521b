"""Exact dedup: a two-pass Bloom filter finds hashes that may repeat; only rows with those are shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import bloom
from .common import SPACE, table, text_or_empty, written

#: Filter bits a row, bits that a row sets, and the most bytes of a filter on one machine (beyond: slices). With two bits a
#: row, building moves 4 bytes a row between tasks, and 0.7 % of unique rows are taken for repeated.
BITS_PER_ROW, HASHES, MAX_BYTES = 24, 2, 128 << 20
#: A group with more than 1 / HOT_SHARE of all rows is hot; so there are fewer than HOT_SHARE hot groups.
HOT_SHARE = 1000


def normalised(column: str = "text"):
    """The text without white space; null counts as empty."""
    return F.regexp_replace(text_or_empty(column), SPACE, "")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with text_sha256 of the normalised text, n_points (code points of the original) and the 64-bit hash h of the digest."""
    return docs.withColumns({"text_sha256": F.sha2(normalised().cast("binary"), 256), "n_points": F.length(text_or_empty()).cast("long")}).withColumn("h", F.xxhash64("text_sha256"))


def tester(held, hashes: int):
    """A predicate over hashes that a broadcast filter holds all bits of."""

    @F.pandas_udf(BooleanType())
    def test(h):
        import numpy as np
        import pandas as pd

        return pd.Series(bloom.holds(held.value, h.to_numpy(np.int64).view(np.uint64), hashes))

    return test


def maybe_repeated(slim: DataFrame, rows: int, *, bits_per_row: int = BITS_PER_ROW, hashes: int = HASHES, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows of slim that surely share their hash h with no other row, the other rows).

    Two passes: the first sets bits, the second tests rows for bits that two rows have set. Beyond max_bytes of filter
    the rows are written by slice of the hash space, and each slice has both passes of its own over its own rows, so that
    the work stays linear and one filter at a time is held; of slices the outcome is written before the next.
    """
    spark = slim.sparkSession
    bits, slices = bloom.plan(rows, bits_per_row, max_bytes)
    if slices > 1:
        slim = written(slim.withColumn("__wl_slice", bloom.slice_of(F.col("h"), slices).cast("long")), "digests-by-slice", by="__wl_slice")
    alone, some = [], []
    for i in range(slices):
        mine = slim.where(F.col("__wl_slice") == i).drop("__wl_slice") if slices > 1 else slim
        held = spark.sparkContext.broadcast(bloom.build(mine, "h", bits=bits, hashes=hashes, repeated=True))
        flagged = mine.withColumn("__wl_maybe", tester(held, hashes)("h"))
        if slices > 1:
            flagged = written(flagged, "flagged")
            held.destroy()
        alone.append(flagged.where("not __wl_maybe").drop("__wl_maybe"))
        some.append(flagged.where("__wl_maybe").drop("__wl_maybe"))
    return reduce(DataFrame.unionByName, alone), reduce(DataFrame.unionByName, some)


def met(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined with the groups of their keys. Hot groups, of over 1 / HOT_SHARE of total rows, so fewer than HOT_SHARE of
    them, are broadcast; the rest is shuffled, so no task gets more than 1 / HOT_SHARE of all rows of one key."""
    hot, cold = groups.where(F.col(size) * HOT_SHARE > total), groups.where(F.col(size) * HOT_SHARE <= total)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def exact_dedup(docs: DataFrame, **bloom_options) -> DataFrame:
    """Groups of texts that are equal without white space; one row of each group stays.

    docs: doc_id, text and any others (ignored). Returns a row for each row: doc_id, keep_id, group_size,
    kept, text_sha256, n_points. The row with the most code points stays, then the one with the smallest
    doc_id (null last), then any one of rows that are equal in both. Null text counts as empty, and empty
    texts are equal to each other. An empty table gives an empty table.

    Plan: texts are read once and whole, however long, for a table of digests. Of that table only rows that the filter
    lets through are shuffled, after map-side aggregation, and meet their groups by met().
    """
    slim = written(keyed(docs.select("doc_id", "text")).select("doc_id", "text_sha256", "n_points", "h").withColumn("row", F.monotonically_increasing_id()), "digests")
    rows = slim.count()
    single, some = maybe_repeated(slim, rows, **bloom_options)
    alone = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "n_points")
    some = written(some.drop("h"), "maybe-repeated")
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))).alias("best")
    groups = some.groupBy("text_sha256").agg(best, F.count("*").alias("group_size")).select("text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    groups = written(groups, "groups")
    found = met(some, groups, ["text_sha256"], "group_size", rows)
    return alone.unionByName(found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "n_points"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that exact_dedup keeps, with all their columns.

    A Bloom filter of the dropped rows' digests lets all other rows pass straight through; the rest meet the
    dropped rows by document, digest and length, keys that are not hot. Of rows equal in all three one stays.
    """
    found = written(exact_dedup(docs), "exact-dedup")
    key = ["doc_id", "text_sha256", "n_points"]
    named = lambda df: df.select(*(F.col(c).alias(f"__wl_k_{c}") for c in key)).distinct()
    same = lambda l, r: [l[f"__wl_{c}"].eqNullSafe(r[f"__wl_k_{c}"]) for c in key]
    dropped, kept = named(found.where("not kept")), named(found.where("kept and group_size > 1"))
    both = [dropped[c].eqNullSafe(kept[c]) for c in dropped.columns]
    gone = written(dropped.join(kept, both, "left_anti"), "dropped")
    twins = written(dropped.join(kept, both, "left_semi"), "twins")  # rows repeated in full: one of them stays
    marks = found.where("kept and group_size > 1").select(F.xxhash64("text_sha256").alias("h"))  # a row for each group
    rows = docs.withColumns({"__wl_doc_id": F.col("doc_id"), "__wl_text_sha256": F.sha2(normalised().cast("binary"), 256), "__wl_n_points": F.length(text_or_empty()).cast("long")})
    out, again = split_by(rows, F.xxhash64("__wl_text_sha256"), marks)
    again = again.join(gone, same(again, gone), "left_anti")
    if not twins.isEmpty():
        one = again.join(twins, same(again, twins), "left_semi").dropDuplicates([f"__wl_{c}" for c in key])
        again = again.join(twins, same(again, twins), "left_anti").unionByName(one)
    return out.unionByName(again).select(*docs.columns)


def split_by(rows: DataFrame, h: Column, marks: DataFrame, *, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash is surely not in marks.h, the other rows), without a shuffle.

    The filter has BITS_PER_ROW bits for each mark; beyond max_bytes it is cut into slices of the hash space, each held by a
    filter of its own, and rows pass them one after the other, written between passes.
    """
    spark, hashes = rows.sparkSession, 6
    bits, slices = bloom.plan(marks.count(), BITS_PER_ROW, max_bytes)
    rows = rows.withColumns({"__wl_h": h, "__wl_maybe": F.lit(False)})
    for i in range(slices):
        held = spark.sparkContext.broadcast(bloom.build(marks, "h", bits=bits, hashes=hashes, repeated=False, slices=slices, slice_no=i))
        mine = tester(held, hashes)("__wl_h") & (bloom.slice_of(F.col("__wl_h"), slices) == i)
        rows = rows.withColumn("__wl_maybe", F.col("__wl_maybe") | mine)
        if slices > 1:
            rows = written(rows, "bloom-pass")
            held.destroy()
    return rows.where("not __wl_maybe").drop("__wl_h", "__wl_maybe"), rows.where("__wl_maybe").drop("__wl_h", "__wl_maybe")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_points")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body, length(coalesce(text, '')) AS points FROM documents),
k AS (SELECT doc_id, sha256(body) AS text_sha256, points FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM k WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ASC NULLS LAST)
"""

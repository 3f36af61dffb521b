"""Queries of the earlier benchmark builder: two negatives a kit, over the items of all splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import legacy
from ..sources.staging import staged
from . import domain as d
from .documents import _swap
from .domain import query

TWO = 2


def _kits(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, sf, "legacy-kits", lambda: legacy.picked(d.items(spark, sf), per_outfit=TWO))


def _negatives(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, sf, "legacy-negatives", lambda: legacy.negatives(d.items(spark, sf), _kits(spark, sf)))


def _turn(number: int, taken: str) -> str:
    return f"SELECT * FROM (SELECT spots.*, {number} AS number, {taken} AS turn, row_number() OVER (PARTITION BY spots.kit_id ORDER BY sha256('42|' || spots.kit_id || '|' || spots.item_id || '|{number}'), spots.pos) AS r FROM spots{' LEFT JOIN one USING (kit_id)' if number > 1 else ''} WHERE pool_size - own > {taken}) WHERE r = 1"


SPOTS = f"""whole AS (SELECT kit_id FROM items GROUP BY 1 HAVING count(*) >= 2), everyone AS (SELECT item_id, kit_id, master, row_number() OVER (PARTITION BY master ORDER BY substr(sha256(item_id), 1, 2), item_id) - 1 AS pool_index, count(*) OVER (PARTITION BY master) AS pool_size FROM items),
  spots AS (SELECT i.kit_id, i.item_id, i.master, e.pool_size, count(*) OVER (PARTITION BY i.kit_id, i.master) AS own, row_number() OVER (PARTITION BY i.kit_id ORDER BY i.slot NULLS LAST, i.item_id) - 1 AS pos FROM items i JOIN everyone e USING (item_id) JOIN whole ON whole.kit_id = i.kit_id),
  one AS ({_turn(1, '0').replace('spots.*', 'spots.kit_id, spots.pos AS pos_one')}), picks AS (SELECT * EXCLUDE (r) FROM ({_turn(1, '0')}) UNION ALL SELECT * EXCLUDE (r) FROM ({_turn(2, 'CASE WHEN pos = pos_one THEN 1 ELSE 0 END')}))"""
MADE = f"""{SPOTS}, steps AS (SELECT *, unnest(range(0, own + turn + 1)) AS step, ('0x' || substr(sha256('42|start|' || kit_id || '|' || item_id), 1, 8))::BIGINT % pool_size AS start FROM picks),
  made AS (SELECT * FROM (SELECT s.*, e.item_id AS replacement, e.kit_id AS replacement_kit, row_number() OVER (PARTITION BY s.kit_id, number ORDER BY step) AS c FROM steps s JOIN everyone e ON e.master = s.master AND e.pool_index = (s.start + s.step) % s.pool_size WHERE e.kit_id <> s.kit_id) WHERE c = turn + 1)"""


@query("legacy_negatives", f"SELECT * FROM (WITH {MADE} SELECT kit_id || '_neg_' || number AS sample_id, kit_id AS source_kit_id, 'same_category_different_kit' AS negative_type, pos::INTEGER AS swapped_item_index, item_id AS original_item_id, replacement AS replacement_item_id, master AS swap_category, replacement_kit AS replacement_kit_id FROM made)", "items")
def legacy_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return _negatives(spark, sf).select("sample_id", "source_kit_id", "negative_metadata.*")


@query("legacy_counters", f"""SELECT * FROM (WITH {SPOTS}, sized AS (SELECT kits.kit_id, count(i.item_id) AS n FROM kits LEFT JOIN items i USING (kit_id) GROUP BY 1), k AS (SELECT sized.kit_id, n, coalesce(made, 0) AS made, coalesce(can, FALSE) AS can FROM sized LEFT JOIN (SELECT kit_id, count(*) AS made FROM picks GROUP BY 1) USING (kit_id) LEFT JOIN (SELECT kit_id, bool_or(pool_size > own) AS can FROM spots GROUP BY 1) USING (kit_id))
  SELECT count(*) AS kits_processed, count(*) FILTER (n >= 2) AS kits_with_items, count(*) FILTER (n = 0) AS kits_without_items, count(*) FILTER (n = 1) AS kits_too_small, count(*) FILTER (n >= 2) AS positive_samples, sum(made)::BIGINT AS negative_samples, 2 * count(*) FILTER (n >= 2) AS negative_attempts,
    coalesce(sum(2 - made) FILTER (n >= 2 AND NOT can), 0)::BIGINT AS failed_no_valid_candidate, coalesce(sum(2 - made) FILTER (n >= 2 AND can), 0)::BIGINT AS failed_duplicate_pair, count(*) FILTER (made = 2) AS negative_generation_complete FROM k)""", "items", "kits")
def legacy_counters(spark: SparkSession, sf: str) -> DataFrame:
    return legacy.counters(d.kits(spark, sf).select("kit_id"), d.items(spark, sf), _kits(spark, sf), per_outfit=TWO)


FAULTS = ("invalid_source_kit_id", "items_empty", "invalid_item_id", "invalid_label", "positive_sample_id_suffix", "negative_without_metadata", "negative_metadata_missing_field", "unsupported_negative_type", "swapped_item_index_out_of_range", "replacement_not_at_index", "item_without_category", "replacement_of_same_kit", "original_category_mismatch", "original_not_in_outfit")


@query("legacy_issues", f"""SELECT * FROM (WITH {MADE} SELECT code, count(*) AS n FROM (SELECT {list(FAULTS)}[kit_id::BIGINT % 40] AS code FROM made WHERE number = 1 AND kit_id::BIGINT % 40 BETWEEN 1 AND {len(FAULTS)}
  UNION ALL SELECT 'duplicate_sample_id' FROM made WHERE number = 1 AND kit_id::BIGINT % 40 = 20 UNION ALL SELECT 'positive_with_negative_metadata' FROM made WHERE number = 1 AND kit_id::BIGINT % 40 = 21) GROUP BY code)""", "items")
def legacy_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The builder's records, one fault in the first negative of a kit for each of a few residues of its number; one comes twice."""
    made = _negatives(spark, sf)
    first = F.col("sample_id").endswith("_neg_1")
    x = made.withColumn("r", F.when(first, F.col("source_kit_id").cast("long") % 40).otherwise(0))
    m, ids = F.col("negative_metadata"), F.col("items")
    at = m["swapped_item_index"]
    put = lambda field, v: m.withField(field, v)
    odd = lambda name: F.transform(ids, lambda i, k: F.when(k == at, F.lit(name)).otherwise(i))
    next_id = F.get(ids, (at + 1) % F.size(ids))
    x = x.withColumn("_id", F.when(F.col("r") == 5, F.concat("source_kit_id", F.lit("_neg"))).otherwise(F.col("sample_id")))
    y = _swap(x, "items", {2: F.slice(ids, 1, 0), 3: odd(""), 10: odd("none"), 11: F.concat(ids, F.array(F.lit("none")))})
    y = _swap(y, "negative_metadata", {5: F.lit(None), 6: F.lit(None), 7: put("swap_category", F.lit(None).cast("string")), 8: put("negative_type", F.lit("other")), 9: put("swapped_item_index", F.size(ids)), 12: put("replacement_kit_id", F.col("source_kit_id")), 13: put("original_item_id", F.lit("none")), 14: put("original_item_id", m["replacement_item_id"])})
    y = _swap(_swap(y, "label", {4: F.lit(2), 5: F.lit(1), 21: F.lit(1)}), "source_kit_id", {1: F.lit(" ")})
    y = y.select(F.col("_id").alias("sample_id"), "source_kit_id", "items", "label", "negative_metadata")
    twice = made.where(first & (F.col("source_kit_id").cast("long") % 40 == 20))
    every = legacy.positives(_kits(spark, sf)).unionByName(y).unionByName(twice)
    return legacy.record_issues(every, d.items(spark, sf)).groupBy("code").agg(F.count("*").alias("n"))

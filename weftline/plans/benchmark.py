"""Queries of the benchmark stages: clean, map, validate, sample, pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import kit_of, slot_of, strip
from ..operators import clean, expect, negatives
from . import domain as d
from .domain import query


def _order():
    return [F.col(c) for c in d.ORDER]


@query("parse_item_ids", """SELECT trim(item_id) AS item_id, CASE WHEN contains(trim(item_id), '_') THEN regexp_extract(trim(item_id), '^(.*)_[^_]*$', 1) ELSE trim(item_id) END AS kit_id,
  try_cast(nullif(regexp_extract(trim(item_id), '_([^_]*)$', 1), '') AS INTEGER) AS slot, count(*) AS n FROM raw GROUP BY ALL""", "raw")
def parse_item_ids(spark: SparkSession, sf: str) -> DataFrame:
    i = strip(F.col("item_id"))
    return d.raw_items(spark, sf).select(i.alias("item_id"), kit_of(i).alias("kit_id"), slot_of(i).alias("slot")).groupBy("item_id", "kit_id", "slot").agg(F.count("*").alias("n"))


@query("item_counters", """SELECT count(*) AS n_rows, count(*) FILTER (state = 'missing') AS n_missing, count(*) FILTER (state = 'duplicate') AS n_duplicate, count(*) FILTER (state = 'malformed') AS n_malformed,
  count(*) FILTER (state = 'kept') AS n_kept, count(*) FILTER (state = 'kept' AND try_cast(regexp_extract(item_id, '_([^_]*)$', 1) AS INTEGER) IS NULL) AS n_null_slot FROM audited""", "audited")
def item_counters(spark: SparkSession, sf: str) -> DataFrame:
    return clean.item_counters(d.raw_items(spark, sf), _order())


@query("clean_items", "SELECT * FROM items", "items")
def clean_items(spark: SparkSession, sf: str) -> DataFrame:
    return d.items(spark, sf)


@query("mapping_v2", """SELECT master, CASE master WHEN 'Brand#25' THEN 'HAT' WHEN 'Brand#24' THEN 'BAG' ELSE coarse END AS coarse, count(*) OVER (PARTITION BY CASE master WHEN 'Brand#25' THEN 'HAT' WHEN 'Brand#24' THEN 'BAG' ELSE coarse END) AS n_in_class FROM mapping""", "mapping")
def mapping_v2(spark: SparkSession, sf: str) -> DataFrame:
    m = clean.resolved_mapping(d.base_mapping(spark), d.overrides(spark))
    return m.join(m.groupBy("coarse").agg(F.count("*").alias("n_in_class")), "coarse").select("master", "coarse", "n_in_class")


@query("mapping_coverage", "SELECT DISTINCT master, 'unmapped' AS issue FROM items WHERE master NOT IN (SELECT master FROM mapping) UNION ALL SELECT master, 'unused' FROM mapping WHERE master NOT IN (SELECT master FROM items)", "items", "mapping")
def mapping_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return clean.mapping_coverage(d.items(spark, sf), d.base_mapping(spark))


@query("category_report", """SELECT coarse, n_before, CASE WHEN coarse = 'DROP' THEN 0 ELSE n_before END AS n_after, round(CASE WHEN coarse = 'DROP' THEN 0 ELSE n_before END / sum(n_before) OVER ()::DOUBLE, 9) AS share_kept
  FROM (SELECT coarse, count(*) AS n_before FROM items JOIN mapping USING (master) GROUP BY coarse)""", "items", "mapping")
def category_report(spark: SparkSession, sf: str) -> DataFrame:
    return clean.category_report(d.items(spark, sf), d.base_mapping(spark)).withColumn("share_kept", F.round("share_kept", 9))


@query("core_items", "SELECT * FROM core", "core")
def core_items(spark: SparkSession, sf: str) -> DataFrame:
    return d.core(spark, sf)


@query("kit_report", """SELECT count(*) AS n_kits, count(*) FILTER (coalesce(r.n, 0) = 0) AS n_without_items, count(*) FILTER (coalesce(r.n, 0) > 0 AND coalesce(c.n, 0) < 3) AS n_too_short, count(*) FILTER (coalesce(c.n, 0) >= 3) AS n_kept,
  round(count(*) FILTER (coalesce(c.n, 0) >= 3) / count(*)::DOUBLE, 9) AS keep_rate FROM kits LEFT JOIN (SELECT kit_id, count(*) AS n FROM items GROUP BY 1) r USING (kit_id) LEFT JOIN (SELECT kit_id, count(*) AS n FROM core GROUP BY 1) c USING (kit_id)""", "kits", "items", "core")
def kit_report(spark: SparkSession, sf: str) -> DataFrame:
    return clean.kit_report(d.kits(spark, sf), d.items(spark, sf), d.core(spark, sf)).withColumn("keep_rate", F.round("keep_rate", 9))


@query("clean_positives", "SELECT split, kit_id, n_items, array_to_string(ids, ',') AS items FROM samples", "samples")
def clean_positives(spark: SparkSession, sf: str) -> DataFrame:
    return d.samples(spark, sf).select("split", "kit_id", "n_items", F.array_join("items.item_id", ",").alias("items"))


@query("outfit_lengths", "SELECT n_items, count(*) AS n_outfits FROM (SELECT count(*) AS n_items FROM core GROUP BY kit_id) WHERE n_items >= 3 GROUP BY 1", "core")
def outfit_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return clean.length_histogram(clean.outfits(d.core(spark, sf)))


@query("debug_kits", "SELECT kit_id, split FROM kits ORDER BY kit_id LIMIT 100", "kits")
def debug_kits(spark: SparkSession, sf: str) -> DataFrame:
    """The head-limit is the feature: the first hundred kits in order."""
    return d.kits(spark, sf).select("kit_id", "split").orderBy("kit_id").limit(100)


@query("item_metadata", "SELECT *, 'core7-item-metadata-v1' AS item_metadata_version, 'core7-v2' AS category_mapping_version FROM meta", "meta")
def item_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return d.metadata(spark, sf)


def _partial(spark: SparkSession, sf: str) -> DataFrame:
    """Item rows as two sources state them: blanks, later values that override, classes that disagree."""
    li = d.table(spark, sf, "lineitem").select("l_partkey", "l_linenumber", "l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    df = li.join(d.table(spark, sf, "part").select("p_partkey", "p_brand"), li["l_partkey"] == F.col("p_partkey"))
    pos = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_suppkey") * 50 + F.col("l_quantity").cast("long")
    coarse = F.when(F.col("l_partkey") % 10 == 3, F.col("l_returnflag")).otherwise(F.lit("TOP"))
    return df.select(F.col("l_partkey").cast("string").alias("item_id"), F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(F.col("p_brand")).alias("master"), F.when(F.col("l_linenumber") == 1, None).otherwise(coarse).alias("coarse"), F.when(F.col("l_linenumber") == 3, F.concat(F.lit("img/"), F.col("p_brand"))).alias("image"), pos.alias("pos"))


@query("metadata_index", """SELECT item_id, max_by(master, pos) FILTER (trim(master) <> '') AS master, max_by(image, pos) FILTER (trim(image) <> '') AS image, count(DISTINCT coarse) FILTER (trim(coarse) <> '') > 1 AS conflict, count(*) AS n_rows
  FROM (SELECT l_partkey::VARCHAR AS item_id, CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE p_brand END AS master, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_partkey % 10 = 3 THEN l_returnflag ELSE 'TOP' END AS coarse,
    CASE WHEN l_linenumber = 3 THEN 'img/' || p_brand END AS image, (l_orderkey * 8 + l_linenumber) * 100000 + l_suppkey * 50 + l_quantity::BIGINT AS pos FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY item_id""")
def metadata_index(spark: SparkSession, sf: str) -> DataFrame:
    return clean.merged_metadata(_partial(spark, sf), "pos").drop("coarse")


@query("category_pools", "SELECT split, master, item_id, pool_index, pool_size FROM pool", "pool")
def category_pools(spark: SparkSession, sf: str) -> DataFrame:
    return clean.pools(d.metadata(spark, sf), ["split", "master"]).select("split", "master", "item_id", "pool_index", "pool_size")


def _usable(spark: SparkSession, sf: str) -> DataFrame:
    return d.item_vectors(spark, sf).where("vec_id % 7 <> 0").select("item_id")


USABLE = "(SELECT item_id FROM itemvec WHERE vec_id % 7 <> 0)"


@query("repair_split", f"SELECT split, kit_id, n_items AS n_before, count(*) AS n_items, string_agg(item_id, ',' ORDER BY pos) AS items FROM used WHERE item_id IN {USABLE} GROUP BY split, kit_id, used.n_items HAVING count(*) >= 3", "used", "itemvec")
def repair_split(spark: SparkSession, sf: str) -> DataFrame:
    return clean.repaired(d.samples(spark, sf), _usable(spark, sf)).withColumn("items", F.array_join("items", ","))


@query("split_coverage", f"""SELECT split, count(*) AS n_items, count(*) FILTER (item_id NOT IN (SELECT item_id FROM meta)) AS n_without_metadata, count(*) FILTER (item_id NOT IN {USABLE}) AS n_without_vector,
  round(count(*) FILTER (item_id IN {USABLE}) / count(*)::DOUBLE, 9) AS coverage FROM (SELECT DISTINCT split, item_id FROM used) GROUP BY split""", "used", "meta", "itemvec")
def split_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return expect.coverage(d.samples(spark, sf), d.metadata(spark, sf), _usable(spark, sf)).withColumn("coverage", F.round("coverage", 9))


def _positives(spark: SparkSession, sf: str) -> DataFrame:
    s = d.samples(spark, sf)
    none = F.lit(None).cast("string")
    return s.select("split", F.concat("kit_id", F.lit("_pos")).alias("sample_id"), F.col("kit_id").alias("source_kit_id"), none.alias("paired_positive_sample_id"), F.lit(1).alias("label"), F.col("items.item_id").alias("items"), none.alias("negative_metadata"))


def _faulty(df: DataFrame) -> DataFrame:
    """One fault for each of a few residues of the kit number."""
    kit = F.col("source_kit_id")
    r, first = kit.cast("long") % 50, F.get("items", F.lit(0))
    return df.select(
        F.when(r == 8, F.concat(kit, F.lit("_p"))).when(r == 9, "z_pos").otherwise(F.col("sample_id")).alias("sample_id"), F.when(r == 1, "").otherwise(kit).alias("source_kit_id"), F.when(r == 6, "x").alias("paired_positive_sample_id"),
        F.when(r == 2, 0).otherwise(F.col("label")).alias("label"), F.when(r == 7, "x").alias("negative_metadata"),
        F.when(r == 3, F.slice("items", 1, 2)).when(r == 4, F.concat("items", F.array(first))).when(r == 5, F.concat(F.array(F.lit("9_9")), "items")).otherwise(F.col("items")).alias("items"),
    )


@query("validate_positives", """SELECT code, count(*) AS n FROM (SELECT unnest(CASE r WHEN 1 THEN ['invalid_source_kit_id'] WHEN 2 THEN ['label_must_be_1'] WHEN 3 THEN ['outfit_below_min_items'] WHEN 4 THEN ['duplicate_item_in_outfit'] WHEN 5 THEN ['missing_category_item']
    WHEN 6 THEN ['paired_positive_sample_id_must_be_null'] WHEN 7 THEN ['negative_metadata_must_be_null'] WHEN 8 THEN ['invalid_sample_id', 'sample_id_source_kit_mismatch'] WHEN 9 THEN CASE WHEN place = 1 THEN ['sample_id_source_kit_mismatch'] ELSE ['sample_id_source_kit_mismatch', 'duplicate_sample_id'] END END) AS code
  FROM (SELECT kit_id::BIGINT % 50 AS r, row_number() OVER (PARTITION BY kit_id::BIGINT % 50) AS place FROM samples)) GROUP BY code""", "samples")
def validate_positives(spark: SparkSession, sf: str) -> DataFrame:
    found = expect.positive_issues(_faulty(_positives(spark, sf)), d.core(spark, sf))
    return found.groupBy("code").agg(F.count("*").alias("n"))


@query("validate_metadata", """SELECT code, count(*) AS n FROM (SELECT unnest(CASE slot % 40 WHEN 1 THEN ['item_metadata_version_mismatch'] WHEN 2 THEN ['invalid_coarse_category'] WHEN 3 THEN ['missing_from_metadata'] WHEN 4 THEN ['category_mapping_version_mismatch'] WHEN 5 THEN ['split_mismatch']
    WHEN 6 THEN ['invalid_source_kit_id'] WHEN 7 THEN ['invalid_master_category'] WHEN 8 THEN ['invalid_item_id', 'missing_from_metadata'] WHEN 9 THEN ['extra_in_metadata'] WHEN 10 THEN ['duplicate_item_id'] END) AS code FROM meta WHERE split = 'train') GROUP BY code""", "meta")
def validate_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """The metadata of one split with one fault for each of a few residues of the slot."""
    r = F.col("slot") % 40
    bad = lambda c, n, value: F.when(r == n, value).otherwise(F.col(c))
    m = d.metadata(spark, sf).where("split = 'train'")
    extra = m.where(r == 9).withColumn("item_id", F.concat(F.lit("x"), "item_id")).unionByName(m.where(r == 10))
    m = m.where(r != 3).withColumns({"item_metadata_version": bad("item_metadata_version", 1, "old"), "coarse": bad("coarse", 2, "SOCKS"), "category_mapping_version": bad("category_mapping_version", 4, "old"), "split": bad("split", 5, "valid"), "source_kit_id": bad("source_kit_id", 6, ""), "master": bad("master", 7, ""), "item_id": bad("item_id", 8, "")})
    found = expect.metadata_issues(m.unionByName(extra), _positives(spark, sf).where("split = 'train'"), split="train", version=d.META_VERSION, mapping_version=d.MAP_VERSION, classes=list(clean.CATEGORY_IDS))
    return found.groupBy("code").agg(F.count("*").alias("n"))


@query("load_issues", """SELECT code, count(*) AS n FROM (SELECT unnest(list_concat(CASE WHEN len(ids) > 8 THEN ['too_many_items'] ELSE [] END, CASE WHEN len(list_filter(ids, lambda x: x LIKE '%77')) > 0 THEN ['missing_vector_or_class'] ELSE [] END)) AS code FROM records) GROUP BY code""", "records")
def load_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Records that a scorer of eight items can't load: long ones, and those with an item that lacks its vector."""
    return expect.load_issues(d.records(spark, sf), d.core(spark, sf).where(~F.col("item_id").endswith("77"))).groupBy("code").agg(F.count("*").alias("n"))


@query("negatives", "SELECT split, kit_id, 1 AS negative_number, position::INTEGER AS position, original_item_id, replacement_item_id, replacement_kit_id, master, coarse FROM neg", "neg")
def made_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return d.made_negatives(spark, sf)


@query("negative_report", "SELECT split, count(*) AS n_samples, count(neg.kit_id) AS n_with_negative, count(*) - count(neg.kit_id) AS n_failed, round(count(neg.kit_id) / count(*)::DOUBLE, 9) AS coverage FROM samples LEFT JOIN neg USING (split, kit_id) GROUP BY split", "samples", "neg")
def negative_report(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.negative_report(d.samples(spark, sf), d.made_negatives(spark, sf)).withColumn("coverage", F.round("coverage", 9))


@query("negative_failures", """SELECT split, reason, count(*) AS n FROM (SELECT s.split, CASE WHEN s.kit_id::BIGINT % 50 = 1 THEN 'invalid_positive_shape' WHEN s.kit_id::BIGINT % 50 = 2 THEN 'input_is_not_positive' WHEN s.kit_id::BIGINT % 50 = 3 THEN 'positive_missing_metadata' WHEN neg.kit_id IS NULL THEN 'no_valid_same_master_category_candidate' END AS reason
  FROM samples s LEFT JOIN neg USING (split, kit_id)) WHERE reason IS NOT NULL GROUP BY ALL""", "samples", "neg")
def negative_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Positives without a negative, by reason; a few are broken on purpose."""
    p = _positives(spark, sf)
    r = F.col("source_kit_id").cast("long") % 50
    p = p.select("split", "sample_id", "source_kit_id", F.when(r == 2, 0).otherwise(F.col("label")).alias("label"), F.when(r == 1, F.slice("items", 1, 0)).when(r == 3, F.concat(F.array(F.lit("9_9")), "items")).otherwise(F.col("items")).alias("items"))
    return negatives.failures(p, d.metadata(spark, sf), d.made_negatives(spark, sf)).groupBy("split", "reason").agg(F.count("*").alias("n"))


@query("swap_histogram", "SELECT split, coarse, count(*) AS n_swaps FROM neg GROUP BY ALL", "neg")
def swap_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.swap_histogram(d.made_negatives(spark, sf))


@query("families", "SELECT split, sample_id, source_kit_id, pair_id, label, array_to_string(ids, ',') AS items, problem::INTEGER AS position FROM records", "records")
def families(spark: SparkSession, sf: str) -> DataFrame:
    return d.records(spark, sf).select("split", "sample_id", "source_kit_id", "pair_id", "label", F.array_join("items", ",").alias("items"), F.col("swap.position").alias("position"))


@query("family_items", "SELECT label, count(*) AS n_rows, count(DISTINCT item_id) AS n_items FROM (SELECT label, unnest(ids) AS item_id FROM records) GROUP BY label", "records")
def family_items(spark: SparkSession, sf: str) -> DataFrame:
    return d.records(spark, sf).select("label", F.explode("items").alias("item_id")).groupBy("label").agg(F.count("*").alias("n_rows"), F.count_distinct("item_id").alias("n_items"))


@query("metadata_from_negatives", "SELECT item_id, count(*) AS n FROM (SELECT unnest([original_item_id, replacement_item_id]) AS item_id FROM neg) GROUP BY 1", "neg")
def metadata_from_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Both items of each swap in rows of their own."""
    return d.made_negatives(spark, sf).select(F.explode(F.array("original_item_id", "replacement_item_id")).alias("item_id")).groupBy("item_id").agg(F.count("*").alias("n"))


def _typed(records: DataFrame) -> DataFrame:
    s = F.col("swap")
    return records.withColumn("swap", F.when(s.isNotNull(), F.struct(s["position"].alias("position"), s["original_item_id"].alias("original_item_id"), s["replacement_item_id"].alias("replacement_item_id"), s["replacement_kit_id"].alias("replacement_kit_id"), s["master"].alias("master"), s["coarse"].alias("coarse"), F.lit(expect.SWAP_TYPE).alias("kind"))))


@query("validate_pairs", "SELECT 0::BIGINT AS n_issues, 'READY' AS status")
def validate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return expect.gate(expect.pair_issues(_typed(d.records(spark, sf)), d.metadata(spark, sf)))


FAULTS = """CASE
    WHEN label = 0 AND r = 1 THEN ['negative_metadata_missing'] WHEN label = 0 AND r = 2 THEN ['wrong_negative_type'] WHEN label = 0 AND r = 3 THEN ['negative_missing_positive_pair'] WHEN label = 1 AND r = 3 THEN ['positive_pair_count_not_one']
    WHEN label = 0 AND r = 4 THEN ['swapped_index_mismatch'] WHEN label = 0 AND r = 5 THEN ['negative_sample_id_mismatch'] WHEN label = 1 AND r = 6 THEN ['positive_has_pair_reference'] WHEN label = 0 AND r = 7 THEN ['invalid_label'] WHEN label = 1 AND r = 7 THEN ['positive_pair_count_not_one']
    WHEN label = 0 AND r = 8 THEN ['swap_category_metadata_mismatch'] WHEN label = 0 AND r = 9 THEN ['negative_metadata_missing_fields'] WHEN label = 0 AND r = 10 THEN ['replacement_kit_metadata_mismatch']
    WHEN label = 1 AND r = 11 THEN ['positive_sample_id_mismatch', 'positive_pair_count_not_one'] WHEN label = 0 AND r = 11 THEN ['negative_missing_positive_pair'] WHEN label = 1 AND r = 12 THEN ['positive_has_negative_metadata']
    WHEN label = 0 AND r = 13 THEN ['missing_sample_fields'] WHEN label = 0 AND r = 14 THEN ['outfit_below_min_items'] WHEN label = 1 AND r IN (13, 14) THEN ['positive_pair_count_not_one'] WHEN label = 0 AND r = 15 THEN ['invalid_swapped_item_index']
    WHEN label = 0 AND r = 16 THEN ['original_item_mismatch'] WHEN label = 0 AND r = 17 THEN ['negative_sample_id_mismatch', 'pair_source_kit_mismatch'] WHEN label = 0 AND r = 18 THEN ['pair_length_mismatch'] WHEN label = 0 AND r = 19 THEN ['negative_not_exactly_one_swap']
    WHEN label = 0 AND r = 20 THEN list_concat(['replacement_item_mismatch', 'replacement_already_in_positive', 'replacement_kit_metadata_mismatch', 'replacement_from_same_kit'], CASE WHEN next_master <> original_master THEN ['replacement_master_category_mismatch'] ELSE [] END)
    WHEN label = 0 AND r = 21 THEN ['duplicate_item_inside_outfit', 'replacement_item_mismatch'] WHEN label = 0 AND r = 22 THEN ['missing_item_metadata', 'replacement_item_mismatch']
    WHEN label = 1 AND r = 23 THEN ['missing_item_metadata', 'positive_item_wrong_source_kit'] WHEN label = 0 AND r = 23 THEN CASE WHEN problem = 0 THEN ['original_item_mismatch'] ELSE ['negative_not_exactly_one_swap'] END
    WHEN label = 0 AND r = 24 THEN ['invalid_identity', 'negative_sample_id_mismatch', 'pair_source_kit_mismatch'] WHEN label = 1 AND r = 25 THEN ['duplicate_sample_id'] ELSE [] END"""


@query("validate_faulty_pairs", f"""SELECT code, count(*) AS n FROM (SELECT unnest({FAULTS}) AS code FROM (SELECT label, problem, source_kit_id::BIGINT % 60 AS r, o.master AS original_master, x.master AS next_master
  FROM records LEFT JOIN core o ON o.item_id = original_item_id LEFT JOIN core x ON x.item_id = ids[(problem + 1) % len(ids) + 1])) GROUP BY code""", "records", "core")
def validate_faulty_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The validator over records with one fault for each of a few residues of the kit number; all its 29 codes come up."""
    r, neg, n = F.col("source_kit_id").cast("long") % 60, F.col("label") == 0, F.size("items")
    df = _typed(d.records(spark, sf))
    part = lambda field, *faults: F.coalesce(*(F.when(neg & (r == k), value) for k, value in faults), F.when(~(neg & r.isin(*(k for k, value in faults))), F.col(f"swap.{field}"))).alias(field)
    at, own = F.col("swap.position"), F.get("items", (F.col("swap.position") + 1) % n)
    swap = F.struct(
        part("position", (4, (at + 1) % n), (15, F.lit(99))), part("original_item_id", (16, F.col("swap.replacement_item_id"))), part("replacement_item_id", (9, F.lit(None)), (20, own)), part("replacement_kit_id", (10, F.lit("0"))),
        part("master", (8, F.lit("none"))), F.col("swap.coarse").alias("coarse"), part("kind", (2, F.lit("other"))),
    )
    put = lambda value: F.transform("items", lambda x, i: F.when(i == at, value).otherwise(x))
    any_swap = F.struct(*(F.lit(v).cast(t).alias(k) for k, v, t in (("position", 0, "int"), ("original_item_id", "a", "string"), ("replacement_item_id", "b", "string"), ("replacement_kit_id", "c", "string"), ("master", "m", "string"), ("coarse", "k", "string"), ("kind", "x", "string"))))
    faulty = df.select(
        "split",
        F.when(neg & (r == 5), F.concat("sample_id", F.lit("x"))).when(~neg & (r == 11), F.concat("source_kit_id", F.lit("_q"))).otherwise(F.col("sample_id")).alias("sample_id"),
        F.when(neg & (r == 17), "zzz").when(neg & (r == 24), " ").otherwise(F.col("source_kit_id")).alias("source_kit_id"),
        F.when(neg & (r == 3), "none").when(~neg & (r == 6), "x").otherwise(F.col("pair_id")).alias("pair_id"), F.when(neg & (r == 7), 2).otherwise(F.col("label")).alias("label"),
        F.when(neg & (r == 13), None).when(neg & (r == 14), F.slice("items", 1, 2)).when(neg & (r == 18), F.concat("items", F.array("swap.original_item_id"))).when(neg & (r == 19), put(F.col("swap.original_item_id"))).when(neg & (r == 21), put(own)).when(neg & (r == 22), put(F.lit("none")))
        .when(~neg & (r == 23), F.transform("items", lambda x, i: F.when(i == 0, F.lit("x_1")).otherwise(x))).otherwise(F.col("items")).alias("items"),
        F.when(neg & (r != 1), swap).when(~neg & (r == 12), any_swap).alias("swap"),
    )
    again = faulty.where("label = 1 and cast(source_kit_id as long) % 60 = 25")
    return expect.pair_issues(faulty.unionByName(again), d.metadata(spark, sf)).groupBy("code").agg(F.count("*").alias("n"))


@query("split_leaks", """SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_parts FROM (SELECT DISTINCT split, slot FROM meta) a JOIN (SELECT DISTINCT split, slot FROM meta) b ON a.slot = b.slot AND a.split < b.split GROUP BY ALL""", "meta")
def split_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Parts (not items, which never leak here) that occur in two splits."""
    return expect.leaks(d.metadata(spark, sf), "slot").groupBy("split_a", "split_b").agg(F.count("*").alias("n_parts"))


@query("embedding_report", "SELECT count(*) AS n_vectors, count(*) FILTER (abs(n - 1) <= 0.01) AS n_usable, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm FROM (SELECT sqrt(list_inner_product(v, v)) AS n FROM vec)", "vec")
def embedding_report(spark: SparkSession, sf: str) -> DataFrame:
    v = d.vectors(spark, sf).select(F.col("vec_id").cast("string").alias("item_id"), "v")
    return expect.embedding_report(v, dim=d.DIM).withColumns({"min_norm": F.round("min_norm", 6), "max_norm": F.round("max_norm", 6)})


@query("embedding_issues", """SELECT code, count(*) AS n FROM (SELECT CASE vec_id % 20 WHEN 1 THEN 'missing_vector' WHEN 2 THEN 'wrong_dimension' WHEN 3 THEN 'not_finite' WHEN 4 THEN 'zero_vector' WHEN 5 THEN 'not_unit_norm' WHEN 6 THEN 'blank_id' END AS code FROM vec) WHERE code IS NOT NULL GROUP BY code
  UNION ALL SELECT 'duplicate_id', count(*) - 1 FROM vec WHERE vec_id % 20 = 6""", "vec")
def embedding_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The cache validator over vectors with one fault for each of a few residues of their id."""
    r = F.col("vec_id") % 20
    bad = F.when(r == 1, None).when(r == 2, F.slice("v", 1, 63)).when(r == 3, F.concat(F.array(F.lit(float("nan"))), F.slice("v", 2, 63))).when(r == 4, F.transform("v", lambda x: x * 0.0)).when(r == 5, F.transform("v", lambda x: x * F.lit(2.0))).otherwise(F.col("v"))
    cache = d.vectors(spark, sf).select(F.when(r == 6, " ").otherwise(F.col("vec_id").cast("string")).alias("item_id"), bad.alias("v"))
    return expect.embedding_issues(cache, dim=d.DIM).groupBy("code").agg(F.count("*").alias("n"))


@query("embedding_gate", "SELECT 'wrong_item_count' AS code, (SELECT count(*) FROM embeddings)::VARCHAR AS wanted, '1' AS found UNION ALL SELECT 'wrong_normalization', 'l2', 'none'")
def embedding_gate(spark: SparkSession, sf: str) -> DataFrame:
    v = d.vectors(spark, sf).select(F.col("vec_id").cast("string").alias("item_id"), "v")
    return expect.manifest_issues({"embedding_dimension": 64, "normalization": "none", "item_count": 1}, expect.embedding_report(v, dim=d.DIM), expected={"embedding_dimension": 64, "normalization": "l2"})

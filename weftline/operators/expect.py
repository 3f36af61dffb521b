"""Constraint validators: rules become issue rows, issue rows become counts with examples and a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null, finite, length

#: Examples of an issue that a report shows.
EXAMPLES = 50
# Fixed value: the type that a negative's swap states.
SWAP_TYPE = "same_category_different_kit"


def issues(df: DataFrame, rules: dict[str, Column], *keep: str) -> DataFrame:
    """A row (keep, code) for each rule that a row breaks. A null condition counts as kept. No shuffle."""
    broken = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules.items()))
    return df.select(*keep, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("code"))


def staged(rules: list[tuple[str, Column, bool]]) -> dict[str, Column]:
    """Rules in order; one that stops (third field) guards all after it."""
    out, stopped = {}, F.lit(False)
    for code, condition, stops in rules:
        c = F.coalesce(condition, F.lit(False))
        out[code] = c & ~stopped
        if stops:
            stopped = stopped | c
    return out


def summary(found: DataFrame, example: str, *, examples: int = EXAMPLES) -> DataFrame:
    """code, n, examples: the least ids as far as the report shows them."""
    rank = F.row_number().over(Window.partitionBy("code").orderBy(example))
    counts = found.groupBy("code").agg(F.count("*").alias("n"))
    shown = found.withColumn("_r", rank).where(F.col("_r") <= examples).groupBy("code").agg(F.array_sort(F.collect_list(example)).alias("examples"))
    return counts.join(shown, "code")


def gate(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("n_issues")).withColumn("status", F.when(F.col("n_issues") == 0, "READY").otherwise("BLOCKED"))


def repeats(df: DataFrame, key: str, code: str) -> DataFrame:
    """An issue row for each row after the first of a key."""
    return df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key), F.explode(F.sequence(F.lit(2), F.col("_n").cast("int"))).alias("_k")).select(key, F.lit(code).alias("code"))


def positive_issues(samples: DataFrame, known: DataFrame, *, least: int = 3) -> DataFrame:
    """Clean positives: sample_id, code. samples: sample_id, source_kit_id, paired_positive_sample_id, label, items,
    negative_metadata (any type); known: item_id of items with a class. An item without a class counts once for each sample."""
    items, sample, kit = F.col("items"), F.col("sample_id"), F.col("source_kit_id")
    none = lambda c: c.isNull() | (c == "")
    short = items.isNull() | (F.size(items) < least)
    repeated = ~short & (F.size(F.array_distinct(items)) != F.size(items))
    rules = {
        "invalid_sample_id": sample.isNull() | ~sample.endswith("_pos"),
        "invalid_source_kit_id": none(kit),
        "sample_id_source_kit_mismatch": ~none(kit) & ~sample.eqNullSafe(F.concat(kit, F.lit("_pos"))),
        "paired_positive_sample_id_must_be_null": F.col("paired_positive_sample_id").isNotNull(),
        "label_must_be_1": F.col("label").isNull() | (F.col("label") != 1),
        "negative_metadata_must_be_null": F.col("negative_metadata").isNotNull(),
        "outfit_below_min_items": short,
        "duplicate_item_in_outfit": repeated,
    }
    found = issues(samples, rules, "sample_id")
    lacking = samples.where(~short & ~repeated).select("sample_id", F.explode("items").alias("item_id")).join(known.select("item_id"), "item_id", "left_anti").select("sample_id", F.lit("missing_category_item").alias("code"))
    return found.unionByName(lacking).unionByName(repeats(samples.where(sample.endswith("_pos")), "sample_id", "duplicate_sample_id"))


def metadata_issues(metadata: DataFrame, samples: DataFrame, *, split: str, version: str, mapping_version: str, classes: list[str]) -> DataFrame:
    """Item metadata of one split: item_id, code; its items must be those of the samples, in both directions."""
    none = lambda c: F.col(c).isNull() | (F.col(c) == "")
    differs = lambda c, v: ~F.col(c).eqNullSafe(F.lit(v))
    rules = {
        "invalid_item_id": none("item_id"),
        "item_metadata_version_mismatch": differs("item_metadata_version", version),
        "category_mapping_version_mismatch": differs("category_mapping_version", mapping_version),
        "split_mismatch": differs("split", split),
        "invalid_source_kit_id": none("source_kit_id"),
        "invalid_master_category": none("master"),
        "invalid_coarse_category": F.col("coarse").isNull() | ~F.col("coarse").isin(*classes),
    }
    named = metadata.where(~none("item_id"))
    used = samples.select(F.explode("items").alias("item_id")).distinct()
    extra = named.select("item_id").distinct().join(used, "item_id", "left_anti").withColumn("code", F.lit("extra_in_metadata"))
    lacking = used.join(named.select("item_id"), "item_id", "left_anti").withColumn("code", F.lit("missing_from_metadata"))
    return issues(metadata, rules, "item_id").unionByName(extra).unionByName(lacking).unionByName(repeats(named, "item_id", "duplicate_item_id"))


def load_issues(records: DataFrame, known: DataFrame, *, least: int = 2, most: int = 8) -> DataFrame:
    """Records that a scorer can't load: sample_id, code. records: sample_id, label, items; known: item_id of items with a vector and a
    class. No record is dropped: a caller decides what an issue costs."""
    items = F.col("items")
    rules = {
        "invalid_sample_id": blank_to_null(F.col("sample_id")).isNull(),
        "invalid_label": F.col("label").isNull() | ~F.col("label").isin(0, 1),
        "too_few_items": items.isNull() | (F.size(items) < least),
        "too_many_items": F.size(items) > most,
        "duplicate_item": F.size(F.array_distinct(items)) != F.size(items),
    }
    lacking = records.select("sample_id", F.explode("items").alias("item_id")).join(known.select("item_id"), "item_id", "left_anti").select("sample_id", F.lit("missing_vector_or_class").alias("code")).distinct()
    return issues(records, rules, "sample_id").unionByName(lacking)


def embedding_issues(cache: DataFrame, *, dim: int, tolerance: float = 1e-2) -> DataFrame:
    """item_id, code of vectors that can't be used. cache: item_id, v (array of doubles)."""
    n = length(F.col("v"))
    rules = staged([
        ("blank_id", blank_to_null(F.col("item_id")).isNull(), False),
        ("missing_vector", F.col("v").isNull(), True),
        ("wrong_dimension", F.size("v") != dim, True),
        ("not_finite", F.exists("v", lambda x: x.isNull() | ~finite(x)), True),
        ("zero_vector", n <= 1e-12, True),
        ("not_unit_norm", F.abs(n - 1.0) > tolerance, False),
    ])
    return issues(cache, rules, "item_id").unionByName(repeats(cache, "item_id", "duplicate_id"))


def embedding_report(cache: DataFrame, *, dim: int, tolerance: float = 1e-2) -> DataFrame:
    """One row: vectors, usable ones, least and largest norm."""
    n = length(F.col("v"))
    fine = F.coalesce((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | ~finite(x)), F.lit(False))
    df = cache.select(fine.alias("fine"), F.when(fine, n).alias("n"))
    ok = F.col("fine") & (F.abs(F.col("n") - 1.0) <= tolerance)
    return df.agg(F.count("*").alias("n_vectors"), F.count_if(ok).alias("n_usable"), F.min("n").alias("min_norm"), F.max("n").alias("max_norm"))


def manifest_issues(manifest: dict, report: DataFrame, *, expected: dict) -> DataFrame:
    """An embedding manifest against a cache's report: code, wanted, found of each field that differs or is missing."""
    spark = report.sparkSession
    rows = [(f"{'missing' if k not in manifest else 'wrong'}_{k}", str(v), str(manifest.get(k))) for k, v in expected.items() if manifest.get(k) != v]
    fields = spark.createDataFrame(rows, "code string, wanted string, found string")
    count = report.select(F.lit("wrong_item_count").alias("code"), F.col("n_vectors").cast("string").alias("wanted"), F.lit(str(manifest.get("item_count"))).alias("found")).where("wanted <> found")
    return fields.unionByName(count)


def coverage(samples: DataFrame, metadata: DataFrame, usable: DataFrame) -> DataFrame:
    """By split: items that samples need, those without metadata, those without a usable vector, and the share covered."""
    need = samples.select("split", F.explode("items.item_id").alias("item_id")).distinct()
    has = need.join(metadata.select("item_id").distinct().withColumn("_m", F.lit(1)), "item_id", "left").join(usable.select("item_id").distinct().withColumn("_v", F.lit(1)), "item_id", "left")
    out = has.groupBy("split").agg(F.count("*").alias("n_items"), F.count_if(F.col("_m").isNull()).alias("n_without_metadata"), F.count_if(F.col("_v").isNull()).alias("n_without_vector"))
    return out.withColumn("coverage", (F.col("n_items") - F.col("n_without_vector")) / F.col("n_items"))


def pair_issues(records: DataFrame, metadata: DataFrame, *, least: int = 3) -> DataFrame:
    """The pair reconstruction validator: sample_id, code for each rule that a record breaks.

    records: sample_id, source_kit_id, pair_id, label, items, swap (struct position, original_item_id,
    replacement_item_id, replacement_kit_id, master, coarse, kind); metadata: item_id, source_kit_id, master, coarse.
    Record rules run first; a record that a stopping rule drops meets no later rule and no pair. Then negatives meet
    their positive by one equi-join, items their metadata by another.
    """
    items, swap = F.col("items"), F.col("swap")
    meta = metadata.select("item_id", F.col("source_kit_id").alias("_kit"), F.col("master").alias("_master"), F.col("coarse").alias("_coarse"))
    lacking = records.select("sample_id", F.explode("items").alias("item_id")).join(meta.select("item_id"), "item_id", "left_anti").select("sample_id").distinct().withColumn("_lacks", F.lit(True))
    df = records.join(lacking, "sample_id", "left").withColumn("_lacks", F.coalesce("_lacks", F.lit(False)))
    positive, negative = F.col("label") == 1, F.col("label") == 0
    first = [
        ("missing_sample_fields", F.col("sample_id").isNull() | F.col("source_kit_id").isNull() | items.isNull(), True),
        ("invalid_identity", (F.trim("sample_id") == "") | (F.trim("source_kit_id") == ""), False),
        ("outfit_below_min_items", F.size(items) < least, True),
        ("duplicate_item_inside_outfit", F.size(F.array_distinct(items)) != F.size(items), False),
        ("missing_item_metadata", F.col("_lacks"), False),
        ("invalid_label", F.col("label").isNull() | ~F.col("label").isin(0, 1), True),
        ("positive_sample_id_mismatch", positive & (F.col("sample_id") != F.concat("source_kit_id", F.lit("_pos"))), False),
        ("positive_has_negative_metadata", positive & swap.isNotNull(), False),
        ("positive_has_pair_reference", positive & F.col("pair_id").isNotNull(), False),
        ("positive_item_wrong_source_kit", positive & F.exists(items, lambda x: ~x.startswith(F.concat("source_kit_id", F.lit("_")))), False),
    ]
    rules = staged(first)
    stop = F.coalesce(first[0][1], F.lit(False)) | F.coalesce(first[2][1], F.lit(False)) | F.coalesce(first[5][1], F.lit(False))
    found = issues(df, rules, "sample_id").unionByName(repeats(df.where(~stop & F.col("sample_id").isNotNull()), "sample_id", "duplicate_sample_id"))
    live = df.where(~stop)
    pos = live.where("label = 1").groupBy("sample_id").agg(F.min_by(F.struct("source_kit_id", "items"), F.struct("source_kit_id", "items")).alias("p")).select(F.col("sample_id").alias("_pid"), F.col("p.source_kit_id").alias("_pkit"), F.col("p.items").alias("_pitems"))
    neg = live.where("label = 0")
    met = neg.join(pos, neg["pair_id"] == pos["_pid"], "left")
    repl = meta.select(F.col("item_id").alias("_rid"), F.col("_kit").alias("_rkit"), F.col("_master").alias("_rmaster"))
    orig = meta.select(F.col("item_id").alias("_oid"), F.col("_master").alias("_omaster"))
    met = met.join(repl, met["swap.replacement_item_id"] == F.col("_rid"), "left").join(orig, met["swap.original_item_id"] == F.col("_oid"), "left")
    swapped = F.filter(F.sequence(F.lit(0), F.size("items") - 1), lambda i: F.get("items", i) != F.get("_pitems", i))
    at = F.get(swapped, F.lit(0))
    filled = F.col("swap.position").isNotNull() & F.col("swap.original_item_id").isNotNull() & F.col("swap.replacement_item_id").isNotNull() & F.col("swap.master").isNotNull() & F.col("swap.replacement_kit_id").isNotNull() & F.col("swap.kind").isNotNull()
    second = staged([
        ("negative_sample_id_mismatch", F.col("sample_id") != F.concat("source_kit_id", F.lit("_neg_1")), False),
        ("negative_missing_positive_pair", F.col("_pid").isNull(), True),
        ("pair_source_kit_mismatch", F.col("_pkit") != F.col("source_kit_id"), False),
        ("pair_length_mismatch", F.size("items") != F.size("_pitems"), True),
        ("negative_not_exactly_one_swap", F.size(swapped) != 1, True),
        ("negative_metadata_missing", swap.isNull(), True),
        ("negative_metadata_missing_fields", ~filled, True),
        ("invalid_swapped_item_index", (F.col("swap.position") < 0) | (F.col("swap.position") >= F.size("items")), True),
        ("swapped_index_mismatch", F.col("swap.position") != at, False),
        ("original_item_mismatch", F.col("swap.original_item_id") != F.get("_pitems", at), False),
        ("replacement_item_mismatch", F.col("swap.replacement_item_id") != F.get("items", at), False),
        ("replacement_already_in_positive", F.array_contains("_pitems", F.col("swap.replacement_item_id")), False),
        ("wrong_negative_type", F.col("swap.kind") != SWAP_TYPE, False),
        ("replacement_master_category_mismatch", F.col("_rmaster") != F.col("_omaster"), False),
        ("swap_category_metadata_mismatch", F.col("swap.master") != F.col("_omaster"), False),
        ("replacement_kit_metadata_mismatch", F.col("swap.replacement_kit_id") != F.col("_rkit"), False),
        ("replacement_from_same_kit", F.col("_rkit") == F.col("source_kit_id"), False),
    ])
    pairs = issues(met, second, "sample_id")
    counts = pos.select("_pid").join(neg.groupBy(F.col("pair_id").alias("_pid")).agg(F.count("*").alias("_n")), "_pid", "left").where(F.coalesce("_n", F.lit(0)) != 1)
    return found.unionByName(pairs).unionByName(counts.select(F.col("_pid").alias("sample_id"), F.lit("positive_pair_count_not_one").alias("code")))


def leaks(records: DataFrame, key: str) -> DataFrame:
    """Values that occur in more than one split, with the pair of splits."""
    one = records.select("split", key).distinct()
    a, b = one.select(F.col("split").alias("split_a"), key), one.select(F.col("split").alias("split_b"), key)
    return a.join(b, key).where("split_a < split_b")

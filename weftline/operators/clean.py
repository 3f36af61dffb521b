"""From raw items and kits to clean positives: strip, dedup, parse, map categories, filter, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null, kit_of, slot_of, strip

DROP = "DROP"
#: Ids of the seven categories, 0 for padding.
CATEGORY_IDS = {"TOP": 1, "BOTTOM": 2, "DRESS": 3, "OUTERWEAR": 4, "SHOES": 5, "BAG": 6, "HAT": 7}
MIN_ITEMS, MAX_ITEMS = 3, 8
#: Parts into which rows without an id are dealt.
SPREAD = 1 << 16


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; an error names those that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def category_id(coarse: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, number in CATEGORY_IDS.items():
        out = F.when(coarse == name, number).otherwise(out)
    return out


def audited_items(raw: DataFrame, order: list, *, dealt: tuple[str, ...] = ()) -> DataFrame:
    """raw: item_id, master and the columns of order. Adds state: missing, duplicate, malformed or kept, in this order of tests.

    Ids and categories are stripped; of rows with one id the first in order counts, but malformed ids count each
    time. One shuffle, by item id; none if raw lies dealt by the columns dealt, which a well-formed id must determine.
    """
    df = raw.withColumns({"item_id": strip(F.col("item_id")), "master": strip(F.col("master"))})
    bad = F.col("item_id").isNull() | (F.col("item_id") == "") | F.col("master").isNull() | (F.col("master") == "")
    df = df.withColumns({"_bad": bad, "kit_id": kit_of(F.col("item_id")), "slot": slot_of(F.col("item_id"))})
    malformed = ~F.col("item_id").contains("_") | (F.col("kit_id") == "")
    spread = F.when(F.col("_bad"), F.pmod(F.xxhash64(*order), F.lit(SPREAD)))  # missing ids are counted, not compared: they needn't meet
    turn = F.row_number().over(Window.partitionBy(*dealt, "item_id", spread).orderBy(*order))
    state = F.when(F.col("_bad"), "missing").when(malformed, "malformed").when(turn > 1, "duplicate").otherwise("kept")
    return df.withColumn("state", state).drop("_bad")


def clean_items(raw: DataFrame, order: list, *, dealt: tuple[str, ...] = ()) -> DataFrame:
    return audited_items(raw, order, dealt=dealt).where(F.col("state") == "kept").select("item_id", "kit_id", "slot", "master")


def item_counters(raw: DataFrame, order: list) -> DataFrame:
    """Rows by state, one row: n_rows, n_missing, n_duplicate, n_malformed, n_kept, n_null_slot."""
    a = audited_items(raw, order)
    count = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
    return a.agg(F.count("*").alias("n_rows"), count("missing"), count("duplicate"), count("malformed"), count("kept"), F.count_if((F.col("state") == "kept") & F.col("slot").isNull()).alias("n_null_slot"))


def resolved_mapping(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """master, coarse: overrides go before base; texts stripped, classes in upper case."""
    tidy = lambda df: df.select(strip(F.col("master")).alias("master"), F.upper(strip(F.col("coarse"))).alias("coarse"))
    new = tidy(overrides).withColumnRenamed("coarse", "_new")
    return tidy(base).join(new, "master", "full_outer").select("master", F.coalesce("_new", "coarse").alias("coarse"))


def mapping_issues(mapping: DataFrame) -> DataFrame:
    """Categories that are blank, repeated or of an unknown class."""
    known = [*CATEGORY_IDS, DROP]
    df = mapping.groupBy("master").agg(F.count("*").alias("n"), F.max("coarse").alias("coarse"))
    issue = F.when(blank_to_null(F.col("master")).isNull(), "blank").when(F.col("n") > 1, "repeated").when(~F.col("coarse").isin(*known), "unknown_class")
    return df.select("master", issue.alias("issue")).where(F.col("issue").isNotNull())


def mapping_coverage(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Categories seen but not mapped, and mapped but never seen."""
    seen, mapped = items.select("master").distinct(), mapping.select("master").distinct()
    return seen.join(mapped, "master", "left_anti").withColumn("issue", F.lit("unmapped")).unionByName(mapped.join(seen, "master", "left_anti").withColumn("issue", F.lit("unused")))


def mapped_items(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """items with coarse. The mapping has a row per category; Spark broadcasts it while it is small."""
    return items.join(mapping.select("master", "coarse"), "master")


def core_items(items: DataFrame, mapping: DataFrame) -> DataFrame:
    return mapped_items(items, mapping).where(F.col("coarse") != DROP)


def category_report(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Items of each class before and after the filter, with the share kept of all."""
    m = mapped_items(items, mapping).groupBy("coarse").agg(F.count("*").alias("n_before"))
    kept = F.when(F.col("coarse") != DROP, F.col("n_before")).otherwise(0)
    total = F.sum("n_before").over(Window.partitionBy(F.lit(1)))  # a row per class
    return m.select("coarse", "n_before", kept.cast("long").alias("n_after"), (kept / total).alias("share_kept"))


def in_kit_order(*fields: str) -> Column:
    """The items of a group as structs, by (slot is null, slot, item_id)."""
    entry = F.struct(F.col("slot").isNull().alias("_none"), F.coalesce("slot", F.lit(0)).alias("_slot"), "item_id", *[f for f in fields if f != "item_id"])
    return F.array_sort(F.collect_list(entry))


def outfits(items: DataFrame, *, least: int = MIN_ITEMS) -> DataFrame:
    """kit_id, n_items, items (array of item structs in kit order) of kits with at least least items; expect.load_issues reports those
    that are too long for a scorer. A kit is small, so it fits a row."""
    df = items.groupBy("kit_id").agg(F.count("*").alias("n_items"), in_kit_order("master", "coarse", "slot").alias("items"))
    return df.where(F.col("n_items") >= least)


def kit_report(kits: DataFrame, before: DataFrame, after: DataFrame, *, least: int = MIN_ITEMS) -> DataFrame:
    """One row: kits, kits without items, kits that are too short after the filter, kits kept, share kept."""
    size = lambda df, name: df.groupBy("kit_id").agg(F.count("*").alias(name))
    df = kits.join(size(before, "n_raw"), "kit_id", "left").join(size(after, "n_core"), "kit_id", "left").select(F.coalesce("n_raw", F.lit(0)).alias("n_raw"), F.coalesce("n_core", F.lit(0)).alias("n_core"))
    df = df.agg(F.count("*").alias("n_kits"), F.count_if(F.col("n_raw") == 0).alias("n_without_items"), F.count_if((F.col("n_raw") > 0) & (F.col("n_core") < least)).alias("n_too_short"), F.count_if(F.col("n_core") >= least).alias("n_kept"))
    return df.withColumn("keep_rate", F.try_divide(F.col("n_kept").cast("double"), F.col("n_kits")))


def length_histogram(sized: DataFrame) -> DataFrame:
    return sized.groupBy("n_items").agg(F.count("*").alias("n_outfits"))


def item_metadata(samples: DataFrame, items: DataFrame, *, version: str, mapping_version: str) -> DataFrame:
    """A row for each item of a sample, the first time it occurs; samples: split, kit_id, items."""
    used = samples.select("split", F.explode("items.item_id").alias("item_id")).distinct()
    return used.join(items, "item_id").select("split", "item_id", F.col("kit_id").alias("source_kit_id"), "slot", "master", "coarse", F.lit(version).alias("item_metadata_version"), F.lit(mapping_version).alias("category_mapping_version"))


def merged_metadata(rows: DataFrame, order: str) -> DataFrame:
    """Rows of one item merged: of each field the last filled value in order; conflict: more than one class.

    rows: item_id, master, coarse, image and the column of order.
    """
    last = lambda c: F.max_by(c, F.when(blank_to_null(F.col(c)).isNotNull(), F.col(order))).alias(c)
    return rows.groupBy("item_id").agg(last("master"), last("coarse"), last("image"), (F.count_distinct(blank_to_null(F.col("coarse"))) > 1).alias("conflict"), F.count("*").alias("n_rows"))


def repaired(samples: DataFrame, usable: DataFrame, *, least: int = MIN_ITEMS) -> DataFrame:
    """Samples without unusable items, those that get too short dropped: split, kit_id, n_before, n_items, items (ids)."""
    parts = samples.select("split", "kit_id", "n_items", F.posexplode("items.item_id").alias("pos", "item_id"))
    kept = parts.join(usable.select("item_id"), "item_id", "left_semi")
    out = kept.groupBy("split", "kit_id").agg(F.first("n_items").alias("n_before"), F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.struct("pos", "item_id"))).alias("items"))
    return out.where(F.col("n_items") >= least).withColumn("items", F.col("items.item_id"))


def pools(metadata: DataFrame, keys: list[str]) -> DataFrame:
    """metadata with pool_index (from 0) and pool_size within keys, ordered by (two hex digits of the id's hash, id).

    The digits cut each pool into 256 parts, which are numbered on their own and shifted by the sizes of those
    before them, so that a pool of any share of the rows is spread.
    """
    df = metadata.withColumn("_part", F.substring(F.sha2("item_id", 256), 1, 2))
    sizes = df.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_first": F.coalesce(F.sum("_n").over(before), F.lit(0)), "pool_size": F.sum("_n").over(Window.partitionBy(*keys))}).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("item_id")) - 1
    return df.withColumn("_rank", rank).join(sizes, [*keys, "_part"]).withColumn("pool_index", F.col("_rank") + F.col("_first")).drop("_rank", "_first", "_part")

"""The earlier benchmark builder: several negatives of a kit from pools over all splits, its counters, and its verifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bound
from .clean import in_kit_order, pools
from .expect import SWAP_TYPE
from .negatives import hashed, hashed_number

# What the builder counts, in the order of its report.
COUNTERS = ("kits_processed", "kits_with_items", "kits_without_items", "kits_too_small", "positive_samples", "negative_samples", "negative_attempts", "failed_no_valid_candidate", "failed_duplicate_pair", "negative_generation_complete")
PICKS = "array<struct<number: int, spot: int, turn: int>>"


def _picks(per_outfit: int) -> Column:
    """For attempts 1 to per_outfit the position whose hash is least among those with a candidate left, and how often it was taken before."""
    none = F.array().cast(PICKS)

    def attempt(state: Column, number: Column) -> Column:
        spots = F.transform("spots", lambda s, i: F.struct(hashed(F.col("kit_id"), s["item_id"], number.cast("string")).alias("h"), i.alias("spot"), F.get(state["used"], i).alias("turn"), s["others"].alias("others")))
        best = F.array_min(F.filter(spots, lambda s: s["turn"] < s["others"]))
        return bound(best, lambda b: F.struct(
            F.transform(state["used"], lambda u, i: F.when(i == b["spot"], u + 1).otherwise(u)).alias("used"),
            F.concat(state["picks"], F.when(b.isNull(), none).otherwise(F.array(F.struct(number.alias("number"), b["spot"].alias("spot"), b["turn"].alias("turn"))).cast(PICKS))).alias("picks"),
        ))

    start = F.struct(F.transform("spots", lambda s: F.lit(0)).alias("used"), none.alias("picks"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(per_outfit)), start, attempt, lambda s: s["picks"])


def picked(items: DataFrame, *, per_outfit: int = 1, least: int = 2) -> DataFrame:
    """kit_id, spots (position, item_id, master, own, others, pool_size by kit order), picks of kits with at least least items.

    items: item_id, kit_id, slot, master, ids distinct. One shuffle, by kit: a kit's own items are counted in its row, and the sizes of
    the pools, a number for each category, are held by each task. others counts the items of the category in other kits: a position with none serves never.
    """
    if per_outfit < 0 or least < 1:
        raise ValueError("per_outfit must be at least 0, least at least 1")
    items = items.where("master is not null")
    sizes = items.groupBy("master").agg(F.count("*").alias("pool_size")).agg(F.map_from_entries(F.collect_list(F.struct("master", "pool_size"))).alias("_sizes"))  # one row
    kits = items.groupBy("kit_id").agg(F.count("*").alias("n_items"), in_kit_order("master").alias("_spots")).crossJoin(F.broadcast(sizes))
    own = lambda s: F.size(F.filter("_spots", lambda t: t["master"] == s["master"])).cast("long")
    size = lambda s: F.try_element_at("_sizes", s["master"])
    kits = kits.select("kit_id", "n_items", F.transform("_spots", lambda s: F.struct(s["_none"].alias("_none"), s["_slot"].alias("_slot"), s["item_id"].alias("item_id"), s["master"].alias("master"), own(s).alias("own"), (size(s) - own(s)).alias("others"), size(s).alias("pool_size"))).alias("spots"))
    return kits.where(F.col("n_items") >= least).withColumn("picks", _picks(per_outfit) if per_outfit else F.array().cast(PICKS))


def negatives(items: DataFrame, kits: DataFrame) -> DataFrame:
    """Records of the negatives that picked() chose: sample_id, source_kit_id, items (ids), label, negative_metadata.

    A position's candidates lie on a circle from a hashed start; its turn-th use takes the turn-th item of another kit, so no pair of an
    item and its replacement comes twice. That costs the kit's own items in the pool plus the turn, as rows of an equi-join.
    """
    pool = pools(items.select("item_id", "kit_id", "master"), ["master"])
    p = kits.select("kit_id", "spots", F.explode("picks").alias("p")).withColumn("s", F.get("spots", F.col("p.spot")))
    p = p.select("kit_id", "p.number", "p.spot", "p.turn", F.col("s.item_id").alias("original"), F.col("s.master").alias("master"), F.col("s.own").alias("own"), F.col("s.pool_size").alias("pool_size"))
    first = F.pmod(hashed_number(F.lit("start"), F.col("kit_id"), F.col("original")), F.col("pool_size"))
    steps = p.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") + F.col("turn")))).withColumn("pool_index", F.pmod(first + F.col("_step"), F.col("pool_size")))
    other = pool.select("master", "pool_index", F.col("item_id").alias("_id"), F.col("kit_id").alias("_kit"))
    met = steps.join(other, ["master", "pool_index"]).where(F.col("_kit") != F.col("kit_id"))
    found = met.groupBy("kit_id", "number", "spot", "turn", "original", "master").agg(F.array_sort(F.collect_list(F.struct("_step", "_id", "_kit"))).alias("c")).withColumn("c", F.get("c", F.col("turn")))
    meta = F.struct(F.lit(SWAP_TYPE).alias("negative_type"), F.col("spot").alias("swapped_item_index"), F.col("original").alias("original_item_id"), F.col("c._id").alias("replacement_item_id"), F.col("master").alias("swap_category"), F.col("c._kit").alias("replacement_kit_id"))
    made = found.select("kit_id", "number", meta.alias("negative_metadata")).join(kits.select("kit_id", F.col("spots.item_id").alias("_ids")), "kit_id")
    swapped = F.transform("_ids", lambda x, i: F.when(i == F.col("negative_metadata.swapped_item_index"), F.col("negative_metadata.replacement_item_id")).otherwise(x))
    return made.select(F.concat("kit_id", F.lit("_neg_"), F.col("number").cast("string")).alias("sample_id"), F.col("kit_id").alias("source_kit_id"), swapped.alias("items"), F.lit(0).alias("label"), "negative_metadata")


def positives(kits: DataFrame) -> DataFrame:
    none = "struct<negative_type: string, swapped_item_index: int, original_item_id: string, replacement_item_id: string, swap_category: string, replacement_kit_id: string>"
    return kits.select(F.concat("kit_id", F.lit("_pos")).alias("sample_id"), F.col("kit_id").alias("source_kit_id"), F.col("spots.item_id").alias("items"), F.lit(1).alias("label"), F.lit(None).cast(none).alias("negative_metadata"))


def counters(all_kits: DataFrame, items: DataFrame, kits: DataFrame, *, per_outfit: int = 1) -> DataFrame:
    """COUNTERS in one row. all_kits: kit_id, a row for each kit; kits: picked() of items with the same per_outfit."""
    sizes = items.groupBy("kit_id").agg(F.count("*").alias("_n"))
    picks = kits.select("kit_id", F.size("picks").alias("_made"), F.exists("spots", lambda s: s["others"] > 0).alias("_can"))
    df = all_kits.select(F.trim("kit_id").alias("kit_id")).join(sizes, "kit_id", "left").join(picks, "kit_id", "left")
    long = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    failed = F.lit(per_outfit) - F.col("_made")
    used = F.col("_made").isNotNull()
    values = (F.count("*"), F.count_if(used), F.count_if(F.col("_n").isNull()), F.count_if(F.col("_n").isNotNull() & ~used), F.count_if(used), long(F.col("_made")), F.count_if(used) * per_outfit, long(F.when(~F.col("_can"), failed)), long(F.when(F.col("_can"), failed)), F.count_if(F.col("_made") == per_outfit))
    return df.agg(*(v.alias(n) for n, v in zip(COUNTERS, values, strict=True)))


def record_issues(records: DataFrame, items: DataFrame) -> DataFrame:
    """sample_id, code: the first rule that each record breaks, shape first, then repeated ids, then against items (item_id, kit_id, master).

    All but one row of a repeated sample_id are repeats. Equal records share one key, so each is judged alike.
    """
    m, ids, n = F.col("negative_metadata"), F.col("items"), F.size("items")
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    at = m["swapped_item_index"]
    positive, negative = F.col("label") == 1, F.col("label") == 0
    df = records.withColumn("_key", F.unhex(F.sha2(F.to_json(F.struct(*records.columns)), 256))).groupBy("_key").agg(F.first(F.struct(*records.columns)).alias("r"), F.count("*").alias("_copies")).select("_key", "_copies", "r.*")
    asked = df.select("_key", "source_kit_id", F.explode(F.concat(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.struct(F.lit("item").alias("role"), x.alias("item_id"))), F.array(*(F.struct(F.lit(role).alias("role"), m[f"{role}_item_id"].alias("item_id")) for role in ("original", "replacement"))))).alias("a")).select("_key", "source_kit_id", "a.*")
    known = items.select("item_id", F.col("kit_id").alias("_kit"), F.col("master").alias("_master"))
    seen = asked.join(known, "item_id", "left")
    of = lambda role, c: F.max(F.when(F.col("role") == role, c))
    own = F.coalesce(F.col("_kit") == F.col("source_kit_id"), F.lit(False))
    facts = seen.groupBy("_key").agg(of("item", F.col("_master").isNull()).alias("_lacks"), of("original", F.col("_master")).alias("_from"), of("replacement", F.col("_master")).alias("_to"), of("original", own).alias("_inside"), of("replacement", own).alias("_again"))
    df = df.join(facts, "_key", "left")
    rules = (
        ("invalid_sample_id", blank(F.col("sample_id"))), ("invalid_source_kit_id", blank(F.col("source_kit_id"))), ("items_empty", ids.isNull() | (n == 0)), ("invalid_item_id", F.exists(ids, lambda x: x.isNull() | (x == ""))), ("invalid_label", F.col("label").isNull() | ~(positive | negative)),
        ("positive_with_negative_metadata", positive & m.isNotNull()), ("positive_sample_id_suffix", positive & ~F.col("sample_id").endswith("_pos")), ("negative_without_metadata", negative & m.isNull()), ("negative_metadata_missing_field", negative & F.concat(*(m[f].cast("string") for f in ("negative_type", "swapped_item_index", "original_item_id", "replacement_item_id", "swap_category", "replacement_kit_id"))).isNull()),
        ("unsupported_negative_type", negative & (m["negative_type"] != SWAP_TYPE)), ("swapped_item_index_out_of_range", negative & ((at < 0) | (at >= n))), ("replacement_not_at_index", negative & ~F.get(ids, at).eqNullSafe(m["replacement_item_id"])),
        ("item_without_category", F.col("_lacks")), ("replacement_of_same_kit", negative & (m["replacement_kit_id"] == F.col("source_kit_id"))), ("original_category_mismatch", negative & ~F.col("_from").eqNullSafe(m["swap_category"])), ("replacement_category_mismatch", negative & ~F.col("_to").eqNullSafe(m["swap_category"])),
        ("original_not_in_outfit", negative & ~F.col("_inside")), ("replacement_in_outfit", negative & F.col("_again")),
    )
    first = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules))
    each = df.withColumn("code", first).select("sample_id", "code", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_c"))
    more = df.groupBy("sample_id").agg(F.sum("_copies").alias("_n")).where("_n > 1 and trim(sample_id) <> ''").select("sample_id", F.explode(F.sequence(F.lit(2), F.col("_n").cast("int"))).alias("_c")).select("sample_id", F.lit("duplicate_sample_id").alias("code"))
    return each.where("code is not null").select("sample_id", "code").unionByName(more)

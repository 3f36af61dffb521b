"""One-swap negatives: a hashed circular probe of the category pool, families, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(SEED)), *parts), 256)


def hashed_number(*parts: Column) -> Column:
    """32 bits of the hash."""
    return F.conv(F.substring(hashed(*parts), 1, 8), 16, 10).cast("long")


def numbered(samples: DataFrame, n: int) -> DataFrame:
    """Each sample n times, with negative_number from 1."""
    return samples.withColumn("negative_number", F.explode(F.sequence(F.lit(1), F.lit(n))))


def negatives(samples: DataFrame, metadata: DataFrame | None = None, *, per_sample: int = 1) -> DataFrame:
    """For each sample one item replaced by one of the same master category and split from another kit.

    samples: split, kit_id, items (structs with item_id, master, coarse); metadata: split, item_id, source_kit_id, master, or None if the
    pools are the samples' own items (then one sample per split and kit, all ids distinct). Positions are tried in the order of a hash; a
    position serves if its pool holds items of other kits. From a hashed start the pool is probed in a circle for as many steps as the kit
    has members in it, plus one, so the first other kit is always met: each probe is one row, never a product of the pool.

    A pool is ordered by (two hex digits of the id's hash, id), as in clean.pools(). The sizes of its 256 parts, a row per pool on each
    executor, tell the part and the rank in it that a probe asks for, so that pool and probes meet in one shuffle by part.
    Returns split, kit_id, negative_number, position, original_item_id, replacement_item_id, replacement_kit_id, master, coarse.
    """
    if metadata is None:
        rows = samples.select("split", F.col("kit_id").alias("source_kit_id"), F.explode("items").alias("x")).select("split", "source_kit_id", "x.item_id", "x.master")
        own = lambda x: F.size(F.filter("items", lambda y: y["master"] == x["master"])).cast("long")
    else:
        rows = metadata.select("split", "source_kit_id", "item_id", "master")
        counted = metadata.groupBy("split", F.col("source_kit_id").alias("kit_id"), "master").agg(F.count("*").alias("own"))
        samples = samples.join(counted.groupBy("split", "kit_id").agg(F.map_from_entries(F.collect_list(F.struct("master", "own"))).alias("_own")), ["split", "kit_id"])
        own = lambda x: F.try_element_at("_own", x["master"])
    rows = rows.withColumn("_part", F.conv(F.substring(F.sha2("item_id", 256), 1, 2), 16, 10).cast("int"))
    sizes = rows.groupBy("split", "master", "_part").agg(F.count("*").alias("_n")).groupBy("split", "master").agg(F.sum("_n").alias("pool_size"), F.collect_list(F.struct("_part", "_n")).alias("_l"))
    before = lambda p: F.aggregate(F.filter("_l", lambda x: x["_part"] < p), F.lit(0).cast("long"), lambda s, x: s + x["_n"])
    firsts = sizes.select("split", "master", F.transform(F.sequence(F.lit(0), F.lit(255)), before).alias("_firsts"))
    by_split = sizes.groupBy("split").agg(F.map_from_entries(F.collect_list(F.struct("master", "pool_size"))).alias("_pools"))

    number = F.col("negative_number").cast("string")
    spots = F.transform("items", lambda x, i: F.struct(hashed(F.col("kit_id"), x["item_id"], number).alias("h"), i.alias("position"), x["item_id"].alias("original_item_id"), x["master"].alias("master"), x["coarse"].alias("coarse"), own(x).alias("own"), F.try_element_at("_pools", x["master"]).alias("pool_size")))
    spot = numbered(samples, per_sample).join(F.broadcast(by_split), "split").select("split", "kit_id", "negative_number", F.array_min(F.filter(spots, lambda s: s["pool_size"] > s["own"])).alias("s")).where("s is not null").select("split", "kit_id", "negative_number", "s.*")
    start = F.pmod(hashed_number(F.lit("start"), F.col("kit_id"), F.col("original_item_id"), number), F.col("pool_size"))
    probe = spot.withColumn("_start", start).join(F.broadcast(firsts), ["split", "master"]).withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own"))))
    index = F.pmod(F.col("_start") + F.col("_step"), F.col("pool_size"))
    halves = F.array(*(F.lit(1 << k) for k in range(7, -1, -1)))
    probe = probe.withColumn("_index", index).withColumn("_part", F.aggregate(halves, F.lit(0), lambda p, h: F.when(F.get("_firsts", p + h) <= F.col("_index"), p + h).otherwise(p)))  # the last part that starts at or before the index
    # a row of the shuffle is an item of the pool or a probe: both name an item and its kit
    probe = probe.select("split", "master", "_part", (F.col("_index") - F.get("_firsts", F.col("_part"))).alias("_want"), "_step", F.col("original_item_id").alias("_item"), F.col("kit_id").alias("_kit"), "negative_number", "position", "coarse")
    other = rows.select("split", "master", "_part", F.col("item_id").alias("_item"), F.col("source_kit_id").alias("_kit"))
    part = Window.partitionBy("split", "master", "_part")
    pooled = F.col("_want").isNull()
    rank = F.count_if(pooled).over(part.orderBy("_item").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    both = other.unionByName(probe, allowMissingColumns=True).withColumn("_at", F.coalesce("_want", rank))
    same = Window.partitionBy("split", "master", "_part", "_at")  # one item and the probes that ask for it
    found = lambda c: F.max(F.when(pooled, F.col(c))).over(same)
    met = both.withColumns({"replacement_item_id": found("_item"), "replacement_kit_id": found("_kit")}).where(~pooled & (F.col("replacement_kit_id") != F.col("_kit"))).withColumnsRenamed({"_item": "original_item_id", "_kit": "kit_id"})
    best = met.groupBy("split", "kit_id", "negative_number").agg(F.min_by(F.struct("position", "original_item_id", "replacement_item_id", "replacement_kit_id", "master", "coarse"), "_step").alias("x"))
    return best.select("split", "kit_id", "negative_number", "x.*")


def negative_report(samples: DataFrame, made: DataFrame) -> DataFrame:
    """By split: samples, samples with a negative, without one, coverage."""
    has = made.select("split", "kit_id").distinct().withColumn("_has", F.lit(1))
    df = samples.join(has, ["split", "kit_id"], "left").groupBy("split").agg(F.count("*").alias("n_samples"), F.count("_has").alias("n_with_negative"))
    return df.withColumns({"n_failed": F.col("n_samples") - F.col("n_with_negative"), "coverage": F.col("n_with_negative") / F.col("n_samples")})


# Why a positive gets no negative, in the order of tests.
FAILURES = ("invalid_positive_shape", "input_is_not_positive", "positive_missing_metadata", "no_valid_same_master_category_candidate")


def failures(positives: DataFrame, metadata: DataFrame, made: DataFrame) -> DataFrame:
    """sample_id, reason of positives without a negative: the first of FAILURES that holds. positives: split, sample_id,
    source_kit_id, label, items (ids); metadata: split, item_id; made: split, kit_id."""
    lacking = positives.select("split", "sample_id", F.explode("items").alias("item_id")).join(metadata.select("split", "item_id"), ["split", "item_id"], "left_anti").select("split", "sample_id").distinct().withColumn("_lacks", F.lit(True))
    has = made.select("split", F.col("kit_id").alias("source_kit_id")).distinct().withColumn("_has", F.lit(True))
    df = positives.join(lacking, ["split", "sample_id"], "left").join(has, ["split", "source_kit_id"], "left")
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    tests = (blank("sample_id") | blank("source_kit_id") | F.col("items").isNull() | (F.size("items") == 0), F.coalesce(F.col("label") != 1, F.lit(True)), F.col("_lacks").isNotNull(), F.col("_has").isNull())
    return df.select("split", "sample_id", F.coalesce(*(F.when(t, r) for r, t in zip(FAILURES, tests, strict=True))).alias("reason")).where("reason is not null")


def swap_histogram(made: DataFrame) -> DataFrame:
    return made.groupBy("split", "coarse").agg(F.count("*").alias("n_swaps"))


def families(samples: DataFrame, made: DataFrame) -> DataFrame:
    """Positives and negatives of samples with exactly one negative, as records.

    Returns split, sample_id, source_kit_id, pair_id (null for positives), label, items (ids), coarse (their classes; a replacement
    has that of its original), swap (struct, null for positives).
    """
    one = made.groupBy("split", "kit_id").agg(F.count("*").alias("n"), F.first(F.struct("position", "original_item_id", "replacement_item_id", "replacement_kit_id", "master", "coarse")).alias("swap")).where("n = 1").drop("n")
    df = samples.select("split", "kit_id", F.col("items.item_id").alias("items"), F.col("items.coarse").alias("coarse")).join(one, ["split", "kit_id"])
    swapped = F.transform("items", lambda x, i: F.when(i == F.col("swap.position"), F.col("swap.replacement_item_id")).otherwise(x))
    name = lambda end: F.concat("kit_id", F.lit(end))
    side = lambda sample_id, pair_id, label, items, swap: F.struct(sample_id.alias("sample_id"), pair_id.alias("pair_id"), F.lit(label).alias("label"), items.alias("items"), swap.alias("swap"))
    positive = side(name("_pos"), F.lit(None).cast("string"), 1, F.col("items"), F.when(F.lit(False), F.col("swap")))
    negative = side(name("_neg_1"), name("_pos"), 0, swapped, F.col("swap"))
    both = df.select("split", F.col("kit_id").alias("source_kit_id"), "coarse", F.explode(F.array(positive, negative)).alias("r"))  # one join for both sides
    return both.select("split", "r.sample_id", "source_kit_id", "r.pair_id", "r.label", "r.items", "coarse", "r.swap")

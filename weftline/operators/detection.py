"""Post-processing of detections: boxes, labels, accepted and rejected candidates, category choice."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null, dot, expanded_box, label_text, unit

#: The detector labels that count as garments.
SUPPORTED = ("shirt, blouse", "top, t-shirt, sweatshirt", "sweater", "cardigan", "jacket", "vest", "pants", "shorts", "skirt", "coat", "dress", "jumpsuit", "cape", "hat", "shoe", "bag, wallet")


#: A category set has at most so many prototypes.
MOST_PROTOTYPES = 256
# Reasons for a rejection.
UNSUPPORTED, TOO_SMALL = "unsupported_fashionpedia_object_type", "crop_too_small"
LOW_SIMILARITY, LOW_MARGIN = "category_similarity_below_threshold", "category_margin_below_threshold"


def candidates(detections: DataFrame, class_names: list[str], *, supported=SUPPORTED) -> DataFrame:
    """Each detection with its label, and why it is rejected, else null.

    detections: image_id, x1, y1, x2, y2, confidence, class_id, class_name. A blank name is looked up by class_id in class_names,
    else it is "unknown". Boxes and confidences aren't judged here; crops() does what boxes need.
    """
    names = F.array(*(F.lit(n) for n in class_names))
    known = F.when(F.col("class_id") >= 0, F.try_element_at(names, F.col("class_id").cast("int") + 1))
    label = label_text(F.coalesce(blank_to_null(F.col("class_name")), blank_to_null(known), F.lit("unknown")))
    listed = [" ".join(x.lower().split()) for x in supported]
    return detections.withColumn("label", label).withColumn("reject_reason", F.when(~F.col("label").isin(*listed), UNSUPPORTED))


def crops(accepted: DataFrame, *, padding: float, least_side: int) -> DataFrame:
    """accepted: x1, y1, x2, y2, width, height. Adds the crop left, top, right, bottom and its reject_reason: a side under least_side."""
    box = expanded_box(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")), padding)
    df = accepted.withColumns(box)
    small = F.least(F.col("right") - F.col("left"), F.col("bottom") - F.col("top")) < least_side
    return df.withColumn("reject_reason", F.when(small, TOO_SMALL))


def best_category(scores: DataFrame, *, least: float | None = None, margin: float = 0.0) -> DataFrame:
    """scores: id, category, position, score. id, category, score, margin to the second, accepted, reason; ties go to the first position."""
    top = scores.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "position", "category"))), 1, 2).alias("t"))
    df = top.select("id", F.get("t", F.lit(0))["category"].alias("category"), (-F.get("t", F.lit(0))["less"]).alias("score"), F.coalesce(F.get("t", F.lit(1))["less"] - F.get("t", F.lit(0))["less"], F.lit(float("inf"))).alias("margin"))
    low = F.col("score") < F.lit(least) if least is not None else F.lit(False)
    reason = F.when(low, LOW_SIMILARITY).when(F.col("margin") < F.lit(margin), LOW_MARGIN)
    return df.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def zero_shot(vectors: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Scores of vectors (id, v) against category prototypes (category, position, v), a row each; an error over MOST_PROTOTYPES of them."""
    few = prototypes.select("category", "position", F.col("v").alias("p")).limit(MOST_PROTOTYPES + 1).collect()
    if len(few) > MOST_PROTOTYPES:
        raise ValueError(f"more than {MOST_PROTOTYPES} prototypes")
    rows = F.array(*(F.struct(F.lit(r.category).alias("category"), F.lit(r.position).alias("position"), F.array(*(F.lit(float(x)) for x in r.p)).alias("p")) for r in few))
    return vectors.select("id", "v", F.explode(rows).alias("x")).select("id", "x.category", "x.position", dot(F.col("v"), F.col("x.p")).alias("score"))


def prototypes(prompts: DataFrame, dim: int) -> DataFrame:
    """category, position, v: unit vectors of prompts, averaged and made unit again, by (category, position)."""
    parts = prompts.select("category", "position", F.posexplode(unit(F.col("v"))).alias("d", "x")).groupBy("category", "position", "d").agg(F.avg("x").alias("x"))
    df = parts.groupBy("category", "position").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("s")).where(F.size("s") == dim)
    return df.select("category", "position", unit(F.col("s.x")).alias("v"))


def handoff(accepted: DataFrame, *, least: int = 3, most: int = 8) -> DataFrame:
    """image_id, items (in order of position), status: ready, too_few or too_many; never cut."""
    df = accepted.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("position", "category"))).alias("items"))
    n = F.size("items")
    return df.withColumn("status", F.when(n < least, "too_few").when(n > most, "too_many").otherwise("ready"))


def duplicate_pairs(hashes: DataFrame, *, within: int = 14) -> DataFrame:
    """Pairs of images of different splits whose 64-bit perceptual hashes differ in at most `within` (15 at most) bits: a, b, distance.

    A hash is cut into 4 chunks of 16 bits; of a pair within 15 bits one chunk differs in at most 3. One side is keyed by its
    chunks, the other by all values near them (radius within div 4: 1, 17, 137 or 697 keys a chunk), so pairs meet by
    equi-join on 4 * 65,536 keys. Equal hashes count once on both sides: copies of one image meet as a group, after the join.
    """
    if not 0 <= within <= 15:
        raise ValueError("within is from 0 to 15 bits")
    flips = [0]
    for r in range(1, within // 4 + 1):
        flips += [sum(1 << b for b in bits) for bits in itertools.combinations(range(16), r)]
    chunk = lambda i: F.shiftrightunsigned("phash", 16 * i).bitwiseAND(F.lit(0xFFFF)).cast("int")
    one = hashes.select("split", "phash").distinct()
    key = F.explode(F.array(*(F.struct(F.lit(i).alias("chunk"), chunk(i).alias("part")) for i in range(4)))).alias("k")
    keyed = one.select("split", "phash", key).select("split", "phash", "k.*")
    near = keyed.withColumn("part", F.explode(F.transform(F.array(*(F.lit(x) for x in flips)), lambda x: x.bitwiseXOR(F.col("part")))))
    a, b = keyed.select(F.col("split").alias("_sa"), F.col("phash").alias("_pa"), "chunk", "part"), near.select(F.col("split").alias("_sb"), F.col("phash").alias("_pb"), "chunk", "part")
    met = a.join(b, ["chunk", "part"]).where("_sa < _sb").select("_sa", "_pa", "_sb", "_pb", F.bit_count(F.col("_pa").bitwiseXOR(F.col("_pb"))).alias("distance")).where(F.col("distance") <= within).distinct()
    named = lambda s, p, name: hashes.select(F.col("split").alias(s), F.col("phash").alias(p), F.col("image_id").alias(name))
    return met.join(named("_sa", "_pa", "a"), ["_sa", "_pa"]).join(named("_sb", "_pb", "b"), ["_sb", "_pb"]).select("a", "b", "distance")


def overlap_class(in_train: Column, in_valid: Column, in_test: Column, unresolved: Column) -> Column:
    """TH1: in none; TH2: in test only; TH3: in train or valid; unresolved if a review is open."""
    return F.when(unresolved > 0, "unresolved").when(in_train + in_valid > 0, "TH3").when(in_test > 0, "TH2").otherwise("TH1")

"""Evidence documents of a diagnosis and its recommendations: assembly, checks, score-free views, template texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot, joined_vi, percent_score, sigmoid, vector_sum

#: Tolerances of the identities that a document must keep.
DELTA_TOLERANCE, GAP_TOLERANCE = 1e-5, 1e-7
# Vietnamese names of the classes.
CATEGORY_VI = {"TOP": "áo trên", "BOTTOM": "quần hoặc váy dưới", "DRESS": "váy liền", "OUTERWEAR": "áo khoác", "SHOES": "giày", "BAG": "túi", "HAT": "mũ"}
# Disclosures of each document, and the one for outfits of three items.
LIMITATIONS = ("recommendation_not_implemented", "compatibility_logit_is_not_probability", "vlm_visual_observations_are_inferences")
EXTRAPOLATION = "loo_uses_two_item_extrapolation"
# Closed vocabularies of visual analyses.
DIMENSIONS = ("color_harmony", "pattern_coherence", "silhouette_balance", "formality_alignment", "style_coherence")
CONFIDENCES = ("low", "medium", "high")
LOO_EFFECTS = ("supports_loo", "ambiguous", "contradicts_loo")
RECOMMENDATION_EFFECTS = ("supports_recommendation", "ambiguous", "contradicts_recommendation")
# What a recommendation section states of itself.
SECTION = {"status": "available", "version": "category-aware-hybrid-v2", "ranking_semantics": "frozen_scorer_descending_compatibility_logit", "score_semantics": "uncalibrated_logits_not_probabilities"}
# Codes of refused requests, in the order of tests.
REQUEST_CODES = ("insufficient_garments", "too_many_garments", "missing_embedding", "missing_category", "invalid_embedding_shape", "non_finite_embedding", "embedding_not_l2_normalized", "invalid_category", "duplicate_item_id")
NORM_TOLERANCE = 1e-3


def named_vi(coarse: Column) -> Column:
    out = coarse
    for k, v in CATEGORY_VI.items():
        out = F.when(coarse == k, v).otherwise(out)
    return out


def documents(ranked: DataFrame, classes: DataFrame) -> DataFrame:
    """One document per outfit: ranked_items by rank, the problem item, the gap of the first two, extrapolation.

    ranked: sample_id, n_items, full_logit, rank, position, item_id, logit_without, delta (leave_one_out); classes: item_id, coarse.
    Nothing of the swap that made a negative goes in.
    """
    row = F.struct("rank", F.col("position").alias("item_index"), "item_id", F.col("coarse").alias("coarse_category"), F.col("logit_without").alias("without_item_logit"), F.col("delta").alias("loo_delta"))
    df = ranked.join(classes.select("item_id", "coarse"), "item_id", "left")
    return _documents(df.groupBy("sample_id", "n_items", "full_logit").agg(F.array_sort(F.collect_list(row)).alias("ranked_items")))


def documents_of(found: DataFrame, classes: Column, *keep: str) -> DataFrame:
    """documents() from the rows of scoring.diagnosed(), with keep, without a shuffle; classes: a map of coarse_id to class."""
    row = lambda x, i: F.struct((i + 1).alias("rank"), x["position"].alias("item_index"), x["item_id"].alias("item_id"), F.get(F.map_values(F.map_filter(classes, lambda k, _: k == x["coarse_id"])), F.lit(0)).alias("coarse_category"), x["logit_without"].alias("without_item_logit"), x["delta"].alias("loo_delta"))
    return _documents(found.withColumn("ranked_items", F.transform("ranked", row)), *keep)


def _documents(df: DataFrame, *keep: str) -> DataFrame:
    one, two = F.get("ranked_items", F.lit(0)), F.get("ranked_items", F.lit(1))
    return df.select("sample_id", "n_items", "full_logit", "ranked_items", one["item_index"].alias("problematic_item_index"), one["item_id"].alias("problematic_item_id"), one["coarse_category"].alias("problematic_category"), (one["loo_delta"] - F.coalesce(two["loo_delta"], one["loo_delta"])).alias("top1_top2_delta_gap"), (F.col("n_items") == 3).alias("uses_two_item_extrapolation"), *keep)


def document_rules() -> dict[str, Column]:
    """Code and test of each rule over the columns of documents(): counts, permutation, order by (delta descending, index), identities."""
    items = F.col("ranked_items")
    place = F.transform(items, lambda r: r["item_index"].cast("int"))
    sorted_items = F.array_sort(F.transform(items, lambda r: F.struct((-r["loo_delta"]).alias("less"), r["item_index"].cast("int").alias("i"))))
    return {
        "item_count_out_of_range": ~F.col("n_items").between(3, 8),
        "ranking_length": F.size(items) != F.col("n_items"),
        "ranking_not_a_permutation": F.array_sort(place) != F.transform(F.sequence(F.lit(0), F.col("n_items") - 1), lambda i: i.cast("int")),
        "ranking_order": F.transform(sorted_items, lambda r: r["i"]) != place,
        "unknown_category": F.exists(items, lambda r: r["coarse_category"].isNull() | ~r["coarse_category"].isin(*CATEGORY_VI)),
        "delta_identity": F.exists(items, lambda r: F.abs(r["without_item_logit"] - F.col("full_logit") - r["loo_delta"]) > DELTA_TOLERANCE),
        "gap_identity": F.abs(F.get(items, F.lit(0))["loo_delta"] - F.get(items, F.lit(1))["loo_delta"] - F.col("top1_top2_delta_gap")) > GAP_TOLERANCE,
        "problem_not_first": F.get(items, F.lit(0))["item_index"] != F.col("problematic_item_index"),
        "extrapolation_flag": F.col("uses_two_item_extrapolation") != (F.col("n_items") == 3),
    }


def document_issues(docs: DataFrame) -> DataFrame:
    """sample_id, code of documents that break a rule."""
    return _found(docs, "sample_id", document_rules())


def limitations(extrapolates: Column) -> Column:
    base = F.array(*(F.lit(x) for x in LIMITATIONS))
    return F.when(extrapolates, F.concat(base, F.array(F.lit(EXTRAPOLATION)))).otherwise(base)


def explained(docs: DataFrame) -> DataFrame:
    """sample_id, headline, summary, note, limitations from templates only."""
    first = F.get("ranked_items", F.lit(0))
    headline = F.concat(F.lit("Món "), F.col("problematic_item_index").cast("string"), F.lit(" ("), named_vi(F.col("problematic_category")), F.lit(") đứng đầu khi bỏ lần lượt từng món."))
    summary = F.format_string("Khi bỏ món %d, logit đổi từ %.4f thành %.4f.", F.col("problematic_item_index").cast("int"), F.col("full_logit"), first["without_item_logit"])
    others = F.transform(F.slice("ranked_items", 2, 8), lambda r: named_vi(r["coarse_category"]))
    return docs.select("sample_id", headline.alias("headline"), summary.alias("summary"), F.concat(F.lit("So với "), joined_vi(others)).alias("context"), F.array_join(limitations(F.col("uses_two_item_extrapolation")), ",").alias("limitations"))


def prompt_context(docs: DataFrame) -> DataFrame:
    """A view without scores: the items by index, the problem item, what must be disclosed."""
    items = F.array_sort(F.transform("ranked_items", lambda r: F.struct(r["item_index"].alias("item_index"), r["item_id"].alias("item_id"), r["coarse_category"].alias("coarse_category"))))
    return docs.select("sample_id", items.alias("items"), "problematic_item_index", limitations(F.col("uses_two_item_extrapolation")).alias("limitations"))


def _found(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    broken = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules.items()))
    return df.select(key, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("code"))


def recommendation_issues(recommendations: DataFrame, *, tolerance: float = 1e-5, count: int = 3) -> DataFrame:
    """query_id, code of rows that break one of recommended_rules()."""
    return _found(recommendations, "query_id", recommended_rules(tolerance=tolerance, count=count))


def recommended_rules(*, tolerance: float = 1e-5, count: int = 3) -> dict[str, Column]:
    """Code and test of each rule over outfit_ids, problem_coarse, baseline, rows (rank, item_id, master, coarse, logit, improvement); of
    scorer_ids, the reranked order, the first must be those of rows."""
    rows = F.col("rows")
    ids = F.transform(rows, lambda r: r["item_id"])
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    place = F.transform(rows, lambda r: F.struct((-r["logit"]).alias("less"), r["item_id"].alias("id")))
    return {
        "not_exactly_three_items": rows.isNull() | (F.size(rows) != count),
        "rank_sequence": F.transform(rows, lambda r: r["rank"].cast("int")) != F.transform(F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1))), lambda i: i.cast("int")),
        "blank_field": F.exists(rows, lambda r: blank(r["item_id"]) | blank(r["master"]) | blank(r["coarse"])),
        "repeated_item": F.size(F.array_distinct(ids)) != F.size(ids),
        "item_of_the_outfit": F.arrays_overlap(ids, "outfit_ids"),
        "other_than_reranked": F.slice("scorer_ids", 1, count) != ids,
        "unknown_category": F.exists(rows, lambda r: ~F.upper(r["coarse"]).isin(*CATEGORY_VI)),
        "other_category": F.exists(rows, lambda r: F.upper(r["coarse"]) != F.col("problem_coarse")),
        "logit_not_finite": F.exists(rows, lambda r: bad(r["logit"]) | bad(r["improvement"])),
        "improvement_identity": F.exists(rows, lambda r: F.abs(r["logit"] - F.col("baseline") - r["improvement"]) > tolerance),
        "order": F.array_sort(place) != place,
    }


def recommendation_sections(recommendations: DataFrame) -> DataFrame:
    """query_id, section (JSON): the recommendation section of an evidence document, scores included, and public (JSON): its items without
    scores. recommendations: query_id, problem, problem_id, rows as recommendation_issues() takes them; rows that break a rule there have no section."""
    bad = recommendation_issues(recommendations).select("query_id").distinct()
    fine = recommendations.join(bad, "query_id", "left_anti")
    shown = lambda r: [r["rank"].cast("int").alias("rank"), r["item_id"].alias("item_id"), r["master"].alias("master_category"), F.upper(r["coarse"]).alias("coarse_category")]
    scored = F.transform("rows", lambda r: F.struct(*shown(r), r["logit"].alias("compatibility_logit"), r["improvement"].alias("improvement_logit")))
    fixed = {k: F.lit(v).alias(k) for k, v in SECTION.items()}
    section = F.struct(fixed["status"], fixed["version"], F.col("problem").cast("int").alias("problematic_item_index"), F.col("problem_id").alias("problematic_item_id"), fixed["ranking_semantics"], fixed["score_semantics"], scored.alias("items"))
    public = F.struct(F.lit("ok").alias("status"), F.lit(SECTION["version"]).alias("recommendation_version"), F.transform("rows", lambda r: F.struct(*shown(r))).alias("items"))
    return fine.select("query_id", F.to_json(section).alias("section"), F.to_json(public).alias("public"))


def _vocabulary(obs: Column, effects: tuple[str, ...], prefix: str) -> dict[str, Column]:
    out = lambda field, allowed: F.exists(obs, lambda o: ~F.coalesce(o[field].isin(*allowed), F.lit(False)))
    return {f"{prefix}_dimension": out("dimension", DIMENSIONS), f"{prefix}_effect": out("effect", effects), f"{prefix}_confidence": out("confidence", CONFIDENCES)}


def _support(overall: Column, obs: Column, effects: tuple[str, ...], prefix: str) -> dict[str, Column]:
    """An overall label other than ambiguous needs an observation of the same effect."""
    has = lambda e: F.exists(obs, lambda o: o["effect"] == e)
    yes, _, no = effects
    return {
        f"{prefix}_overall": ~F.coalesce(overall.isin(*effects), F.lit(False)),
        f"{prefix}_overall_without_observations": (F.size(obs) == 0) & (overall != "ambiguous"),
        f"{prefix}_support_without_observation": (F.size(obs) > 0) & (overall == yes) & ~has(yes),
        f"{prefix}_contradiction_without_observation": (F.size(obs) > 0) & (overall == no) & ~has(no),
    }


def diagnosis_rules(n_items: Column, problem: Column, overall: Column, obs: Column, *, least: int = 1) -> dict[str, Column]:
    """Rules of the observations of a diagnosis: item_indices (least of them, the problem item's among them), dimension, effect, confidence."""
    i = lambda o: o["item_indices"]
    return {
        "diagnosis_too_many_observations": obs.isNull() | (F.size(obs) > n_items),
        "diagnosis_index_count": F.exists(obs, lambda o: i(o).isNull() | (F.size(i(o)) < least) | (F.size(i(o)) > n_items)),
        "diagnosis_unknown_item": F.exists(obs, lambda o: F.exists(i(o), lambda x: x.isNull() | (x < 0) | (x >= n_items))),
        "diagnosis_repeated_index": F.exists(obs, lambda o: F.size(F.array_distinct(i(o))) != F.size(i(o))),
        "diagnosis_without_problem_item": F.exists(obs, lambda o: ~F.array_contains(i(o), problem)),
        **_vocabulary(obs, LOO_EFFECTS, "diagnosis"),
        **_support(overall, obs, LOO_EFFECTS, "diagnosis"),
    }


def recommendation_rules(n_items: Column, problem: Column, recs: Column) -> dict[str, Column]:
    """Rules of three analyses of recommendations: rank, overall, observations (context_item_indices, never the problem item's)."""
    i = lambda o: o["context_item_indices"]
    any_obs = lambda f: F.exists(recs, lambda r: F.exists(r["observations"], f))
    each = lambda rules: {k: F.exists(recs, lambda r: F.coalesce(rules(r)[k], F.lit(False))) for k in rules(F.get(recs, F.lit(0)))}
    return {
        "recommendations_not_three": recs.isNull() | (F.size(recs) != 3),
        "recommendation_rank": F.transform(recs, lambda r: r["rank"].cast("int")) != F.array(F.lit(1), F.lit(2), F.lit(3)),
        "recommendation_too_many_observations": F.exists(recs, lambda r: r["observations"].isNull() | (F.size(r["observations"]) > n_items - 1)),
        "recommendation_index_count": any_obs(lambda o: i(o).isNull() | (F.size(i(o)) == 0) | (F.size(i(o)) > n_items - 1)),
        "recommendation_outside_context": any_obs(lambda o: F.exists(i(o), lambda x: x.isNull() | (x < 0) | (x >= n_items) | (x == problem))),
        "recommendation_repeated_index": any_obs(lambda o: F.size(F.array_distinct(i(o))) != F.size(i(o))),
        **each(lambda r: _vocabulary(r["observations"], RECOMMENDATION_EFFECTS, "recommendation")),
        **each(lambda r: _support(r["overall"], r["observations"], RECOMMENDATION_EFFECTS, "recommendation")),
        "cloned_recommendations": cloned(recs),
    }


def cloned(recs: Column) -> Column:
    """Whether three analyses are equal in overall and observations, not ambiguous, with observations all of high confidence."""
    signature = F.transform(recs, lambda r: F.to_json(F.struct(r["overall"].alias("overall"), r["observations"].alias("observations"))))
    first = F.get(recs, F.lit(0))
    sure = (F.size(first["observations"]) > 0) & F.forall(first["observations"], lambda o: o["confidence"] == "high")
    return (F.size(recs) == 3) & (F.size(F.array_distinct(signature)) == 1) & (first["overall"] != "ambiguous") & sure


def analysis_issues(analyses: DataFrame, *, version: str = "vlm-visual-analysis-v1") -> DataFrame:
    """sample_id, code of analyses of a diagnosis. analyses: sample_id, n_items, problem, problem_id, uses_two_item_extrapolation as the
    evidence has them, and schema_version, out_index, out_id, overall, observations, limitations as the analysis states them."""
    c = F.col
    return _found(analyses, "sample_id", {
        "schema_version": ~c("schema_version").eqNullSafe(F.lit(version)),
        "changed_problem_index": ~c("out_index").eqNullSafe(c("problem")),
        "changed_problem_id": ~c("out_id").eqNullSafe(c("problem_id")),
        **diagnosis_rules(c("n_items"), c("problem"), c("overall"), c("observations")),
        "limitations": ~c("limitations").eqNullSafe(limitations(c("uses_two_item_extrapolation"))),
    })


def analysis_issues_v2(analyses: DataFrame) -> DataFrame:
    """sample_id, code of analyses of a diagnosis and its three recommendations. analyses: sample_id, n_items, problem, overall,
    observations (two items at least), recommendations (rank, overall, observations)."""
    c = F.col
    return _found(analyses, "sample_id", diagnosis_rules(c("n_items"), c("problem"), c("overall"), c("observations"), least=2) | recommendation_rules(c("n_items"), c("problem"), c("recommendations")))


def request_errors(requests: DataFrame, dim: int, *, least: int = 3, most: int = 8, tolerance: float = NORM_TOLERANCE) -> DataFrame:
    """Adds error_code, the first of REQUEST_CODES that a request breaks, else null, and error_index, the item that breaks it where one does.

    requests: request_id, items (struct item_id, coarse_category_id, embedding; null item_id: by place).
    """
    items, n = F.col("items"), F.coalesce(F.size("items"), F.lit(0))
    norms = F.transform(items, lambda x: F.sqrt(F.aggregate(x["embedding"], F.lit(0.0), lambda s, y: s + y * y)))
    first = lambda f: F.get(F.filter(F.transform(items, lambda x, i: F.when(F.coalesce(f(x), F.lit(False)), i)), lambda i: i.isNotNull()), F.lit(0))
    df = requests.withColumn("_norms", norms)
    lacks = first(lambda x: x["embedding"].isNull() | x["coarse_category_id"].isNull())
    unit = F.get(F.filter(F.transform("_norms", lambda v, i: F.when(F.abs(v - 1.0) > tolerance, i)), lambda i: i.isNotNull()), F.lit(0))
    ids = F.transform(items, lambda x, i: F.coalesce(x["item_id"].cast("string"), F.concat(F.lit("item-"), i.cast("string"))))
    df = df.withColumns({"_lacks": lacks, "_unit": unit})
    code = F.when(n < least, REQUEST_CODES[0]).when(n > most, REQUEST_CODES[1])
    code = code.when(F.get(items, F.col("_lacks"))["embedding"].isNull() & F.col("_lacks").isNotNull(), REQUEST_CODES[2]).when(F.col("_lacks").isNotNull(), REQUEST_CODES[3])
    code = code.when(F.exists(items, lambda x: F.size(x["embedding"]) != dim), REQUEST_CODES[4])
    code = code.when(F.exists(items, lambda x: F.exists(x["embedding"], lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))), REQUEST_CODES[5])
    code = code.when(F.col("_unit").isNotNull(), REQUEST_CODES[6]).when(F.exists(items, lambda x: ~x["coarse_category_id"].between(1, 7)), REQUEST_CODES[7])
    code = code.when(F.size(F.array_distinct(ids)) != n, REQUEST_CODES[8])
    df = df.withColumn("error_code", code)
    at = F.when(F.col("error_code").isin(*REQUEST_CODES[2:4]), F.col("_lacks")).when(F.col("error_code") == REQUEST_CODES[6], F.col("_unit"))
    return df.withColumn("error_index", at).drop("_norms", "_lacks", "_unit")


def analysed(requests: DataFrame, dim: int, *, scale: float, bias: float, digits: int = 9) -> DataFrame:
    """The record of each request: request_id, status, error (code, item_index, item_count), compatibility (logit, score),
    diagnosis (problematic_item_index, problematic_item_id, ranked_item_indices, deltas_without_minus_full, uses_two_item_extrapolation).

    Scored, calibrated and diagnosed in one pass over each row by the stand-in scorer: no join, no shuffle.
    """
    df = request_errors(requests, dim)
    fine = F.col("error_code").isNull()
    vectors = F.when(fine, F.transform("items", lambda x: F.transform(x["embedding"], lambda y: y.cast("double"))))
    n, pairs = F.size("items"), lambda k: k * (k - 1) / F.lit(2.0)
    df = df.withColumn("_v", vectors).withColumn("_t", vector_sum(F.col("_v"), dim))
    df = df.withColumn("_p", (dot(F.col("_t"), F.col("_t")) - F.aggregate("_v", F.lit(0.0), lambda s, v: s + dot(v, v))) / F.lit(2.0))
    df = df.withColumn("_logit", F.col("_p") / pairs(n))
    df = df.withColumn("_deltas", F.transform("_v", lambda v: F.round((F.col("_p") - (dot(v, F.col("_t")) - dot(v, v))) / pairs(n - 1) - F.col("_logit"), digits)))
    order = F.transform(F.array_sort(F.transform("_deltas", lambda x, i: F.struct((-x).alias("less"), i.alias("i")))), lambda x: x["i"])
    df = df.withColumn("_order", F.when(fine, order))
    worst = F.get("_order", F.lit(0))
    named = F.coalesce(F.get("items", worst)["item_id"].cast("string"), F.concat(F.lit("item-"), worst.cast("string")))
    return df.select(
        "request_id", F.when(fine, "ok").otherwise("error").alias("status"),
        F.when(~fine, F.struct(F.col("error_code").alias("code"), F.col("error_index").alias("item_index"), F.coalesce(n, F.lit(0)).alias("item_count"))).alias("error"),
        F.when(fine, F.struct(F.col("_logit").alias("compatibility_logit"), percent_score(sigmoid(F.col("_logit") * F.lit(scale) + F.lit(bias))).alias("compatibility_score"))).alias("compatibility"),
        F.when(fine, F.struct(worst.alias("problematic_item_index"), named.alias("problematic_item_id"), F.col("_order").alias("ranked_item_indices"), F.col("_deltas").alias("deltas_without_minus_full"), (n == 3).alias("uses_two_item_extrapolation"))).alias("diagnosis"),
    )

"""Queries of evidence documents, detections, hashes and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as texts
from ..functions.scalars import expanded_box, image_url, joined_vi, label_text, media_type, sentence_case
from ..operators import clean, detection, evidence
from . import agreement, retrieval
from . import domain as d
from .agreement import rounded
from .domain import query


def docs(spark: SparkSession, sf: str, split: str | None = None) -> DataFrame:
    return evidence.documents_of(agreement.diagnosed(spark, sf, split), classes())


def classes() -> Column:
    return F.create_map(*(F.lit(x) for name, number in clean.CATEGORY_IDS.items() for x in (number, name)))


@query("evidence_documents", """SELECT l.sample_id, any_value(l.n_items)::INTEGER AS n_items, max(CASE WHEN rank = 1 THEN position END)::INTEGER AS problematic_item_index, max(CASE WHEN rank = 1 THEN item_id END) AS problematic_item_id, max(CASE WHEN rank = 1 THEN coarse END) AS problematic_category,
  round(max(CASE WHEN rank = 1 THEN delta END) - max(CASE WHEN rank = 2 THEN delta END), 6) + 0.0 AS top1_top2_delta_gap, any_value(l.n_items) = 3 AS uses_two_item_extrapolation, string_agg(position, ',' ORDER BY rank) AS ranking FROM loo l JOIN core USING (item_id) WHERE sample_id LIKE '%_neg_1' GROUP BY 1""", "loo", "core")
def evidence_documents(spark: SparkSession, sf: str) -> DataFrame:
    x = docs(spark, sf).withColumn("ranking", F.array_join(F.transform("ranked_items", lambda r: r["item_index"].cast("string")), ","))
    return rounded(x.drop("ranked_items", "full_logit"))


@query("evidence_issues", """SELECT code, count(*) AS n FROM (SELECT unnest(CASE WHEN r = 1 THEN ['delta_identity'] WHEN r = 2 THEN ['gap_identity'] WHEN r = 3 THEN ['problem_not_first'] WHEN r = 4 THEN ['extrapolation_flag'] ELSE [] END) AS code FROM (SELECT source_kit_id::BIGINT % 30 AS r FROM records WHERE label = 0)
  UNION ALL SELECT 'item_count_out_of_range' FROM records WHERE label = 0 AND len(ids) > 8) GROUP BY code""", "records")
def evidence_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The document validator over documents with one fault for each of a few residues of the kit number."""
    r = F.expr("cast(replace(sample_id, '_neg_1', '') as bigint)") % 30
    bad = docs(spark, sf).withColumns({
        "full_logit": F.when(r == 1, F.col("full_logit") + 1.0).otherwise(F.col("full_logit")), "top1_top2_delta_gap": F.when(r == 2, F.col("top1_top2_delta_gap") + 1.0).otherwise(F.col("top1_top2_delta_gap")),
        "problematic_item_index": F.when(r == 3, F.col("problematic_item_index") + 1).otherwise(F.col("problematic_item_index")), "uses_two_item_extrapolation": F.when(r == 4, ~F.col("uses_two_item_extrapolation")).otherwise(F.col("uses_two_item_extrapolation")),
    })
    return evidence.document_issues(bad).groupBy("code").agg(F.count("*").alias("n"))


VI = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in evidence.CATEGORY_VI.items())


@query("explanations", f"""SELECT sample_id, 'Món ' || max(CASE WHEN rank = 1 THEN position END) || ' (' || max(CASE WHEN rank = 1 THEN CASE coarse {VI} END END) || ') đứng đầu khi bỏ lần lượt từng món.' AS headline,
  'recommendation_not_implemented,compatibility_logit_is_not_probability,vlm_visual_observations_are_inferences' || CASE WHEN any_value(n_items) = 3 THEN ',loo_uses_two_item_extrapolation' ELSE '' END AS limitations FROM loo JOIN core USING (item_id) WHERE sample_id LIKE '%_neg_1' GROUP BY 1""", "loo", "core")
def explanations(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.explained(docs(spark, sf)).select("sample_id", "headline", "limitations")


@query("prompt_contexts", "SELECT sample_id, max(CASE WHEN rank = 1 THEN position END)::INTEGER AS problematic_item_index, string_agg(coarse, ',' ORDER BY position) AS categories FROM loo JOIN core USING (item_id) WHERE sample_id LIKE '%_neg_1' GROUP BY 1", "loo", "core")
def prompt_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.prompt_context(docs(spark, sf)).select("sample_id", "problematic_item_index", F.array_join("items.coarse_category", ",").alias("categories"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Each kit's vectors as one request, with one fault for each of a few residues of the kit number."""
    iv = d.item_vectors(spark, sf).join(d.core(spark, sf).select("item_id", "kit_id", "slot"), "item_id")
    entry = F.struct(F.col("slot").isNull().alias("none"), F.coalesce("slot", F.lit(0)).alias("slot"), "item_id", F.col("coarse_id").alias("coarse_category_id"), F.col("v").alias("embedding"))
    o = iv.groupBy(F.col("kit_id").alias("request_id")).agg(F.array_sort(F.collect_list(entry)).alias("items"))
    r = F.col("request_id").cast("long") % 30
    nan = lambda v: F.concat(F.array(F.lit(float("nan"))), F.slice(v, 2, 63))
    v = lambda x, i: F.when((r == 1) & (i == 1), None).when((r == 3) & (i == 0), F.slice(x["embedding"], 1, 63)).when((r == 4) & (i == 0), nan(x["embedding"])).when((r == 5) & (i == 2), F.transform(x["embedding"], lambda y: y * F.lit(2.0))).otherwise(x["embedding"])
    c = lambda x, i: F.when((r == 2) & (i == 0), None).when((r == 6) & (i == 0), 9).otherwise(x["coarse_category_id"])
    name = lambda x, i: F.when((r == 7) & (i < 2), "same").when((r == 8) & (i == 0), None).otherwise(x["item_id"])
    return o.select("request_id", F.transform("items", lambda x, i: F.struct(name(x, i).alias("item_id"), c(x, i).alias("coarse_category_id"), v(x, i).alias("embedding"))).alias("items"))


REQUESTS = """req AS (SELECT kit_id AS request_id, kit_id::BIGINT % 30 AS r, item_id, v, row_number() OVER (PARTITION BY kit_id ORDER BY slot NULLS LAST, item_id) - 1 AS pos, count(*) OVER (PARTITION BY kit_id) AS n FROM itemvec JOIN core USING (item_id)),
err AS (SELECT request_id, any_value(n) AS n, CASE WHEN any_value(n) < 3 THEN 'insufficient_garments' WHEN any_value(n) > 8 THEN 'too_many_garments' WHEN any_value(r) BETWEEN 1 AND 7 THEN ['missing_embedding', 'missing_category', 'invalid_embedding_shape', 'non_finite_embedding', 'embedding_not_l2_normalized', 'invalid_category', 'duplicate_item_id'][any_value(r)] END AS code FROM req GROUP BY 1)"""


@query("request_errors", f"""SELECT * FROM (WITH {REQUESTS} SELECT request_id, CASE WHEN code IS NULL THEN 'ok' ELSE 'error' END AS status, code, CASE code WHEN 'missing_embedding' THEN 1 WHEN 'missing_category' THEN 0 WHEN 'embedding_not_l2_normalized' THEN 2 END AS item_index, CASE WHEN code IS NOT NULL THEN n END::INTEGER AS item_count FROM err)""", "itemvec", "core")
def request_errors(spark: SparkSession, sf: str) -> DataFrame:
    a = evidence.analysed(requests(spark, sf), d.DIM, scale=agreement.SCALE, bias=agreement.BIAS)
    return a.select("request_id", "status", "error.code", "error.item_index", "error.item_count")


@query("request_analyses", f"""SELECT * FROM (WITH {REQUESTS}, cp AS (SELECT a.request_id, a.n, a.pos AS i, b.pos AS j, list_inner_product(a.v, b.v) AS c FROM req a JOIN req b ON a.request_id = b.request_id AND a.pos < b.pos JOIN err ON err.request_id = a.request_id AND err.code IS NULL),
  f AS (SELECT request_id, any_value(n) AS n, sum(c) AS t, avg(c) AS s FROM cp GROUP BY 1), o AS (SELECT request_id, pos, sum(c) AS t FROM (SELECT request_id, i AS pos, c FROM cp UNION ALL SELECT request_id, j, c FROM cp) GROUP BY ALL),
  l AS (SELECT f.request_id, f.n, f.s, o.pos, row_number() OVER (PARTITION BY f.request_id ORDER BY round((f.t - o.t) / ((f.n - 1) * (f.n - 2) / 2.0) - f.s, 9) DESC, o.pos) AS rank FROM f JOIN o USING (request_id))
  SELECT l.request_id, round(any_value(s) + 1e-11, 6) AS compatibility_logit, greatest(0, least(100, floor(100 / (1 + exp(-({agreement.SCALE} * any_value(s) + {agreement.BIAS}))) + 0.5)))::INTEGER AS compatibility_score, max(CASE WHEN rank = 1 THEN l.pos END)::INTEGER AS problematic_item_index,
    max(CASE WHEN rank = 1 THEN CASE WHEN r = 8 AND l.pos = 0 THEN 'item-0' ELSE item_id END END) AS problematic_item_id, string_agg(l.pos, ',' ORDER BY rank) AS ranking, any_value(l.n) = 3 AS uses_two_item_extrapolation FROM l JOIN req ON req.request_id = l.request_id AND req.pos = l.pos GROUP BY 1)""", "itemvec", "core")
def request_analyses(spark: SparkSession, sf: str) -> DataFrame:
    a = evidence.analysed(requests(spark, sf), d.DIM, scale=agreement.SCALE, bias=agreement.BIAS).where("status = 'ok'")
    g = F.col("diagnosis")
    return a.select("request_id", F.round(F.col("compatibility.compatibility_logit") + F.lit(1e-11), 6).alias("compatibility_logit"), "compatibility.compatibility_score", g["problematic_item_index"].alias("problematic_item_index"), g["problematic_item_id"].alias("problematic_item_id"), F.array_join(F.transform(g["ranked_item_indices"], lambda i: i.cast("string")), ",").alias("ranking"), g["uses_two_item_extrapolation"].alias("uses_two_item_extrapolation"))


def kit_number(column: str = "sample_id"):
    return F.replace(F.col(column), F.lit("_neg_1"), F.lit("")).cast("long")


def analyses(spark: SparkSession, sf: str) -> DataFrame:
    """What a model might say of each diagnosis: one observation of the problem item and the next, three recommendations with one each."""
    x = docs(spark, sf).select("sample_id", "n_items", F.col("problematic_item_index").alias("problem"), F.col("problematic_item_id").alias("problem_id"), "uses_two_item_extrapolation")
    n, p = F.col("n_items"), F.col("problem").cast("int")
    after = ((p + 1) % n).cast("int")
    obs = lambda field, ids, effect, sure="high": F.struct(ids.alias(field), F.lit("color_harmony").alias("dimension"), F.lit(effect).alias("effect"), F.lit(sure).alias("confidence"))
    rec = lambda k, sure: F.struct(F.lit(k).alias("rank"), F.lit("supports_recommendation").alias("overall"), F.array(obs("context_item_indices", F.array(after), "supports_recommendation", sure)).alias("observations"))
    return x.withColumns({
        "problem": p, "schema_version": F.lit("vlm-visual-analysis-v1"), "out_index": p, "out_id": F.col("problem_id"), "overall": F.lit("supports_loo"), "observations": F.array(obs("item_indices", F.array(p, after), "supports_loo")),
        "limitations": evidence.limitations(F.col("uses_two_item_extrapolation")), "recommendations": F.array(rec(1, "high"), rec(2, "low"), rec(3, "high")), "r": kit_number() % 60,
    })


def _swap(df: DataFrame, column: str, faults: dict[int, object]) -> DataFrame:
    out = F.col(column)
    for r, value in faults.items():
        out = F.when(F.col("r") == r, value).otherwise(out)
    return df.withColumn(column, out)


@query("analysis_issues", """SELECT code, count(*) AS n FROM (SELECT unnest(CASE r WHEN 1 THEN ['schema_version'] WHEN 2 THEN ['changed_problem_index'] WHEN 3 THEN ['changed_problem_id'] WHEN 4 THEN ['limitations'] WHEN 5 THEN ['diagnosis_overall'] WHEN 6 THEN ['diagnosis_overall_without_observations']
    WHEN 7 THEN ['diagnosis_support_without_observation'] WHEN 8 THEN ['diagnosis_contradiction_without_observation'] WHEN 9 THEN ['diagnosis_too_many_observations'] WHEN 10 THEN ['diagnosis_index_count', 'diagnosis_without_problem_item'] WHEN 11 THEN ['diagnosis_unknown_item'] WHEN 12 THEN ['diagnosis_repeated_index']
    WHEN 13 THEN ['diagnosis_without_problem_item'] WHEN 14 THEN ['diagnosis_dimension'] WHEN 15 THEN ['diagnosis_effect', 'diagnosis_support_without_observation'] WHEN 16 THEN ['diagnosis_confidence'] END) AS code FROM (SELECT source_kit_id::BIGINT % 60 AS r FROM records WHERE label = 0)) GROUP BY code""", "records")
def analysis_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Analyses of a diagnosis with one fault for each of a few residues of the kit number."""
    x, one = analyses(spark, sf), F.get("observations", F.lit(0))
    with_field = lambda f, v: F.array(one.withField(f, v))
    i = one["item_indices"]
    x = _swap(x, "observations", {
        6: F.slice("observations", 1, 0), 7: with_field("effect", F.lit("ambiguous")), 9: F.array_repeat(one, F.col("n_items").cast("int") + 1), 10: with_field("item_indices", F.slice(i, 1, 0)), 11: with_field("item_indices", F.concat(i, F.array(F.col("n_items").cast("int")))),
        12: with_field("item_indices", F.concat(i, F.slice(i, 1, 1))), 13: with_field("item_indices", F.slice(i, 2, 1)), 14: with_field("dimension", F.lit("taste")), 15: with_field("effect", F.lit("likes")), 16: with_field("confidence", F.lit("sure")),
    })
    x = _swap(_swap(_swap(_swap(_swap(x, "schema_version", {1: F.lit("v0")}), "out_index", {2: F.col("problem") + 1}), "out_id", {3: F.lit("x")}), "limitations", {4: F.array(F.lit("x"))}), "overall", {5: F.lit("good"), 8: F.lit("contradicts_loo")})
    return evidence.analysis_issues(x).groupBy("code").agg(F.count("*").alias("n"))


@query("analysis_issues_v2", """SELECT code, count(*) AS n FROM (SELECT unnest(CASE r WHEN 1 THEN ['recommendations_not_three', 'recommendation_rank'] WHEN 2 THEN ['recommendation_rank'] WHEN 3 THEN ['recommendation_too_many_observations'] WHEN 4 THEN ['recommendation_index_count'] WHEN 5 THEN ['recommendation_outside_context']
    WHEN 6 THEN ['recommendation_repeated_index'] WHEN 7 THEN ['recommendation_dimension'] WHEN 8 THEN ['recommendation_effect', 'recommendation_support_without_observation'] WHEN 9 THEN ['recommendation_confidence'] WHEN 10 THEN ['recommendation_overall']
    WHEN 11 THEN ['recommendation_overall_without_observations'] WHEN 12 THEN ['recommendation_contradiction_without_observation'] WHEN 13 THEN ['cloned_recommendations'] WHEN 14 THEN ['diagnosis_index_count'] END) AS code FROM (SELECT source_kit_id::BIGINT % 60 AS r FROM records WHERE label = 0)) GROUP BY code""", "records")
def analysis_issues_v2(spark: SparkSession, sf: str) -> DataFrame:
    """Analyses of a diagnosis and three recommendations with one fault for each of a few residues of the kit number."""
    x, recs = analyses(spark, sf), F.col("recommendations")
    of = lambda k: F.get(recs, F.lit(k))
    one = F.get(of(0)["observations"], F.lit(0))
    first = lambda f, v: F.array(of(0).withField(f, v), of(1), of(2))
    seen = lambda f, v: first("observations", F.array(one.withField(f, v)))
    i = one["context_item_indices"]
    x = _swap(x, "recommendations", {
        1: F.slice(recs, 1, 2), 2: first("rank", F.lit(2)), 3: first("observations", F.array_repeat(one, F.col("n_items").cast("int"))), 4: seen("context_item_indices", F.slice(i, 1, 0)), 5: seen("context_item_indices", F.array("problem")), 6: seen("context_item_indices", F.concat(i, i)),
        7: seen("dimension", F.lit("taste")), 8: seen("effect", F.lit("likes")), 9: seen("confidence", F.lit("sure")), 10: first("overall", F.lit("good")), 11: first("observations", F.slice(of(0)["observations"], 1, 0)), 12: first("overall", F.lit("contradicts_recommendation")),
        13: F.array(of(0), of(0).withField("rank", F.lit(2)), of(2)),
    })
    o = F.get("observations", F.lit(0))
    x = _swap(x, "observations", {14: F.array(o.withField("item_indices", F.slice(o["item_indices"], 1, 1)))})
    return evidence.analysis_issues_v2(x).groupBy("code").agg(F.count("*").alias("n"))


def final_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """The recommended three of each query that has them, as an evidence document holds them."""
    final, known = retrieval.finals(spark, sf)
    name = F.element_at(F.create_map(*(F.lit(x) for k, v in clean.CATEGORY_IDS.items() for x in (v, k))), F.col("coarse_id"))
    top = final.join(known.select("item_id", "master", name.alias("coarse")), "item_id")
    rows = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("final_rank").alias("rank"), "item_id", "master", "coarse", "logit", "improvement"))).alias("rows")).where("size(rows) = 3")
    x = d.query_items(spark, sf).select("query_id", "problem", F.get("item_ids", F.col("problem")).alias("problem_id"), F.col("item_ids").alias("outfit_ids")).join(rows, "query_id")
    one = F.get("rows", F.lit(0))
    x = x.withColumns({"scorer_ids": F.col("rows.item_id"), "baseline": one["logit"] - one["improvement"], "r": kit_number("query_id") % 30})
    # a pool of a class may hold items of the problem's class only; a pool of a master category is made to, for this query
    return x.withColumns({"problem_coarse": one["coarse"], "rows": F.transform("rows", lambda y: y.withField("coarse", one["coarse"]))})


@query("recommendation_issues", """SELECT code, count(*) AS n FROM (SELECT unnest(CASE r WHEN 1 THEN ['rank_sequence'] WHEN 2 THEN ['not_exactly_three_items', 'other_than_reranked'] WHEN 3 THEN ['blank_field'] WHEN 4 THEN ['repeated_item', 'other_than_reranked'] WHEN 5 THEN ['item_of_the_outfit'] WHEN 6 THEN ['unknown_category', 'other_category']
    WHEN 7 THEN ['improvement_identity'] WHEN 8 THEN ['logit_not_finite', 'improvement_identity', 'order'] WHEN 9 THEN ['order'] WHEN 10 THEN ['other_category'] END) AS code FROM (SELECT replace(query_id, '_neg_1', '')::BIGINT % 30 AS r FROM ranked GROUP BY query_id HAVING count(*) >= 3)) GROUP BY code""", "ranked")
def recommendation_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Recommendations with one fault for each of a few residues of the kit number."""
    x, rows = final_recommendations(spark, sf), F.col("rows")
    of = lambda k: F.get(rows, F.lit(k))
    first = lambda **f: F.array(_fields(of(0), f), of(1), of(2))
    x = _swap(x, "outfit_ids", {5: F.array(of(0)["item_id"])})
    x = _swap(x, "problem_coarse", {10: F.lit("none")})
    x = _swap(x, "rows", {
        1: F.transform(rows, lambda y: y.withField("rank", y["rank"] + 1)), 2: F.slice(rows, 1, 2), 3: first(master=F.lit(" ")), 4: F.array(of(0), of(1), of(2).withField("item_id", of(0)["item_id"])), 6: first(coarse=F.lit("SOCKS")), 7: first(improvement=of(0)["improvement"] + 1.0),
        8: first(logit=F.lit(float("nan"))), 9: first(logit=of(0)["logit"] - 10.0, improvement=of(0)["improvement"] - 10.0),
    })
    return evidence.recommendation_issues(x).groupBy("code").agg(F.count("*").alias("n"))


CLASS_NAME = "CASE c.coarse_id WHEN 1 THEN 'TOP' WHEN 2 THEN 'BOTTOM' WHEN 3 THEN 'DRESS' WHEN 4 THEN 'OUTERWEAR' WHEN 5 THEN 'SHOES' WHEN 6 THEN 'BAG' WHEN 7 THEN 'HAT' END"


@query("recommendation_sections", f"""SELECT q.query_id, '{{"status":"ok","recommendation_version":"category-aware-hybrid-v2","items":[' || items || ']}}' AS public, 'available' AS status, q.problem::INTEGER AS position, q.item_ids[q.problem + 1] AS problem_id, round(best + 1e-11, 6) AS best_logit, round(gain + 1e-11, 6) AS best_improvement
  FROM q JOIN (SELECT query_id, string_agg('{{"rank":' || final_rank || ',"item_id":"' || item_id || '","master_category":"' || master || '","coarse_category":"' || first_class || '"}}', ',' ORDER BY final_rank) AS items, max(CASE WHEN final_rank = 1 THEN logit END) AS best, max(CASE WHEN final_rank = 1 THEN improvement END) AS gain
    FROM (SELECT r.query_id, r.item_id, r.final_rank, r.logit, r.improvement, c.master, first_value({CLASS_NAME}) OVER (PARTITION BY r.query_id ORDER BY r.final_rank) AS first_class FROM ranked r JOIN catalog c USING (item_id) WHERE final_rank <= 3) GROUP BY query_id HAVING count(*) = 3) USING (query_id)""", "q", "ranked", "catalog")
def recommendation_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Recommendation sections of evidence documents, and what the public sees of them."""
    x = evidence.recommendation_sections(final_recommendations(spark, sf))
    schema = "status string, problematic_item_index int, problematic_item_id string, items array<struct<compatibility_logit double, improvement_logit double>>"
    s = x.select("query_id", "public", F.from_json("section", schema).alias("s"))
    one = F.get("s.items", F.lit(0))
    off = lambda c: F.round(c + F.lit(1e-11), 6)
    return s.select("query_id", "public", "s.status", F.col("s.problematic_item_index").alias("position"), F.col("s.problematic_item_id").alias("problem_id"), off(one["compatibility_logit"]).alias("best_logit"), off(one["improvement_logit"]).alias("best_improvement"))


def _fields(row, values: dict):
    for k, v in values.items():
        row = row.withField(k, v)
    return row


NAMES = ["shoe", "hat"]
LABEL = r"coalesce(CASE WHEN p_size % 5 <> 0 THEN lower(trim(regexp_replace(p_type, '\s+', ' ', 'g'))) END, CASE p_size % 4 WHEN 0 THEN 'shoe' WHEN 1 THEN 'hat' END, 'unknown')"


@query("detection_candidates", f"""SELECT label, CASE WHEN label NOT IN ('shoe', (SELECT min(lower(p_type)) FROM part)) THEN 'unsupported_fashionpedia_object_type' END AS reject_reason, count(*) AS n FROM (SELECT {LABEL} AS label FROM part) GROUP BY ALL""")
def detection_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as detections: names with odd spaces, blank ones that the class id stands in for, ids without a name."""
    p = d.table(spark, sf, "part")
    one = p.agg(F.min(F.lower("p_type"))).first()[0]  # one name
    x = p.select(F.col("p_partkey").alias("image_id"), (F.col("p_size") % 4).alias("class_id"), F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.concat(F.lit("  "), "p_type")).alias("class_name"))
    return detection.candidates(x, NAMES, supported=("Shoe", one)).groupBy("label", "reject_reason").agg(F.count("*").alias("n"))


@query("detection_crops", """SELECT CASE WHEN least(r - l, b - t) < 40 THEN 'crop_too_small' END AS reject_reason, count(*) AS n, sum(r - l)::BIGINT AS width FROM (SELECT l, t, least(100, greatest(ceil(x2 + (x2 - x1) * 0.1), l + 1)) AS r, least(100, greatest(ceil(50 + 5.0), t + 1)) AS b
  FROM (SELECT *, greatest(0, least(floor(x1 - (x2 - x1) * 0.1), 99)) AS l, greatest(0, least(floor(0 - 5.0), 99)) AS t FROM (SELECT p_size::DOUBLE AS x1, p_size + p_retailprice / 50 AS x2 FROM part))) GROUP BY 1""")
def detection_crops(spark: SparkSession, sf: str) -> DataFrame:
    p = d.table(spark, sf, "part").select(F.col("p_size").cast("double").alias("x1"), F.lit(0.0).alias("y1"), (F.col("p_size") + F.col("p_retailprice") / 50).alias("x2"), F.lit(50.0).alias("y2"), F.lit(100).alias("width"), F.lit(100).alias("height"))
    x = detection.crops(p, padding=0.1, least_side=40)
    return x.groupBy("reject_reason").agg(F.count("*").alias("n"), F.sum((F.col("right") - F.col("left")).cast("long")).alias("width"))


@query("handoff_status", "SELECT CASE WHEN n < 3 THEN 'too_few' WHEN n > 8 THEN 'too_many' ELSE 'ready' END AS status, count(*) AS n FROM (SELECT count(*) AS n FROM core GROUP BY kit_id) GROUP BY 1", "core")
def handoff_status(spark: SparkSession, sf: str) -> DataFrame:
    x = detection.handoff(d.core(spark, sf).select(F.col("kit_id").alias("image_id"), F.col("slot").alias("position"), F.col("coarse").alias("category")))
    return x.groupBy("status").agg(F.count("*").alias("n"))


@query("overlap_classes", """SELECT class, count(*) AS n FROM (SELECT CASE WHEN slot % 50 = 0 THEN 'unresolved' WHEN count(*) FILTER (split IN ('train', 'valid')) > 0 THEN 'TH3' WHEN count(*) FILTER (split = 'test') > 0 THEN 'TH2' ELSE 'TH1' END AS class FROM (SELECT vec_id AS slot FROM vec) v LEFT JOIN meta USING (slot) GROUP BY slot) GROUP BY 1""", "vec", "meta")
def overlap_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as images: in which splits their part occurs."""
    of = lambda s: F.count_if(F.col("split") == s)
    x = d.vectors(spark, sf).select(F.col("vec_id").cast("int").alias("slot")).join(d.metadata(spark, sf).select("slot", "split"), "slot", "left")
    open_ = F.max(F.when(F.col("slot") % 50 == 0, 1).otherwise(0))
    return x.groupBy("slot").agg(detection.overlap_class(of("train"), of("valid"), of("test"), open_).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


BITS = "(SELECT vec_id, vec_id % 3 AS s, list_sum(list_transform(v, lambda x, i: CASE WHEN x > 0 AND i <= 40 THEN 1::BIGINT << (i - 1)::INTEGER ELSE 0 END))::BIGINT AS h FROM vec)"


@query("duplicate_images", f"SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM {BITS} a JOIN {BITS} b ON a.s < b.s WHERE bit_count(xor(a.h, b.h)) <= 8", "vec")
def duplicate_images(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as images whose hash is the signs of their first 40 components, in three splits."""
    bit = F.aggregate(F.transform("v", lambda x, i: F.when((x > 0) & (i < 40), F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return detection.duplicate_pairs(d.vectors(spark, sf).select(F.col("vec_id").alias("image_id"), (F.col("vec_id") % 3).alias("split"), bit.alias("phash")), within=8)


@query("expanded_boxes", """SELECT p_partkey, greatest(0, least(floor(x1 - (x2 - x1) * 0.1), 99))::BIGINT AS left, least(100, greatest(ceil(x2 + (x2 - x1) * 0.1), greatest(0, least(floor(x1 - (x2 - x1) * 0.1), 99)) + 1))::BIGINT AS right FROM (SELECT p_partkey, p_size::DOUBLE AS x1, p_size + p_retailprice / 50 AS x2 FROM part)""")
def expanded_boxes(spark: SparkSession, sf: str) -> DataFrame:
    p = d.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x1"), (F.col("p_size") + F.col("p_retailprice") / 50).alias("x2"))
    box = expanded_box(F.col("x1"), F.col("x1"), F.col("x2"), F.col("x2"), F.lit(100), F.lit(100), 0.1)
    return p.select("p_partkey", box["left"].cast("long").alias("left"), box["right"].cast("long").alias("right"))


PROTO = """p AS (SELECT label AS category, list(x / n ORDER BY d) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM (SELECT label, d, avg(x / sqrt(s)) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d, list_inner_product(v, v) AS s FROM vec) GROUP BY ALL)) GROUP BY label)"""


@query("zero_shot_categories", f"""SELECT * FROM (WITH {PROTO} SELECT vec_id, category, round(score, 6) AS score, round(score - second, 6) + 0.0 AS margin, score - second >= 0.05 AND score >= 0.3 AS accepted, CASE WHEN score < 0.3 THEN 'category_similarity_below_threshold' WHEN score - second < 0.05 THEN 'category_margin_below_threshold' END AS reason FROM (SELECT vec_id, p.category, list_inner_product(vec.v, p.v) AS score, lead(list_inner_product(vec.v, p.v)) OVER w AS second, row_number() OVER w AS r FROM vec, p WINDOW w AS (PARTITION BY vec_id ORDER BY list_inner_product(vec.v, p.v) DESC, p.category)) WHERE r = 1)""", "vec")
def zero_shot_categories(spark: SparkSession, sf: str) -> DataFrame:
    v = d.vectors(spark, sf)
    proto = detection.prototypes(v.select(F.col("label").alias("category"), F.col("label").alias("position"), "v"), d.DIM)
    s = detection.zero_shot(v.select(F.col("vec_id").alias("id"), "v"), proto)
    return rounded(detection.best_category(s, least=0.3, margin=0.05).select(F.col("id").alias("vec_id"), "category", "score", "margin", "accepted", "reason"))


@query("external_items", "SELECT o_orderkey * 4 + r AS position, o_orderkey::VARCHAR || '_' || role AS item_id, role FROM orders, (VALUES (0, 'top'), (1, 'bottom'), (2, 'shoes'), (3, 'bag')) t(r, role)")
def external_items(spark: SparkSession, sf: str) -> DataFrame:
    """Each outfit in the four roles, with a running index."""
    roles = F.explode(F.array(*(F.struct(F.lit(i).alias("r"), F.lit(x).alias("role")) for i, x in enumerate(("top", "bottom", "shoes", "bag")))))
    o = d.table(spark, sf, "orders").select("o_orderkey", roles.alias("x"))
    return o.select((F.col("o_orderkey") * 4 + F.col("x.r")).alias("position"), F.concat(F.col("o_orderkey").cast("string"), F.lit("_"), F.col("x.role")).alias("item_id"), F.col("x.role").alias("role"))


@query("manifest_hash", "SELECT count(*) AS n, sha256(string_agg(s_suppkey || '|' || s_name || '|' || s_nationkey, chr(10) ORDER BY s_suppkey)) AS sha256 FROM supplier")
def manifest_hash(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws("|", F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string"))
    return texts.ordered_hash(d.table(spark, sf, "supplier"), line, "s_suppkey")


@query("artifact_hashes", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'missing' WHEN s_suppkey % 7 = 0 THEN 'changed' ELSE 'same' END AS status FROM supplier) GROUP BY 1")
def artifact_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded hashes of artifacts against current ones."""
    s = d.table(spark, sf, "supplier").select("s_suppkey", F.sha2("s_name", 256).alias("now"))
    report = s.where("s_suppkey % 9 <> 0").select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, "old").otherwise(F.col("now")).alias("recorded"))
    return s.join(report, "s_suppkey", "left").groupBy(F.when(F.col("recorded").isNull(), "missing").when(F.col("recorded") != F.col("now"), "changed").otherwise("same").alias("status")).agg(F.count("*").alias("n"))


@query("text_functions", """SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS sentence, lower(p_brand) AS label, '/images/' || replace(p_brand, '#', '%23') || '%20' || p_size AS url,
  CASE p_size % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/webp' ELSE 'image/jpeg' END AS media, CASE WHEN p_mod = 0 THEN p_brand ELSE p_brand || ' và ' || p_mod END AS joined FROM (SELECT *, p_size % 2 AS p_mod FROM part)""")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    p = d.table(spark, sf, "part")
    third = F.col("p_size") % 3
    name = F.concat(F.lit("x."), F.when(third == 0, "PNG").when(third == 1, "webp").otherwise("jpg"))
    odd = F.col("p_size") % 2
    return p.select("p_partkey", sentence_case(F.col("p_name")).alias("sentence"), label_text(F.concat(F.lit(" "), "p_brand", F.lit(" "))).alias("label"), image_url("/images/", F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string"))).alias("url"), media_type(name).alias("media"), joined_vi(F.when(odd == 0, F.array("p_brand", "p_brand")).otherwise(F.array("p_brand", odd.cast("string")))).alias("joined"))


@query("json_documents", """SELECT error, canonical, count(*) AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'repeated_key' ELSE 'not_one_object' END AS error, CASE WHEN event_id % 3 = 0 THEN '{"a":1,"k":' || json_extract(props, '$.k') || '}' END AS canonical FROM events) GROUP BY ALL""")
def json_documents(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    r = F.col("event_id") % 3
    text = F.when(r == 0, F.concat(F.lit('```json\n{"k": '), k, F.lit(', "a": 1}\n```'))).when(r == 1, F.lit('{"a": 1, "a": 2}')).otherwise(F.lit('x {"a": 1}'))
    x = d.table(spark, sf, "events").select(texts.checked_json(text, {"label"}).alias("c"))
    return x.groupBy("c.error", "c.canonical").agg(F.count("*").alias("n"))


@query("image_inventory", "SELECT count(*) AS n_images, count(*) FILTER (n > 1) AS n_repeated, (SELECT count(*) FROM vec WHERE vec_id % 5 = 0) AS n_without_image FROM (SELECT vec_id, 1 AS n FROM vec WHERE vec_id % 5 <> 0)", "vec")
def image_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """A declared inventory against the ids of vectors, in both directions."""
    v = d.vectors(spark, sf).select("vec_id")
    files = v.where("vec_id % 5 <> 0").groupBy("vec_id").agg(F.count("*").alias("n"))
    lacking = v.join(files, "vec_id", "left_anti").agg(F.count("*").alias("n_without_image"))
    return files.agg(F.count("*").alias("n_images"), F.count_if(F.col("n") > 1).alias("n_repeated")).crossJoin(lacking)  # a row on each side

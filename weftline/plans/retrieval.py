"""Queries of retrieval, rerank, recommendation and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recommend, scoring
from ..operators.reports import LOO_VERSION
from . import domain as d
from .agreement import loo, rounded
from .domain import query, staged


def prepared(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return recommend.retrieval_queries(d.test_queries(spark, sf), d.DIM), d.catalog(spark, sf)


def found_of(q: DataFrame, c: DataFrame) -> DataFrame:
    return recommend.held_candidates(q, c) if recommend.fits(c) else recommend.hybrid(q, c)


def candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q, c = prepared(spark, sf)
    return q, c, staged(spark, sf, "candidates", lambda: found_of(q, c))


def finals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The first results of the rerank only (query_id, final_rank, item_id, logit, improvement), and item_id, master and coarse_id of the catalog:
    the other candidates of a catalog that a task may hold are never written, and such a catalog meets them where they are."""
    q, c = prepared(spark, sf)
    known, told = c.select("item_id", "master", "coarse_id"), ["query_id", "final_rank", "item_id", "logit", "improvement"]
    if recommend.fits(c):
        return staged(spark, sf, "finals", lambda: recommend.held_candidates(q, c, dim=d.DIM, final=recommend.FINAL).select(*told)), F.broadcast(known)
    return ranked(spark, sf)[3].where(F.col("final_rank") <= recommend.FINAL).select(*told), known


def judged(spark: SparkSession, sf: str) -> DataFrame | None:
    """query_id, diagnosis (problem, n_items, full_logit, ranked as of scoring.diagnosed()) and rows (recommend.LISTED, the first results) of each
    query, both made where its record is, so that documents and recommendations needn't meet in a shuffle. None if a task may not hold the
    catalog, or if an item or a query has no id of its own: then they meet by id."""
    c = d.catalog(spark, sf)
    if not recommend.fits(c) or not c.groupBy("item_id").count().where("item_id is null or count > 1").isEmpty() or not d.asked_once(spark, sf):
        return None

    def build() -> DataFrame:
        x = scoring.diagnosed(d.asked_vectors(spark, sf, "items", "coarse").withColumn("entries", d.own_entries()), d.DIM, "query_id", "problem", "vec_ids", "vs", "labels")
        x = x.withColumn("diagnosis", F.struct("problem", "n_items", "full_logit", "ranked"))
        q = recommend.retrieval_queries(d.queries_of(x, d.vectors(spark, sf), "diagnosis"), d.DIM)
        return recommend.held_candidates(q, c, dim=d.DIM, final=recommend.FINAL, keep=("diagnosis",))

    return staged(spark, sf, "judged", build)


@query("catalog_search", """SELECT query_id, item_id, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank
  FROM (SELECT a.item_id AS query_id, b.item_id, round(list_inner_product(a.v, b.v), 9) AS similarity FROM catalog a JOIN catalog b ON a.master = b.master AND a.item_id <> b.item_id)) WHERE rank <= 10""", "catalog")
def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    c = d.catalog(spark, sf)
    q = c.select(F.col("item_id").alias("query_id"), F.col("item_id").alias("own_id"), "master", "v")
    return rounded(recommend.catalog_search(q, c, k=10, scope="master"))


@query("hybrid_candidates", "SELECT query_id, item_id, item_rank::INTEGER AS item_rank, context_rank::INTEGER AS context_rank, order_rank::INTEGER AS order_rank FROM cand", "cand")
def hybrid_candidates(spark: SparkSession, sf: str) -> DataFrame:
    q, c = prepared(spark, sf)
    found = recommend.held_candidates(q, c) if recommend.fits(c) else candidates(spark, sf)[2]
    return found.select("query_id", "item_id", "item_rank", "context_rank", "order_rank")


def faulty_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog as the pools name it, against metadata, vectors and images that lack some of its items."""
    c = d.catalog(spark, sf).withColumn("n", F.substring("item_id", 2, 20).cast("long"))
    own = c.where("n % 29 <> 3").select("item_id", F.when(F.col("n") % 23 == 1, None).otherwise(F.col("master")).alias("own_master"), F.col("coarse_id").alias("own_coarse"))
    return recommend.pool_states(c.drop("n"), own, c.where("n % 19 <> 2"), c.where("n % 17 <> 3"))


POOL = "(SELECT *, CASE WHEN n % 29 = 3 OR n % 23 = 1 THEN 'm' WHEN n % 19 = 2 THEN 'e' WHEN n % 17 = 3 THEN 'i' ELSE 'ok' END AS state FROM (SELECT *, substr(item_id, 2)::BIGINT AS n FROM catalog))"


@query("pool_states", f"SELECT master, CASE state WHEN 'm' THEN 'missing_metadata' WHEN 'e' THEN 'missing_embedding' WHEN 'i' THEN 'missing_image' ELSE 'eligible' END AS state, count(*) AS n FROM {POOL} GROUP BY ALL", "catalog")
def pool_states(spark: SparkSession, sf: str) -> DataFrame:
    return faulty_pool(spark, sf).groupBy("master", "state").agg(F.count("*").alias("n"))


@query("retrieval_counters", f"""SELECT q.query_id, CASE WHEN problem_master IS NULL THEN 'core7_fallback' ELSE 'exact_master_category' END AS retrieval_scope, problem_master IS NULL AS used_core7_fallback, coalesce(n_ok, 0) AS category_pool_count, coalesce(n_m, 0) AS missing_metadata_count, coalesce(n_e, 0) AS missing_embedding_count,
  coalesce(n_i, 0) AS missing_image_count, coalesce(n_item, 0) AS problematic_hit_count, coalesce(n_context, 0) AS context_hit_count, coalesce(n_both, 0) AS both_count, coalesce(n_union, 0) AS union_count FROM q
  LEFT JOIN (SELECT query_id, count(*) FILTER (state = 'ok') AS n_ok, count(*) FILTER (state = 'm') AS n_m, count(*) FILTER (state = 'e') AS n_e, count(*) FILTER (state = 'i') AS n_i FROM q JOIN {POOL} c ON (q.problem_master IS NOT NULL AND c.master = q.problem_master OR q.problem_master IS NULL AND c.coarse_id = q.problem_coarse_id) AND NOT list_contains(q.item_ids, c.item_id) GROUP BY 1) USING (query_id)
  LEFT JOIN (SELECT query_id, count(item_rank) AS n_item, count(context_rank) AS n_context, count(*) FILTER (item_rank IS NOT NULL AND context_rank IS NOT NULL) AS n_both, count(*) AS n_union FROM cand GROUP BY 1) USING (query_id)""", "q", "cand", "catalog")
def retrieval_counters(spark: SparkSession, sf: str) -> DataFrame:
    q, _, found = candidates(spark, sf)
    return recommend.retrieval_counters(q, faulty_pool(spark, sf), found)


def ranked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    q, c, found = candidates(spark, sf)
    return q, c, found, staged(spark, sf, "reranked", lambda: recommend.reranked(q, found, c, d.DIM))


@query("reranked_candidates", "SELECT query_id, item_id, order_rank::INTEGER AS order_rank, used_category_id, false AS used_fallback, logit, round(improvement, 6) + 0.0 AS improvement, final_rank::INTEGER AS final_rank FROM ranked", "ranked")
def reranked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(spark, sf)[3].withColumn("improvement", F.round("improvement", 6))


@query("recommendations", """SELECT q.query_id, CASE WHEN coalesce(n, 0) = 3 THEN 'ok' ELSE 'insufficient_candidates' END AS status, coalesce(items, '') AS items FROM q
  LEFT JOIN (SELECT query_id, count(*) AS n, string_agg(item_id, ',' ORDER BY final_rank) AS items FROM ranked WHERE final_rank <= 3 GROUP BY 1) USING (query_id)""", "q", "ranked")
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    q, _, _, r = ranked(spark, sf)
    return recommend.recommended(q, r).withColumn("items", F.array_join("items", ","))


def diagnosed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Queries whose problem is the place that leave-one-out found, the catalog, candidates, reranked."""
    c = d.catalog(spark, sf)
    masters = c.select("item_id", F.when(F.col("master") != "L9", F.col("master")).alias("master"), "coarse_id")
    q = staged(spark, sf, "diagnosed-queries", lambda: recommend.retrieval_queries(recommend.diagnosed(d.test_queries(spark, sf), loo(spark, sf, d.TEST), masters), d.DIM))
    found = staged(spark, sf, "diagnosed-candidates", lambda: found_of(q, c))
    return q, c, found, staged(spark, sf, "diagnosed-reranked", lambda: recommend.reranked(q, found, c, d.DIM))


@query("loo_recommendations", """SELECT lq.query_id, lq.problem::INTEGER AS position, CASE WHEN coalesce(n, 0) = 3 THEN 'ok' ELSE 'insufficient_candidates' END AS status, coalesce(items, '') AS items FROM lq
  LEFT JOIN (SELECT query_id, count(*) AS n, string_agg(item_id, ',' ORDER BY final_rank) AS items FROM lranked WHERE final_rank <= 3 GROUP BY 1) USING (query_id)""", "lq", "lranked")
def loo_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """Recommendations for the item that leave-one-out blames, not for the one that was swapped."""
    q, _, _, r = diagnosed(spark, sf)
    return recommend.recommended(q, r).withColumn("items", F.array_join("items", ",")).join(q.select("query_id", F.col("problem").alias("position")), "query_id").select("query_id", "position", "status", "items")


@query("recommendation_metadata", """SELECT lq.query_id, lq.problem::INTEGER AS position, 'loo-diagnostic-v1' AS protocol, lq.problem_master AS master, lq.problem_coarse_id AS class, coalesce(n_item, 0) AS problematic_hit_count, coalesce(n, 0) AS union_count, coalesce(n, 0)::INTEGER AS n_retrieved, coalesce(r.reranked, '') AS reranked, coalesce(c.retrieved, '') AS retrieved, round(best + 1e-11, 6) AS best_logit FROM lq
  LEFT JOIN (SELECT query_id, count(*) AS n, count(item_rank) AS n_item, string_agg(item_id || ':' || coalesce(item_rank::VARCHAR, '') || ':' || coalesce(context_rank::VARCHAR, ''), ',' ORDER BY order_rank) AS retrieved FROM lcand GROUP BY 1) c USING (query_id)
  LEFT JOIN (SELECT query_id, string_agg(item_id, ',' ORDER BY final_rank) AS reranked, max(logit) AS best FROM lranked GROUP BY 1) r USING (query_id)""", "lq", "lcand", "lranked")
def recommendation_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """What is kept of each recommendation for audit."""
    q, _, found, r = diagnosed(spark, sf)
    x = recommend.internal_metadata(q, recommend.retrieval_counters(q, faulty_pool(spark, sf), found), found, r, protocol=LOO_VERSION)
    told = F.transform("retrieval_candidates", lambda h: F.concat_ws(":", h["item_id"], F.coalesce(h["problematic_rank"].cast("string"), F.lit("")), F.coalesce(h["context_rank"].cast("string"), F.lit(""))))
    return x.select(
        "query_id", F.col("problematic_item_index").alias("position"), F.col("loo_protocol_version").alias("protocol"), F.col("retrieval.target_master_category").alias("master"), F.col("retrieval.target_category_id").alias("class"), "retrieval.problematic_hit_count", "retrieval.union_count",
        F.size("retrieval_candidates").alias("n_retrieved"), F.array_join("reranked_candidates.item_id", ",").alias("reranked"), F.array_join(told, ",").alias("retrieved"), F.round(F.get("reranked_candidates", F.lit(0))["compatibility_logit"] + F.lit(1e-11), 6).alias("best_logit"),
    )


RECALL = ", ".join(f"round(avg(coalesce({c} <= {k}, false)::INT), 6) AS {n}_recall_{k}" for n, c in (("item", "item_rank"), ("context", "context_rank"), ("hybrid", "order_rank")) for k in recommend.DEPTHS)


@query("retrieval_evaluation", f"""SELECT count(*) AS n_queries, {RECALL}, round(avg((order_rank IS NOT NULL)::INT), 6) AS coverage, round(avg(1.0 / order_rank), 6) AS mrr_before, round(avg(1.0 / final_rank), 6) AS mrr_after,
  round(avg((order_rank > final_rank)::INT), 6) AS improved, round(avg((order_rank = final_rank)::INT), 6) AS unchanged, round(avg((order_rank < final_rank)::INT), 6) AS worsened, round(avg(order_rank - final_rank), 6) AS mean_change, round(quantile_cont(order_rank - final_rank, 0.5), 6) AS median_change,
  count(*) FILTER (NOT coalesce(order_rank <= 200, false)) AS ground_truth_not_in_hybrid_top200, count(*) FILTER (order_rank IS NULL) AS ground_truth_not_in_full_union, count(*) FILTER (order_rank IS NOT NULL AND final_rank IS NULL) AS ground_truth_missing_after_rerank, count(*) FILTER (coalesce(n_final, 0) < 3) AS fewer_than_three_final_candidates,
  sum(coalesce(n_better, 0))::BIGINT AS successful, sum(coalesce(n_final, 0))::BIGINT AS evaluated_recommendations, round(sum(n_better) / sum(n_final)::DOUBLE, 6) AS success_rate, round(avg(coalesce(final_rank <= 1, false)::INT), 6) AS hit_1, round(avg(coalesce(final_rank <= 3, false)::INT), 6) AS hit_3, round(avg(coalesce(1.0 / final_rank, 0)), 6) AS mrr
  FROM q LEFT JOIN (SELECT c.query_id, c.item_id AS truth_id, item_rank, context_rank, c.order_rank, final_rank FROM cand c JOIN ranked r USING (query_id, item_id)) t USING (query_id, truth_id) LEFT JOIN (SELECT query_id, count(*) AS n_final, count(*) FILTER (improvement > 0) AS n_better FROM ranked WHERE final_rank <= 3 GROUP BY 1) USING (query_id)""", "q", "cand", "ranked")
def retrieval_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    q, _, found, r = ranked(spark, sf)
    return rounded(recommend.evaluation(q, found, d.held(r)))


@query("rank_then_filter", """SELECT query_id, item_id, rank::INTEGER AS rank FROM (SELECT q.query_id, c.item_id, c.master, q.problem_master, q.item_ids, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_inner_product(q.item_query, c.v), 9) DESC, c.item_id) AS rank FROM q, catalog c)
  WHERE rank <= 50 AND master = problem_master AND NOT list_contains(item_ids, item_id)""", "q", "catalog")
def rank_then_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The earlier retrieval: the whole catalog is ranked, then filtered."""
    return recommend.rank_then_filter(*prepared(spark, sf), k=50)


@query("candidate_traces", """SELECT q.query_id, 'test' AS source_split, problem::INTEGER AS position, q.item_ids[problem + 1] AS problem_id, truth_id, list_aggregate(list_slice(coalesce(hybrid, []), 1, 200), 'string_agg', ',') AS hybrid, coalesce(last, '') AS final, coalesce(n_union, 0)::INTEGER AS full_union,
  coalesce(n_item, 0)::INTEGER AS item_retrieval, least(3, coalesce(n_union, 0))::INTEGER AS n_final, CASE WHEN coalesce(n_union, 0) < 3 THEN 'fewer_than_three_final_candidates' END AS failure_reason, pre::INTEGER AS pre, (pre - post)::INTEGER AS change FROM q
  LEFT JOIN (SELECT query_id, list(item_id ORDER BY order_rank) AS hybrid, count(*) AS n_union, count(item_rank) AS n_item FROM cand GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, string_agg(item_id, ',' ORDER BY final_rank) AS last FROM ranked WHERE final_rank <= 3 GROUP BY 1) USING (query_id)
  LEFT JOIN (SELECT query_id, item_id AS truth_id, order_rank AS pre, final_rank AS post FROM ranked) t USING (query_id, truth_id)""", "q", "cand", "ranked")
def candidate_traces(spark: SparkSession, sf: str) -> DataFrame:
    q, _, found, r = ranked(spark, sf)
    q = q.withColumns({"source_split": F.lit("test"), "replacement_id": F.get("item_ids", F.col("problem"))})
    t = recommend.trace(q, found, r, recommend.retrieval_counters(q, faulty_pool(spark, sf), found))
    schema = "source_split string, problematic_item_index int, problematic_item_id string, ground_truth_item_id string, hybrid_candidates_top200 array<string>, final_top3 array<string>, candidate_counts struct<full_union int, item_retrieval int, final int>, failure_reason string, gt_rank_pre_rerank int, gt_rank_change_pre_minus_post int"
    x = t.select("query_id", F.from_json("trace", schema).alias("t"))
    c = F.col("t.candidate_counts")
    return x.select(
        "query_id", "t.source_split", F.col("t.problematic_item_index").alias("position"), F.col("t.problematic_item_id").alias("problem_id"), F.col("t.ground_truth_item_id").alias("truth_id"), F.array_join("t.hybrid_candidates_top200", ",").alias("hybrid"), F.array_join("t.final_top3", ",").alias("final"),
        c["full_union"].alias("full_union"), c["item_retrieval"].alias("item_retrieval"), c["final"].alias("n_final"), "t.failure_reason", F.col("t.gt_rank_pre_rerank").alias("pre"), F.col("t.gt_rank_change_pre_minus_post").alias("change"),
    )


def faulty_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Records checked against vectors, metadata and images that lack some items; a few swaps are broken."""
    r = d.records(spark, sf)
    kit = F.col("source_kit_id").cast("long") % 40
    swap = F.struct(F.when(kit == 2, 99).otherwise(F.col("swap.position")).alias("position"), F.col("swap.original_item_id"), F.when(kit == 3, "other").otherwise(F.col("swap.replacement_item_id")).alias("replacement_item_id"))
    r = r.where("label = 0").withColumn("swap", F.when(kit != 1, swap))
    items = d.core(spark, sf).select("item_id")
    return recommend.required_items(r, items.where(~F.col("item_id").endswith("77")), items.where(~F.col("item_id").endswith("33")), items.where(~F.col("item_id").endswith("11")))


CHECKED = """(SELECT *, CASE WHEN k = 1 THEN 'missing_negative_metadata' WHEN k IN (2, 3) THEN 'invalid_negative_metadata' WHEN v < n THEN 'missing_embedding' WHEN m < n THEN 'missing_metadata' WHEN i < n THEN 'missing_image' END AS exclusion
  FROM (SELECT sample_id, k, len(need) AS n, len(list_filter(need, lambda x: x NOT LIKE '%77')) AS v, len(list_filter(need, lambda x: x NOT LIKE '%33')) AS m, len(list_filter(need, lambda x: x NOT LIKE '%11')) AS i
    FROM (SELECT sample_id, source_kit_id::BIGINT % 40 AS k, CASE WHEN source_kit_id::BIGINT % 40 = 1 THEN ids ELSE list_append(ids, original_item_id) END AS need FROM records WHERE label = 0)))"""


@query("evaluation_exclusions", f"SELECT exclusion, count(*) AS n FROM {CHECKED} GROUP BY 1", "records")
def evaluation_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return faulty_samples(spark, sf).groupBy("exclusion").agg(F.count("*").alias("n"))


@query("evaluation_coverage", f"""SELECT count(*) AS total_queries, count(*) FILTER (exclusion IS NULL) AS valid_queries, sum(n)::BIGINT AS required_item_checks, sum(v)::BIGINT AS embedding_available, sum(m)::BIGINT AS metadata_available, sum(i)::BIGINT AS image_available,
  {", ".join(f"count(*) FILTER (exclusion = '{r}') AS {r}" for r in recommend.EXCLUSIONS)}, round(sum(v) / sum(n)::DOUBLE, 6) AS embedding_ratio, round(sum(m) / sum(n)::DOUBLE, 6) AS metadata_ratio, round(sum(i) / sum(n)::DOUBLE, 6) AS image_ratio FROM {CHECKED}""", "records")
def evaluation_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(recommend.coverage(faulty_samples(spark, sf)))

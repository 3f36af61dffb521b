"""Queries of scoring, diagnosis, calibration and agreement with human labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import percent_score, sigmoid
from ..operators import metrics, scoring
from ..sources.staging import made
from . import domain as d
from .domain import query, staged

SCALE, BIAS = 0.47218, -0.17733


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("item_pairs", "SELECT n_items::INTEGER AS n_items, count(*) AS n_pairs, round(avg(cosine), 6) AS mean_cosine FROM pairs GROUP BY 1", "pairs")
def item_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = scoring.item_pairs(d.entries(spark, sf).withColumn("n_items", F.size("entries")), "n_items")
    return rounded(p.groupBy("n_items").agg(F.count("*").alias("n_pairs"), F.avg("cosine").alias("mean_cosine")))


@query("outfit_scores", "SELECT sample_id, split, label, n_items::INTEGER AS n_items, round(compatibility_logit, 6) AS compatibility_logit FROM scored", "scored")
def outfit_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.scored_records(spark, sf).drop("pair_id"))


@query("learned_scores", None)
def learned_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The learned scorer's forward pass with fixed pseudo-random weights; tested against plain loops."""
    return scoring.learned_logits(d.entries(spark, sf), scoring.PairScorer.random(d.DIM), "sample_id", "split", "label")


@query("context_centroids", """SELECT query_id, round(context_query[1], 6) AS first_component, round(sqrt(list_inner_product(context_query, context_query)), 6) AS norm FROM ctx""", "ctx")
def context_centroids(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.scalars import length
    from ..operators.recommend import retrieval_queries

    q = retrieval_queries(d.test_queries(spark, sf), d.DIM).where("context_query is not null")
    return rounded(q.select("query_id", F.get("context_query", F.lit(0)).alias("first_component"), length(F.col("context_query")).alias("norm")))


def diagnosed(spark: SparkSession, sf: str, split: str | None = None) -> DataFrame:
    """Leave-one-out of each negative, or of those of a split, in a row, with the place that was swapped as target."""
    if split is not None and made(spark, sf, "leave-one-out"):
        return diagnosed(spark, sf).where(F.col("split") == split)
    name = "leave-one-out" if split is None else f"leave-one-out-{split}"
    return staged(spark, sf, name, lambda: scoring.diagnosed(d.entries(spark, sf, split).where("label = 0").withColumn("target", F.col("swap.position")), d.DIM, "sample_id", "split", "target"))


def loo(spark: SparkSession, sf: str, split: str | None = None) -> DataFrame:
    return scoring.by_rank(diagnosed(spark, sf, split), "sample_id")


@query("leave_one_out", "SELECT sample_id, n_items::INTEGER AS n_items, position::INTEGER AS position, rank::INTEGER AS rank, item_id, round(full_logit + 1e-11, 6) AS full_logit, round(logit_without + 1e-11, 6) AS logit_without, round(delta + 1e-11, 6) AS delta FROM loo WHERE sample_id LIKE '%_neg_1'", "loo")
def leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    """Logits are moved off the edges of rounding, as sums in another order differ in their last bits."""
    return rounded(loo(spark, sf).withColumns({c: F.col(c) + F.lit(1e-11) for c in ("full_logit", "logit_without", "delta")}))


@query("loo_report", """SELECT sizes, count(*) AS n, round(avg((rank = 1)::INT), 6) AS top1, round(avg((rank <= 2)::INT), 6) AS hit_at_2, round(avg(target_delta), 6) AS mean_target_delta, round(avg(max_delta), 6) AS mean_max_delta, count(*) FILTER (n_items = 3) AS n_extrapolated
  FROM (SELECT *, unnest(['overall', CASE WHEN n_items = 3 THEN 'size_3' ELSE 'size_4_plus' END, 'items_' || n_items]) AS sizes
    FROM (SELECT l.sample_id, any_value(l.n_items) AS n_items, max(CASE WHEN l.position = r.problem THEN l.rank END) AS rank, max(CASE WHEN l.position = r.problem THEN delta END) AS target_delta, max(delta) AS max_delta FROM loo l JOIN records r ON r.sample_id = l.sample_id WHERE r.label = 0 GROUP BY 1)) GROUP BY sizes""", "loo", "records")
def loo_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.localized(diagnosed(spark, sf)))


AUC = """SELECT count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative, round((sum(CASE WHEN label = 1 THEN r END) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS roc_auc"""
RANKED = "(SELECT *, rank() OVER (PARTITION BY {by} ORDER BY compatibility_logit) + (count(*) OVER (PARTITION BY {by}, compatibility_logit) - 1) / 2.0 AS r FROM scored)"


@query("roc_auc", f"SELECT split, {AUC[7:]} FROM {RANKED.format(by='split')} GROUP BY split", "scored")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.roc_auc(d.scored_records(spark, sf), keys=["split"]))


@query("paired_margins", "SELECT p.sample_id AS pair_id, round(p.compatibility_logit - n.compatibility_logit, 6) AS margin FROM scored p JOIN scored n ON n.pair_id = p.sample_id", "scored")
def paired_margins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.margins(d.scored_records(spark, sf)))


@query("scorer_metrics", f"""SELECT a.*, n_families, fitb, mean_margin, median_margin FROM ({AUC} FROM {RANKED.format(by='1')}) a,
  (SELECT count(*) AS n_families, round(avg((m > 0)::INT), 6) AS fitb, round(avg(m), 6) AS mean_margin, round(quantile_cont(m, 0.5), 6) AS median_margin FROM (SELECT p.compatibility_logit - n.compatibility_logit AS m FROM scored p JOIN scored n ON n.pair_id = p.sample_id))""", "scored")
def scorer_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.scorer_metrics(d.scored_records(spark, sf)))


@query("prediction_issues", "SELECT issue, count(*) AS n FROM (SELECT CASE WHEN label = 0 AND n_items = 5 THEN 'label_not_binary' WHEN label = 1 AND n_items = 4 THEN 'logit_not_finite' END AS issue FROM scored) WHERE issue IS NOT NULL GROUP BY 1", "scored")
def prediction_issues(spark: SparkSession, sf: str) -> DataFrame:
    s = d.scored_records(spark, sf)
    bad = s.select("sample_id", F.when((F.col("label") == 0) & (F.col("n_items") == 5), 3).otherwise(F.col("label")).alias("label"), F.when((F.col("label") == 1) & (F.col("n_items") == 4), F.lit(float("nan"))).otherwise(F.col("compatibility_logit")).alias("compatibility_logit"))
    return metrics.prediction_issues(bad).groupBy("issue").agg(F.count("*").alias("n"))


P = "1 / (1 + exp(-({a} * compatibility_logit * 4 + {b})))"
CAL = """SELECT count(*) AS n, round(avg(-CASE WHEN label = 1 THEN ln(greatest(p, 1e-15)) ELSE ln(greatest(1 - p, 1e-15)) END), 6) AS nll, round(avg((p - label) * (p - label)), 6) AS brier,
  round((SELECT sum(abs(d)) FROM (SELECT sum(p - label) AS d FROM c GROUP BY least(floor(p * 10), 9))) / count(*), 6) AS ece, round(avg(p), 6) AS mean_probability, round(avg(((p >= 0.5) = (label = 1))::INT), 6) AS accuracy FROM c"""


def logits(spark: SparkSession, sf: str) -> DataFrame:
    return d.scored_records(spark, sf).withColumn("compatibility_logit", F.col("compatibility_logit") * F.lit(4.0))


@query("calibration_metrics", "SELECT * FROM (WITH c AS (SELECT label, " + P.format(a=SCALE, b=BIAS) + f" AS p FROM scored) {CAL})", "scored")
def calibration_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.calibration(logits(spark, sf), scale=SCALE, bias=BIAS))


@query("raw_calibration_metrics", "SELECT * FROM (WITH c AS (SELECT label, " + P.format(a=1.0, b=0.0) + f" AS p FROM scored) {CAL})", "scored")
def raw_calibration_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.calibration(logits(spark, sf)))


@query("product_scores", "SELECT sample_id, greatest(0, least(100, floor(" + P.format(a=SCALE, b=BIAS) + " * 100 + 0.5)))::INTEGER AS score FROM scored", "scored")
def product_scores(spark: SparkSession, sf: str) -> DataFrame:
    return logits(spark, sf).select("sample_id", percent_score(sigmoid(F.col("compatibility_logit") * F.lit(SCALE) + F.lit(BIAS))).alias("score"))


@query("platt_fit", None)
def platt_fit(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.fit_platt(logits(spark, sf).where("split = 'valid'"))


@query("threshold_metrics", """SELECT tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1
  FROM (SELECT count(*) FILTER (compatibility_logit >= 0 AND label = 1) AS tp, count(*) FILTER (compatibility_logit >= 0 AND label = 0) AS fp, count(*) FILTER (compatibility_logit < 0 AND label = 1) AS fn FROM scored)""", "scored")
def threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.threshold_metrics(d.scored_records(spark, sf), 0.0))


@query("holdout_split", "SELECT split, ('0x' || substr(sha256(source_kit_id || '_pos'), 1, 8))::BIGINT % 5 = 0 AS held_out, count(*) AS n FROM records GROUP BY ALL", "records")
def holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    family = F.concat("source_kit_id", F.lit("_pos"))
    return d.records(spark, sf).groupBy("split", metrics.in_holdout(family).alias("held_out")).agg(F.count("*").alias("n"))


def human(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of the test split's positives with a human class from 1 to 3; the derived quality is 4 - class."""
    k = d.kits(spark, sf).where("split = 'test'")
    cls = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(3)
    s = d.scored_records(spark, sf).where("label = 1")
    return s.join(k.select(F.concat("kit_id", F.lit("_pos")).alias("sample_id"), (4 - cls).alias("quality"), (F.col("o_orderpriority") != "5-LOW").alias("subset_a"), F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM", "4-NOT SPECIFIED").alias("subset_b")), "sample_id").select("sample_id", "compatibility_logit", "quality", "subset_a", "subset_b")


HUMAN = """h AS (SELECT sample_id, compatibility_logit AS x, 4 - CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 WHEN o_orderpriority = '3-MEDIUM' THEN 2 ELSE 3 END AS quality, o_orderpriority <> '5-LOW' AS subset_a, o_orderpriority IN ('1-URGENT', '3-MEDIUM', '4-NOT SPECIFIED') AS subset_b
  FROM scored JOIN kits ON kit_id || '_pos' = sample_id WHERE label = 1 AND kits.split = 'test')"""


def human_query(name: str, sql: str | None):
    return query(name, f"SELECT * FROM (WITH {HUMAN} {sql})" if sql else None, "scored", "kits")


TAU = "(count(*) FILTER (s > 0) - count(*) FILTER (s < 0)) / sqrt((count(*) - count(*) FILTER (dx = 0))::DOUBLE * (count(*) - count(*) FILTER (dy = 0)))"
TAU_SQL = "SELECT (SELECT count(*) FROM h) AS n, round(" + TAU + ", 6) AS kendall_tau_b FROM (SELECT sign(a.x - b.x) AS dx, sign(a.quality - b.quality) AS dy, sign(a.x - b.x) * sign(a.quality - b.quality) AS s FROM h a JOIN h b ON a.sample_id < b.sample_id)"


@human_query("kendall_tau", TAU_SQL)
def kendall_tau(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.kendall(human(spark, sf), "compatibility_logit", "quality", [1, 2, 3]))


@human_query("spearman_rho", "SELECT count(*) AS n, round(corr(rx, ry), 6) AS spearman_rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS ry FROM h)")
def spearman_rho(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.spearman(d.held(human(spark, sf)), "compatibility_logit", "quality"))


@human_query("class_summary", "SELECT quality, count(*) AS n, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.75), 6) AS q3, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr FROM h GROUP BY quality")
def class_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.class_summary(human(spark, sf), "quality", "compatibility_logit"))


@human_query("pair_ordering", "SELECT a.quality AS higher, b.quality AS lower, count(*) FILTER (a.x > b.x) AS wins, count(*) FILTER (a.x = b.x) AS ties, count(*) FILTER (a.x < b.x) AS losses, round((count(*) FILTER (a.x > b.x) + count(*) FILTER (a.x = b.x) / 2.0) / count(*), 6) AS probability FROM h a JOIN h b ON a.quality > b.quality GROUP BY ALL")
def pair_ordering(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.pair_ordering(human(spark, sf), "quality", "compatibility_logit", [1, 2, 3]))


@human_query("human_subsets", "SELECT subset, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max FROM (SELECT x, unnest(list_filter(['full', CASE WHEN subset_a THEN 'a' END, CASE WHEN subset_b THEN 'b' END], lambda s: s IS NOT NULL)) AS subset FROM h) GROUP BY subset")
def human_subsets(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("compatibility_logit")
    names = F.filter(F.array(F.lit("full"), F.when(F.col("subset_a"), "a"), F.when(F.col("subset_b"), "b")), lambda s: s.isNotNull())
    h = human(spark, sf).select(F.explode(names).alias("subset"), x)
    return rounded(h.groupBy("subset").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")))


def _subset_sql() -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY subset ORDER BY {c}) + (count(*) OVER (PARTITION BY subset, {c}) - 1) / 2.0"
    return f""", hs AS (SELECT *, unnest(list_filter(['full', CASE WHEN subset_a THEN 'a' END, CASE WHEN subset_b THEN 'b' END], lambda s: s IS NOT NULL)) AS subset FROM h)
  SELECT subset, n, kendall_tau_b, spearman_rho FROM (SELECT subset, count(*) AS n, round(corr(rx, ry), 6) AS spearman_rho FROM (SELECT subset, {rank("x")} AS rx, {rank("quality")} AS ry FROM hs) GROUP BY 1)
  JOIN (SELECT subset, round({TAU}, 6) AS kendall_tau_b FROM (SELECT a.subset, sign(a.x - b.x) AS dx, sign(a.quality - b.quality) AS dy, sign(a.x - b.x) * sign(a.quality - b.quality) AS s FROM hs a JOIN hs b ON a.subset = b.subset AND a.sample_id < b.sample_id) GROUP BY 1) USING (subset)"""


@human_query("subset_metrics", _subset_sql())
def subset_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Each agreement statistic over each of the nested subsets."""
    h, x = human(spark, sf), "compatibility_logit"
    out = None
    for name, rows in (("full", h), ("a", h.where("subset_a")), ("b", h.where("subset_b"))):
        one = metrics.kendall(rows, x, "quality", [1, 2, 3]).join(metrics.spearman(rows, x, "quality").drop("n")).select(F.lit(name).alias("subset"), "*")  # a row on each side
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("family_orphans", "SELECT side, count(*) AS n FROM (SELECT CASE WHEN label = 1 THEN 'positive' ELSE 'negative' END AS side FROM scored WHERE label = 1 AND coalesce(replace(sample_id, '_pos', ''), '')::BIGINT % 10 = 2 OR label = 0 AND replace(pair_id, '_pos', '')::BIGINT % 10 = 1) GROUP BY side", "scored")
def family_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Families that lost a side: positives of kits that end in 1, negatives of kits that end in 2."""
    kit = F.replace(F.coalesce("pair_id", "sample_id"), F.lit("_pos"), F.lit("")).cast("long") % 10
    s = d.scored_records(spark, sf).where(~((F.col("label") == 1) & (kit == 1)) & ~((F.col("label") == 0) & (kit == 2)))
    return metrics.orphans(s).groupBy("side").agg(F.count("*").alias("n"))


@query("bootstrap_intervals", None)
def bootstrap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bootstrap(human(spark, sf), "compatibility_logit", "quality", resamples=10_000, blocks=96)


@query("latency_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM events GROUP BY 1")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.latency_summary(d.table(spark, sf, "events"), "value", "event_type"))

"""Ranking, calibration and agreement statistics without a global sort in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, log_loss, sigmoid

NAN = float("nan")


#: Bins that the distinct values of a key are cut into.
BINS = 256


def cumulative(df: DataFrame, value: str, counts: dict[str, Column], *, keys: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """A row per distinct value (within keys): its counts, and below_*: the counts of all smaller values.

    Values are counted map-side, then summed in bins and inside each bin. Edges of bins are approximate quantiles of a key's
    distinct values, so whatever the range and the ties of the values, no task holds more than the bins or about one bin's share.
    """
    keys = keys or []
    per = df.groupBy(*keys, value).agg(*(c.alias(n) for n, c in counts.items()))
    edges = per.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, F.array(*(F.lit(i / bins) for i in range(1, bins))), 10_000)).alias("_edges"))
    per = (per.join(edges, keys) if keys else per.join(F.broadcast(edges))).withColumn("_bin", F.size(F.filter("_edges", lambda e: e <= F.col(value)))).drop("_edges")
    sums = per.groupBy(*keys, "_bin").agg(*(F.sum(n).alias(f"_s_{n}") for n in counts))
    order = Window.partitionBy(*keys or [F.lit(1)]).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most bins rows a key
    sums = sums.select(*keys, "_bin", *(F.coalesce(F.sum(f"_s_{n}").over(order), F.lit(0)).alias(f"_b_{n}") for n in counts))
    inside = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = per.select("*", *(F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_i_{n}") for n in counts)).join(sums, [*keys, "_bin"])
    return out.select(*keys, value, *counts, *((F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(f"below_{n}") for n in counts))


def quantiles(df: DataFrame, value: str, points: dict[str, float], *, keys: list[str] | None = None) -> DataFrame:
    """Of each key, linear quantiles of the values that aren't null, exact, from cumulative counts: no buffer of a key's values."""
    keys = keys or []
    c = cumulative(df.where(F.col(value).isNotNull()), value, {"n": F.count("*")}, keys=keys)
    totals = c.groupBy(*keys).agg(F.sum("n").alias("_total"))
    c = c.join(totals, keys) if keys else c.join(F.broadcast(totals))  # a row per key
    at = lambda rank: F.max(F.when(F.col("below_n") <= rank, F.col(value).cast("double")))
    place = lambda p: F.lit(p) * (F.col("_total") - 1)
    parts = [x for i, p in enumerate(points.values()) for x in (at(F.floor(place(p))).alias(f"_l{i}"), at(F.ceil(place(p))).alias(f"_h{i}"))]
    got = c.groupBy(*keys).agg(F.max("_total").alias("_total"), *parts)
    share = lambda p: place(p) - F.floor(place(p))
    return got.select(*keys, *((F.col(f"_l{i}") * (F.lit(1.0) - share(p)) + F.col(f"_h{i}") * share(p)).alias(n) for i, (n, p) in enumerate(points.items())))


def nan_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(NAN))


def prediction_issues(df: DataFrame) -> DataFrame:
    """Rows that no metric takes: sample_id, issue. df: sample_id, label, compatibility_logit."""
    issue = F.when(F.col("sample_id").isNull(), "missing_id").when(F.col("label").isNull() | ~F.col("label").isin(0, 1), "label_not_binary").when(~F.coalesce(finite(F.col("compatibility_logit")), F.lit(False)), "logit_not_finite")
    return df.select("sample_id", issue.alias("issue")).where("issue is not null")


def roc_auc(df: DataFrame, *, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half; NaN without both classes. df: label, compatibility_logit."""
    keys = keys or []
    c = cumulative(df, "compatibility_logit", {"pos": F.count_if(F.col("label") == 1), "neg": F.count_if(F.col("label") == 0)}, keys=keys)
    wins = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / F.lit(2.0)))
    out = c.groupBy(*keys).agg(wins.alias("_w"), F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative"))
    return out.select(*keys, "n_positive", "n_negative", nan_if_null(F.try_divide(F.col("_w"), F.col("n_positive") * F.col("n_negative").cast("double"))).alias("roc_auc"))


def margins(df: DataFrame) -> DataFrame:
    """pair_id, margin: the positive's logit less the negative's, one row a family; an orphan on either side has no margin, and
    orphans() names it."""
    p = df.where("label = 1").select(F.col("sample_id").alias("pair_id"), F.col("compatibility_logit").alias("_p"))
    n = df.where("label = 0").select("pair_id", F.col("compatibility_logit").alias("_n"))
    return p.join(n, "pair_id").select("pair_id", (F.col("_p") - F.col("_n")).alias("margin"))


def orphans(df: DataFrame) -> DataFrame:
    p, n = df.where("label = 1").select(F.col("sample_id").alias("pair_id")), df.where("label = 0").select("pair_id")
    return p.join(n, "pair_id", "left_anti").withColumn("side", F.lit("positive")).unionByName(n.join(p, "pair_id", "left_anti").withColumn("side", F.lit("negative")))


def scorer_metrics(df: DataFrame) -> DataFrame:
    """One row: AUC, two-way fill-in (strictly positive margins), mean and median margin, counts."""
    m = margins(df)
    sums = m.agg(F.count("*").alias("n_families"), F.avg((F.col("margin") > 0).cast("double")).alias("fitb"), F.avg("margin").alias("mean_margin"))
    return roc_auc(df).join(sums).join(quantiles(m, "margin", {"median_margin": 0.5}))  # a row on each side


def calibration(df: DataFrame, *, scale: float = 1.0, bias: float = 0.0, bins: int = 10) -> DataFrame:
    """One row: nll, brier, ece, mean probability, accuracy, n. Bins are [k / bins, (k + 1) / bins), the last one closed."""
    p = sigmoid(F.col("compatibility_logit") * F.lit(scale) + F.lit(bias))
    d = df.select("label", p.alias("p"))
    edge = sum(((F.col("p") >= F.lit(k / bins)).cast("int") for k in range(1, bins)), F.lit(0))
    d = d.select("label", "p", edge.alias("bin"))
    per = d.groupBy("bin").agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("label").alias("sy"), F.sum(log_loss(F.col("p"), F.col("label"))).alias("sl"), F.sum((F.col("p") - F.col("label")) * (F.col("p") - F.col("label"))).alias("sb"), F.count_if((F.col("p") >= 0.5) == (F.col("label") == 1)).alias("ok"))
    total = F.sum("n")
    return per.agg(total.alias("n"), (F.sum("sl") / total).alias("nll"), (F.sum("sb") / total).alias("brier"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / total).alias("ece"), (F.sum("sp") / total).alias("mean_probability"), (F.sum("ok") / total).alias("accuracy"))


def fit_platt(df: DataFrame, *, rate: float = 0.03, steps: int = 5000, tolerance: float = 1e-10, digits: int = 6) -> DataFrame:
    """Scale and bias of least log loss by Adam over (logit, label, count) in one task: scale, bias, steps, nll.

    The rows are counted by logit rounded to digits first, so the task's input is bounded by the range of logits.
    scale = exp(theta), theta within 8 and bias within 50 of zero.
    """

    def run(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        x, y, n = (got[c].to_numpy(float) for c in ("x", "label", "n"))
        at, m, v, taken = np.zeros(2), np.zeros(2), np.zeros(2), 0
        for t in range(1, steps + 1):
            scale = np.exp(at[0])
            p = 1 / (1 + np.exp(-np.clip(scale * x + at[1], -700, 700)))
            e = n * (p - y) / n.sum()
            g = np.array([(e * x).sum() * scale, e.sum()])
            taken = t
            if np.abs(g).max() < tolerance:
                break
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            at = at - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            at = np.clip(at, [-8, -50], [8, 50])
        p = np.clip(1 / (1 + np.exp(-np.clip(np.exp(at[0]) * x + at[1], -700, 700))), 1e-15, 1 - 1e-15)
        return pd.DataFrame({"scale": [np.exp(at[0])], "bias": [at[1]], "steps": [taken], "nll": [-(n * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / n.sum()]})

    few = df.select(F.round("compatibility_logit", digits).alias("x"), "label").groupBy("x", "label").agg(F.count("*").alias("n"))
    return few.groupBy(F.lit(1).alias("one")).applyInPandas(run, "scale double, bias double, steps int, nll double")


def kendall(df: DataFrame, x: str, y: str, levels: list[int]) -> DataFrame:
    """Tau-b of x with an ordinal y of few levels, in n log n: for each pair of levels, how often x agrees; NaN if either is constant."""
    c = cumulative(df, x, {f"l{v}": F.count_if(F.col(y) == v) for v in levels})
    agree = F.lit(0).cast("long")
    for i, low in enumerate(levels):
        for high in levels[i + 1 :]:
            # pairs (low, high) with x of high above x of low, less those the other way
            agree = agree + F.sum(F.col(f"l{high}") * F.col(f"below_l{low}")) - F.sum(F.col(f"l{low}") * F.col(f"below_l{high}"))
    all_of = sum((F.col(f"l{v}") for v in levels), F.lit(0))
    pairs = lambda k: k * (k - 1) / F.lit(2.0)
    d = c.agg(agree.alias("s"), F.sum(all_of).alias("n"), F.sum(pairs(all_of)).alias("tx"), *(F.sum(f"l{v}").alias(f"l{v}") for v in levels))
    ty = sum((pairs(F.col(f"l{v}")) for v in levels), F.lit(0.0))
    under = F.sqrt((pairs(F.col("n")) - F.col("tx")) * (pairs(F.col("n")) - ty))
    return d.select("n", nan_if_null(F.try_divide(F.col("s").cast("double"), under)).alias("kendall_tau_b"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the average rank (from 1) of value."""
    c = cumulative(df, value, {"n": F.count("*")}).select(F.col(value).alias("_v"), (F.col("below_n") + (F.col("n") + 1) / F.lit(2.0)).alias(name))
    return df.join(c, df[value] == c["_v"]).drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's correlation of average ranks; NaN if either side is constant."""
    r = average_ranks(average_ranks(df, x, "_rx"), y, "_ry")
    return r.agg(F.count("*").alias("n"), nan_if_null(F.corr("_rx", "_ry")).alias("spearman_rho"))


def class_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """By group: n, median, quartiles (linear), their distance, mean, sample deviation (NaN for one row)."""
    out = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), nan_if_null(F.stddev_samp(value)).alias("std"))
    return out.join(quantiles(df, value, {"median": 0.5, "q1": 0.25, "q3": 0.75}, keys=[group]), group).withColumn("iqr", F.col("q3") - F.col("q1"))


def pair_ordering(df: DataFrame, group: str, value: str, levels: list[int]) -> DataFrame:
    """For each pair of levels: pairs that the higher level wins, ties, losses, and the chance to win with ties half (NaN without pairs)."""
    c = cumulative(df, value, {f"l{v}": F.count_if(F.col(group) == v) for v in levels})
    sums, rows = [F.sum(f"l{v}").alias(f"t{v}") for v in levels], []
    for i, low in enumerate(levels):
        for high in levels[i + 1 :]:
            sums += [F.sum(F.col(f"l{high}") * F.col(f"below_l{low}")).alias(f"w{low}_{high}"), F.sum(F.col(f"l{high}") * F.col(f"l{low}")).alias(f"e{low}_{high}")]
            rows.append(F.struct(F.lit(high).alias("higher"), F.lit(low).alias("lower"), F.col(f"w{low}_{high}").alias("wins"), F.col(f"e{low}_{high}").alias("ties"), (F.col(f"t{low}") * F.col(f"t{high}")).alias("pairs")))
    d = c.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return d.select("higher", "lower", "wins", "ties", (F.col("pairs") - F.col("wins") - F.col("ties")).alias("losses"), nan_if_null(F.try_divide(F.col("wins") + F.col("ties") / F.lit(2.0), F.col("pairs").cast("double"))).alias("probability"))


def bootstrap(df: DataFrame, x: str, y: str, *, resamples: int = 1000, level: float = 0.95, seed: int = 42, blocks: int = 16) -> DataFrame:
    """Percentile intervals of tau-b and rho over resamples of the pairs, the same draws for both; one task per block of resamples.

    df is one evaluation set (thousands of rows), copied to each block. At least max(100, 99 %) of resamples must have
    both statistics, else the intervals are NaN.
    """

    def ranks(v: np.ndarray) -> np.ndarray:
        _, inverse, n = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[inverse]

    def tau(a: np.ndarray, b: np.ndarray) -> float:
        n, total = len(a), 0.0
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        values = np.unique(b)
        below = {v: np.concatenate([[0], np.cumsum(b == v)]) for v in values}
        edge = np.searchsorted(a, a, "left")
        for v in values:
            total += sum(below[u][edge[b == v]].sum() * (1 if u < v else -1) for u in values if u != v)
        ties = lambda z: sum(k * (k - 1) / 2 for k in np.unique(z, return_counts=True)[1])
        under = np.sqrt((n * (n - 1) / 2 - ties(a)) * (n * (n - 1) / 2 - ties(b)))
        return total / under if under else NAN

    def run(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values([x, y])
        a, b = got[x].to_numpy(float), got[y].to_numpy(float)
        out = []
        for k in range(int(key[0]), resamples, blocks):
            at = np.random.default_rng([seed, k]).integers(0, len(a), len(a))
            ra, rb = ranks(a[at]), ranks(b[at])
            rho = np.corrcoef(ra, rb)[0, 1] if ra.std() and rb.std() else NAN
            out.append((k, tau(a[at], b[at]), rho))
        return pd.DataFrame(out, columns=["resample", "tau", "rho"]).astype({"resample": "int32"})

    drawn = df.select(x, y).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(blocks, "block").groupBy("block").applyInPandas(run, "resample int, tau double, rho double")
    long = drawn.select(F.explode(F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(s).alias("v")) for s in ("tau", "rho")))).alias("r")).select("r.*").where(~F.isnan("v"))
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    out = long.groupBy("statistic").agg(F.count("*").alias("n_valid"), F.percentile("v", F.lit(low)).alias("ci_low"), F.percentile("v", F.lit(high)).alias("ci_high"))
    enough = F.col("n_valid") >= max(100, int(np.ceil(0.99 * resamples)))
    return out.select("statistic", "n_valid", *(F.when(enough, F.col(c)).otherwise(F.lit(NAN)).alias(c) for c in ("ci_low", "ci_high")))


def latency_summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.join(quantiles(df, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, keys=list(keys)), list(keys))


def threshold_metrics(df: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall and F1 of logit >= threshold; null without a denominator."""
    yes, true = F.col("compatibility_logit") >= threshold, F.col("label") == 1
    d = df.agg(F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"))
    d = d.withColumns({"precision": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))})
    return d.withColumn("f1", F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def in_holdout(family: Column, *, parts: int = 5) -> Column:
    """Family-preserving split: 32 bits of the family's hash are 0 modulo parts."""
    return F.conv(F.substring(F.sha2(family, 256), 1, 8), 16, 10).cast("long") % parts == 0

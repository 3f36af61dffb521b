"""Hand-checked cases of the outfit engine, and sources by round trip."""

import hashlib
import io
import json
import math
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import documents, scalars
from weftline.operators import clean, detection, evidence, expect, metrics, negatives, recommend, scoring
from weftline.sources import records, shards
from weftline.streaming import traces


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.first().asDict()


RAW = "item_id string, master string, pos int"


@pytest.fixture(scope="module")
def items(spark):
    rows = [("a_1", "T-Shirts", 1), (" a_2 ", "Jeans", 2), ("a_3", "Sneakers", 3), ("a_4", "Lipstick", 4), ("b_1", "T-Shirts", 5), ("b_2", "Jeans", 6), ("b_3", "Lipstick", 7), ("a_1", "Jeans", 8), ("bad", "Jeans", 9), ("bad", "Jeans", 10), (None, "Jeans", 11), ("c_x", " ", 12), ("a_z", "Sneakers", 13)]
    return frame(spark, rows, RAW)


MAP = [("T-Shirts", "TOP"), ("Jeans", "BOTTOM"), ("Sneakers", "SHOES"), ("Lipstick", "DROP")]


def test_clean_positives(spark, items):
    mapping = frame(spark, MAP, "master string, coarse string")
    assert one(clean.item_counters(items, ["pos"])) == {"n_rows": 13, "n_missing": 2, "n_duplicate": 1, "n_malformed": 2, "n_kept": 8, "n_null_slot": 1}
    core = clean.core_items(clean.clean_items(items, ["pos"]), mapping)
    got = clean.outfits(core).collect()
    assert [(r.kit_id, [x.item_id for x in r["items"]]) for r in got] == [("a", ["a_1", "a_2", "a_3", "a_z"])]
    kits = frame(spark, [("a",), ("b",), ("none",)], "kit_id string")
    assert one(clean.kit_report(kits, clean.clean_items(items, ["pos"]), core)) == {"n_kits": 3, "n_without_items": 1, "n_too_short": 1, "n_kept": 1, "keep_rate": 1 / 3}
    with pytest.raises(ValueError):
        clean.require(items, "item_id", "price")


def test_mapping(spark):
    base, over = frame(spark, MAP, "master string, coarse string"), frame(spark, [(" Lipstick ", "bag")], "master string, coarse string")
    assert dict(map(tuple, clean.resolved_mapping(base, over).collect()))["Lipstick"] == "BAG"
    bad = frame(spark, [("x", "SOCKS"), ("y", "TOP"), ("y", "TOP"), (" ", "TOP")], "master string, coarse string")
    assert {r.issue for r in clean.mapping_issues(bad).collect()} == {"unknown_class", "repeated", "blank"}


def kit(split, name, n):
    return (split, name, n, [(f"{name}_{i}", "T-Shirts" if i == 0 else "Jeans", "TOP" if i == 0 else "BOTTOM") for i in range(n)])


SAMPLES = "split string, kit_id string, n_items int, items array<struct<item_id string, master string, coarse string>>"


def metadata(samples):
    return samples.select("split", F.col("kit_id").alias("source_kit_id"), F.explode("items").alias("x")).select("split", "source_kit_id", "x.*")


def test_negatives_swap_one_item(spark):
    s = frame(spark, [kit("train", "k1", 3), kit("train", "k2", 3), kit("valid", "alone", 3)], SAMPLES)
    m = metadata(s)
    made = negatives.negatives(s, m)
    rows = made.collect()
    assert {r.kit_id for r in rows} == {"k1", "k2"} and all(r.replacement_kit_id != r.kit_id for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, negatives.negatives(s.repartition(3), m).collect()))
    assert {r.split: (r.n_failed, r.coverage) for r in negatives.negative_report(s, made).collect()} == {"train": (0, 1.0), "valid": (1, 0.0)}
    two = negatives.negatives(s, m, per_sample=2)
    assert two.count() == 4 and negatives.families(s, two).count() == 0
    fam = {r.sample_id: r for r in negatives.families(s, made).collect()}
    for k in ("k1", "k2"):
        assert sum(a != b for a, b in zip(fam[f"{k}_pos"]["items"], fam[f"{k}_neg_1"]["items"])) == 1


def test_negatives_from_own_pools_shuffle_each_pool_once(spark):
    s = frame(spark, [kit("train", f"k{n}", 3 + n % 4) for n in range(40)] + [kit("valid", f"v{n}", 3) for n in range(2)], SAMPLES)
    own = negatives.negatives(s)
    assert own.count() == 42 and sorted(map(tuple, own.collect())) == sorted(map(tuple, negatives.negatives(s, metadata(s)).collect()))
    pool = clean.pools(metadata(s), ["split", "master"]).collect()
    index = {(r.split, r.master, r.pool_index): r for r in pool}
    size = {(r.split, r.master): r.pool_size for r in pool}
    for r in own.collect():  # the first item of another kit from the hashed start on
        n = size[r.split, r.master]
        start = int(hashlib.sha256(f"42|start|{r.kit_id}|{r.original_item_id}|1".encode()).hexdigest()[:8], 16) % n
        assert r.replacement_item_id == next(x.item_id for x in (index[r.split, r.master, (start + k) % n] for k in range(n)) if x.source_kit_id != r.kit_id)
    plan = own._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 0  # pools and probes meet in one shuffle, not by joins of whole tables


FAULTS = {
    "outfit_below_min_items": ("items", lambda: F.slice("items", 1, 2)),
    "duplicate_item_inside_outfit": ("items", lambda: F.concat("items", F.slice("items", 1, 1))),
    "invalid_label": ("label", lambda: F.lit(3)),
    "negative_metadata_missing": ("swap", lambda: F.lit(None)),
    "negative_missing_positive_pair": ("pair_id", lambda: F.lit("none")),
    "negative_sample_id_mismatch": ("sample_id", lambda: F.lit("other")),
    "pair_source_kit_mismatch": ("source_kit_id", lambda: F.lit("k9")),
    "pair_length_mismatch": ("items", lambda: F.concat("items", F.array(F.lit("k1_9")))),
    "missing_item_metadata": ("items", lambda: F.concat(F.slice("items", 1, 2), F.array(F.lit("zz_1")))),
    "missing_sample_fields": ("source_kit_id", lambda: F.lit(None)),
    "invalid_identity": ("source_kit_id", lambda: F.lit(" ")),
}


@pytest.mark.parametrize("code", FAULTS)
def test_pair_validator_reports_each_fault(spark, code):
    s = frame(spark, [kit("train", "k1", 3), kit("train", "k2", 3)], SAMPLES)
    good = negatives.families(s, negatives.negatives(s, metadata(s)))
    good = good.withColumn("swap", F.when(F.col("swap").isNotNull(), F.struct("swap.*", F.lit(expect.SWAP_TYPE).alias("kind"))))
    assert one(expect.gate(expect.pair_issues(good, metadata(s)))) == {"n_issues": 0, "status": "READY"}
    at = F.col("sample_id") == "k1_neg_1"
    c, value = FAULTS[code]
    bad = good.withColumns({c: F.when(at, value().cast(good.schema[c].dataType)).otherwise(F.col(c))})
    found = {r.code: r.n for r in expect.summary(expect.pair_issues(bad, metadata(s)), "sample_id").collect()}
    assert found[code] == 1


SCORED = "sample_id string, pair_id string, label int, compatibility_logit double"


def test_scorer_metrics(spark):
    assert one(metrics.roc_auc(frame(spark, [("a", None, 1, 2.0), ("b", None, 0, -1.0), ("c", None, 1, 1.0), ("d", None, 0, 0.0)], SCORED)))["roc_auc"] == 1.0
    assert one(metrics.roc_auc(frame(spark, [("a", None, 1, 0.5), ("b", None, 0, 0.5)], SCORED)))["roc_auc"] == 0.5
    assert math.isnan(one(metrics.roc_auc(frame(spark, [("a", None, 1, 0.5)], SCORED)))["roc_auc"])
    rows = frame(spark, [("b_neg", "b_pos", 0, 0.2), ("a_pos", None, 1, 2.0), ("b_pos", None, 1, 0.1), ("a_neg", "a_pos", 0, 1.0)], SCORED)
    assert sorted(round(r.margin, 9) for r in metrics.margins(rows).collect()) == [-0.1, 1.0]
    m = one(metrics.scorer_metrics(rows))
    assert m["fitb"] == 0.5 and m["mean_margin"] == pytest.approx(0.45) and m["median_margin"] == pytest.approx(0.45)
    tie = frame(spark, [("p", None, 1, 0.0), ("n", "p", 0, 0.0)], SCORED)
    assert one(metrics.scorer_metrics(tie))["fitb"] == 0.0


def test_agreement(spark):
    xy = lambda x, y: frame(spark, list(zip(x, y)), "x double, y int")
    assert one(metrics.kendall(xy([-1.2, -0.3, 0.2, 1.4, 2.0], [1, 2, 2, 3, 3]), "x", "y", [1, 2, 3]))["kendall_tau_b"] == pytest.approx(8 / math.sqrt(80))
    assert one(metrics.spearman(xy([-0.8, 0.1, 0.4, 0.7, 1.2], [1, 2, 2, 3, 3]), "x", "y"))["spearman_rho"] == pytest.approx(9 / math.sqrt(90))
    q = one(metrics.class_summary(xy([0.0, 10.0, 20.0, 30.0], [1] * 4), "y", "x"))
    assert (q["q1"], q["median"], q["q3"], q["iqr"]) == (7.5, 15.0, 22.5, 15.0)
    assert math.isnan(one(metrics.class_summary(xy([1.0], [1]), "y", "x"))["std"])
    o = one(metrics.pair_ordering(xy([1.0, 2.0, 1.0, 0.0], [2, 2, 1, 1]), "y", "x", [1, 2]))
    assert (o["wins"], o["ties"], o["probability"]) == (3, 1, 0.875)
    empty = one(metrics.pair_ordering(xy([0.1, 0.2], [1, 1]), "y", "x", [1, 2]))
    assert empty["wins"] + empty["ties"] + empty["losses"] == 0 and math.isnan(empty["probability"])
    b = [metrics.bootstrap(xy([0.1, 0.5, 0.2, 0.9, 1.4, 1.1, 0.3, 2.0], [1, 1, 2, 2, 3, 3, 1, 3]), "x", "y", resamples=200).orderBy("statistic").collect() for _ in range(2)]
    assert b[0] == b[1] and all(r.n_valid >= 198 and r.ci_low <= r.ci_high for r in b[0])


def test_calibration(spark):
    x = [5.0, -5.0, 3.0, -3.0, 1.5, -1.5, 0.5, -0.5]
    df = frame(spark, [(str(i), None, int(v > 0), v) for i, v in enumerate(x)], SCORED)
    fit = one(metrics.fit_platt(df, steps=300))
    assert fit["scale"] > 0
    raw, after = one(metrics.calibration(df)), one(metrics.calibration(df, scale=fit["scale"], bias=fit["bias"]))
    assert after["nll"] < raw["nll"] and raw["accuracy"] == 1.0
    p = scalars.sigmoid(F.col("x") * 0.5 - 0.2)
    scores = [r.s for r in frame(spark, [(float(v),) for v in range(-100, 101)], "x double").select("x", scalars.percent_score(p).alias("s")).orderBy("x").collect()]
    assert scores == sorted(scores) and scores[0] == 0 and scores[-1] == 100


ENTRIES = "sample_id string, entries array<struct<pos int, item_id string, coarse_id int, v array<double>>>"


def test_leave_one_out_and_learned_scorer(spark):
    rng = np.random.default_rng(0)
    vs = rng.normal(size=(5, 4))
    vs /= np.linalg.norm(vs, axis=1)[:, None]
    rows = [("s", [(i, f"i{i}", i % 3 + 1, [float(x) for x in v]) for i, v in enumerate(vs)]), ("t", [(i, f"i{i}", 1, [float(x) for x in v]) for i, v in enumerate(vs[:3])])]
    df = frame(spark, rows, ENTRIES)
    mean = lambda m: np.mean([m[i] @ m[j] for i in range(len(m)) for j in range(i)])
    got = [r for r in scoring.leave_one_out(df, 4, "sample_id").collect() if r.sample_id == "s"]
    want = {i: mean(np.delete(vs, i, 0)) - mean(vs) for i in range(5)}
    assert {r.position: pytest.approx(want[r.position], abs=1e-8) == r.delta for r in got} == dict.fromkeys(range(5), True)
    assert [r.position for r in sorted(got, key=lambda r: r["rank"])] == sorted(want, key=lambda i: (-want[i], i))
    targets = frame(spark, [("s", max(want, key=want.get)), ("t", 0)], "sample_id string, target int")
    report = {r.sizes: r for r in scoring.localization(scoring.leave_one_out(df, 4, "sample_id"), targets).collect()}
    assert report["overall"].n == 2 and report["size_4_plus"].top1 == 1.0 and report["overall"].n_extrapolated == 1
    model = scoring.PairScorer.random(4)
    a = model.logits([vs], [np.array([1, 2, 3, 1, 2])])
    order = [3, 1, 4, 0, 2]
    assert model.logits([vs[order]], [np.array([1, 2, 3, 1, 2])[order]]) == pytest.approx(a)
    assert {r.sample_id for r in scoring.learned_logits(df, model, "sample_id").collect()} == {"s", "t"}


def test_retrieval_rerank_evaluation(spark):
    e = lambda i: [1.0 if k == i else 0.0 for k in range(4)]
    catalog = frame(spark, [("same", "T", 1, e(0)), ("p", "T", 1, e(0)), ("c", "T", 1, e(1)), ("wrong", "S", 1, e(0)), ("own", "T", 1, e(0))], "item_id string, master string, coarse_id int, v array<double>")
    entries = [(0, "own", 1, e(0)), (1, "x", 2, e(1)), (2, "y", 5, e(2))]
    q = frame(spark, [("q1", 0, "p", "T", 1, entries), ("q2", 0, "gone", None, 1, entries)], "query_id string, problem int, truth_id string, problem_master string, problem_coarse_id int, entries array<struct<pos int, item_id string, coarse_id int, v array<double>>>")
    q = recommend.retrieval_queries(q, 4)
    h = recommend.hybrid(q, catalog, k=2)
    got = {(r.query_id, r.item_id) for r in h.collect()}
    assert ("q1", "wrong") not in got and not any(i == "own" for _, i in got)
    first = {r.query_id: r.item_id for r in h.where("order_rank = 1").collect()}
    assert first["q1"] == "c"  # rank 1 by context, before p and same by id
    r = recommend.reranked(q, h, catalog, 4)
    done = {x.query_id: (x.status, list(x["items"])) for x in recommend.recommended(q, r).collect()}
    assert done["q1"] == ("ok", ["c", "p", "same"])
    m = one(recommend.evaluation(q, h, r))
    assert m["n_queries"] == 2 and m["coverage"] == 0.5 and m["hybrid_recall_50"] == 0.5
    assert m["successful"] <= m["evaluated_recommendations"] == 6 and m["ground_truth_not_in_full_union"] == 1 and m["fewer_than_three_final_candidates"] == 0
    own = catalog.select("item_id", F.when(F.col("item_id") != "p", F.col("master")).alias("own_master"), F.col("coarse_id").alias("own_coarse"))
    pool = recommend.pool_states(catalog, own, catalog.where("item_id <> 'c'"), catalog.where("item_id <> 'same'"))
    assert {x.item_id: x.state for x in pool.collect()} == {"p": "missing_metadata", "c": "missing_embedding", "same": "missing_image", "wrong": "eligible", "own": "eligible"}
    counters = recommend.retrieval_counters(q, pool, h)
    got = {x.query_id: (x.retrieval_scope, x.category_pool_count, x.missing_metadata_count, x.missing_embedding_count, x.missing_image_count) for x in counters.collect()}
    assert got == {"q1": ("exact_master_category", 0, 1, 1, 1), "q2": ("core7_fallback", 1, 1, 1, 1)}
    t = {x.query_id: json.loads(x.trace) for x in recommend.trace(q.withColumns({"source_split": F.lit("test"), "replacement_id": F.lit("own")}), h, r, counters).collect()}
    assert t["q1"]["final_top3"] == ["c", "p", "same"] and t["q1"]["candidate_counts"]["full_union"] == 3 and t["q1"]["excluded_counts"]["missing_image"] == 1 and t["q2"]["gt_rank_pre_rerank"] is None
    assert t["q1"]["gt_rank_change_pre_minus_post"] == t["q1"]["gt_rank_pre_rerank"] - t["q1"]["gt_rank_post_rerank"] and len(t["q1"]) == 16


def test_block_hits_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    v = [(f"i{k:03}", "ab"[k % 2], [float(x) for x in np.round(rng.normal(0, 1, 4), 1)]) for k in range(120)]
    catalog = frame(spark, v, "item_id string, scope string, v array<double>")
    q = frame(spark, [(f"q{k}", "abz"[k % 3], [f"i{k:03}"], x[2], None if k == 4 else x[2][::-1]) for k, x in enumerate(v[:30])], "query_id string, scope string, own array<string>, one array<double>, two array<double>")
    got = {}
    for r in recommend.block_hits(q, catalog, ["one", "two"], k=5, pool_rows=11, query_rows=4).collect():
        got.setdefault((r.query_id, r.channel), {})[r["rank"]] = r.item_id
    for row in q.collect():
        for channel in ("one", "two"):
            if row[channel] is not None and row.scope != "z":
                best = sorted((-round(float(np.dot(row[channel], x)), 9), i) for i, s, x in v if s == row.scope and i not in row.own)[:5]
                assert [i for _, i in best] == [got[row.query_id, channel][k] for k in range(1, 6)]
            else:
                assert (row.query_id, channel) not in got


def test_quantiles_and_cumulative_counts(spark):
    rng = np.random.default_rng(2)
    values = [*rng.normal(0, 1, 300).tolist(), *[0.5] * 200, 1e12, -1e12, 7.0]
    df = frame(spark, [("a" if i % 3 else "b", float(x)) for i, x in enumerate(values)] + [("c", 4.0), ("c", None)], "g string, x double")
    got = {r.g: (r.lo, r.mid, r.hi) for r in metrics.quantiles(df, "x", {"lo": 0.05, "mid": 0.5, "hi": 0.99}, keys=["g"]).collect()}
    for g, xs in (("a", [x for i, x in enumerate(values) if i % 3]), ("b", values[::3]), ("c", [4.0])):
        assert got[g] == pytest.approx(tuple(np.quantile(xs, [0.05, 0.5, 0.99])))
    below = {r.x: r.below_n for r in metrics.cumulative(df.where("g = 'a'"), "x", {"n": F.count("*")}, bins=7).collect()}
    assert all(n == sum(y < x for y in values[1::3] + values[2::3]) for x, n in below.items())


def test_stage_tables_are_built_once_and_released(spark):
    from weftline.sources import staging

    made = []
    build = lambda: made.append(1) or spark.range(5)
    assert [staging.staged(spark, "here", "numbers", build).count() for _ in range(3)] == [5] * 3 and len(made) == 1
    staging.release(spark)
    assert staging.staged(spark, "here", "numbers", build).count() == 5 and len(made) == 2


def test_a_stage_leaves_no_shuffle_on_disk(spark):
    from weftline.sources import staging

    files = lambda: sum("shuffle_" in f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    kept, before = [], files()
    build = lambda: kept.append(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()) or kept[0]
    assert staging.staged(spark, "there", "counts", build).count() == 7
    until = time.time() + 10
    while files() > before and time.time() < until:
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(staging.CLEANUP) == "false"
    staging.release(spark)


def test_embeddings(spark):
    rows = [("a", [1.0, 0.0]), ("b", [float("nan"), 0.0]), ("c", [0.0, 0.0]), ("d", [2.0, 0.0]), ("e", [1.0]), ("f", None), (" ", [0.0, 1.0]), ("a", [0.0, 1.0])]
    found = {r.code: r.n for r in expect.embedding_issues(frame(spark, rows, "item_id string, v array<double>"), dim=2).groupBy("code").agg(F.count("*").alias("n")).collect()}
    assert found == {"not_finite": 1, "zero_vector": 1, "not_unit_norm": 1, "wrong_dimension": 1, "missing_vector": 1, "blank_id": 1, "duplicate_id": 1}


def test_evidence_and_detection(spark):
    looked = frame(spark, [("s", 3, 0.1, k + 1, p, f"i{p}", 0.1 + d, d) for k, (p, d) in enumerate([(2, 0.5), (0, 0.2), (1, -0.3)])], "sample_id string, n_items int, full_logit double, rank int, position int, item_id string, logit_without double, delta double")
    classes = frame(spark, [("i0", "TOP"), ("i1", "BOTTOM"), ("i2", "SHOES")], "item_id string, coarse string")
    docs = evidence.documents(looked, classes)
    assert evidence.document_issues(docs).count() == 0
    r = one(evidence.explained(docs))
    assert "Món 2 (giày)" in r["headline"] and evidence.EXTRAPOLATION in r["limitations"] and r["context"] == "So với áo trên và quần hoặc váy dưới"
    assert {x.code for x in evidence.document_issues(docs.withColumn("top1_top2_delta_gap", F.lit(9.0))).collect()} == {"gap_identity"}
    scores = frame(spark, [("x", "TOP", 0, 0.5), ("x", "BAG", 1, 0.5), ("y", "TOP", 0, 0.2), ("y", "BAG", 1, 0.9)], "id string, category string, position int, score double")
    best = {b.id: (b.category, b.accepted) for b in detection.best_category(scores, margin=0.1).collect()}
    assert best == {"x": ("TOP", False), "y": ("BAG", True)}
    hashes = frame(spark, [("a", "train", 0), ("b", "test", 0b111), ("c", "test", -1)], "image_id string, split string, phash long")
    assert [(p.a, p.b, p.distance) for p in detection.duplicate_pairs(hashes).collect()] == [("b", "a", 3)] or [(p.a, p.b, p.distance) for p in detection.duplicate_pairs(hashes).collect()] == [("a", "b", 3)]


@pytest.mark.parametrize("within", [0, 5, 9, 15])
def test_image_pairs_against_all_pairs(spark, within):
    rng = np.random.default_rng(within)
    base = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 25)]
    flip = lambda h, n: int(np.uint64(h & (1 << 64) - 1) ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False)))) - (0)
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    rows = [(f"a{i}", "train", h) for i, h in enumerate(base)] + [(f"b{i}", "test", signed(flip(h, i % 18))) for i, h in enumerate(base)] + [("c", "valid", base[0]), ("d", "train", base[0])]
    far = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1")
    want = {(a, b, far(x, y)) for a, s, x in rows for b, t, y in rows if s < t and far(x, y) <= within}
    assert {tuple(r) for r in detection.duplicate_pairs(frame(spark, rows, "image_id string, split string, phash long"), within=within).select("a", "b", "distance").collect()} == want


def test_json_documents():
    assert documents.single_object('```json\n{"a": 1}\n```') == {"a": 1}
    for bad in ('{"a": 1, "a": 2}', 'x {"a": 1}', "[1]", "", None):
        with pytest.raises(ValueError):
            documents.single_object(bad)
    assert documents.forbidden_paths({"a": [{"Label": 1}], "label": {"b": 2}}, {"label"}) == ["root.a[0].Label", "root.label"]
    assert documents.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'


def test_record_files(spark, tmp_path):
    df = frame(spark, [("a", None), ("b", 2)], "id string, n int")
    records.write_jsonl(df, f"{tmp_path}/x")
    assert sorted(map(tuple, records.read_jsonl(spark, f"{tmp_path}/x", df.schema).collect())) == [("a", None), ("b", 2)]
    (tmp_path / "bad").write_text('{"id": "a"}\n\n[{"id": "b"}]\n')
    with pytest.raises(Exception, match="no JSON object"):
        records.read_jsonl(spark, f"{tmp_path}/bad", "id string").collect()
    (tmp_path / "c.csv").write_text("﻿id,n\na,1\n")
    assert records.read_csv(spark, f"{tmp_path}/c.csv", ["id", "n"]).first().id == "a"
    with pytest.raises(ValueError):
        records.write_csv(df.limit(0), f"{tmp_path}/none")
    records.write_report(df.where("id = 'b'"), f"{tmp_path}/report")
    assert records.read_json_object(spark, f"{tmp_path}/report") == {"id": "b", "n": 2}


def test_shards_and_archives(spark, tmp_path):
    for i, names in enumerate((["b", "c"], ["a", "d"], ["z"])):
        np.savez(tmp_path / f"s{i}.npz", item_ids=np.array(names), embeddings=np.eye(4, dtype=np.float16)[[k % 4 for k in range(len(names))]])
    manifest = {"expected_dim": 4, "completed_shards": ["s0.npz", "s1.npz"]}
    got = shards.read_npz(spark, str(tmp_path), dim=4, manifest=manifest)
    assert sorted(r.item_id for r in got.collect()) == ["a", "b", "c", "d"]
    assert one(shards.catalog_status(got, items=4, shards=3)) == {"n_items": 4, "n_shards": 2, "complete": False}
    with pytest.raises(ValueError):
        shards.read_npz(spark, str(tmp_path), dim=5, manifest=manifest)
    with zipfile.ZipFile(tmp_path / "i.zip", "w") as z:
        z.writestr("x/a.jpg", b"1")
        z.writestr("y/a.png", b"2")
        z.writestr("notes.txt", b"3")
    entries = shards.read_zip_entries(spark, str(tmp_path))
    issues = shards.inventory_issues(entries, frame(spark, [("a",), ("m",)], "item_id string"))
    assert {(r.item_id, r.issue) for r in issues.collect()} == {("a", "repeated"), ("m", "missing")}
    assert io.BytesIO(entries.where("entry = 'x/a.jpg'").first().content).read() == b"1"


def test_stream_appends_only_what_is_new(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"id": i}) + "\n")
        traces.append(traces.follow(spark, f"{tmp_path}/in", "id int"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ['{"id":0}', '{"id":1}']


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_bootstrap_query_draws_as_often_as_the_reference(spark):
    from weftline.plans import registry

    got = {r.statistic: r for r in registry.QUERIES["bootstrap_intervals"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {"tau", "rho"} and all(9900 <= r.n_valid <= 10_000 and r.ci_low < r.ci_high for r in got.values())


def test_vectors_are_looked_up_or_joined_alike(spark):
    vectors = frame(spark, [(0, 5, [1.0, 0.0]), (1, 6, [0.0, 1.0]), (2, 7, None), (3, 1, [1.0, 1.0]), (3, 2, [2.0, 2.0])], "vec_id long, label int, v array<double>")
    rows = [("a", [1, 0, 1]), ("b", [0, 9]), ("c", [2, 0]), ("d", [3, 0]), ("e", []), ("f", None), ("g", [None, 0]), ("a", [1, 0, 1])]
    df = frame(spark, rows, "sample_id string, vec_ids array<long>")
    got = [sorted((r.sample_id, list(r.vec_ids), r.vs, r.labels) for r in scoring.attached(df, vectors, held_bytes=n).collect()) for n in (1 << 20, 0)]
    assert got[0] == got[1] == [("a", [1, 0, 1], [[0.0, 1.0], [1.0, 0.0], [0.0, 1.0]], [6, 5, 6])] * 2 + [("c", [2, 0], [None, [1.0, 0.0]], [7, 5])]
    assert scoring.attached(df, vectors.where("false")).count() == 0
    held, joined = (scoring.attached(df, vectors, held_bytes=n)._jdf.queryExecution().toString() for n in (1 << 20, 0))
    assert "Exchange" not in held and "Exchange" in joined  # no vector is shuffled


def test_a_row_per_outfit_serves_as_the_rows_per_position(spark):
    rng = np.random.default_rng(1)
    rows = [(s, n % 3, [(i, f"i{i}", i % 7 + 1, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 4)))]) for s, n in (("s", 5), ("t", 3), ("u", 2))]
    df = frame(spark, rows, "sample_id string, target int, " + ENTRIES.partition(", ")[2])
    found, ranked = scoring.diagnosed(df, 4, "sample_id", "target"), scoring.leave_one_out(df, 4, "sample_id")
    key = lambda r: str(r.sizes)
    assert sorted(scoring.localized(found).collect(), key=key) == sorted(scoring.localization(ranked, df.select("sample_id", "target")).collect(), key=key)
    names = {1: "TOP", 2: "BOTTOM", 3: "DRESS", 4: "OUTERWEAR", 5: "SHOES"}
    classes = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    whole = evidence.documents(ranked, frame(spark, [(f"i{i}", names[i + 1]) for i in range(5)], "item_id string, coarse string"))
    assert sorted(map(tuple, evidence.documents_of(found, classes).collect())) == sorted(map(tuple, whole.collect()))


def test_held_retrieval_equals_blocks_without_a_shuffle(spark):
    rng = np.random.default_rng(5)
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(0, 1, 8))
    rows = [(f"i{n:02}", "LM" [n % 2] if n % 7 else None, n % 3, unit()) for n in range(60)]
    rows[9] = ("i09", "M", 0, rows[11][3])  # a tie
    catalog = frame(spark, rows, "item_id string, master string, coarse_id int, v array<double>")
    entry = lambda p, n: (p, rows[n][0], rows[n][2], rows[n][3])
    asked = [(f"q{k}", k % 3, [entry(p, (7 * k + 5 * p) % 60) for p in range(3 if k % 4 else 4)], None if k % 5 == 0 else "LMx"[k % 3], k % 3) for k in range(20)]
    q = frame(spark, asked, "query_id string, problem int, entries array<struct<pos: int, item_id: string, coarse_id: int, v: array<double>>>, problem_master string, problem_coarse_id int")
    q = recommend.retrieval_queries(q, 8)
    q = q.withColumn("context_query", F.when(F.col("query_id") != "q3", F.col("context_query")))
    rounded = lambda df: sorted(tuple(round(x, 8) if isinstance(x, float) else -1 if x is None else x for x in r) for r in df.collect())
    whole, names = recommend.hybrid(q, catalog, k=6), ["query_id", "item_id", "item_rank", "context_rank", "item_similarity", "context_similarity", "order_rank"]
    assert whole.count() > 60 and rounded(whole.select(names)) == rounded(recommend.held_candidates(q, catalog, k=6).select(names))
    ranked = recommend.reranked(q, whole, catalog, 8)
    held = recommend.held_candidates(q, catalog, dim=8, k=6)
    assert rounded(ranked) == rounded(held.select(ranked.columns))
    assert rounded(ranked.where("final_rank <= 3")) == rounded(recommend.held_candidates(q, catalog, dim=8, k=6, final=3).select(ranked.columns))
    here, blocks = (recommend.rank_then_filter(q, catalog, k=20, held_bytes=n) for n in (1 << 20, 0))
    assert here.count() > 0 and rounded(here) == rounded(blocks)
    assert all("Exchange" not in df._jdf.queryExecution().executedPlan().toString() for df in (held, here))
    assert recommend.fits(catalog, 60 * 128) and not recommend.fits(catalog, 60 * 128 - 1)

"""Queries of outside evaluation inputs, manifests and the calibrator's artifact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import external
from ..sources import calibration
from . import agreement
from . import domain as d
from .domain import query
from .files import _folder


@query("label_issues", """SELECT code, count(*) AS n FROM (SELECT unnest(CASE k % 20 WHEN 1 THEN ['missing_prediction'] WHEN 2 THEN ['missing_human_label'] WHEN 3 THEN ['human_ordinal_mismatch'] WHEN 4 THEN ['duplicate_prediction'] WHEN 5 THEN ['duplicate_human_label'] WHEN 6 THEN ['missing_prediction', 'missing_human_label'] ELSE [] END) AS code FROM (SELECT o_orderkey AS k FROM orders)) GROUP BY code""")
def label_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as outfits: predictions, human classes and the manifest with faults for each of a few residues of the key."""
    o = d.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("outfit_id"), F.col("o_totalprice").cast("double").alias("compatibility_logit"), (F.col("o_orderkey") % 20).alias("r"))
    twice = lambda df, r: df.unionByName(df.where(F.col("r") == r)).drop("r")
    p = twice(o.where("r not in (1, 6)"), 4)
    cmt = (F.length("outfit_id") % 3 + 1).cast("int")
    h = twice(o.where("r not in (2, 6)").select("outfit_id", cmt.alias("cmt_original"), (4 - cmt + F.when(F.col("r") == 3, 1).otherwise(0)).alias("human_ordinal_quality"), "r"), 5)
    return external.label_issues(p, h, o.select("outfit_id")).groupBy("code").agg(F.count("*").alias("n"))


@query("id_list_report", "SELECT count(*) AS n, count(DISTINCT c_name) AS n_unique, 0 AS n_blank, min_by(c_name, c_custkey) AS first_outfit_id, max_by(c_name, c_custkey) AS last_outfit_id, sha256(string_agg(c_name, chr(10) ORDER BY c_custkey)) AS sha256 FROM customer")
def id_list_report(spark: SparkSession, sf: str) -> DataFrame:
    c = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("position"), F.concat(F.lit(" "), "c_name").alias("outfit_id"))
    return external.id_list_report(c)


PATH = "CASE r WHEN 0 THEN 'Outfits/' || s_suppkey || '/bag.jpg' WHEN 1 THEN 'outfit/' || s_suppkey || '/bag.jpg' WHEN 2 THEN s_suppkey || '/bag.jpg' WHEN 3 THEN 'outfit/' || s_suppkey || '/bag.JPG' WHEN 4 THEN 'Outfits/' || s_suppkey || '/bag.JPG' END"


@query("member_map", f"SELECT s_suppkey AS item_index, {PATH} AS member FROM (SELECT s_suppkey, s_suppkey % 6 AS r FROM supplier)")
def member_map(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as outfits with one image: under one of the patterns, under two at once, or under none."""
    s = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("item_index"), F.col("s_suppkey").cast("string").alias("outfit_id"), F.lit("bag").alias("role"), (F.col("s_suppkey") % 6).alias("r"))
    at = lambda folder, end: F.concat(F.lit(folder), "outfit_id", F.lit(f"/bag.{end}"))
    names = F.array(F.when(F.col("r") == 0, at("Outfits/", "jpg")), F.when(F.col("r").isin(0, 1), at("outfit/", "jpg")), F.when(F.col("r").isin(0, 2), at("", "jpg")), F.when(F.col("r") == 3, at("outfit/", "JPG")), F.when(F.col("r") == 4, at("Outfits/", "JPG")), F.when(F.col("r") == 5, at("other/", "jpg")))
    members = s.select(F.explode(F.filter(names, lambda x: x.isNotNull())).alias("name"))
    return external.member_map(s.drop("r"), members).select("item_index", "member")


@query("split_manifest", "SELECT split, count(*) AS sample_count, count(*) FILTER (label = 1) AS positive_count, count(*) FILTER (label = 0) AS negative_count, count(DISTINCT source_kit_id) FILTER (label = 1) AS source_kit_count FROM records GROUP BY split", "records")
def split_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return external.split_counts(d.records(spark, sf))


@query("stale_inputs", "SELECT reason, count(*) AS n FROM (SELECT CASE s_suppkey % 8 WHEN 1 THEN 'missing_report_fingerprint' WHEN 2 THEN 'missing_current_file' WHEN 3 THEN 'sha256_mismatch' WHEN 4 THEN 'sha256_mismatch' END AS reason FROM supplier) WHERE reason IS NOT NULL GROUP BY 1")
def stale_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as input files of a report: some untold, gone, altered, or recorded without a hash."""
    s = d.table(spark, sf, "supplier").select(F.col("s_name").alias("artifact"), F.sha2("s_name", 256).alias("h"), (F.col("s_suppkey") % 8).alias("r"))
    then = s.where("r <> 1").select("artifact", F.when(F.col("r") == 3, "old").when(F.col("r") != 4, F.col("h")).alias("sha256"))
    now = s.select("artifact", F.when(F.col("r") != 2, F.col("h")).alias("sha256"))
    return external.stale_inputs(then, now).groupBy("reason").agg(F.count("*").alias("n"))


@query("calibrated_scores", f"SELECT sample_id, round({agreement.P.format(a=agreement.SCALE, b=agreement.BIAS)}, 6) AS probability, greatest(0, least(100, floor({agreement.P.format(a=agreement.SCALE, b=agreement.BIAS)} * 100 + 0.5)))::INTEGER AS score FROM scored", "scored")
def calibrated_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by a calibrator that is written and read back."""
    at = _folder(spark, "calibrator")
    calibration.save(spark, calibration.Calibrator(agreement.SCALE, agreement.BIAS, "stand-in"), at)
    c, x = calibration.load(spark, at), F.col("compatibility_logit")
    return agreement.logits(spark, sf).select("sample_id", F.round(c.probability(x), 6).alias("probability"), c.score(x).alias("score"))

"""Queries of sources and sinks: files written from the tables, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import expect
from ..sources import bundles, records, shards
from ..sources.staging import staging_dir
from . import domain as d
from .domain import query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{staging_dir(spark)}/weftline-files/{name}-{uuid.uuid4().hex}"


@query("jsonl_round_trip", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, [c_mktsegment, c_name][1 + c_custkey % 2] AS last FROM customer")
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as JSON lines with null fields and arrays, read back strictly."""
    at = _folder(spark, "jsonl")
    c = d.table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.array("c_mktsegment", "c_name").alias("tags"))
    records.write_jsonl(c, at)
    back = records.read_jsonl(spark, at, c.schema)
    return back.select("c_custkey", "c_name", "c_acctbal", F.get("tags", (F.col("c_custkey") % 2).cast("int")).alias("last"))


@query("csv_round_trip", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name || ', \"' || n_regionkey || '\"' AS label FROM nation")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as CSV with quotes and commas inside, read back as texts."""
    at = _folder(spark, "csv")
    n = d.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), F.concat("n_name", F.lit(', "'), F.col("n_regionkey").cast("string"), F.lit('"')).alias("label"))
    records.write_csv(n, at)
    return records.read_csv(spark, at, ["n_nationkey", "label"])


@query("report_round_trip", "SELECT count(*) AS n, sum(s_suppkey)::BIGINT AS total, min(s_name) AS first FROM supplier")
def report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A report of one row as an indented object, read back with repeated keys refused."""
    at = _folder(spark, "report")
    s = d.table(spark, sf, "supplier").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("total"), F.min("s_name").alias("first"))
    records.write_report(s, at)
    got = records.read_json_object(spark, at)
    return spark.createDataFrame([(got["n"], got["total"], got["first"])], "n long, total long, first string")


@query("resumed_rows", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey % 3 <> 1 GROUP BY 1")
def resumed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What an interrupted run has left to do."""
    c = d.table(spark, sf, "customer")
    return records.remaining(c, c.where("c_custkey % 3 = 1"), "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("shard_catalog", "SELECT 'v' || vec_id AS item_id, label, round(v[1], 3) AS first, round(list_inner_product(v, v), 2) AS norm FROM vec", "vec")
def shard_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as NPZ shards of half precision under a manifest that names them, read back; components lose their fourth digit."""
    at = _folder(spark, "npz")
    v = d.vectors(spark, sf).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("item_id"), "label", "v")
    made = [r.name for r in bundles.write_npz(v, at, shard_rows=200).select("name").collect()]  # a name per shard
    got = shards.read_npz(spark, at, dim=d.DIM, manifest={"expected_dim": d.DIM, "normalized": True, "completed_shards": made})
    back = got.join(v.select("item_id", "label", F.col("v").alias("_v")), "item_id")
    same = F.forall(F.zip_with("v", "_v", lambda x, y: F.abs(x - y) < 1e-3), lambda x: x)
    kept = F.when(same, F.col("_v"))
    return back.select("item_id", "label", F.round(F.get(kept, F.lit(0)), 3).alias("first"), F.round(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x * x), 2).alias("norm"))


@query("shard_status", "SELECT count(*) AS n_items, TRUE AS complete FROM embeddings")
def shard_status(spark: SparkSession, sf: str) -> DataFrame:
    """The shards against the counts that their manifest declares."""
    at = _folder(spark, "npz")
    v = d.vectors(spark, sf).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("item_id"), "v")
    made = bundles.write_npz(v, at, shard_rows=200).agg(F.count("*").alias("shards"), F.sum("rows").alias("rows")).first()
    return shards.catalog_status(shards.read_npz(spark, at, dim=d.DIM), items=made.rows, shards=made.shards).select("n_items", "complete")


def _archives(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, str]:
    """Suppliers as images in ZIP archives by nation, among entries of other kinds: index, suppliers, folder."""
    at = _folder(spark, "zips")
    s = d.table(spark, sf, "supplier")
    image = F.struct(F.concat(F.lit("images/"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".jpg").otherwise(".PNG")).alias("entry"), F.encode("s_name", "UTF-8").alias("content"))
    note = F.struct(F.concat(F.lit("notes/"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("entry"), F.encode(F.lit("note"), "UTF-8").alias("content"))
    entries = s.where("s_suppkey % 11 <> 0").select(F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string"), F.lit(".zip")).alias("archive"), F.explode(F.array(image, note)).alias("e")).select("archive", "e.*")
    bundles.write_zips(entries, at).count()
    return bundles.zip_index(spark, at, suffixes=shards.IMAGE_SUFFIXES), s, at


@query("archive_index", "SELECT 'nation-' || s_nationkey || '.zip' AS archive, count(*) AS n, sum(strlen(s_name))::BIGINT AS bytes FROM supplier WHERE s_suppkey % 11 <> 0 GROUP BY 1")
def archive_index(spark: SparkSession, sf: str) -> DataFrame:
    return _archives(spark, sf)[0].groupBy("archive").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("wanted_images", "SELECT s_suppkey::VARCHAR AS item_id, s_suppkey % 11 <> 0 AS readable, CASE WHEN s_suppkey % 11 <> 0 THEN s_name END AS text, CASE WHEN s_suppkey % 11 <> 0 THEN 'nation-' || s_nationkey || '.zip' END AS archive FROM supplier WHERE s_suppkey % 3 = 0")
def wanted_images(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the images by id, archive by archive, some of them missing."""
    index, s, at = _archives(spark, sf)
    got = bundles.read_wanted(index, s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").cast("string").alias("item_id")), at)
    return got.select("item_id", "readable", F.decode("content", "UTF-8").alias("text"), "archive")


@query("archive_gate", "SELECT issue, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 11 = 0 THEN 'missing' WHEN s_suppkey % 13 = 0 THEN 'unexpected' END AS issue FROM supplier) WHERE issue IS NOT NULL GROUP BY 1")
def archive_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Images in the archives against the ids that should be there, in both directions."""
    index, s, _ = _archives(spark, sf)
    wanted = s.where("s_suppkey % 13 <> 0 or s_suppkey % 11 = 0").select(F.col("s_suppkey").cast("string").alias("item_id"))
    return shards.inventory_issues(index.withColumn("readable", F.lit(True)), wanted).groupBy("issue").agg(F.count("*").alias("n"))


@query("bundle_issues", "SELECT code, count(*) AS n FROM (SELECT unnest(CASE s_suppkey % 5 WHEN 1 THEN ['missing_required_entry'] WHEN 2 THEN ['entry_sha256_mismatch'] ELSE [] END) AS code FROM supplier) GROUP BY code")
def bundle_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles of two entries each against what is required of them: one is lost in some, altered in others."""
    s, r = d.table(spark, sf, "supplier"), F.col("s_suppkey") % 5
    sha = lambda text: F.sha2(F.lit(text), 256)
    both = F.array(F.struct(F.lit("manifest.json").alias("entry"), F.when(r == 2, sha("other")).otherwise(sha("manifest")).alias("sha256")), F.struct(F.when(r == 1, "lost.json").otherwise("metadata.jsonl").alias("entry"), F.concat(sha("any"), F.lit("")).alias("sha256")))
    entries = s.select(F.col("s_name").alias("archive"), F.explode(both).alias("e")).select("archive", "e.*")
    required = spark.range(1).select(F.explode(F.array(F.struct(F.lit("manifest.json").alias("entry"), sha("manifest").alias("sha256")), F.struct(F.lit("metadata.jsonl").alias("entry"), F.lit(None).cast("string").alias("sha256")))).alias("e")).select("e.*")
    return bundles.bundle_issues(entries, required).groupBy("code").agg(F.count("*").alias("n"))


@query("file_fingerprints", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN r_regionkey % 5 = 1 THEN 'missing' WHEN r_regionkey % 5 = 2 THEN 'changed' WHEN r_regionkey % 5 = 3 THEN 'new' ELSE 'same' END AS status FROM region) GROUP BY 1")
def file_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each region, hashed, against recorded hashes: some are gone, altered or new since."""
    at = _folder(spark, "hashed")
    r = d.table(spark, sf, "region")
    name = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit(".zip"))
    bundles.write_zips(r.where("r_regionkey % 5 <> 1").select(name.alias("archive"), F.lit("name").alias("entry"), F.encode("r_name", "UTF-8").alias("content")), at).count()
    now = bundles.fingerprints(spark, at, glob="*.zip")
    old = r.where("r_regionkey % 5 <> 3").select(name.alias("name"), "r_regionkey").join(now, "name", "left").select("name", F.when(F.col("r_regionkey") % 5 == 2, "old").otherwise(F.coalesce("sha256", F.lit("gone"))).alias("sha256"))
    return bundles.changes(old, now).groupBy("status").agg(F.count("*").alias("n"))


@query("text_lines", "SELECT count(*) AS n, sha256(string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' || chr(10), '' ORDER BY r_regionkey)) AS sha256, sum(strlen(r_name)) + count(*) * strlen('{\"r_regionkey\":0,\"r_name\":\"\"}') + count(*) AS bytes FROM region")
def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Compact JSON lines byte by byte: the hash of the one file that holds the regions in order."""
    at = _folder(spark, "lines")
    records.write_jsonl(d.table(spark, sf, "region").select("r_regionkey", "r_name").coalesce(1).sortWithinPartitions("r_regionkey"), at)
    n = spark.read.text(at).agg(F.count("*").alias("n"))
    return bundles.fingerprints(spark, at, glob="part-*").select("sha256", "bytes").join(F.broadcast(n))  # a row on each side


@query("issue_summary", "SELECT 'label_must_be_1' AS code, count(*) AS n, list_aggregate(list_slice(list(kit_id || '_pos' ORDER BY kit_id || '_pos'), 1, 50), 'string_agg', ',') AS examples FROM samples WHERE kit_id::BIGINT % 50 = 2", "samples")
def issue_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts with the first fifty examples, as a report shows them."""
    from .benchmark import _faulty, _positives

    found = expect.positive_issues(_faulty(_positives(spark, sf)), d.core(spark, sf)).where("code = 'label_must_be_1'")
    return expect.summary(found, "sample_id").withColumn("examples", F.array_join("examples", ","))

"""Inputs of an evaluation on outside outfits and the records that bind a benchmark to its files: gates, joins, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import ordered_hash
from ..sources.records import read_json_object

# Where an archive may hold the image of an outfit's role, the first that exists counts.
MEMBER_PATTERNS = ("Outfits/{outfit}/{role}.jpg", "outfit/{outfit}/{role}.jpg", "{outfit}/{role}.jpg", "Outfits/{outfit}/{role}.JPG", "outfit/{outfit}/{role}.JPG", "{outfit}/{role}.JPG")
# Versions of manifests, and the status of a protocol that no longer changes.
SPLIT_MANIFEST, DATASET_MANIFEST, FROZEN = "split-manifest-v2", "dataset-manifest-v2", "FROZEN"


def frozen_protocol(spark: SparkSession, path: str) -> dict:
    """The protocol object at path, refused unless it is frozen."""
    found = read_json_object(spark, path)
    if found.get("protocol_status") != FROZEN:
        raise ValueError("the protocol isn't frozen")
    return found


def label_issues(predictions: DataFrame, human: DataFrame, manifest: DataFrame) -> DataFrame:
    """outfit_id, code of what keeps the three from meeting one to one. predictions: outfit_id, compatibility_logit; human: outfit_id,
    cmt_original, human_ordinal_quality (4 - cmt_original); manifest: outfit_id, which drives. A null counts as a mismatch."""
    repeated = lambda df, code: df.groupBy("outfit_id").agg(F.count("*").alias("_n")).where("_n > 1").select("outfit_id", F.lit(code).alias("code"))
    lacking = lambda df, code: manifest.join(df, "outfit_id", "left_anti").select("outfit_id", F.lit(code).alias("code"))
    wrong = human.join(manifest, "outfit_id", "left_semi").where(~F.col("human_ordinal_quality").cast("int").eqNullSafe(4 - F.col("cmt_original").cast("int"))).select("outfit_id", F.lit("human_ordinal_mismatch").alias("code"))
    found = repeated(predictions, "duplicate_prediction").unionByName(repeated(human, "duplicate_human_label"))
    return found.unionByName(lacking(predictions, "missing_prediction")).unionByName(lacking(human, "missing_human_label")).unionByName(wrong)


def labelled(predictions: DataFrame, human: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest's outfits with their prediction and human label, where label_issues() finds none; the gate is the caller's."""
    return manifest.join(predictions, "outfit_id").join(human, "outfit_id")


def id_list_report(ids: DataFrame) -> DataFrame:
    """One row of a list of outfits (position, outfit_id): n, n_unique, n_blank, sha256 of the stripped ids in order, first and last id."""
    x = ids.select("position", F.trim(F.coalesce("outfit_id", F.lit(""))).alias("outfit_id"))
    counts = x.agg(F.count("*").alias("n"), F.countDistinct("outfit_id").alias("n_unique"), F.count_if(F.col("outfit_id") == "").alias("n_blank"), F.min_by("outfit_id", "position").alias("first_outfit_id"), F.max_by("outfit_id", "position").alias("last_outfit_id"))
    return counts.crossJoin(ordered_hash(x, F.col("outfit_id"), "position").select("sha256"))  # a row on each side


def id_list_issues(report: DataFrame, frozen: dict, *, count: int) -> DataFrame:
    """code of what a list's report breaks of its frozen manifest (test_outfit_count, unique_test_outfit_count, ordered_test_ids_sha256,
    first_outfit_id, last_outfit_id; the last three may be absent)."""
    said = lambda key: F.lit(str(frozen[key]).strip()) if frozen.get(key) else None
    differs = lambda c, key: F.lit(False) if said(key) is None else ~F.col(c).eqNullSafe(said(key))
    rules: dict[str, Column] = {
        "unexpected_count": F.col("n") != count,
        "duplicate_outfit_id": F.col("n_unique") != F.col("n"),
        "blank_outfit_id": F.col("n_blank") > 0,
        "manifest_count_mismatch": F.lit(frozen.get("test_outfit_count") != count or frozen.get("unique_test_outfit_count") != count),
        "ordered_ids_sha256_mismatch": differs("sha256", "ordered_test_ids_sha256"),
        "first_outfit_mismatch": differs("first_outfit_id", "first_outfit_id"),
        "last_outfit_mismatch": differs("last_outfit_id", "last_outfit_id"),
    }
    return report.select(F.explode(F.filter(F.array(*(F.when(c, code) for code, c in rules.items())), lambda x: x.isNotNull())).alias("code"))


def member_map(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """item_index, outfit_id, role, member of wanted items (item_index, outfit_id, role): the first of MEMBER_PATTERNS that members (name) holds,
    null where none does."""
    path = lambda p: F.concat(*(F.lit(x) if i % 2 == 0 else F.col(x) for i, x in enumerate(p.replace("{outfit}", "\0outfit_id\0").replace("{role}", "\0role\0").split("\0"))))
    asked = wanted.select("item_index", F.posexplode(F.array(*map(path, MEMBER_PATTERNS))).alias("_place", "_path"))
    met = asked.join(members.select(F.col("name").alias("_path")).distinct(), "_path").groupBy("item_index").agg(F.min_by("_path", "_place").alias("member"))
    return wanted.select("item_index", "outfit_id", "role").join(met, "item_index", "left")


def split_counts(records: DataFrame) -> DataFrame:
    """By split: sample_count, positive_count, negative_count, source_kit_count (distinct kits of positives)."""
    positive = F.col("label") == 1
    return records.groupBy("split").agg(F.count("*").alias("sample_count"), F.count_if(positive).alias("positive_count"), F.count_if(F.col("label") == 0).alias("negative_count"), F.countDistinct(F.when(positive, F.col("source_kit_id"))).alias("source_kit_count"))


def manifests(records: DataFrame, files: DataFrame, *, dataset_version: str, splits: tuple[str, ...] = ("train", "valid", "test"), **facts) -> tuple[dict, dict]:
    """Manifest of the splits and of the whole set: the counts of each split beside the names and hashes of its files. files: split, kind
    (scorer, negative, item_metadata), file, sha256. Raises where a split lacks a file. A row per split and file comes to the driver."""
    counts = {r.split: r.asDict() for r in split_counts(records).collect()}
    at = {(r.split, r.kind): r for r in files.collect()}
    entries: dict[str, dict] = {}
    for split in splits:
        lacking = [k for k in ("scorer", "negative", "item_metadata") if (split, k) not in at]
        if lacking:
            raise ValueError(f"{split} lacks {', '.join(lacking)}")
        own = counts.get(split, {k: 0 for k in ("sample_count", "positive_count", "negative_count", "source_kit_count")})
        named = {f"{k}_{f}": at[split, k][f] for k in ("scorer", "negative", "item_metadata") for f in ("file", "sha256")}
        entries[split] = named | {k: v for k, v in own.items() if k != "split"}
    whole = {"dataset_version": dataset_version, "splits": entries}
    return whole | {"manifest_version": SPLIT_MANIFEST}, whole | {"manifest_version": DATASET_MANIFEST} | facts


def stale_inputs(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """artifact, reason of inputs whose recorded hash doesn't hold any more. recorded: artifact, sha256; current: artifact, sha256 for each
    input that the report must cover, null where its file is gone."""
    met = current.select("artifact", F.col("sha256").alias("_now")).join(recorded.select("artifact", F.col("sha256").alias("_then"), F.lit(True).alias("_told")), "artifact", "left")
    reason = F.when(F.col("_told").isNull(), "missing_report_fingerprint").when(F.col("_now").isNull(), "missing_current_file").when(~F.col("_now").eqNullSafe(F.col("_then")), "sha256_mismatch")
    return met.select("artifact", reason.alias("reason")).where("reason is not null")

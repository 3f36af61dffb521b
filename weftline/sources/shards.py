"""Sharded vector catalogs (NPZ) and image archives (ZIP) as tables, read through Spark's binary file source."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")


def shard_names(manifest: dict, dim: int) -> list[str] | None:
    """Completed shards of a manifest, or none to take all; wrong dimension or normalisation is an error."""
    if manifest.get("expected_dim", dim) != dim:
        raise ValueError(f"the manifest has dimension {manifest['expected_dim']}")
    if manifest.get("normalized") is False:
        raise ValueError("the manifest's vectors aren't normalised")
    return manifest.get("completed_shards")


def read_npz(spark: SparkSession, folder: str, *, dim: int, manifest: dict | None = None, tolerance: float = 0.02, glob: str = "*.npz") -> DataFrame:
    """shard, item_id, v of NPZ shards; each shard is one row of the binary source and is unpacked where it lies.

    Shards that the manifest doesn't name aren't read. Shape, finiteness and norms are checked shard by shard.
    """
    names = shard_names(manifest or {}, dim)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    if names is not None:
        files = files.where(F.col("shard").isin(list(names)))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for got in batches:
            for name, content in zip(got["shard"], got["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    ids, v = z["item_ids"], z["embeddings"].astype(np.float64)
                if v.ndim != 2 or v.shape != (len(ids), dim):
                    raise ValueError(f"{name}: shape {v.shape}")
                if not np.isfinite(v).all() or (np.abs(np.linalg.norm(v, axis=1) - 1) > tolerance).any():
                    raise ValueError(f"{name}: vectors that aren't finite and of unit length")
                for i in range(0, len(ids), 4096):
                    yield pd.DataFrame({"shard": name, "item_id": [str(x) for x in ids[i : i + 4096]], "v": list(v[i : i + 4096])})

    return files.mapInPandas(unpack, "shard string, item_id string, v array<double>")


def catalog_status(catalog: DataFrame, *, items: int | None, shards: int | None) -> DataFrame:
    """n_items, n_shards, complete against the declared counts."""
    s = catalog.agg(F.count("*").alias("n_items"), F.count_distinct("shard").alias("n_shards"))
    return s.withColumn("complete", (F.col("n_items") == F.lit(items if items is not None else -1)) & (F.col("n_shards") == F.lit(shards if shards is not None else -1)))


def read_zip_entries(spark: SparkSession, folder: str, *, suffixes=IMAGE_SUFFIXES, glob: str = "*.zip") -> DataFrame:
    """archive, entry, item_id (the stem), size, readable, content of matching entries."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    kinds = tuple(suffixes)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for got in batches:
            for name, content in zip(got["archive"], got["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for e in z.infolist():
                        if e.is_dir() or not e.filename.lower().endswith(kinds):
                            continue
                        try:
                            data, fine = z.read(e), True
                        except (zipfile.BadZipFile, OSError):
                            data, fine = b"", False
                        stem = e.filename.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                        yield pd.DataFrame({"archive": [name], "entry": [e.filename], "item_id": [stem], "size": [e.file_size], "readable": [fine], "content": [data]})

    return files.mapInPandas(unpack, "archive string, entry string, item_id string, size long, readable boolean, content binary")


def inventory_issues(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """item_id, issue: repeated, unreadable, missing (of wanted.item_id), unexpected."""
    e = entries.groupBy("item_id").agg(F.count("*").alias("n"), F.min(F.col("readable").cast("int")).alias("ok"))
    own = e.select("item_id", F.explode(F.filter(F.array(F.when(F.col("n") > 1, "repeated"), F.when(F.col("ok") == 0, "unreadable")), lambda x: x.isNotNull())).alias("issue"))
    missing = wanted.select("item_id").distinct().join(e.select("item_id"), "item_id", "left_anti").withColumn("issue", F.lit("missing"))
    extra = e.select("item_id").join(wanted.select("item_id").distinct(), "item_id", "left_anti").withColumn("issue", F.lit("unexpected"))
    return own.unionByName(missing).unionByName(extra)


def zip_json(content: bytes, entry: str) -> dict:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return json.loads(z.read(entry))

"""Files that the executors write, hash and gate: NPZ shards, ZIP archives, fingerprints, bundles of required entries."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def filesystem(path: str):
    """(pyarrow filesystem, path in it) of a folder by its scheme; executors and driver use the same."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _put(folder: str, name: str, content: bytes) -> None:
    """Writes under another name and moves, so that a reader never sees half a file."""
    store, at = filesystem(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/.{name}.part", compression=None) as f:
        f.write(content)
    store.move(f"{at}/.{name}.part", f"{at}/{name}")


FILES = "name string, rows long, bytes long, sha256 string"


def write_npz(vectors: DataFrame, folder: str, *, shard_rows: int = 65_536) -> DataFrame:
    """vectors: item_id, v. Writes shards of item_ids and embeddings (half precision) by hash of the item; a row of FILES each."""
    shards = max(1, -(-vectors.count() // shard_rows))

    def write(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        got, out, name = got.sort_values("item_id"), io.BytesIO(), f"shard-{int(key[0]):05}.npz"
        np.savez(out, item_ids=got["item_id"].to_numpy(str), embeddings=np.stack(got["v"].to_numpy()).astype(np.float16))
        _put(folder, name, out.getvalue())
        return pd.DataFrame({"name": [name], "rows": [len(got)], "bytes": [len(out.getvalue())], "sha256": [hashlib.sha256(out.getvalue()).hexdigest()]})

    return vectors.select("item_id", "v", F.pmod(F.xxhash64("item_id"), F.lit(shards)).alias("_s")).groupBy("_s").applyInPandas(write, FILES)


def write_zips(entries: DataFrame, folder: str) -> DataFrame:
    """entries: archive, entry, content (binary). One ZIP per archive, its entries in order; a row of FILES each."""

    def write(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in got.sort_values("entry").itertuples():
                z.writestr(zipfile.ZipInfo(r.entry, (1980, 1, 1, 0, 0, 0)), bytes(r.content))
        _put(folder, key[0], out.getvalue())
        return pd.DataFrame({"name": [key[0]], "rows": [len(got)], "bytes": [len(out.getvalue())], "sha256": [hashlib.sha256(out.getvalue()).hexdigest()]})

    return entries.groupBy("archive").applyInPandas(write, FILES)


def zip_index(spark: SparkSession, folder: str, *, suffixes: tuple[str, ...], glob: str = "*.zip") -> DataFrame:
    """archive, entry, item_id (the stem), size of matching entries; only directories of the archives are read."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("archive"))  # no content

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, path = filesystem(folder)
        for got in batches:
            for name in got["archive"]:
                with where.open_input_file(f"{path}/{name}") as f, zipfile.ZipFile(f) as z:
                    found = [e for e in z.infolist() if not e.is_dir() and e.filename.lower().endswith(suffixes)]
                    yield pd.DataFrame({"archive": name, "entry": [e.filename for e in found], "item_id": [e.filename.rsplit("/", 1)[-1].rsplit(".", 1)[0] for e in found], "size": [e.file_size for e in found]})

    return names.mapInPandas(index, "archive string, entry string, item_id string, size long")


def read_wanted(index: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """item_id, archive, entry, readable, content of the wanted ids: they are grouped by archive, each is opened once, and only the
    wanted entries are read. Ids without an entry come back with nulls; an id with two entries is an error."""

    def read(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        where, path = filesystem(folder)
        out = []
        with where.open_input_file(f"{path}/{key[0]}") as f, zipfile.ZipFile(f) as z:
            for r in got.sort_values("entry").itertuples():
                try:
                    out.append((r.item_id, key[0], r.entry, True, z.read(r.entry)))
                except (zipfile.BadZipFile, OSError, KeyError):
                    out.append((r.item_id, key[0], r.entry, False, None))
        return pd.DataFrame(out, columns=["item_id", "archive", "entry", "readable", "content"])

    one = index.groupBy("item_id").agg(F.count("*").alias("_n"), F.first(F.struct("archive", "entry")).alias("_e"))
    place = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("more than one entry for "), F.col("item_id")))).otherwise(F.col("_e"))
    met = wanted.select("item_id").distinct().join(one.select("item_id", place.alias("_e")), "item_id", "left").select("item_id", "_e.archive", "_e.entry")
    schema = "item_id string, archive string, entry string, readable boolean, content binary"
    read_ = met.where("archive is not null").groupBy("archive").applyInPandas(read, schema)
    none = met.where("archive is null").select("item_id", "archive", "entry", F.lit(False).alias("readable"), F.lit(None).cast("binary").alias("content"))
    return read_.unionByName(none)


def fingerprints(spark: SparkSession, folder: str, *, glob: str = "*") -> DataFrame:
    """name, bytes, sha256 of the files in a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changes(recorded: DataFrame, current: DataFrame, *, key: str = "name") -> DataFrame:
    """key, status of recorded hashes against current ones: same, changed, missing (now) or new."""
    a, b = recorded.select(key, F.col("sha256").alias("_r")), current.select(key, F.col("sha256").alias("_c"))
    status = F.when(F.col("_r").isNull(), "new").when(F.col("_c").isNull(), "missing").when(F.col("_r") != F.col("_c"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def bundle_issues(entries: DataFrame, required: DataFrame) -> DataFrame:
    """archive, entry, code of bundles: entries (archive, entry, sha256) against required (entry, sha256; null: any content)."""
    need = entries.select("archive").distinct().crossJoin(F.broadcast(required.select("entry", F.col("sha256").alias("_want"))))  # a handful of required entries
    met = need.join(entries.select("archive", "entry", F.col("sha256").alias("_got")), ["archive", "entry"], "left")
    code = F.when(F.col("_got").isNull(), "missing_required_entry").when(F.col("_got") != F.col("_want"), "entry_sha256_mismatch")
    return met.select("archive", "entry", code.alias("code")).where("code is not null")

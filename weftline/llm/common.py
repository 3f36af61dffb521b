"""What the corpus operators share: tables in the shared folder, word patterns, and arrays of a Spark string column."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words of all contracts, as Java and DuckDB regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one.

    On a cluster without that setting there is no such folder, which is an error: a machine-local
    folder would lose rows.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="weftline-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used; removed when the driver ends."""
    path = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = []
        atexit.register(_clean, spark, app)
    _made[app].append(path)
    return path


def _clean(spark: SparkSession, app: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    for path in _made.pop(app, []):
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is scratch
            return


def written(df: DataFrame, name: str, *, by: str | None = None) -> DataFrame:
    """The rows from a table in the shared folder: the lineage ends there, so a lost executor costs a reread only.

    by: a column that folders of the table stand for, so that a filter on it reads only its own rows.
    """
    path = fresh_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame, *, each: int = 8) -> DataFrame:
    """df with up to each neighbouring partitions in one, where it has more than four a core: fewer small files when it is written.

    For rows read from files: counting the partitions of a shuffle would run it.
    """
    n = df.rdd.getNumPartitions()
    return df.coalesce(max(1, min(n, max(4 * df.sparkSession.sparkContext.defaultParallelism, parts_for(n, each)))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column):
    """Number of words of a text, natively: runs of other characters than white space."""
    return F.regexp_count(column, F.lit(r"[^ \t-\r]+")).cast("long")


def held_out(column: str = "doc_id"):
    """crc32(doc_id as text) mod 5 is 0; a null doc_id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def parts_for(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Holds the rows of an Arrow batch to what long texts allow, in this session; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def string_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string column without nulls, not copied."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind, n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices_of(offsets: np.ndarray, size: int):
    """(first, last) document numbers of runs of at most about size bytes; a longer document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x

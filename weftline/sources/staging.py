"""Stage tables: a stage of the benchmark is built once in a session and read by everything after it."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[tuple[str, str, str], DataFrame] = {}


def staging_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one that goes with the driver."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="weftline-stages-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def staged(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """build()'s rows from a table in the shared folder, written the first time that the session asks for this stage of source.

    The lineage ends at the table, so a lost executor costs a reread only, and each input is read once however many
    stages need it. release() forgets and removes the tables. What the stage shuffled is of no use once the table is there, but Spark
    removes it only when the driver's garbage is collected: else the shuffles of all stages stay on disk together. So the write removes
    its shuffles as it ends (Spark from 4.1 on); the collection takes what other jobs of build() left.
    """
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _made:
        df = build()
        path = f"{staging_dir(spark)}/weftline-stages/{name}-{uuid.uuid4().hex}"
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
        schema = df.schema
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _made[key] = spark.read.schema(schema).parquet(path)
    return _made[key]


def made(spark: SparkSession, source: str, name: str) -> bool:
    """Whether the session has this stage of source."""
    return (spark.sparkContext.applicationId, source, name) in _made


def release(spark: SparkSession) -> None:
    """Removes the session's stage tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId]:
        for path in {f.rsplit("/", 1)[0] for f in _made.pop(key).inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)

"""MinHash near-dedup with sequential Bayesian verification of banded candidates and exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import mix64, slices_of, small_batches, string_buffer, table, text_or_empty, written
from .components import connected
from .dedup_exact import met, split_by

#: Words of a shingle; links need SIMILAR percent of the union in common.
WIDTH, SIMILAR = 5, 75
#: Bands of ROWS hashes each. A pair at 0.75 shares no band with probability (1 - 0.75^5)^48 = 2.3e-6, at 0.85 with 1e-12.
BANDS, ROWS = 48, 5
#: Hashes that are compared at a time, and the chance at which a pair may be at SIMILAR or above and still be pruned.
BATCH, MISS = 32, 1e-6
#: Candidates that meet in one task, at most, by number and by shingles; more are cut into blocks, and pairs of blocks meet.
CLUSTER_TEXTS, CLUSTER_SHINGLES = 1500, 4_000_000
#: A cluster of more blocks than that is laid out by bucket, so that a text is copied BANDS times at most. Both layouts test the
#: same pairs, those that share a band.
CLUSTER_BLOCKS = 16
#: Bytes of text that one step of a task works on.
STEP = 1 << 18

_rng = np.random.default_rng(19970501)
FLIP, FACTOR = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64), _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of a set that isn't empty."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 256):
        np.minimum(low, ((shingles[i : i + 256, None] ^ FLIP) * FACTOR).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A key for each band of each signature, (n, BANDS); bands have keys of their own."""
    x = low.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), x.shape[:2]).copy()
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, k])
    return key


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """After n compared hashes, the matches below which the posterior chance of similarity >= threshold is under miss.

    With a uniform prior the similarity of a pair with m of n matches is Beta(m + 1, n - m + 1), whose upper
    tail is a binomial sum of n + 1 trials.
    """
    out = {}
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def shortened(low: np.ndarray) -> np.ndarray:
    """16 bits of each signature hash: unequal hashes look equal once in 65,536 times, which only lets more pairs through."""
    return (mix64(low) >> np.uint64(48)).astype(np.uint16)


SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, signature binary"


def sketches(docs: DataFrame) -> DataFrame:
    """Of each text: the size of its shingle set, 128 bits that tell sets apart, its band keys and its shortened signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = string_buffer(batch.column(1))
            ids = batch.column(0)
            for i, j in slices_of(at, STEP):
                sets = words.shingles(raw[at[i] : at[j]], at[i : j + 1] - at[i], WIDTH)
                n = np.array([len(s) for s in sets], np.int64)
                f1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                f2 = np.array([np.bitwise_xor.reduce(mix64(s + np.uint64(77))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                some = np.flatnonzero(n)
                low = np.array([signature(sets[k]) for k in some], np.uint64).reshape(len(some), BANDS * ROWS)
                keys, short = band_keys(low), iter(shortened(low))
                ends = np.zeros(len(sets) + 1, np.int32)
                ends[1:] = np.cumsum((n > 0) * BANDS)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
                marks = pa.array([next(short).tobytes() if k else b"" for k in n], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), pa.array(f1), pa.array(f2), bands, marks], ["doc_id", "n_shingles", "f1", "f2", "bands", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SKETCH)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node (doc_id), n, signature, shingles (binary, sorted 64-bit hashes) of texts that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = string_buffer(batch.column(1))
            for i, j in slices_of(at, STEP):
                sets = words.shingles(raw[at[i] : at[j]], at[i : j + 1] - at[i], WIDTH)
                marks = [shortened(signature(x)).tobytes() if len(x) else b"" for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(x) for x in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "n", "signature", "shingles"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "node long, n long, signature binary, shingles binary").where("n > 0")


def survivors(n: np.ndarray, marks: np.ndarray, i: int, old: np.ndarray, least: dict[int, int], similar: int) -> np.ndarray:
    """Those of old that may be similar to i: by sizes, by a band that both share, then by batches of hashes as long as the posterior allows."""
    old = old[100 * np.minimum(n[old], n[i]) >= similar * np.maximum(n[old], n[i])]
    old = old[(marks[old] == marks[i]).reshape(len(old), BANDS, ROWS).all(axis=2).any(axis=1)]
    matches, done = np.zeros(len(old), np.int64), 0
    for upto, need in least.items():
        if not len(old):
            break
        matches += (marks[old, done:upto] == marks[i, done:upto]).sum(axis=1)
        old, matches, done = old[matches >= need], matches[matches >= need], upto
    return old


def links_within(ids: np.ndarray, n: np.ndarray, marks: np.ndarray, side: np.ndarray, sets: list[np.ndarray] | None = None, *, similar: int = SIMILAR, miss: float = MISS) -> list[tuple[int, int]]:
    """Links that connect what the links of these texts connect (a spanning forest).

    n: set sizes; marks: shortened signatures; side: only pairs with different sides count, unless all sides are 0. Each text
    is compared with those before it that it isn't yet connected to: by survivors(), then by the full sets if given.
    """
    least = least_matches(similar / 100, miss)
    if sets is not None:
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.concatenate([[0], np.cumsum(n)])
        held = np.zeros(int(code.max()) + 1, bool)
    group, found, both = np.arange(len(ids)), [], bool(side.any())
    for i in range(1, len(ids)):
        old = survivors(n, marks, i, np.flatnonzero((group[:i] != group[i]) & ((side[:i] != side[i]) | (not both))), least, similar)
        if not len(old):
            continue
        if sets is not None:
            held[code[at[i] : at[i + 1]]] = True
        for j in old:
            if group[j] != group[i]:
                shared = int(held[code[at[j] : at[j + 1]]].sum()) if sets is not None else 0
                if sets is None or 100 * shared >= similar * (n[i] + n[j] - shared):
                    found.append((int(ids[i]), int(ids[j])))
                    group[group == group[j]] = group[i]
        if sets is not None:
            held[code[at[i] : at[i + 1]]] = False
    return found


def _verify(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
    """Links of one cluster, bucket or pair of blocks; got: doc_id, n, signature, block, low, high and, to confirm links, shingles."""
    got = got.sort_values(["doc_id", "n"], ignore_index=True)
    apart = got["low"].iloc[0] != got["high"].iloc[0]
    side = (got["block"] != got["block"].iloc[0]).to_numpy(np.int64) if apart else np.zeros(len(got), np.int64)
    if len(got) < 2 or (apart and not side.any()):
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    marks = np.stack([np.frombuffer(s, np.uint16) for s in got["signature"]])
    sets = [np.frombuffer(s, np.uint64) for s in got["shingles"]] if "shingles" in got else None
    found = links_within(got["doc_id"].to_numpy(np.int64), got["n"].to_numpy(np.int64), marks, side, sets)
    return pd.DataFrame(found, columns=["a", "b"]).astype(np.int64)


def placed(members: DataFrame, weigh: bool) -> DataFrame:
    """members: node, cluster, n (shingles). Adds blocks, the number of its cluster's blocks, and block, its own; 1 block up to the
    limits of a task, that of shingles only if weigh."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    limits = {"texts": CLUSTER_TEXTS} | ({"shingles": CLUSTER_SHINGLES} if weigh else {})
    need = F.greatest(F.lit(1), *(F.when(F.col(c) <= most, F.lit(1)).otherwise(F.ceil(F.col(c) * 2 / most)) for c, most in limits.items()))
    return members.join(sizes.select("cluster", need.cast("long").alias("blocks")), "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))


def units_of(members: DataFrame, keys: DataFrame, *, weigh: bool) -> DataFrame:
    """The tasks that members (node, cluster, n) meet in: node, cluster, wide, blocks, block.

    A cluster is one task, or is cut into blocks of which each pair is a task, or, with over CLUSTER_BLOCKS blocks as weak
    candidates chain up in large corpora, is laid out by its buckets, each one task or blocks. keys: node, key of the buckets.
    """
    whole = written(placed(members, weigh), "placed")
    narrow, wide = whole.where(F.col("blocks") <= CLUSTER_BLOCKS), whole.where(F.col("blocks") > CLUSTER_BLOCKS)
    if wide.isEmpty():
        return narrow.withColumn("wide", F.lit(False))
    by_bucket = keys.join(wide.select("node", "n"), "node").select("node", F.col("key").alias("cluster"), "n")
    return narrow.withColumn("wide", F.lit(False)).unionByName(placed(by_bucket, weigh).withColumn("wide", F.lit(True)))


def linked(facts: DataFrame, units: DataFrame) -> DataFrame:
    """Links a, b that _verify finds in each task of units; facts: node and what _verify needs of it."""
    full = facts.join(units.select("node", "cluster", "wide", "blocks", "block"), "node").withColumnRenamed("node", "doc_id")
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    return full.drop("other", "blocks").groupBy("cluster", "wide", "low", "high").applyInPandas(_verify, "a long, b long")


def near_dedup(docs: DataFrame) -> DataFrame:
    """Groups of documents whose sets of five-word shingles are connected by similarities of 0.75 or more.

    docs: doc_id, text and any others (ignored). Returns a row per row: doc_id, n_shingles, component_id,
    kept. Null and empty texts have no shingles and are linked with nothing; texts of any length are read whole. A row
    without a doc_id can't represent a group: it has no component_id and is kept. Rows that repeat a doc_id with the same
    text are one document; with another text each has its own group. An empty table gives an empty table.

    Equal sets count once (their smallest doc_id); a hot set's copies stay where they are. Texts that share a band key are
    candidates; a bucket yields one pair per member, with its smallest member, so a group of any size adds as many pairs
    as it has members and bands. Connected candidates form a cluster, whose signatures meet first (480 bytes a text): pairs
    that share a band are compared in batches against the posterior bound. What survives is connected again, into fewer
    and smaller clusters, and only their full sets are made and moved, to confirm links. Each task returns a spanning forest.
    The pairs tested are those that share a band, whatever the size of a cluster.
    """
    small_batches(docs.sparkSession)
    slim = written(sketches(docs), "sketches")
    total, same = slim.count(), ["f1", "f2"]
    able = slim.where("n_shingles > 0 and doc_id is not null")
    repeated = able.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    repeated = written(repeated, "repeated-sets")
    single, some = split_by(able, F.xxhash64(*same), repeated.select(F.xxhash64(*same).alias("h")))
    single = single.unionByName(some.join(repeated.select(*same), same, "left_anti"))
    _, heads = split_by(some, F.xxhash64(*same, "doc_id"), repeated.select(F.xxhash64(*same, "rep").alias("h")))
    again = heads.groupBy(*same, "doc_id").count().where("count > 1").select("doc_id")  # rows repeated in full
    heads = heads.dropDuplicates([*same, "doc_id"]).join(repeated.select(*same, F.col("rep").alias("doc_id")), [*same, "doc_id"], "left_semi")
    reps = single.unionByName(heads).select(F.col("doc_id").alias("node"), "bands", F.col("n_shingles").alias("n"), "signature")
    reps = written(reps, "distinct-sets")

    keys = reps.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last").select("key", "pivot")
    shared = keys.join(buckets, "key")
    star = shared.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    sizes = reps.groupBy("node").agg(F.sum("n").alias("n"))
    members = lambda links: connected(links).withColumnRenamed("label", "cluster").join(sizes, "node")
    near = members(star)
    likely = members(linked(reps.select("node", "n", "signature"), units_of(near, shared.select("node", "key"), weigh=False)))
    likely = written(likely, "likely-members")
    _, wanted = split_by(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null"), F.xxhash64("doc_id"), likely.select(F.xxhash64("node").alias("h")))
    sets = shingle_sets(wanted)
    if not again.isEmpty():
        sets, twice = split_by(sets, F.xxhash64("node"), again.select(F.xxhash64("doc_id").alias("h")))
        sets = sets.unionByName(twice.dropDuplicates(["node", "shingles"]))
    groups = connected(linked(sets, units_of(likely, shared.select("node", "key"), weigh=True)))

    kin = repeated.join(groups, repeated["rep"] == groups["node"], "left").select(*same, "copies", F.coalesce("label", "rep").alias("component_id"))
    lone = single.select("doc_id", "n_shingles").join(groups, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    rest = slim.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = lone.unionByName(met(some.select("doc_id", "n_shingles", *same), kin, same, "copies", total).select("doc_id", "n_shingles", "component_id")).unionByName(rest)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents of docs that near_dedup keeps, with all their columns. Others than those dropped pass the filter straight through."""
    found = written(near_dedup(docs), "near-dedup")
    gone = found.where("not kept").select(F.col("doc_id").alias("__wl_id")).distinct()
    rows = docs.withColumn("__wl_long", F.col("doc_id").cast("long"))
    stay, again = split_by(rows, F.coalesce(F.xxhash64("__wl_long"), F.lit(0)), gone.select(F.xxhash64("__wl_id").alias("h")))
    return stay.unionByName(again.join(gone, again["__wl_long"] == gone["__wl_id"], "left_anti")).select(*docs.columns)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))

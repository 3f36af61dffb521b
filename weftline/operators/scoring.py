"""Vectors of outfits, the stand-in scorer over item pairs, the learned scorer's forward pass, leave-one-out diagnosis."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bound, dot, pair_count, unit, vector_sum

#: Bytes of vectors that a task may hold; a larger table goes by a join.
HELD_BYTES = 1 << 26


def with_vectors(records: DataFrame, catalog: DataFrame, *keep: str) -> DataFrame:
    """records: keep, items (ids). Adds entries: array of (pos, item_id, coarse_id, v) in order; records with an item that
    has no vector are left out. catalog: item_id, coarse_id, v."""
    parts = records.select(*keep, F.posexplode("items").alias("pos", "item_id"), F.size("items").alias("_n"))
    met = parts.join(catalog.select("item_id", "coarse_id", "v"), "item_id")
    out = met.groupBy(*keep, "_n").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id", "coarse_id", "v"))).alias("entries"))
    return out.where(F.size("entries") == F.col("_n")).drop("_n")


def attached(outfits: DataFrame, vectors: DataFrame, *, held_bytes: int = HELD_BYTES) -> DataFrame:
    """outfits: vec_ids (array) and others. Adds vs (their vectors) and labels in order; outfits with an id that has no vector, or more
    than one, are left out. vectors: vec_id, label, v.

    A table of at most held_bytes is looked up where the outfits are, in Arrow batches, so that no vector is shuffled or written; a larger
    one meets the exploded ids in two shuffles that carry its vectors.
    """
    spark, names = outfits.sparkSession, outfits.columns
    found = vectors.select("vec_id", F.col("label").cast("int").alias("label"), "v")
    if (found.agg(F.sum(F.coalesce(F.size("v"), F.lit(0)) * 8 + 16)).first()[0] or 0) > held_bytes:
        one = found.join(found.groupBy("vec_id").agg(F.count("*").alias("_c")).where("_c = 1").select("vec_id"), "vec_id")
        keyed = outfits.withColumn("_id", F.monotonically_increasing_id()).select("*", F.posexplode("vec_ids").alias("_pos", "vec_id"))
        met = keyed.select("_id", "_pos", "vec_id", F.when(F.col("_pos") == 0, F.struct(*names)).alias("_row")).join(one, "vec_id")
        out = met.groupBy("_id").agg(F.max_by("_row", F.when(F.col("_pos") == 0, 1)).alias("_row"), F.array_sort(F.collect_list(F.struct("_pos", "label", "v"))).alias("_e"))
        return out.where(F.size("_e") == F.size("_row.vec_ids")).select("_row.*", F.col("_e.v").alias("vs"), F.col("_e.label").alias("labels"))
    got = found.toArrow()
    held = spark.sparkContext.broadcast((got["vec_id"].to_numpy().astype(np.int64), got["label"].combine_chunks(), got["v"].combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vs = held.value
        order = np.argsort(ids, kind="stable")
        known, first, times = np.unique(ids[order], return_index=True, return_counts=True)
        known, at = known[times == 1], order[first[times == 1]]
        for batch in batches:
            asked = batch.column(names.index("vec_ids"))
            flat = asked.flatten()
            want = flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.minimum(np.searchsorted(known, want), max(0, len(known) - 1))
            there = ((known[place] == want) if len(known) else np.zeros(len(want), bool)) & ~flat.is_null().to_numpy(zero_copy_only=False)
            sizes = asked.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            whole = (np.bincount(owner[~there], minlength=len(sizes)) == 0) & (sizes > 0)
            where = pa.array(at[place[whole[owner]]] if len(at) else np.zeros(0, np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[whole])]).astype(np.int32))
            kept = batch.filter(pa.array(whole))
            lists = [pa.ListArray.from_arrays(offsets, x.take(where)) for x in (vs, labels)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *lists], names=[*names, "vs", "labels"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outfits.schema.fields)
    return outfits.mapInArrow(run, f"{fields}, vs array<array<double>>, labels array<int>")


def pair_sum(vectors: Column, dim: int) -> Column:
    """The sum of inner products over all pairs: (|sum|^2 - sum of |v|^2) / 2."""
    return (bound(vector_sum(vectors, dim), lambda total: dot(total, total)) - F.aggregate(vectors, F.lit(0.0), lambda s, v: s + dot(v, v))) / F.lit(2.0)


def mean_pair_cosine(vectors: Column, dim: int) -> Column:
    """The stand-in compatibility logit of unit vectors; null under two items."""
    n = F.size(vectors)
    return F.when(n >= 2, pair_sum(vectors, dim) / pair_count(n))


def scored(outfits: DataFrame, dim: int) -> DataFrame:
    return outfits.withColumn("compatibility_logit", mean_pair_cosine(F.col("entries.v"), dim))


def item_pairs(outfits: DataFrame, *keep: str) -> DataFrame:
    """All unordered pairs of positions of an outfit (at most eight items): keep, i, j, cosine."""
    a = outfits.select(*keep, "entries", F.posexplode("entries").alias("i", "x"))
    return a.select(*keep, "i", "x", F.posexplode("entries").alias("j", "y")).where("i < j").select(*keep, "i", "j", dot(F.col("x.v"), F.col("y.v")).alias("cosine"))


def diagnosed(outfits: DataFrame, dim: int, *keep: str, digits: int = 9) -> DataFrame:
    """A row per outfit of three items and more: keep, n_items, full_logit, ranked: the rows of leave_one_out() by rank, as structs
    (position, item_id, coarse_id, logit_without, delta). No shuffle.

    Only pairs of the removed item leave the sum, so a variant costs one inner product with the outfit's vector sum.
    Gains are rounded to digits before they are ranked, so that the order doesn't hang on the last bits.
    """
    total = vector_sum(F.col("entries.v"), dim)
    df = outfits.where(F.size("entries") >= 3).withColumns({"_t": total, "_p": pair_sum(F.col("entries.v"), dim), "n_items": F.size("entries")})
    df = df.withColumn("full_logit", F.try_divide(F.col("_p"), pair_count(F.col("n_items"))))  # Spark may test the sizes later than it divides
    without = lambda e: F.try_divide(F.col("_p") - (dot(e["v"], F.col("_t")) - dot(e["v"], e["v"])), pair_count(F.col("n_items") - 1))
    delta = F.transform("entries", lambda e: F.struct((-F.round(without(e) - F.col("full_logit"), digits)).alias("less"), e["pos"].alias("pos"), e["item_id"].alias("item_id"), e["coarse_id"].alias("coarse_id"), without(e).alias("logit_without")))
    ranked = F.transform(F.array_sort(delta), lambda x: F.struct(x["pos"].alias("position"), x["item_id"].alias("item_id"), x["coarse_id"].alias("coarse_id"), x["logit_without"].alias("logit_without"), (-x["less"]).alias("delta")))
    return df.select(*keep, "n_items", "full_logit", ranked.alias("ranked"))


def by_rank(found: DataFrame, *keep: str) -> DataFrame:
    """diagnosed() with a row per position: keep, n_items, full_logit, rank, position, item_id, logit_without, delta."""
    rows = found.select(*keep, "n_items", "full_logit", F.posexplode("ranked").alias("_r", "d"))
    return rows.select(*keep, "n_items", "full_logit", (F.col("_r") + 1).alias("rank"), "d.position", "d.item_id", "d.logit_without", "d.delta")


def leave_one_out(outfits: DataFrame, dim: int, *keep: str, digits: int = 9) -> DataFrame:
    """For each position the logit without it, its gain over the full logit, and its rank by (gain descending, position)."""
    return by_rank(diagnosed(outfits, dim, *keep, digits=digits), *keep)


def localized(found: DataFrame) -> DataFrame:
    """localization() of rows of diagnosed() with target, the place that was swapped."""
    at = F.array_position("ranked.position", F.col("target"))
    one = found.select("n_items", F.when(at > 0, at).alias("rank"), F.get("ranked", (at - 1).cast("int"))["delta"].alias("target_delta"), F.get("ranked.delta", F.lit(0)).alias("max_delta"))
    return by_sizes(one)


def localization(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """By group of sizes (overall, size 3, size 4 and more, each size): top-1, hit@2, mean gains. targets: sample_id, target."""
    df = ranked.join(targets, "sample_id")
    one = df.groupBy("sample_id", "n_items").agg(F.max(F.when(F.col("position") == F.col("target"), F.col("rank"))).alias("rank"), F.max(F.when(F.col("position") == F.col("target"), F.col("delta"))).alias("target_delta"), F.max("delta").alias("max_delta"))
    return by_sizes(one)


def by_sizes(one: DataFrame) -> DataFrame:
    """one: n_items, rank, target_delta, max_delta of each outfit."""
    groups = F.array(F.lit("overall"), F.when(F.col("n_items") == 3, "size_3").otherwise("size_4_plus"), F.concat(F.lit("items_"), F.col("n_items")))
    out = one.withColumn("sizes", F.explode(groups)).groupBy("sizes")
    mean = lambda c: F.avg(c.cast("double"))
    return out.agg(F.count("*").alias("n"), mean(F.col("rank") == 1).alias("top1"), mean(F.col("rank") <= 2).alias("hit_at_2"), F.avg("target_delta").alias("mean_target_delta"), F.avg("max_delta").alias("mean_max_delta"), F.count_if(F.col("n_items") == 3).alias("n_extrapolated"))


@dataclass(frozen=True)
class PairScorer:
    """Weights of the pairwise scorer: a category table, an item layer, a symmetric pair layer, an output layer."""

    category: np.ndarray
    item: tuple
    hidden: tuple
    pair: tuple
    output: tuple
    last: tuple

    @staticmethod
    def random(dim: int, seed: int = 7, *, categories: int = 8, width: int = 16, inner: int = 32, pair: int = 16, out: int = 8) -> PairScorer:
        rng = np.random.default_rng(seed)
        layer = lambda a, b: (rng.normal(0, a**-0.5, (a, b)), rng.normal(0, 0.1, b))
        table = rng.normal(0, 1, (categories, width))
        table[0] = 0
        return PairScorer(table, layer(dim + width, inner), layer(inner, pair), layer(4 * pair + 2 * width, pair), layer(pair, out), layer(out, 1))

    def logits(self, vectors: list[np.ndarray], categories: list[np.ndarray]) -> np.ndarray:
        """Of each outfit the output layer over the mean of its pairs; each pair is taken in both orders."""
        relu = lambda x: np.maximum(x, 0)
        apply = lambda x, w: x @ w[0] + w[1]
        sizes = np.array([len(v) for v in vectors])
        c = self.category[np.concatenate(categories)]
        h = relu(apply(relu(apply(np.concatenate([np.concatenate(vectors), c], 1), self.item)), self.hidden))
        first = np.concatenate([[0], np.cumsum(sizes)])
        pairs = [np.array(np.triu_indices(n, 1)) + a for n, a in zip(sizes, first, strict=False)]
        i, j = np.concatenate(pairs, 1)
        owner = np.repeat(np.arange(len(sizes)), [p.shape[1] for p in pairs])
        side = lambda a, b: relu(apply(np.concatenate([h[a], h[b], np.abs(h[a] - h[b]), h[a] * h[b], c[a], c[b]], 1), self.pair))
        both = (side(i, j) + side(j, i)) / 2
        mean = np.stack([np.bincount(owner, both[:, k], len(sizes)) for k in range(both.shape[1])], 1) / np.bincount(owner, minlength=len(sizes))[:, None]
        return apply(relu(apply(mean, self.output)), self.last)[:, 0]


def learned_logits(outfits: DataFrame, model: PairScorer, *keep: str) -> DataFrame:
    """keep, compatibility_logit by the learned scorer, in Arrow batches; the weights are a few hundred kB on each executor."""
    held = outfits.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in outfits.select(*keep).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for got in batches:
            if len(got):
                vectors = [np.stack([np.asarray(v, float) for v in vs]) for vs in got["vs"]]
                got["compatibility_logit"] = held.value.logits(vectors, [np.asarray(c, int) for c in got["cs"]])
                yield got[[*keep, "compatibility_logit"]]

    return outfits.select(*keep, F.col("entries.v").alias("vs"), F.col("entries.coarse_id").alias("cs")).where(F.size("vs") >= 2).mapInPandas(run, f"{schema}, compatibility_logit double")


def centroid(vectors: Column, dim: int) -> Column:
    """The unit vector of the mean; null if the mean is zero."""
    return bound(F.size(vectors), lambda n: unit(F.transform(vector_sum(vectors, dim), lambda x: x / n)))

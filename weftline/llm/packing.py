"""Best-fit packing: each partition's best-fit decreasing is certified by dual-feasible-function bounds; the rest is exchanged."""

from __future__ import annotations

import base64
import bisect
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_for, small_batches, table, text_or_empty, written

CAPACITY = 2048
#: Pieces of a partition that is packed on its own, and the most rounds of exchange after the first; they end when no round
#: saves a sequence or the whole packing meets its bound.
PARTITION_PIECES, ROUNDS = 4096, 12
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_encoders: dict[tuple, object] = {}


def _encoder(json_path: str, ranks_path: str, pattern: str):
    """text -> ids as little-endian bytes, equal to the JSON vocabulary's ids.

    The rank file is the same vocabulary for a faster encoder. A text that holds a special token's string
    goes to the JSON tokenizer itself, which alone knows it.
    """
    key = (json_path, ranks_path)
    if key not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        slow: list = []

        def encode(text: str) -> bytes:
            if "<|" in text:
                if not slow:
                    slow.append(Tokenizer.from_file(json_path))
                return np.array(slow[0].encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            return array("I", fast(text)).tobytes()

        _encoders[key] = encode
    return _encoders[key]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces; ids: 4 bytes each. All but the first are full."""
    n = len(ids) // 4
    first = (n - 1) % capacity + 1
    edges = [0, *range(first, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(edges, edges[1:], strict=False)]


def pieces(docs: DataFrame, *, json_path: str | None = None, ranks_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Token ids of each whole text and a closing id 0, cut into pieces of at most capacity ids (doc_id, piece, start, length, ids_crc32)."""
    import public_tokenizers

    files = (json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(*files)
        for batch in batches:
            got: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got += [(doc, k, *p) for k, p in enumerate(cut(encode(text.as_py()) + b"\0\0\0\0", capacity))]
            columns = list(zip(*got, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, counts: np.ndarray | None = None) -> int:
    """The least number of bins that any packing needs, by dual feasible functions. counts: how often each length occurs (once, if not given).

    Three families: the identity (total length), rounding to multiples of 1 / k, and dropping items below a
    threshold while items above its complement fill a bin.
    """
    if not len(lengths):
        return 0
    size, at = np.unique(lengths, return_inverse=True)
    n = np.zeros(len(size), np.int64)
    np.add.at(n, at, 1 if counts is None else counts)
    best = -(-int((size * n).sum()) // capacity)
    for k in range(1, 21):  # u_k(x) = x if (k + 1) x is whole, else floor((k + 1) x) / k; in units of capacity * k
        whole = (size * (k + 1)) % capacity == 0
        total = int((np.where(whole, size * k, (size * (k + 1) // capacity) * capacity) * n).sum())
        best = max(best, -(-total // (capacity * k)))
    order = np.arange(0, capacity // 2 + 1)
    at_least = np.zeros(capacity + 2, np.int64)
    at_least[: capacity + 1] = np.cumsum(np.bincount(size, n, capacity + 1)[::-1])[::-1].astype(np.int64)
    weight = np.zeros(capacity + 2, np.int64)
    weight[: capacity + 1] = np.cumsum(np.bincount(size, size * n, capacity + 1)[::-1])[::-1].astype(np.int64)
    total = at_least[capacity - order + 1] * capacity + weight[order] - weight[capacity - order + 1]
    return max(best, int((-(-total // capacity)).max()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item, and the free room of each bin: the longest first, each into the fullest bin that has room."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[tuple[int, int]] = []
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = int(lengths[i])
        at = bisect.bisect_left(free, (x, -1))
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = capacity, len(room)
            room.append(capacity)
        where[i], offset[i] = b, capacity - left
        room[b] = left - x
        if left - x:
            bisect.insort(free, (left - x, b))
    return where, offset, np.array(room, np.int64)


PACKED = PIECES + ", sequence_id long, offset long, partition long"
ROUND = PACKED + ", bins long, opened long, open boolean"


def _pack(capacity: int):
    """Packs a partition. If its items come from bins of an earlier round and the new packing isn't smaller, they stay in those.

    bins against the partition's bound says whether it can be packed better: a partition with a gap gives away the items of its
    loosest bins, twice as many bins as the gap; one without only its loosest bin. opened: how many bins it gives away.
    """

    def run(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        length = got["length"].to_numpy(np.int64)
        where, offset, room = best_fit_decreasing(length, capacity)
        ids = (int(key[0]) << 32) + where
        if got["sequence_id"].notna().all():
            old, inverse = np.unique(got["sequence_id"].to_numpy(np.int64), return_inverse=True)
            if len(old) <= len(room):
                where, offset, ids = inverse, got["offset"].to_numpy(np.int64), got["sequence_id"].to_numpy(np.int64)
                room = capacity - np.bincount(inverse, length).astype(np.int64)
        gap = len(room) - lower_bound(length, capacity)
        loose = np.argsort(-room, kind="stable")[: max(1, 2 * gap)]
        is_open = np.zeros(len(room), bool)
        is_open[loose[room[loose] > 0]] = True
        return got.drop(columns="__wl_g").assign(sequence_id=ids, offset=offset, partition=int(key[0]), bins=len(room), opened=int(is_open.sum()), open=is_open[where])

    return run


def pack(items: DataFrame, *, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Puts items (columns of PIECES) into sequences: adds sequence_id, offset, partition; certificates() says how good they are.

    Items are dealt by row into partitions of about partition_pieces items, so copies of an item spread. In each further
    round the open bins of all partitions are dealt anew, whole, into partitions of that size and their items packed again;
    they move only if that saves bins. An empty table gives an empty table; equal items are different items; other columns
    than those of PIECES are left out.
    """
    spark = items.sparkSession
    blank = items.select(*(x.split()[0] for x in PIECES.split(", "))).withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    least, rows = total_bound(items, capacity)
    done, todo, base, before, closed = [], blank, 0, None, 0
    for r in range(rounds + 1):
        if not rows:
            break
        groups = parts_for(rows, partition_pieces)
        deal = F.xxhash64("sequence_id", F.lit(r)) if r else F.xxhash64(F.monotonically_increasing_id())
        got = written(todo.withColumn("__wl_g", F.lit(base) + F.pmod(deal, F.lit(groups))).groupBy("__wl_g").applyInPandas(_pack(capacity), ROUND), f"packed-{r}")
        base += groups
        bins, opened, rows = got.groupBy("partition", "bins", "opened").agg(F.count_if("open").alias("n")).agg(F.sum("bins"), F.sum("opened"), F.sum("n")).first()
        if r == rounds or closed + bins <= least or (before is not None and bins >= before):
            done.append(got)
            break
        done.append(got.where("not open"))
        todo, before, closed = got.where("open").select(*blank.columns), opened, closed + bins - opened
    if not done:
        return spark.createDataFrame([], PACKED)
    return reduce(DataFrame.unionByName, done).drop("bins", "opened", "open")


def total_bound(items: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(the least number of sequences that any packing of all items needs, the number of items); at most capacity counts reach the driver."""
    got = items.groupBy("length").agg(F.count("*").alias("n")).collect()
    n = np.array([r.n for r in got], np.int64)
    return lower_bound(np.array([r.length for r in got], np.int64), capacity, n), int(n.sum())


def certificates(packed: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """A row per partition of a finished packing, and one with a null partition for all of it: sequences, bound, certified.

    bound: what any packing of these items needs at least, by dual feasible functions; certified: the packing has no more
    sequences than that. Lengths are counted by partition first, so a task gets at most capacity counts of a partition.
    """

    def run(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        bins = int(got["sequences"].sum())
        some = got[got["length"].notna()]
        bound = lower_bound(some["length"].to_numpy(np.int64), capacity, some["n"].to_numpy(np.int64))
        return pd.DataFrame({"partition": pd.array([key[0]], "Int64"), "sequences": [bins], "bound": [bound], "certified": [bins <= bound]})

    lengths = packed.groupBy("partition", "length").agg(F.count("*").alias("n")).withColumn("sequences", F.lit(0).cast("long"))
    bins = packed.select("partition", "sequence_id").distinct().groupBy("partition").agg(F.count("*").alias("sequences")).select("partition", F.lit(None).cast("long").alias("length"), F.lit(None).cast("long").alias("n"), "sequences")
    each = lengths.unionByName(bins)
    every = each.groupBy("length").agg(F.sum("n").alias("n"), F.sum("sequences").alias("sequences")).withColumn("partition", F.lit(None).cast("long"))
    return each.unionByName(every).groupBy("partition").applyInPandas(run, "partition long, sequences long, bound long, certified boolean")


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Tokenises, cuts and packs documents: a row per piece. Null text counts as empty (one id, the closing 0).

    docs: doc_id, text, others are ignored. Texts of any length are read whole; only those of more than capacity ids are cut.
    Repeated rows are different documents. An empty table gives an empty table.
    """
    return pack(written(pieces(docs, capacity=options.get("capacity", CAPACITY)), "pieces"), **options)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

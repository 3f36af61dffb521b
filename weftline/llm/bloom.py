"""Bloom filters over 64-bit hashes that are built by the executors in blocks and read by broadcast.

A filter grows with its hashes but never takes more than max_bytes on the driver or an executor: beyond that the
hash space is cut into slices, and each slice has a filter of its own that is built, used and released before the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64

#: Bits of a block, the unit in which parts of a filter meet.
BLOCK = 1 << 16


def positions(h: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """(n, hashes) bit positions by double hashing."""
    a = mix64(h.astype(np.uint64))
    b = mix64(a ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return ((a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


def holds(filter_bytes: np.ndarray, h: np.ndarray, hashes: int) -> np.ndarray:
    """Of each hash, whether all its bits are set."""
    if not len(h):
        return np.zeros(0, bool)
    at = positions(h, len(filter_bytes) * 8, hashes)
    return ((filter_bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def slice_of(h: Column, slices: int) -> Column:
    """The slice of a hash, as build() cuts them."""
    return F.pmod(F.shiftright(h, 1), F.lit(slices))


def plan(rows: int, bits_per_row: int, max_bytes: int) -> tuple[int, int]:
    """(bits of a slice's filter, number of slices)."""
    need = max(BLOCK, rows * bits_per_row)
    slices = -(-need // (max_bytes * 8))
    return -(-(-(-need // slices)) // BLOCK) * BLOCK, int(slices)


def build(hashes_df: DataFrame, column: str, *, bits: int, hashes: int, repeated: bool, slices: int = 1, slice_no: int = 0) -> np.ndarray:
    """Bytes of one slice's filter of the hashes; repeated: only bits that two or more rows set.

    Each task sends each block the distinct positions that it set once or, if repeated, more often; one
    row meets per task and block, so that copies of a hash, however many, weigh one row for each task.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: list[np.ndarray] = []
        twice: list[np.ndarray] = []
        seen = 0

        def settle() -> None:
            nonlocal once, twice, seen
            at, n = np.unique(np.concatenate(once), return_counts=True)
            twice, once, seen = [*twice, at[n > 1]], [at], len(at)
            twice = [np.unique(np.concatenate(twice))]

        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if slices > 1:
                h = h[(h.view(np.int64) >> 1) % slices == slice_no]
            if not repeated:
                h = np.unique(h)
            once.append(positions(h, bits, hashes).ravel())
            seen += len(once[-1])
            if seen > 4_000_000:
                settle()
        if not once:
            return
        settle()
        at, more = once[0], twice[0] if repeated else np.zeros(0, np.int64)
        blocks = np.unique(at // BLOCK)
        cut = lambda x, b: (x[np.searchsorted(x, b * BLOCK) : np.searchsorted(x, (b + 1) * BLOCK)] % BLOCK).astype("<u2").tobytes()
        for i in range(0, len(blocks), 256):
            part = blocks[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([cut(at, b) for b in part], pa.binary()), pa.array([cut(more, b) for b in part], pa.binary())], ["block", "once", "twice"])

    def merge(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(BLOCK, np.int64)
        for x in got["once"]:
            count[np.frombuffer(x, "<u2")] += 1
        for x in got["twice"]:
            count[np.frombuffer(x, "<u2")] += 1
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(count >= (2 if repeated else 1), bitorder="little").tobytes()]})

    parts = hashes_df.select(F.col(column).cast("long").alias("h")).where(F.col("h").isNotNull()).mapInArrow(local, "block long, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("block").applyInPandas(merge, "block long, bits binary").toLocalIterator():  # at most the filter's own size
        out[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return out

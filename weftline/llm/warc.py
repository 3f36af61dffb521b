"""WARC archives: an index of offsets, lengths, URLs and digests first, then coalesced byte-range reads of the selected records."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, parts_for, table, written
from .dedup_exact import met, split_by

#: Payload bytes from which equal payloads are written once.
LEAST_PAYLOAD = 100
#: Payload bytes of an archive; bytes between two wanted records that are read along; bytes of one read.
ARCHIVE_BYTES, GAP, SPAN = 64 << 20, 16 << 10, 8 << 20
#: Stretch of an archive that one task reads, and bytes of wanted records for which the readers get a task more.
STRETCH, TASK_BYTES = 8 << 20, 4 << 20
INDEX = "archive string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"


def filesystem(path: str):
    """(pyarrow filesystem, path in it) of a folder by its scheme; executors and driver use the same."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit holds the HTTP header only and names its response by page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {clean}"] if clean else []
    head += [f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'none' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of a gzip member; the payload of a revisit is empty."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record doesn't end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload-bytes"] = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"].decode()
    return fields, payload


def decisions(pages: DataFrame, *, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Of each distinct (page_id, digest): first_id, the page that holds the payload; copies: how many rows are equal in both."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"))
    slim = written(slim.where(F.col("bytes") >= least), "page-digests")
    rows = slim.count()
    groups = written(slim.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id")).alias("first")).where("n > 1").select("digest", "n", F.col("first.page_id").alias("first_id")), "page-groups")
    return met(slim, groups, ["digest"], "n", rows).groupBy("page_id", "digest", "first_id").agg(F.count("*").alias("copies"))


def write_archives(pages: DataFrame, folder: str, *, least: int = LEAST_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of gzip members into folder and returns their index (columns of INDEX), itself a table there.

    pages: page_id, url, html (null: empty). Of records with equal payloads of at least least bytes the one with the
    smallest page_id (null last) is a response, the others revisits; of rows that are equal in page and payload one is
    the response. Each task writes archives under a name that nobody else uses and returns their index rows, so a task
    that is lost and run again leaves at most a file that no index names.
    """
    decided = written(decisions(pages, least=least), "page-decisions")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    other = decided.select(F.col("page_id").alias("__wl_p"), F.col("digest").alias("__wl_d"), "first_id", F.lit(True).alias("shared"), "copies")
    lone, some = split_by(rows, F.xxhash64("page_id", "digest"), decided.select(F.xxhash64("page_id", "digest").alias("h")))  # pages that share no payload stay where they are
    found = some.join(other, some["page_id"].eqNullSafe(other["__wl_p"]) & (some["digest"] == other["__wl_d"]), "left").drop("__wl_p", "__wl_d")
    if not decided.where("copies > 1").isEmpty():  # pages repeated in full meet in one task, by tasks of the digest's hash
        found = found.where("copies is null or copies = 1").unionByName(found.where("copies > 1").repartition("page_id", "digest"))
    found = lone.withColumns({"first_id": F.lit(None).cast("long"), "shared": F.lit(None).cast("boolean"), "copies": F.lit(None).cast("long")}).unionByName(found)
    found = found.sortWithinPartitions("page_id", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, out, name, at, last, used = None, None, "", 0, None, 0
        try:
            for batch in batches:
                got: list[tuple] = []
                for r in batch.to_pylist():
                    payload = r["html"].encode()
                    again = (r["page_id"], r["digest"])  # rows equal in both are neighbours
                    revisit = bool(r["shared"]) and (r["page_id"] != r["first_id"] or last == again)
                    last = again
                    if out is None or used >= archive_bytes:
                        if out is not None:
                            out.close()
                        where = where or filesystem(folder)
                        name, at, used = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        where[0].create_dir(where[1], recursive=True)
                        out = where[0].open_output_stream(f"{where[1]}/{name}", compression=None)
                    member = record(r["page_id"], r["url"], payload, r["digest"], r["first_id"], revisit)
                    out.write(member)
                    got.append((name, at, len(member), r["page_id"], r["url"], r["digest"], len(payload), "revisit" if revisit else "response", r["first_id"] if revisit else None))
                    at, used = at + len(member), used + len(payload)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                columns = list(zip(*got, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return written(found.select("page_id", "url", "html", "digest", "first_id", "shared").mapInArrow(run, INDEX), "warc-index")


def spans(offset: np.ndarray, length: np.ndarray, *, gap: int = GAP, span: int = SPAN) -> list[tuple[int, int]]:
    """Runs (first, last + 1) of sorted records that one read fetches: at most gap bytes between two and span in all, or one record."""
    out, first = [], 0
    for i in range(1, len(offset) + 1):
        if i == len(offset) or offset[i] - (offset[i - 1] + length[i - 1]) > gap or offset[i] + length[i] - offset[first] > span:
            out.append((first, i))
            first = i
    return out if len(offset) else []


RECORD = "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(index: DataFrame, folder: str, *, gap: int = GAP, span: int = SPAN, payloads: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records that index selects, read from the archives: columns of RECORD; a revisit's payload is null, and, unless
    payloads are wanted, all are.

    Wanted ranges are cut by archive and STRETCH of it, dealt to as many tasks as their bytes need, sorted, and coalesced into
    reads. Payloads of responses are held against their digests; a mismatch is an error.
    """
    number = lambda x: None if x == "none" else int(x)

    def fetch(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("offset")
        offset, length = got["offset"].to_numpy(np.int64), got["length"].to_numpy(np.int64)
        store, path = filesystem(folder)
        out = []
        with store.open_input_file(f"{path}/{key[0]}") as f:
            for a, b in spans(offset, length, gap=gap, span=span):
                chunk = f.read_at(int(offset[b - 1] + length[b - 1] - offset[a]), int(offset[a]))
                for i in range(a, b):
                    start = int(offset[i] - offset[a])
                    head, payload = parse(chunk[start : start + int(length[i])])
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    revisit = head["warc-type"] == "revisit"
                    if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["payload-bytes"])):
                        raise ValueError(f"a payload in {key[0]} at {offset[i]} doesn't have its digest")
                    page = number(head["warc-record-id"][len("<urn:page:") : -1])
                    out.append((page, head.get("warc-target-uri"), payload.decode() if payloads and not revisit else None, int(head["payload-bytes"]), digest, head["warc-type"], number(head["warc-refers-to"][len("<urn:page:") : -1]) if revisit else None))
        return pd.DataFrame({c: pd.array([r[k] for r in out], kind) for k, (c, kind) in enumerate(zip([x.split()[0] for x in RECORD.split(", ")], ("Int64", "object", "object", "Int64", "object", "object", "Int64"), strict=True))})

    part = index.select("archive", "offset", "length").withColumn("__wl_part", F.expr(f"offset div {STRETCH}"))
    tasks = parts_for(part.agg(F.sum("length")).first()[0] or 0, task_bytes)
    return part.repartition(tasks, "archive", "__wl_part").groupBy("archive", "__wl_part").applyInPandas(fetch, RECORD)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id ASC NULLS LAST) AS place, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND place > 1 THEN first_id END AS refers_to
FROM k
"""

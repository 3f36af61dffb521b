"""JSON documents as texts: strict extraction, duplicate and forbidden keys, canonical form, hashes."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_fence = re.compile(r"\A\s*```(?:json)?\s*\n(.*?)\n?```\s*\Z", re.S)


def _unique(pairs: list) -> dict:
    keys = [k for k, _ in pairs]
    if len(keys) != len(set(keys)):
        raise ValueError("repeated key")
    return dict(pairs)


def single_object(text: str | None) -> dict:
    """The one JSON object that the text is, a code fence around it allowed, nothing else; keys must not repeat."""
    fenced = _fence.match(text or "")
    found = json.loads(fenced[1] if fenced else text or "", object_pairs_hook=_unique)
    if not isinstance(found, dict):
        raise ValueError("no object")
    return found


def forbidden_paths(value, banned: set[str], at: str = "root") -> list[str]:
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in ([f"{at}.{k}"] if k.lower() in banned else []) + forbidden_paths(v, banned, f"{at}.{k}")]
    if isinstance(value, (list, tuple)):
        return [p for i, v in enumerate(value) for p in forbidden_paths(v, banned, f"{at}[{i}]")]
    return []


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def checked_json(column: Column, banned: set[str]) -> Column:
    """struct(canonical, error, forbidden): the canonical text of a valid document, else why it isn't; paths of banned keys."""

    @F.pandas_udf("canonical string, error string, forbidden array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                found = single_object(t)
                out.append((canonical(found), None, forbidden_paths(found, banned)))
            except ValueError as e:
                out.append((None, "repeated_key" if "repeated" in str(e) else "not_one_object", []))
        return pd.DataFrame(out, columns=["canonical", "error", "forbidden"])

    return run(column)


def ordered_hash(df: DataFrame, value: Column, order: str, *, separator: str = "\n") -> DataFrame:
    """sha256 of all values in order, joined: n, sha256. The executors sort; a hash takes its bytes one after the other, so the lines
    then stream through the driver, one partition at a time."""
    state, n = hashlib.sha256(), 0
    for row in df.orderBy(order).select(value.alias("v")).toLocalIterator():
        state.update((separator if n else "").encode() + (row.v or "").encode())
        n += 1
    return df.sparkSession.createDataFrame([(n, state.hexdigest())], "n long, sha256 string")

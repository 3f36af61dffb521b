"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import dedup_exact, dedup_near, licenses, mixing, packing, quality, sharding, topk, toxicity, warc

QUERIES = {
    "op1_pack": packing.op1_pack,
    "op2_topk": topk.op2_topk,
    "op3_exact_dedup": dedup_exact.op3_exact_dedup,
    "op4_licenses": licenses.op4_licenses,
    "op5_quality": quality.op5_quality,
    "op6_near_dedup": dedup_near.op6_near_dedup,
    "op7_mix": mixing.op7_mix,
    "op8_warc": warc.op8_warc,
    "op9_shard": sharding.op9_shard,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES = {
    "op2_topk": topk.ORACLE,
    "op3_exact_dedup": dedup_exact.ORACLE,
    "op4_licenses": licenses.ORACLE,
    "op8_warc": warc.ORACLE,
}

"""The corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import bloom, components, dedup_exact, dedup_near, licenses, mixing, nbsvm, packing, quality, sharding, topk, toxicity, warc, words

DOCS = "doc_id long, text string, source string, row long, score double, text_sha256 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 90))) for _ in range(40)]
    out = [*base]
    for t in base[:20]:
        w = t.split(" ")
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = "zz"
            out.append(" ".join(v))
    out += [base[0] + "  ", base[0].replace(" ", "\n"), base[1].upper(), "", None, None, " \t", "one two", "One  TWO", "é ü ñ", "x " * 30000, "x " * 30000, base[3], base[3]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["a", "b", None, "c"][i % 7 % 4], 1, 0.5, "clash") for i, t in enumerate(texts())]
    rows += [rows[2], (None, "no id", "a", 1, 0.5, "clash"), (None, None, "a", 1, 0.5, "clash")]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bloom_finds_every_repeat(spark):
    rows = spark.range(5000).select((F.col("id") % 4000).alias("h")).repartition(7)
    for slices in (1, 3):
        got = set()
        for i in range(slices):
            held = bloom.build(rows, "h", bits=bloom.BLOCK, hashes=6, repeated=True, slices=slices, slice_no=i)
            h = np.arange(4000, dtype=np.uint64)
            mine = h[(h >> np.uint64(1)) % np.uint64(slices) == i]
            got |= set(mine[bloom.holds(held, mine, 6)].tolist())
        assert set(range(1000)) <= got and len(got) < 2600


def exact_truth(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k, i))
    out = []
    for body, g in groups.items():
        best = min(g, key=lambda x: x[:4])
        for x in g:
            out.append((x[4], best[4], len(g), hashlib.sha256(body.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"max_bytes": 4096, "bits_per_row": 1000}])
def test_exact_dedup(docs, options):
    got = dedup_exact.exact_dedup(docs, **options).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == exact_truth(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_copies_keeps_one_of_each(docs, none):
    kept = dedup_exact.drop_copies(docs)
    assert kept.columns == docs.columns
    bodies = Counter(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect())
    assert set(bodies.values()) == {1} and len(bodies) == len(exact_bodies(docs))
    assert dedup_exact.drop_copies(none).count() == 0 and dedup_exact.exact_dedup(none).count() == 0


def exact_bodies(docs):
    return {re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.select("text").collect()}


def shingle_set(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_truth(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("cluster", "blocks"), [(dedup_near.CLUSTER_TEXTS, dedup_near.CLUSTER_BLOCKS), (3, 1 << 30), (3, 1)])
def test_near_dedup(docs, none, monkeypatch, cluster, blocks):
    monkeypatch.setattr(dedup_near, "CLUSTER_TEXTS", cluster)
    monkeypatch.setattr(dedup_near, "CLUSTER_BLOCKS", blocks)
    got = dedup_near.near_dedup(docs)
    truth = near_truth([(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()])
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all((r.n_shingles, r.component_id) == truth[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    kept = dedup_near.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i, (_, c) in truth.items() if c == i}
    assert kept.where("doc_id is null").count() == 2
    assert dedup_near.near_dedup(none).count() == 0


def test_posterior_bounds_and_band_recall():
    least = dedup_near.least_matches(0.75, 1e-6)
    assert all(0 < m < 0.75 * n for n, m in least.items())
    assert (1 - 0.75**dedup_near.ROWS) ** dedup_near.BANDS < 1e-5
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        b = a.copy()
        b[:24] = rng.integers(0, 1 << 63, 24, dtype=np.uint64)  # similarity 176 / 224
        sets += [np.unique(a), np.unique(b)]
    low = np.array([dedup_near.signature(s) for s in sets])
    keys = dedup_near.band_keys(low)
    assert all((keys[i] == keys[i + 1]).any() for i in range(0, len(sets), 2))
    assert abs((low[::2] == low[1::2]).mean() - 176 / 224) < 0.02
    n, marks, side = np.array([len(x) for x in sets]), dedup_near.shortened(low), np.zeros(len(sets), int)
    assert {tuple(sorted(p)) for p in dedup_near.links_within(np.arange(len(sets)), n, marks, side, sets)} == {(i, i + 1) for i in range(0, len(sets), 2)}
    assert len(dedup_near.links_within(np.arange(len(sets)), n, marks, side)) >= 60


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 90)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    rounds, one = [], components._round
    monkeypatch.setattr(components, "_round", lambda links, number: rounds.append(number) or one(links, number))
    got = components.connected(spark.range(120).selectExpr("id as a", "id + 1 as b")).collect()
    assert len(got) == 121 and {r.label for r in got} == {0} and len(rounds) < 45


def test_packing(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, partition_pieces=40).collect()
    truth = Counter()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        edges = [0, *range(first, len(ids) + 1, 2048)]
        truth.update((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == truth
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in got])) + 1
    parts = defaultdict(set)
    for r in got:
        parts[r.partition].add(r.sequence_id)
    said = {r.partition: r for r in packing.certificates(spark.createDataFrame(got, packing.PACKED)).collect()}
    assert {p: said[p].sequences for p in parts} == {p: len(x) for p, x in parts.items()} and said[None].sequences == len(bins) and set(said) == {*parts, None}
    for p in said:
        bound = packing.lower_bound(np.array([r.length for r in got if p is None or r.partition == p]))
        assert said[p].bound == bound <= said[p].sequences and said[p].certified == (said[p].sequences == bound)
    assert packing.pack_documents(none).count() == 0


def test_special_token_text_and_bounds(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["a<|endoftext|>b", "tabs\t\t x", "  two  spaces \n\n new", "日本語 text’s", "it's 12 o'clock!!"]
    got = packing.pieces(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == {i: zlib.crc32(np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, x in enumerate(odd)}
    rng = np.random.default_rng(0)
    for _ in range(20):
        x = rng.integers(1, 2049, 60)
        where, offset, room = packing.best_fit_decreasing(x)
        assert packing.lower_bound(x) <= len(room) and (room == 2048 - np.bincount(where, x)).all()
    assert packing.lower_bound(np.array([1025] * 7)) == 7 and packing.lower_bound(np.array([700] * 9)) == 5


def test_top_k(spark):
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(400)] + [(50, [0.1] * 8), (51, [0.1] * 8), (400, None), (450, [float("nan")] * 8), (451, [None] * 8), (500, [0.5] * 3), (501, [0.2] * 3), (None, [0.1] * 8), (600, []), (650, [1e30, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").repartition(3)
    huge = spark.createDataFrame([(0, [1e307, 1.0]), (50, [-1e307, 2.0]), (1, [1e18, 1.0]), (2, [1e18, 3.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    most = (1 << 63) - 1  # scores beyond a long tie there
    assert sorted(map(tuple, topk.top_k(huge, huge.where("vec_id % 50 = 0"), k=3).collect())) == [(0, 1, 1, most), (0, 2, 2, most), (0, 3, 3, most), (50, 1, 0, -most), (50, 2, 1, -most), (50, 3, 2, -most)]
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), shard_rows=90, leaf=7, query_block=3).collect()
    q = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in v if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    truth = Counter()
    for i, a in q:
        if i % 50 == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in q if j != i and len(a) == len(b))[:5]
            truth.update((i, k + 1, j, -s) for k, (s, j) in enumerate(hits))
    assert Counter(tuple(r) for r in got) == truth
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def water_level(sizes, weights, share=1.5):
    total, free, out = share * sum(sizes), set(range(len(sizes))), {}
    while free:
        rest = total - sum(out.values())
        level = rest / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] > 2 * sizes[i]}
        if not over:
            return [out.get(i, level * weights[i]) for i in range(len(sizes))]
        out |= {i: 2.0 * sizes[i] for i in over}
        free -= over
    return [out[i] for i in range(len(sizes))]


def test_mixing(docs, none):
    rows, pieces = mixing.mix(docs, block_words=16)
    got = rows.collect()
    assert len(got) == docs.count() and set(docs.columns) <= set(rows.columns)
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = dict(zip(order, water_level([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len(WORD.findall(r.text or "")) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 16 * 4 for s in order)
    slots = pieces.collect()
    assert sum(p.words for p in slots) == sum(taken.values()) and all(p.words > 0 for p in slots)
    again = mixing.mix(docs.repartition(3), block_words=16)[0]
    key = lambda rs: Counter((r.doc_id, r.source, r["size"], r.taken) for r in rs)
    assert key(again.collect()) == key(got)
    copies = mixing.mixed_documents(docs, block_words=16)
    assert copies.columns == docs.columns
    words, by_text = Counter(), defaultdict(list)
    for r in copies.collect():
        words[r.source] += len(WORD.findall(r.text))
        by_text[r.doc_id, r.source].append(r.text)
    assert words == Counter({s: n for s, n in taken.items() if n})
    for r in got:  # whole copies and at most one that is cut after a word
        mine = [t for t in by_text[r.doc_id, r.source] if (r.text or "").startswith(t)]
        assert r.doc_id in (2, 51, None) or sum(len(WORD.findall(t)) for t in mine) == r.taken and sum(t != r.text for t in mine) <= 1
    clash = docs.limit(50).selectExpr("*", "7 as size", "1 as taken", "2 as start", "3 as target", "4 as source_size", "5 as y")
    assert sorted((r.doc_id or -1, r["size"]) for r in mixing.mix(clash, block_words=16)[0].collect()) == sorted((r.doc_id or -1, len(WORD.findall(r.text or ""))) for r in clash.collect())
    assert mixing.mixed_documents(clash).columns == clash.columns
    assert mixing.mix(none)[0].count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mixing_takes_small_sources_to_their_targets(spark):
    rng = random.Random(4)
    sizes = {f"s{i:02}": rng.randint(40, 400) for i in range(60)} | {"big": 200_000, "odd": 257, "one": 1}
    rows = [(s, k, min(50, n - k)) for s, n in sizes.items() for k in range(0, n, 50)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, at long, size long").repartition(4)
    for weights in ((5, 2, 1), (1, 1, 900)):
        out, pieces = mixing.mix(df, size="size", weights=weights)
        got, slots = out.collect(), pieces.collect()
        order = sorted(sizes)
        want = dict(zip(order, water_level([sizes[s] for s in order], [weights[i % 3] for i in range(len(order))])))
        taken, by_doc, by_slot = Counter(), Counter(), Counter()
        for r in got:
            taken[r.source] += r.taken
        for p in slots:
            by_doc[p.doc_id] += p.words
            by_slot[p.slot] += p.words
        assert all(0 < taken[s] <= 2 * sizes[s] and abs(taken[s] - want[s]) <= min(128, want[s] / 2 + 1) for s in order)
        assert all(taken[s] == 2 * sizes[s] for s in order if want[s] == 2 * sizes[s])
        assert {r.doc_id: r.taken for r in got if r.taken} == dict(by_doc) and max(by_slot.values()) <= 256
        assert sorted(by_slot) == list(range(len(by_slot)))
        for s in order:  # each stretch of the mix holds the source's share
            mine = [p for p in {(p.slot, p.source) for p in slots} if p[1] == s]
            half = sum(slot < len(by_slot) / 2 for slot, _ in mine)
            assert abs(half - len(mine) / 2) <= 4


def test_sharding(docs, none):
    got = sharding.shard_rows(docs).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    n = docs.count()
    assert len(got) == n and max(map(len, slots.values())) - min(len(slots[s]) for s in range(16)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    again = sharding.shard_rows(docs.repartition(2)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert sharding.shard_rows(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 1025])
def test_feistel_permutes(n):
    assert sorted(sharding.permuted(np.arange(n), n).tolist()) == list(range(n))


def test_warc_round_trip(spark):
    big, page = "é" * 5000, "<html>" + "p" * 200
    rows = [(3, "http://a/ b\n", page), (1, "http://b", page), (2, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "http://c", big), (7, "http://c", big), (8, "http://d", big), (None, "n", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    from weftline.llm.common import fresh_path

    folder = fresh_path(spark, "warc-test")
    index = warc.write_archives(df, folder, archive_bytes=6000)
    got = warc.read_records(index, folder, gap=0).collect()
    assert len(got) == len(rows)
    kinds = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got)
    d = lambda s: (len((s or "").encode()), hashlib.sha256((s or "").encode()).hexdigest())
    want = Counter([(3, "revisit", 1, *d(page)), (1, "response", None, *d(page)), (2, "response", None, *d("")), (4, "response", None, *d("")), (5, "response", None, *d("short")), (6, "response", None, *d("short")), (7, "response", None, *d(big)), (7, "revisit", 7, *d(big)), (8, "revisit", 7, *d(big)), (None, "revisit", 1, *d(page))])
    assert kinds == want
    assert {r.page_id: r.payload for r in got if r.record_type == "response"}[7] == big
    part = warc.read_records(index.where("page_id = 7"), folder)
    assert part.count() == 2 and index.select("archive").distinct().count() > 3
    member = warc.record(9, None, b"x", "00", None, False)
    assert gzip.decompress(member).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and warc.parse(member)[1] == b"x"
    empty = warc.write_archives(df.limit(0), fresh_path(spark, "warc-none"))
    assert empty.count() == 0 and warc.read_records(empty, folder).count() == 0
    assert warc.spans(np.array([0, 10, 100]), np.array([10, 20, 5]), gap=5, span=1000) == [(0, 2), (2, 3)]


def test_licenses(spark, none):
    s = licenses.SENTENCES
    long = " ".join(["word"] * 50000)
    rows = [
        (1, "Thing. Released under the MIT License. More."), (2, "Licensed under CC BY-NC 4.0.\nlicensed under the APACHE license, version 2.0."), (3, None), (4, ""), (5, long),
        (6, f"{s['mit-grant'].capitalize()}. {s['mit-notice']}. Nothing here. {s['as-is']}."), (7, f"{s['bsd-source']}. {s['bsd-grant']}."), (8, "A license is a license."), (1, "Released under the MIT License."), (None, "Released under the MIT license."),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = [(r.doc_id, list(r.licenses), r.license, r.n_sentences) for r in licenses.scan_licenses(df).collect()]
    assert sorted(got, key=str) == sorted([(1, ["MIT"], "MIT", 1), (2, ["Apache-2.0", "CC-BY-NC-4.0"], "Apache-2.0", 2), (3, [], None, 0), (4, [], None, 0), (5, [], None, 0), (6, ["MIT"], "MIT", 3), (7, [], None, 2), (8, [], None, 0), (1, ["MIT"], "MIT", 1), (None, ["MIT"], "MIT", 1)], key=str)
    assert [list(r.rule_numbers) for r in licenses.scan_licenses(df.where("doc_id = 6")).collect()] == [[1]]
    assert licenses.scan_licenses(none).count() == 0
    plan = licenses.scan_licenses(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


MIT = """MIT License

Copyright (c) 2024 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of Some Company, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU {1}General Public License as published by
the Free Software Foundation{2} {3}version {4} of the License{5}.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
LATER = ", or\n(at your option) any later version"
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def test_licenses_of_whole_texts(spark):
    texts = [
        (MIT, ["MIT"]), (APACHE, ["Apache-2.0"]), (BSD2, ["BSD-2-Clause"]), (BSD3, ["BSD-3-Clause"]), (MPL, ["MPL-2.0"]), (ISC, ["ISC"]),
        (GPL.format(":", "", ",", "either ", 3, LATER), ["GPL-3.0-or-later"]), (GPL.format(";", "", ";", "either ", 2, LATER), ["GPL-2.0-or-later"]),
        (GPL.format(";", "", ";", "", 2, ""), ["GPL-2.0-only"]), (GPL.format(":", "Lesser ", ",", "either ", 3, LATER), ["LGPL-3.0-or-later"]),
        (GPL.format(";", "Lesser ", ";", "either ", "2.1", LATER), ["LGPL-2.1-or-later"]), (f"{MPL}\n\n{MIT}", ["MIT", "MPL-2.0"]),
        ("Title\nReleased under the MIT\nLicense.\nMore", ["MIT"]), ("Licensed under the Apache License,\nVersion 2.0. More", ["Apache-2.0"]),
        ("Not so. Released under the MIT\n\nLicense.", []), ("Released under the MIT\nlicense of old.", []), ("This is not released under the MIT\nlicense.", []),
    ]
    wraps = [lambda t: t, lambda t: "# " + t.replace("\n", "\n# "), lambda t: "/* " + t.replace("\n", "\r\n * "), lambda t: "pass\n\n" + t + "\n\nend"]
    rows = [(100 * i + k, wrap(t)) for i, (t, _) in enumerate(texts) for k, wrap in enumerate(wraps)]
    got = {r.doc_id: list(r.licenses) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {100 * i + k: want for i, (_, want) in enumerate(texts) for k in range(len(wraps))}


@pytest.mark.parametrize("gap", [" ", "  ", "\t", "-", " / "])
def test_licenses_prefilter_keeps_every_known_sentence(spark, gap):
    known = licenses.SENTENCES | licenses.TEXT_SENTENCES
    rows = [(i, s.upper().replace(" ", gap)) for i, s in enumerate(known.values())]
    got = {r.doc_id: list(r.sentence_ids) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: [name] for i, name in enumerate(known)}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    clean = ["the", "river", "stone", "light", "garden", "window", "paper"]
    rows, labels = [], []
    for i in range(400):
        t = [rng.choice(clean) for _ in range(60)]
        bad, rude = i % 4 == 0, i % 5 == 0
        if rude:
            t.insert(rng.randrange(60), rng.choice(["nasty", "nastyish", "grimble"]))
        t = [w + "$$$" if bad else w for w in t]
        rows.append((i, " ".join(t), "x", 1, 0.1, "c"))
        if i % 3:
            labels.append((i, int(not bad), int(rude)))
    rows += [(900, None, "x", 1, 0.1, "c"), (901, "", "x", 1, 0.1, "c"), (902, "river " * 30000, None, 1, 0.1, "c"), (903, "the river stone n4sty light " + "paper " * 20, "x", 1, 0.1, "c"), (904, "stone g r i m b l e light window", "x", 1, 0.1, "c"), (905, "garden nnnaasty paper", "x", 1, 0.1, "c"), (None, "the river", "x", 1, 0.1, "c"), (1, "the river", "x", 1, 0.1, "c")]
    labels += [(5, None, None), (1, 1, 0), (None, 1, 1), (5000, 1, 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(labelled, none):
    docs, labels = labelled
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all((r.predicted == 1) == (r.doc_id % 4 != 0) for r in got if r.doc_id is not None and 1 < r.doc_id < 400)
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and 290 < kept.count() < 320
    assert quality.score_quality(none, labels).count() == 0
    share = quality.score_quality(docs, labels.where("quality = 1")).select("score").distinct().collect()
    assert len(share) == 1 and share[0].score > 0.9


def test_toxicity(labelled, none):
    docs, labels = labelled
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all((got[i].predicted == 1) == (i % 5 == 0) for i in range(2, 400))
    assert [got[i].predicted for i in (900, 901, 902)] == [0, 0, 0]
    assert [got[i].predicted for i in (903, 904, 905)] == [1, 1, 1]
    assert toxicity.score_toxicity(none, labels).count() == 0


def test_training_takes_whole_documents(spark, monkeypatch):
    rng, seen = random.Random(8), []
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    texts = {i: "".join(rng.choices(signs, k=90_000 if i % 2 else 300)) for i in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    monkeypatch.setattr(nbsvm, "fit", lambda rows, y, totals, dims, **_: seen.append((rows, y.tolist())))
    whole = {}
    for i, text in texts.items():
        if zlib.crc32(str(i).encode()) % 5:
            raw = np.frombuffer(text.encode(), np.uint8)
            whole[i] = (i % 2, quality.trigrams(raw, np.array([0, len(raw)]))[1].tolist())
    quality.quality_model(docs, labels)
    assert sorted((y, r.tolist()) for r, y in zip(*seen[0])) == sorted(whole.values()) and max(len(c) for _, c in whole.values()) > 1 << 15
    quality.quality_model(docs, labels, class_codes=200_000)  # fewer documents, each whole
    few = [(y, r.tolist()) for r, y in zip(*seen[1])]
    assert all(r in whole.values() for r in few) and Counter(y for y, _ in few) == {0: sum(y == 0 for y, _ in whole.values()), 1: 200_000 // max(len(c) for _, c in whole.values())}


DISGUISES = [
    "g" * 60 + "rimble", "gr1mbl3" + "-" * 60, "g r  i m   b l e", "g - r - i - m - b - l - e", "ggrriimmbbllee", "grimmble", "gri-mble", "gr.im.ble", "grim_ble", "g*rimble", "gr-1mble", "GGRRIIMMBBLLEE",
]


def test_toxicity_reads_each_disguise(labelled, spark):
    docs, labels = labelled
    restore = toxicity.Restorer(toxicity.costs(toxicity.language_counts(docs)))
    for form in DISGUISES:
        text = f"the river {form} light"
        got = restore(pa.array([text, "the"])).to_pylist()
        assert re.findall("[a-z]+", got[0].lower()) == ["the", "river", "grimble", "light"] and got[1] == "the", form
    plain = ["the river-stone light", "garden.window paper", "", "g", "e", "-", "m m"]
    assert restore(pa.array(plain)).to_pylist() == plain
    edges = restore(pa.array(["gri", "mble -", "- le", "g", "g", "r"])).to_pylist()  # nothing is joined across texts
    assert edges == ["gri", "mble -", "- le", "g", "g", "r"]
    stretched = "3ab" * 50_000
    assert len(toxicity.decode(stretched, toxicity.costs(np.ones((toxicity.SYMBOLS,) * 3)).tolist())) == 150_000
    more = spark.createDataFrame([(2000 + i, f"the river stone {form} light paper", "x", 1, 0.1, "c") for i, form in enumerate([*DISGUISES, "window"])], DOCS)
    many = docs.union(docs).union(docs).unionByName(more)  # few disguises among many plain words
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(many, labels).where("doc_id >= 2000").collect()}
    assert got == {2000 + i: int(i < len(DISGUISES)) for i in range(len(DISGUISES) + 1)}


def test_viterbi_finds_the_least_cost_of_all_readings():
    rng = np.random.default_rng(4)
    cost = rng.exponential(2, (toxicity.SYMBOLS,) * 3)
    index = lambda c: ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27

    def price(strings, paid):
        a = b = 0
        for c in "".join(strings):
            paid, a, b = paid + cost[a][b][index(c)], b, index(c)
        return paid + cost[a][b][0]

    for token in ("g1mbl3", "a--b!!", "5$llooo", "i.d10t&", "x", "@@@", "b  e"):
        every = [("".join(s for s, _ in way), price([s for s, _ in way], sum(p for _, p in way))) for way in itertools.product(*toxicity.lattice(token))]
        got = toxicity.decode(token, cost.tolist())
        assert min(p for s, p in every if s == got) == pytest.approx(min(p for _, p in every)), token


def dense_hinge(x, y, cost):
    """Least |w|^2 / 2 + cost * hinge by subgradient steps over all rows, the bias as one more feature."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, best, least = np.zeros(x.shape[1]), None, np.inf
    value = lambda w: w @ w / 2 + cost * np.maximum(0, 1 - y * (x @ w)).sum()
    for t in range(1, 40_000):
        w = w - (w - cost * ((y * (x @ w) < 1) * y) @ x) / (t + 50)
        if value(w) < least:
            best, least = w.copy(), value(w)
    return best, least, value


def test_model_against_dense_naive_bayes_and_hinge():
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 12, 6)) for _ in range(60)]
    y = np.array([int(3 in r) if k % 7 else 1 - int(3 in r) for k, r in enumerate(rows)])
    dense = np.array([[float(j in r) for j in range(12)] for r in rows])
    p, q = 1 + dense[y == 1].sum(0), 1 + dense[y == 0].sum(0)
    r = np.log((p / p.sum()) / (q / q.sum()))
    assert nbsvm.ratios(rows, y, 12) == pytest.approx(r)
    w, bias = nbsvm.coordinate_descent(rows, [r[x] for x in rows], y, 12, epochs=2000)
    _, least, value = dense_hinge(dense * r, np.where(y == 1, 1.0, -1.0), 1.0)
    assert value(np.append(w, bias)) <= least * 1.01
    model = nbsvm.fit(rows, y, (int((y == 0).sum()), int((y == 1).sum())), 12, scaled=False)
    doc, code = np.repeat(np.arange(60), [len(x) for x in rows]), np.concatenate(rows)
    margin = dense @ model.weights + model.bias
    assert model.scores(doc, code, 60) == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.shift))))


def test_classifiers_ignore_other_columns_and_repeated_rows(labelled):
    docs, labels = labelled
    more = docs.unionByName(docs.where("doc_id < 50")).selectExpr("*", "'z' as y", "1 as id", "2 as codes", "0 as toxic", "3 as quality", "true as held_out")
    for score in (quality.score_quality, toxicity.score_toxicity):
        want = {(r.doc_id, round(r.score, 9)) for r in score(docs.unionByName(docs.where("doc_id < 50")), labels.selectExpr("*", "1 as y")).collect()}
        assert {(r.doc_id, round(r.score, 9)) for r in score(more, labels).collect()} == want


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.r_[rng.integers(0, 50, 10), [60 if i % 2 else 61]]) for i in range(200)]
    y = np.arange(200) % 2
    w, b = nbsvm.coordinate_descent(rows, [np.ones(len(r)) for r in rows], y, 64)
    margin = np.array([w[r].sum() + b for r in rows])
    assert ((margin > 0) == (y == 1)).all()


def test_word_hashes_do_not_cross_texts():
    raw = np.frombuffer(b"AB cdab", np.uint8)
    at = np.array([0, 5, 7])
    starts, ends = words.runs(~words.SPACES[raw], at)
    assert list(zip(starts, ends)) == [(0, 2), (3, 5), (5, 7)]
    h = words.hashes(raw, starts, ends)
    assert h[0] == h[2] != h[1]


def test_mixing_takes_what_the_schedule_takes(spark, monkeypatch):
    """A schedule without its odd slots: what it doesn't take is in no row, of either query's operator."""
    whole = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda plan, **options: whole(plan, **options).where("slot % 2 = 0"))
    rows = [(i, "ab"[i % 2], " ".join(f"w{i}x{k}" for k in range(5 + i % 40))) for i in range(200)] + [(7, "b", " ".join(f"v{k}" for k in range(12)))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out, pieces = mixing.mix(df, block_words=16)
    slots, taken = pieces.collect(), Counter()
    assert slots and all(p.slot % 2 == 0 for p in slots)
    for r in out.collect():
        taken[r.source] += r.taken
    assert sum(taken.values()) == sum(p.words for p in slots)
    words = Counter()
    for r in mixing.mixed_documents(df, block_words=16).collect():
        words[r.source] += len(WORD.findall(r.text))
    assert words == taken


def test_mixing_writes_few_files(spark, tmp_path, monkeypatch):
    """Each file that executors write costs processes on a local file system: 200 small input files are not 200 small files twice more."""
    made = []
    monkeypatch.setattr(mixing, "written", lambda df, name, *, whole=mixing.written: made.append((name, whole(df, name))) or made[-1][1])
    rows = [(i, "ab"[i % 2], " ".join(f"w{k}" for k in range(5 + i % 40))) for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(200).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a partition for each file
    try:
        assert spark.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions() == 200
        out = mixing.op7_mix(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    files = {name: len(df.inputFiles()) for name, df in made}
    assert set(files) == {"mix-sizes", "mix-targets"} and files["mix-sizes"] <= 25
    got = out.collect()
    assert {r.doc_id: r["size"] for r in got} == {i: len(t.split()) for i, _, t in rows}
    assert all(0 <= r.taken <= 2 * r["size"] for r in got) and abs(sum(r.taken for r in got) - 1.5 * sum(r["size"] for r in got)) <= 256

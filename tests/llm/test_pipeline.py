"""The pipeline stage by stage against brute force, on a small folder of tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from weftline.llm import mixing, quality

from .test_operators import near_truth


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(120):
        t = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        if i % 6 == 0:
            t = [w.upper() + "!!" for w in t]
        rows.append((i, " ".join(t), ["a", "b", None][i % 3], "en"))
        labels.append((i, int(i % 6 != 0), 0))
    for i in range(40):
        base = rows[1 + 3 * (i % 10)][1]
        rows.append((200 + i, base.replace(" ", "  ", 1) if i % 2 else base.rsplit(" ", 1)[0], "b", "en"))
    rows += [(300, None, "a", "en"), (301, "", "a", None)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    stage = {n: f for n, f in corpus_pipeline.STAGES}

    def run(name, df):
        out = stage[name](spark, df, folder)
        assert name == names[-1] or out.columns == docs.columns
        rows = out.collect()
        return (spark.createDataFrame(rows, out.schema) if name != names[-1] else None), rows

    scores = {r.doc_id: r.predicted for r in quality.score_quality(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    good, rows = run(names[0], docs)
    assert {r.doc_id for r in rows} == {i for i, p in scores.items() if p == 1}
    assert not {r.doc_id for r in rows} & set(range(0, 120, 6)) and {r.doc_id for r in rows} >= {i for i in range(120) if i % 6}

    best = {}
    for r in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[body] = min(best.get(body, (1, 0)), (-len(r.text or ""), r.doc_id))
    exact, rows = run(names[1], good)
    assert sorted(r.doc_id for r in rows) == sorted(i for _, i in best.values())

    truth = near_truth([(r.doc_id, r.text) for r in rows])
    near, rows = run(names[2], exact)
    assert sorted(r.doc_id for r in rows) == sorted(i for i, (_, c) in truth.items() if i == c)

    word = re.compile(r"[^\x20\x09-\x0D]+")
    taken, target = Counter(), {}
    for r in mixing.mix(near)[0].collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    mixed, rows = run(names[3], near)
    words = Counter()
    for r in rows:
        words[r.source] += len(word.findall(r.text or ""))
    assert words == taken and all(abs(words[s] - target[s]) <= 128 for s in target)  # each source meets its target to half a block
    kept = {r.doc_id: r.text for r in near.collect()}
    assert all(kept[r.doc_id].startswith(r.text) for r in rows) and sum(r.text != kept[r.doc_id] for r in rows) <= 3

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert len(ids) <= 2048
        want[(r.doc_id, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    _, packed = run(names[4], mixed)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == want

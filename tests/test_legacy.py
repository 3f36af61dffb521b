"""The earlier builder: no pair twice, exhausted pools, counters, the verifier's first rule."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.operators import legacy

ITEMS = [("a_1", "a", 1, "X"), ("a_2", "a", 2, "Y"), ("a_3", "a", 3, "Z"), ("b_1", "b", 1, "X"), ("b_2", "b", 2, "Y"), ("c_1", "c", 1, "X"), ("c_9", "c", 9, "X"), ("d_1", "d", 1, "Q"), ("d_2", "d", 2, "Q"), ("e_1", "e", 1, "X")]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id string, kit_id string, slot int, master string")


@pytest.mark.parametrize("per_outfit", [0, 1, 3, 9])
def test_every_pair_comes_once(spark, items, per_outfit):
    if per_outfit == 0:
        assert legacy.negatives(items, legacy.picked(items, per_outfit=0)).count() == 0
        with pytest.raises(ValueError):
            legacy.picked(items, per_outfit=-1)
        return
    kits = legacy.picked(items, per_outfit=per_outfit)
    made = legacy.negatives(items, kits).collect()
    pairs = Counter((r.source_kit_id, r.negative_metadata.original_item_id, r.negative_metadata.replacement_item_id) for r in made)
    assert max(pairs.values()) == 1
    kit, master = {i[0]: i[1] for i in ITEMS}, {i[0]: i[3] for i in ITEMS}
    for r in made:
        m = r.negative_metadata
        assert master[m.original_item_id] == master[m.replacement_item_id] == m.swap_category and kit[m.replacement_item_id] == m.replacement_kit_id != r.source_kit_id and r["items"][m.swapped_item_index] == m.replacement_item_id
    # brute force: a kit has as many pairs as its items have namesakes of the category in other kits
    room = {k: sum(1 for i in ITEMS if i[1] == k for j in ITEMS if j[3] == i[3] and j[1] != k) for k in "abcd"}
    assert Counter(r.source_kit_id for r in made) == {k: min(per_outfit, n) for k, n in room.items() if n}
    every = spark.createDataFrame([(k,) for k in ("a", "b", "c", "d", "e", "f", " ")], "kit_id string")
    c = legacy.counters(every, items, kits, per_outfit=per_outfit).first().asDict()
    made_n = sum(min(per_outfit, n) for n in room.values())
    assert c == {"kits_processed": 7, "kits_with_items": 4, "kits_without_items": 2, "kits_too_small": 1, "positive_samples": 4, "negative_samples": made_n, "negative_attempts": 4 * per_outfit, "failed_no_valid_candidate": per_outfit, "failed_duplicate_pair": 3 * per_outfit - made_n, "negative_generation_complete": sum(n >= per_outfit for n in room.values())}
    records = legacy.positives(kits).unionByName(legacy.negatives(items, kits))
    assert legacy.record_issues(records, items).count() == 0


def test_verifier(items):
    kits = legacy.picked(items)
    good = legacy.negatives(items, kits).where("source_kit_id = 'a'")
    m = F.col("negative_metadata")
    codes = lambda df: [r.code for r in legacy.record_issues(df, items).collect()]
    assert codes(good) == [] and codes(good.unionByName(good)) == ["duplicate_sample_id"] and codes(good.limit(0)) == []
    assert codes(good.withColumn("sample_id", F.lit(None).cast("string"))) == ["invalid_sample_id"]
    assert codes(good.withColumn("items", F.lit(None).cast("array<string>"))) == ["items_empty"]
    assert codes(good.withColumn("negative_metadata", m.withField("swapped_item_index", F.lit(-1)))) == ["swapped_item_index_out_of_range"]
    assert codes(good.withColumn("negative_metadata", m.withField("replacement_kit_id", F.lit("a")))) == ["replacement_of_same_kit"]


def test_kits_are_made_in_one_shuffle_by_kit(spark):
    items = spark.createDataFrame([("a_1", "a", 1, "X"), ("a_2", "a", 2, "X"), ("a_3", "a", None, "Y"), ("b_1", "b", 1, "X"), ("c_1", "c", 1, "Y"), ("c_2", "c", 2, "Z")], "item_id string, kit_id string, slot int, master string")
    kits = legacy.picked(items, per_outfit=2)
    got = {r.kit_id: [(s.item_id, s.own, s.others, s.pool_size) for s in r.spots] for r in kits.collect()}
    assert got == {"a": [("a_1", 2, 1, 3), ("a_2", 2, 1, 3), ("a_3", 1, 1, 2)], "c": [("c_1", 1, 1, 2), ("c_2", 1, 0, 1)]}
    plan = kits._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan

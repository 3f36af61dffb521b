"""Stages of the benchmark shuffle no more than they must."""

from collections import Counter

import pytest

from weftline.operators import clean, negatives
from weftline.plans import domain
from weftline.sources import staging

SF = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def joins(spark):
    """No table is broadcast, as for tables of any size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_items_meet_where_the_join_left_them(spark, joins):
    found = clean.clean_items(domain.parted_items(spark, SF), domain.ORDER, dealt=("p_partkey",))
    assert planned(found).count("Exchange hashpartitioning") == 2  # line items and parts, no third of the joined rows
    plain = clean.clean_items(domain.raw_items(spark, SF), domain.ORDER)
    assert Counter(found.collect()) == Counter(plain.collect())


def test_of_dealt_rows_the_first_of_an_id_is_kept(spark):
    rows = [(" k_1 ", "B", 2, 1), ("k_1", "A", 1, 1), ("k_2", "C", 1, 2), ("x9", "C", 1, 1), ("x9", "C", 1, 2), (None, "C", 1, 1), ("k_3", " ", 1, 3)]
    raw = spark.createDataFrame(rows, "item_id string, master string, n int, part int")
    states = clean.audited_items(raw, ["n"], dealt=("part",)).collect()
    assert Counter(r.state for r in states) == {"kept": 2, "duplicate": 1, "malformed": 2, "missing": 2}
    assert {(r.item_id, r.master) for r in states if r.state == "kept"} == {("k_1", "A"), ("k_2", "C")}


def test_both_sides_of_a_family_come_from_one_join(spark, joins):
    samples = spark.createDataFrame([("test", "k", [("k_1", "TOP"), ("k_2", "BAG")]), ("test", "l", [("l_1", "TOP")])], "split string, kit_id string, items array<struct<item_id string, coarse string>>")
    made = spark.createDataFrame([("test", "k", 1, 1, "k_2", "m_7", "m", "Brand", "BAG")], "split string, kit_id string, negative_number int, position int, original_item_id string, replacement_item_id string, replacement_kit_id string, master string, coarse string")
    got = negatives.families(samples, made)
    assert planned(got).count("SortMergeJoin") == 1
    rows = {r.label: r for r in got.collect()}
    assert (rows[1].sample_id, rows[1].pair_id, rows[1]["items"], rows[1].swap) == ("k_pos", None, ["k_1", "k_2"], None)
    assert (rows[0].sample_id, rows[0].pair_id, rows[0]["items"], rows[0].swap.position) == ("k_neg_1", "k_pos", ["k_1", "m_7"], 1)
    assert len(rows) == got.count() == 2


def test_a_query_of_one_split_builds_its_kits_only(spark):
    sf = f"{SF}/"  # a source of which the session has no stages
    rows = lambda df: Counter(map(str, df.collect()))
    got = domain.records(spark, sf, domain.TEST)
    assert not staging.made(spark, sf, "items") and not staging.made(spark, sf, "records")
    kits = {r.kit_id for r in domain.kits(spark, sf).where("split = 'test'").select("kit_id").collect()}
    assert {r.kit_id for r in domain.items(spark, sf, domain.TEST).select("kit_id").collect()} <= kits
    assert got.count() > 0 and rows(got) == rows(domain.records(spark, SF).where("split = 'test'"))
    assert rows(domain.records(spark, SF, domain.TEST)) == rows(got)  # from the table of all, which is there


def test_items_of_a_split_are_those_of_all(spark, tmp_path):
    lines = [(1, 1, 1, 5.0), (1, 1, 2, 4.0), (1, 2, 7, 50.0), (1, 3, 7, 49.0), (1, 3, 7, None), (1, 2, None, 50.0), (2, 1, 1, 1.0), (3, 1, 1, 1.0), (4, 1, 1, 1.0), (None, 1, 1, 1.0), (1, None, 1, 1.0), (1, 4, 1, 1.0), (1, 5, 1, 1.0), (1, 9, 1, 1.0)]
    spark.createDataFrame([(*x, 1, 2.0) for x in lines], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "Brand#1"), (2, " Brand#2 "), (3, "Brand#3"), (4, None), (5, " ")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "P", "x"), (1, "P", "x"), (2, "F", "x"), (3, None, "x"), (None, "P", "x")], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = Counter(domain.items(spark, str(tmp_path), "test").collect())
    assert got == Counter(r for r in domain.items(spark, str(tmp_path)).collect() if r.kit_id in ("1", "3"))
    assert {r.item_id for r in got} == {"1_1", "1_2", "1_3", "3_1"} and max(got.values()) == 1

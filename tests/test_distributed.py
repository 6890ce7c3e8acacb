"""Order-dependent building blocks against plain Python, with one hot group."""

import math
import random

import pytest
from pyspark.sql import functions as F

from inkstream.functions import distributed as D


def hot_rows(n=600, seed=3):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else rng.choice("abcde"), i, float(rng.randint(0, 30))) for i in range(n)]


def test_prefix_sums_match_a_running_loop(rows):
    data = hot_rows()
    out = D.prefix_sums(rows(data, "g string, i int, v double"), ["g"], ["i"], {"s": F.col("v")}).collect()
    expected, total = {}, {}
    for g, i, v in sorted(data, key=lambda r: r[1]):
        total[g] = total.get(g, 0.0) + v
        expected[(g, i)] = total[g]
    assert {(r.g, r.i): r.s for r in out} == expected
    assert {r.g: r.s_total for r in out} == total


def test_prefix_sums_without_group_and_with_null_group(rows):
    df = rows([(None, 2), ("a", 1), (None, 3)], "g string, i int")
    whole = D.number_rows(df, [], ["i"], "n").collect()
    assert sorted((r.i, r.n, r.n_total) for r in whole) == [(1, 1, 3), (2, 2, 3), (3, 3, 3)]
    per = D.number_rows(df, ["g"], ["i"], "n").collect()
    assert sorted((r.g or "", r.i, r.n, r.n_total) for r in per) == [("", 2, 1, 2), ("", 3, 2, 2), ("a", 1, 1, 1)]


def test_prefix_sums_keep_rows_of_a_group_in_several_ranges(rows):
    df = rows([("hot", i) for i in range(500)], "g string, i int")
    spread = D._range_ids(df, [F.col("g"), F.col("i")])
    assert spread.select("_range_id").distinct().count() > 1
    assert D.number_rows(df, ["g"], ["i"], "n").where("n <> i + 1").count() == 0


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 0.99, 1.0])
def test_quantiles(rows, p):
    data = hot_rows()
    df = rows(data, "g string, i int, v double")
    linear = {r.g: r.q for r in D.exact_quantiles(df, ["g"], "v", {"q": p}).collect()}
    index = {r.g: r.q for r in D.exact_quantiles(df, ["g"], "v", {"q": p}, "index").collect()}
    for g in {r[0] for r in data}:
        values = sorted(v for k, _, v in data if k == g)
        pos = (len(values) - 1) * p
        lo, hi = values[math.floor(pos)], values[math.ceil(pos)]
        assert linear[g] == pytest.approx(lo + (hi - lo) * (pos - math.floor(pos)))
        assert index[g] == values[min(int(len(values) * p), len(values) - 1)]


def test_quantiles_of_nothing(rows):
    empty = rows([], "g string, v double")
    assert D.exact_quantiles(empty, ["g"], "v", {"q": 0.5}).count() == 0
    assert [r.q for r in D.exact_quantiles(empty, [], "v", {"q": 0.5}).collect()] == [None]


@pytest.mark.parametrize("share", [0.0001, 0.2, 0.9])
def test_skew_left_join_equals_left_join(rows, share):
    left = rows([(k, f"l{k}") for k in [1, 2, 3, 4, None]], "k int, a string")
    right = rows([(1, i) for i in range(200)] + [(2, 1), (9, 9), (None, 5)], "k int, b int")
    got = D.skew_left_join(left, right, ["k"], salts=4, share=share)
    want = left.join(right, ["k"], "left")
    key = lambda r: (str(r.k), r.a, str(r.b))
    assert sorted(got.select("k", "a", "b").collect(), key=key) == sorted(want.select("k", "a", "b").collect(), key=key)


def test_hot_keys_are_few(rows):
    df = rows([(i % 50,) for i in range(5000)], "k int")
    assert D.hot_keys(df, ["k"], 0.05).count() == 0
    assert D.hot_keys(df, ["k"], 0.01).count() <= 100


def test_skew_left_join_takes_maps_and_splits_equal_rows(spark, rows):
    left = rows([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "k int, l string")
    right = rows([(1, {"x": 1})] * 300 + [(2, {"y": 2})], "k int, m map<string,int>")
    got = D.skew_left_join(left, right, ["k"], salts=4, share=0.1)
    counts = {(r.k, r.l): r.n for r in got.groupBy("k", "l").count().withColumnRenamed("count", "n").collect()}
    assert counts == {(1, "a"): 300, (2, "b"): 1, (3, "c"): 1, (None, "d"): 1}
    assert got.where("k > 2 AND m IS NOT NULL").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") <= 1 or "Broadcast" in plan


def test_written_tables_can_be_released(spark, rows):
    import os

    from inkstream.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    table = D.cut_lineage(rows([(1,), (2,)], "k int"))
    assert table.count() == 2 and len(set(os.listdir(folder)) - before) == 1
    D.release(table)
    assert set(os.listdir(folder)) == before

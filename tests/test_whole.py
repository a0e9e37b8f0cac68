"""Registered jobs cover whole tables, against plain Python."""

from bisect import bisect_left, bisect_right

import pytest
from wordloom.operators import lookups, tree
from wordloom.plans import catalogue
from wordloom.plans.registry import table


def neighbour(keys, target, mode):
    left, right = bisect_left(keys, target), bisect_right(keys, target)
    at = {"exact": left if left < right else -1, "last_before": left - 1, "first_after": right, "exact_or_before": right - 1, "exact_or_after": left}[mode]
    return keys[at] if 0 <= at < len(keys) else None


@pytest.mark.parametrize("mode", lookups.MODES)
def test_lookups_of_all_orders(spark, sf, mode):
    keys = sorted(r[0] for r in table(spark, sf, "orders").select("o_orderkey").collect())
    got = catalogue.queries()[f"lookup_all_{mode}"](spark, sf).collect()
    assert {r["target"] for r in got} >= {float(k) for k in keys} | {keys[0] - 0.5, keys[-1] + 0.5}
    for r in got:
        assert r["rid"] == neighbour(keys, r["target"], mode)


@pytest.mark.parametrize("mode", lookups.MODES)
def test_lookups_of_all_names(spark, sf, mode):
    first = {}
    for r in table(spark, sf, "part").select("p_partkey", "p_name").collect():
        first[r["p_name"]] = min(r["p_partkey"], first.get(r["p_name"], r["p_partkey"]))
    keys = sorted(first)
    got = catalogue.queries()[f"lookup_all_text_{mode}"](spark, sf).collect()
    assert {r["target"] for r in got} >= first.keys() | {"!", "~"}
    for r in got:
        assert r["rid"] == first.get(neighbour(keys, r["target"], mode))


def test_all_customers_by_nation(spark, sf):
    nation = {r["n_nationkey"]: r["n_name"] for r in table(spark, sf, "nation").collect()}
    rows = sorted((r["c_custkey"], nation[r["c_nationkey"]]) for r in table(spark, sf, "customer").collect())
    want = sorted(rows, key=lambda r: r[1], reverse=True)  # stable: ties stay by key
    got = sorted(catalogue.queries()["sort_via_link_all"](spark, sf).collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in got] == list(range(len(want)))
    assert [(r["c_custkey"], r["n_name"]) for r in got] == want


def test_paths_of_a_deep_tree(spark):
    deep = "/".join(f"d{i}" for i in range(150))
    dirs, _ = tree.from_paths(spark.createDataFrame([(deep + "/f",), ("d0/x/f",), ("y/f",)], "path string"), "path")
    got = sorted(r["path"] for r in tree.absolute_paths(dirs).collect())
    want = ["", "/d0/x", "/y"] + ["/" + "/".join(f"d{i}" for i in range(n)) for n in range(1, 151)]
    assert got == sorted(want)


def test_paths_of_many_directories(spark):
    n = 1_000_100
    rows = spark.range(n).selectExpr("id AS dir_id", "if(id = 0, '', string(id)) AS name", "if(id = 0, null, if(id < 1000, 0, id % 999 + 1)) AS parent_id")
    got = tree.absolute_paths(rows)
    assert got.distinct().count() == n
    assert {r["path"] for r in got.where("dir_id in (5, 999999)").collect()} == {"/5", "/1/999999"}


def test_paths_without_a_root(spark):
    rows = [(0, "", None), (1, "a", 0), (2, "b", 1), (3, "lost", 9), (4, "r", 5), (5, "s", 4), (6, "t", 5), (7, "own", 7)]
    got = tree.absolute_paths(spark.createDataFrame(rows, "dir_id long, name string, parent_id long"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, ""), (1, "/a"), (2, "/a/b")]

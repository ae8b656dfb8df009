import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import callgraph, closure, merge, resolve
from graphloom.schemas import EDGES, FUNCTION_DEFS

DEFS = [("k1", "alpha", "/r/a.c", 1), ("k2", "beta", "/r/b.c", 2), ("k3", "twin", "/r/c.c", 3), ("k4", "twin", "/r/d.c", 4)]


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), EDGES)


def defs(spark):
    return spark.createDataFrame(DEFS, FUNCTION_DEFS)


def test_header_site_in_two_units_counts_twice_as_edges_once_as_site(spark):
    e = edges(spark, ("k1", "k2", "alpha", "beta", "/r/h.h:3:1", "a.c"), ("k1", "k2", "alpha", "beta", "/r/h.h:3:1", "b.c"), ("k1", "k2", "alpha", "beta", "/r/h.h:3:1", "b.c"))
    rich = callgraph.enriched_edges(e, defs(spark))
    assert rich.count() == 2
    r = callgraph.call_counts(rich, defs(spark)).first()
    assert (r["callee_key"], r["total_calls"], r["unique_callsite_count"], r["unique_translation_unit_count"], r["unique_caller_count"]) == ("k2", 2, 1, 2, 1)
    assert (r["callers"], r["caller_names"], r["translation_units"]) == ("k1", "alpha", "a.c;b.c")
    fans = {x["function_key"]: x for x in callgraph.fan_summary(rich, defs(spark)).collect()}
    assert (fans["k2"]["fan_in"], fans["k2"]["incoming_edge_count"], fans["k1"]["fan_out"], fans["k1"]["outgoing_edge_count"], fans["k3"]["fan_in"]) == (1, 2, 1, 2, 0)


def test_resolution(spark):
    e = edges(
        spark, ("k1", "beta@<unknown>", "alpha", "beta", "f:1:1", "u"), ("k1", "twin@<unknown>", "alpha", "twin", "f:2:1", "u"), ("k1", "gone", "alpha", "beta", "f:3:1", "u"),
        ("k1", "", "alpha", "beta", "f:4:1", "u"), ("x@<unknown>", "k3", "x", "twin", "f:5:1", "u"),
    )
    got = {r["loc"]: (r["callee_project_key"], r["callee_resolution"]) for r in resolve.resolve_end(e, defs(spark), "callee").collect()}
    assert got == {"f:1:1": ("k2", "name_fallback"), "f:2:1": (None, "unresolved"), "f:3:1": (None, "unresolved"), "f:4:1": ("k2", "name_fallback"), "f:5:1": ("k3", "resolved_key")}
    assert {r["callee"] for r in resolve.resolve_end(e, defs(spark), "caller").filter("caller_project_key is null").collect()} == {"twin"}


def test_order_of_call_counts(spark):
    rows = [("k1", "k2", "alpha", "beta", f"f:{i}:1", "u") for i in range(3)] + [("k1", "k3", "alpha", "twin", "g:1:1", "u"), ("k2", "k3", "beta", "twin", "g:2:1", "u")]
    rich = callgraph.enriched_edges(edges(spark, *rows), defs(spark))
    assert [r["callee_key"] for r in callgraph.call_counts(rich, defs(spark)).collect()] == ["k2", "k3"]
    assert [r["callee_key"] for r in callgraph.call_counts(rich, defs(spark), by_callers=True).collect()] == ["k3", "k2"]


def test_evidence(spark):
    e = edges(
        spark, ("k2", "k1", "beta", "alpha", "/r/b.c:9:2", "b"), ("k2", "alpha@<unknown>", "beta", "alpha", "/r/b.c:10:2", "b"), ("k1", "k1", "alpha", "alpha", "/r/a.c:4:1", "a"),
        ("k1", "k3", "alpha", "twin", "/r/a.c:5:1", "a"),
    )
    asked = spark.createDataFrame([DEFS[0]], FUNCTION_DEFS)
    got = [(r["direction"], r["match_kind"], r["callsite_line"]) for r in callgraph.edge_evidence(asked, e).collect()]
    assert got == [("incoming", "resolved_key", 4), ("incoming", "resolved_key", 9), ("incoming", "name_fallback", 10), ("outgoing", "resolved_key", 4), ("outgoing", "resolved_key", 5)]
    assert callgraph.resolve_edge_query(defs(spark), "beta")["function_key"] == "k2"
    for bad in ("twin", "nobody"):
        with pytest.raises(ValueError):
            callgraph.resolve_edge_query(defs(spark), bad)


def test_unit_report_keeps_units_without_report(spark):
    d = spark.createDataFrame([("a", 3), ("a", 0), ("c", 1)], "translation_unit string, severity int")
    rich = callgraph.enriched_edges(edges(spark, ("k1", "k2", "alpha", "beta", "f:1:1", "a"), ("k1", "k2", "alpha", "beta", "f:1:1", "b")), defs(spark))
    got = {r["translation_unit"]: (r["diagnostic_error_count"], r["total_diagnostic_count"], r["had_errors"], r["exported_edge_count"]) for r in callgraph.unit_report(d, rich).collect()}
    assert got == {"a": (1, 2, True, 1), "b": (0, 0, False, 1), "c": (0, 1, False, 0)}


def test_project_roots(spark):
    rows = spark.createDataFrame([("/p/a/x.c",), ("/p/ab/y.c",), ("/usr/z.c",)], "file string")
    assert [r["file"] for r in resolve.project_filter(rows, ["/p/a/"]).collect()] == ["/p/a/x.c"]
    assert resolve.outside_system(rows).count() == 2
    assert resolve.common_root(rows.filter("file like '/p/%'")) == "/p" and resolve.common_root(rows) is None


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_against_walk(spark, seed):
    rng = random.Random(seed)
    n = 12
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(16)}
    calls = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "caller string, callee string")
    want = set()
    for a in range(n):
        seen, todo = set(), [b for x, b in pairs if x == a]
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += [c for x, c in pairs if x == b]
        want |= {(f"n{a}", f"n{b}") for b in seen}
    assert {(r["caller"], r["callee"]) for r in closure.reachable(calls).collect()} == want


def test_names_reached_with_external_leaf(spark):
    d = spark.createDataFrame([("kf", "foo", "f", 1), ("kh", "helper", "f", 9)], FUNCTION_DEFS)
    e = edges(spark, ("kf", "kh", "foo", "helper", "f:1:1", "u"), ("kh", "m@<unknown>", "helper", "malloc", "f:2:1", "u"))
    got = {r["function_key"]: r["names"] for r in closure.reached_names(e, d).collect()}
    assert got == {"kf": ["helper", "malloc"], "kh": ["malloc"]}


def test_targets_follow_cycles(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "caller string, callee string")
    t = spark.createDataFrame([("b", "open", 1), ("c", "close", 1), ("a", "read", 1)], "function_key string, api string, ord int")
    got = {r["function_key"]: r["apis"] for r in closure.reached_targets(calls, t).collect()}
    assert got == {"a": ["read", "open", "close"], "b": ["open", "read", "close"], "c": ["close"]}


def test_threshold_and_majority(spark):
    for values in ([], [5], [1, 2, 3], list(range(1, 92)), [0, 0, -3]):
        df = spark.createDataFrame([(v,) for v in values], "fan_in int")
        want = 0 if not values else max(1, sorted(max(0, v) for v in values)[int(0.7 * (len(values) - 1))])
        assert merge.fan_in_threshold(df).first()["threshold"] == want
    cat = spark.createDataFrame([("open", "files"), ("close", "files"), ("send", "net")], "api string, grp string")
    rows = spark.createDataFrame([("1", "send - open"), ("2", "send - open - close"), ("3", ""), ("4", "zzz")], "function_key string, api_called string")
    got = {r["function_key"]: r["category"] for r in merge.majority_category(rows, cat).collect()}
    assert got == {"1": "net", "2": "files", "3": "unknown", "4": "unknown"}
    names = spark.createDataFrame([("1", "myOpenFile", "close - open"), ("2", "x", "close")], "function_key string, function string, api_called string")
    assert {r["function_key"]: r["best_api"] for r in merge.best_api(names).collect()} == {"1": "open", "2": ""}
    assert merge.fan_in_threshold(spark.range(3).select(F.lit(None).cast("int").alias("fan_in"))).first()["threshold"] == 1

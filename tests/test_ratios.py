"""Ratios against plain definitions, one pair at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import ratios
from graphloom.operators import fuzzy, merge


def common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def ratio(a, b):
    return 100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b))


def partial(a, b):
    if not a or not b:
        return 0.0
    best = 0.0
    for s, t in ((a, b), (b, a)) if len(a) == len(b) else (sorted((a, b), key=len),):
        for i in range(-len(s) + 1, len(t)):
            best = max(best, ratio(s, t[max(i, 0) : i + len(s)]))
    return best


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y and (x <= y or y <= x):
        return 100.0
    shared, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    with_left, with_right = (" ".join(filter(None, (shared, d))) for d in (left, right))
    edits = len(left) + len(right) - 2 * common(left, right)
    found = [100 - 100 * edits / (len(with_left) + len(with_right))]
    if shared:
        found += [ratio(shared, with_left), ratio(shared, with_right)]
    return max(found)


def weighted(a, b):
    if not a or not b:
        return 0.0
    apart, in_order = max(len(a), len(b)) / min(len(a), len(b)), [" ".join(sorted(s.split())) for s in (a, b)]
    if apart < 1.5:
        return max(ratio(a, b), 0.95 * ratio(*in_order), 0.95 * token_set(a, b))
    scale = 0.9 if apart <= 8 else 0.6
    tokens = 100.0 if set(a.split()) & set(b.split()) else max(partial(*in_order), partial(*(" ".join(sorted(set(s.split()))) for s in (a, b))))
    return max(ratio(a, b), scale * partial(a, b), scale * 0.95 * tokens)


def pairs():
    rng = random.Random(3)
    stems = ["open", "close", "fd", "safe", "my", "é", "mutex", "lock", "x", "aa", "read", "write"]
    names = ["", "a", "open", "x" * 64, "ab" * 40, "open " * 20 + "x"]
    names += [" ".join(rng.choices(stems, k=rng.randint(1, 6))) for _ in range(60)]
    return [(rng.choice(names), rng.choice(names)) for _ in range(700)]


def test_ratios_against_definitions():
    given = pairs()
    for got, want in ((ratios.indel_ratios, ratio), (ratios.partial_ratios, partial), (ratios.token_set_ratios, token_set), (ratios.weighted_ratios, weighted)):
        assert got(given) == pytest.approx(np.array([want(a, b) for a, b in given])), want.__name__


def test_names_by_the_weighted_ratio(spark):
    functions = spark.createDataFrame([("my_fopen_safe",), ("do_close",), ("pthread_lock_mutex",), ("zzz",)], "function string")
    canon = fuzzy.canon_table(spark.createDataFrame([("fopen",), ("open",), ("close",), ("pthread_mutex_lock",)], "api string"))
    rows = fuzzy.fuzzy_scores(functions, canon, ratio="weighted")
    for r in rows.join(canon, "key").collect():
        name = {"my_fopen_safe": "my fopen safe", "do_close": "do close", "pthread_lock_mutex": "pthread lock mutex"}[r["function"]]
        assert r["rf_score"] == pytest.approx(max(weighted(name, r["norm"]), token_set(name, r["norm"])))
    best = {r["function"]: r["key"] for r in fuzzy.top_matches(rows, 1).collect()}
    assert best == {"my_fopen_safe": "fopen", "do_close": "close", "pthread_lock_mutex": "pthread_mutex_lock"}
    plain = fuzzy.fuzzy_scores(functions, canon)
    assert plain.filter(F.col("rf_score") != F.col("combined")).count() == 0
    asked = spark.createDataFrame([("k", "pthread_lock_mutex", "open - pthread_mutex_lock")], "function_key string, function string, api_called string")
    assert merge.best_api(asked, ratio="weighted").first()["best_api"] == ""  # its substring ratio is below the least
    asked = spark.createDataFrame([("k", "xpthread_mutex_lock", "open - pthread_mutex_lock")], "function_key string, function string, api_called string")
    assert merge.best_api(asked, ratio="weighted").first()["best_api"] == "pthread_mutex_lock"

import os

import duckdb
import pytest

from graphloom.plans import tree_queries  # noqa: F401
from graphloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [q for q in QUERIES if q in ORACLES])
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    names = list(rel.columns)
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(shown(r[n]) for n in names) for r in df.collect())
    want = sorted(tuple(shown(v) for v in r) for r in rel.fetchall())
    assert got == want


def test_reach_over_all_edges_against_walk(spark):
    from graphloom.operators import closure
    from graphloom.plans.views import view

    calls = closure.resolved_calls(view(spark, SF, "edges"), view(spark, SF, "defs")).collect()
    steps = {}
    for r in calls:
        steps.setdefault(r["caller"], set()).add(r["callee"])
    want = set()
    for a in steps:
        seen, todo = set(), list(steps[a])
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += steps.get(b, ())
        want |= {(a, b) for b in seen}
    assert {(r["caller"], r["callee"]) for r in QUERIES["reach_pairs"](spark, SF).collect()} == want
    two = {(a, b) for a in steps for m in steps[a] for b in {m} | steps.get(m, set())}
    assert {(r["caller"], r["callee"]) for r in QUERIES["bounded_hops"](spark, SF).collect()} == two


def test_weighted_matches(spark):
    rows = QUERIES["fuzzy_topk_weighted"](spark, SF)
    plain = {(r["function"], r["key"]): r["combined"] for r in QUERIES["fuzzy_topk"](spark, SF).collect()}
    got = rows.collect()
    assert {r["function"] for r in got} == {f for f, _ in plain} and all(r["rank"] <= 3 and 0 <= r["rf_score"] <= 100 for r in got)
    assert all(plain[r["function"], r["key"]] == r["combined"] for r in got if (r["function"], r["key"]) in plain)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_windowed_diagnostics(spark, tmp_path):
    from pyspark.sql import functions as F

    from graphloom.streaming.diagnostics import windowed_diagnostics

    events = spark.read.parquet(f"{SF}/events.parquet")
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("translation_unit"), (F.col("event_id") % 5).cast("int").alias("severity"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_diagnostics(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("diagnosed").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert spark.table("diagnosed").agg(F.sum("total_diagnostic_count")).first()[0] == rows.count()

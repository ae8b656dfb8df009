import os
import random

import duckdb
import pytest

from graphloom.llm import urlfilter as uf

SF = "/root/testdata/sf0.001"


def brute(url, rules):
    host, path = uf.split_url(url)
    fits = [(h.count("."), len(p), v, h + p) for v, h, p in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


def test_trie_against_all_rules(spark, monkeypatch):
    rng = random.Random(1)
    hosts = ["a.b", "b", "x.a.b", "c.b", "com", "A.com", "q"]
    tails = ["/", "/en/1", "/en/", "/en", "", "/en/12/x", "/a//b", "/é/", "/en/" + "z" * 400]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts).lower(), rng.choice(tails)) for _ in range(40)]
    urls = [f"{rng.choice(['http://', 'https://', '://', ''])}{rng.choice(['', 'www.', 'X.'])}{rng.choice(hosts)}{rng.choice(tails)}{rng.choice(['', '?a=://b/', '#/en/1', '5'])}" for _ in range(400)]
    urls += [None, "", "://", "http://", "http://a.b?x/y", "no scheme/en/1"]
    df = spark.createDataFrame([(i, u, "h", "allow") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    for most in (10**6, 7):  # one trie, and blocks of rules
        monkeypatch.setattr(uf, "MAX_RULES", most)
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.judge_urls(df, rules).collect()}
        for i, u in enumerate(urls):
            want = brute(u, rules)
            assert got[i][:2] == want[:2] and got[i][3] == want[3] and (got[i][2] is None) == (want[2] is None), (u, got[i], want)
    assert uf.judge_urls(df, []).filter("verdict <> 'allow'").count() == 0 and uf.judge_urls(df.limit(0), rules).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op1_chat_format", "op9_url_filter"])
def test_oracles(spark, name):
    from graphloom.llm import queries

    c = duckdb.connect()
    for t in ("pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = c.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    show = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert show(df.select(*rel.columns).collect()) == show(rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    import __spark_entry__
    import corpus_pipeline as cp
    from graphloom.llm.common import materialize
    from tests.llm.test_dedup import brute_components, brute_repeats

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), "test-stage")
        seen[name] = (before, docs)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == before.columns
    before, after = seen["MinHash near-dedup"]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, _, c in brute_components(rows, 5, 80) if i == c)
    before, after = seen["suffix-array dedup"]
    assert not brute_repeats(sorted((r["doc_id"], r["text"]) for r in after.collect()), 50)
    before, after = seen["benchmark decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [r["doc_id"] for r in after.collect() if any(x in r["text"] for x in items)]
    before, after = seen["best-fit packing"]
    assert {r["doc_id"] for r in before.collect()} == {r["doc_id"] for r in after.collect()}
    final = __spark_entry__.queries()["pipeline"](spark, SF)
    assert sorted(map(tuple, final.drop("sequence_id", "offset").collect())) == sorted(map(tuple, after.drop("sequence_id", "offset").collect()))

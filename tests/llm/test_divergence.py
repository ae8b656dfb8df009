"""The audit against whole-number arithmetic over plain dictionaries, and against its SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import divergence, queries


def expected(rows, least=3, top=200):
    """(lang, source, part, item, value, rank) from (text, lang, source) rows."""
    groups, docs, whole = {}, Counter(), {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups.setdefault((lang, source), Counter()).update(terms)
        whole.setdefault(lang, Counter()).update(terms)
        docs.update({(lang, t) for t in terms})
    out = set()
    for lang, every in whole.items():
        kept = [t for t in every if docs[lang, t] >= least]

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        own = {s: share(c) for (g, s), c in groups.items() if g == lang}
        q = share(every)
        for s, p in own.items():
            pairs = [(-sum((p[t] - r[t]) ** 2 // r[t] for t in kept), o.encode(), o) for o, r in own.items() if o != s]
            terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if groups[lang, s][t] and p[t] > q[t]]
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:top], 1)}
    return out


def corpus(n, seed=3):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdEÉßñ漢\U0001f600") for _ in range(rng.randint(1, 4))) for _ in range(160)]
    rows = [(None, "xx", "only"), ("", "en", "s0"), ("12 3-4 _ [x", "en", "bare"), ("\x00a\x7fb\x85c d", None, None), ("a a", "solo", "one")]
    for _ in range(n):
        lang = rng.choice(["en", "en", "de", None, ""])
        source = rng.choice([f"s{min(rng.randrange(9), rng.randrange(9))}", None, "é"])
        words = [rng.choice(stems[: 40 + 20 * (len(source or "") + (source == "s1"))]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice([" ", "\n", ", ", "9"]).join(words), lang, source))
    return rows + rows[7:9]


def table(spark, rows):
    cells = [(i % 7 or None, t, lang, s, 1, "x") for i, (t, lang, s) in enumerate(rows)]
    return spark.createDataFrame(cells, "doc_id long, text string, lang string, source string, value int, term string").repartition(4)


def got(df):
    return {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()}


def test_audit_against_dictionaries(spark):
    rows = corpus(260)
    df = divergence.audit(table(spark, rows))
    found = df.collect()
    assert len(found) == len(set(found)) and got(df) == expected(rows)
    assert dict(df.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert got(divergence.audit(table(spark, rows), least=9, top=4)) == expected(rows, 9, 4)


@pytest.mark.parametrize(("name", "value"), [("PAIRS", 300), ("TERMS", 20)])
def test_counts_handed_on_in_parts(monkeypatch, name, value):
    rows = corpus(120, 8)
    monkeypatch.setattr(divergence, name, value)
    parts = [r for b in local_counts(rows) for r in b.to_pylist()]
    want = Counter((lang or "", source or "", re.sub("[A-Z]", lambda m: m[0].lower(), w)) for t, lang, source in rows for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or ""))
    sums = Counter()
    for r in parts:
        sums[r["lang"], r["source"], r["term"]] += r["n"]
    assert +sums == want and len(parts) > len(sums)  # pairs came in several parts


@pytest.mark.parametrize(("name", "value"), [("CHUNK_ROWS", 37), ("KEPT_SUMS", 40)])
def test_small_limits_change_nothing(spark, monkeypatch, name, value):
    monkeypatch.setattr(divergence, name, value)  # travels with the function to the workers
    rows = corpus(120, 8)
    assert got(divergence.audit(table(spark, rows))) == expected(rows)


def local_counts(rows):
    counter = divergence.Counter()
    for k in range(0, len(rows), 9):
        part = rows[k : k + 9]
        counter.add(pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.string()) for i in (1, 2, 0)], names=["lang", "source", "text"]))
        if counter.full():
            yield from counter.batches()
            counter = divergence.Counter()
    yield from counter.batches()


def test_chunks_and_comparison_in_pieces(monkeypatch):
    """Chunks of few rows, dense vectors of few cells: the same sums as in one piece."""
    rng = np.random.default_rng(1)
    n = rng.integers(0, 30, (5, 400)) * (rng.random((5, 400)) < 0.3)
    terms = pa.array([f"t{i:04d}" for i in range(400)])
    group, ids = np.nonzero(n)
    results = []
    for cells in (1 << 20, 64):
        monkeypatch.setattr(divergence, "CELLS", cells)
        c = divergence.Comparison("x", list("abcde"), n.sum(axis=1), 400, 20)
        c.add(terms, list("abcde"), group, ids, n[group, ids])
        results.append((c.sums.tolist(), c.best))
    assert results[0] == results[1]


def test_share_is_exact():
    rng = random.Random(6)
    for _ in range(2000):
        total = rng.randint(1, 9 * 10**15)
        count = rng.randint(0, total)
        assert int(divergence.share(np.array(count), np.array(total))) == 1 + 10**9 * count // total


def test_no_rows_and_one_source(spark):
    assert got(divergence.audit(table(spark, []).limit(0))) == set()
    assert got(divergence.audit(table(spark, [("a a", "en", "s")] * 3))) == expected([("a a", "en", "s")] * 3)
    assert got(divergence.audit(table(spark, [("a", "en", "s"), ("b", "en", "t")]))) == {("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)}


def test_query_against_sql(spark, tmp_path):
    rows = corpus(200, 5)
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(divergence.ORACLE_SQL)
    assert want.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert got(queries.op12_source_divergence(spark, str(tmp_path))) == set(want.fetchall()) == expected(rows)

"""Runs against a plain search, lag counts against pairs, the whole query against a word-by-word version."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from graphloom.llm import periodic, queries


def plain_runs(words):
    """Every maximal stretch with smallest period q and length >= max(6, 4q), place by place."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                stretch = words[i : j + q]
                smaller = any(all(stretch[k] == stretch[k + d] for k in range(len(stretch) - d)) for d in range(1, q))
                if len(stretch) >= max(6, 4 * q) and not smaller:
                    out.add((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def shapes():
    rng = random.Random(4)
    yield []
    yield list("aaaaa")
    yield list("aaaaaa")
    yield list("ababab")
    yield list("abababab")
    yield list("a" * 60)
    yield list("ab" * 5 + "aab" * 9 + "b" * 7 + "aab" * 4)
    yield list("abcabcabcabcab" * 6)
    for alphabet in (1, 2, 3, 8, 50):
        for n in (7, 30, 120, 300):
            yield [rng.randrange(alphabet) for _ in range(n)]
    for _ in range(150):  # blocks of blocks, with errors
        w = []
        while len(w) < rng.randint(10, 250):
            block = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randint(1, 12))]
            block = block * rng.randint(1, 7)
            w += (block * rng.randint(1, 6))[: rng.randint(1, 200)]
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = -1
        yield w


def test_runs_against_plain_search():
    for w in shapes():
        words = [str(x).encode() for x in w]
        assert periodic.find_runs(periodic.word_ids(words)) == plain_runs(words), w


@pytest.mark.parametrize(("n", "kinds"), [(6, 2), (200, 3), (3000, 2), (3000, 700), (3000, 40)])
def test_lag_counts_are_exact(n, kinds):
    rng = np.random.default_rng(n + kinds)
    ids = periodic.word_ids([str(x).encode() for x in np.minimum(rng.geometric(min(0.6, 4 / kinds), n), kinds)])
    most = n // 4
    got = periodic.lag_counts(ids, most)
    assert [int(got[q]) for q in range(1, most + 1)] == [int((ids[q:] == ids[:-q]).sum()) for q in range(1, most + 1)]


def test_small_blocks_change_nothing(monkeypatch):
    rng = random.Random(8)
    ids = periodic.word_ids([str(min(rng.randrange(60), rng.randrange(60))).encode() for _ in range(4000)])
    want = periodic.lag_counts(ids, 1000)
    monkeypatch.setattr(periodic, "BLOCK", 64)
    assert (periodic.lag_counts(ids, 1000) == want).all()


@pytest.mark.parametrize("words", [[b"a"] * 400_000, [b"a", b"b"] * 200_000, [str(i % 997).encode() for i in range(400_000)], [b"x" if i % 3 else str(i).encode() for i in range(400_000)]])
def test_long_texts_take_no_quadratic_time(words):
    began = time.time()
    periodic.find_runs(periodic.word_ids(words))
    assert time.time() - began < 60


def expected(doc, text):
    words = [w for w in (text or "").encode().replace(b"\x0b", b" ").split()]
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    sha = lambda t: hashlib.sha256(t).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *tail, sha(listed), sha(kept))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_word_by_word(spark, docs_of, words, tmp_path):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "one", "a a a a a a", "a b a b", "É é É é É é É é É", "x y " * 30, "the the the cat " * 9 + "the"]
    texts += [words(rng.randint(1, 260), i) for i in range(150)]
    texts += [" ".join([*words(20, i).split(), *(words(rng.randint(1, 20), 900 + i).split() * rng.randint(2, 7)), *words(9, 70 + i).split()]) for i in range(40)]
    texts.append(texts[-1])
    ids = [*range(len(texts) - 1), 3]
    docs_of(texts, ids).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    got = sorted((r["doc_id"], *(r[c] for c in COLUMNS)) for r in rows if r["n_runs"])
    got += sorted((r["doc_id"], *(str(r[c]) for c in COLUMNS)) for r in rows if not r["n_runs"])
    made = [(i, *expected(i, t)) for i, t in zip(ids, texts, strict=True)]
    want = sorted(m for m in made if m[1]) + sorted((m[0], *map(str, m[1:])) for m in made if not m[1])
    assert got == want and sum(m[1] > 0 for m in made) > 30
    assert dict(queries.op11_periodic_runs(spark, str(tmp_path)).dtypes) == {"doc_id": "bigint"} | dict.fromkeys(COLUMNS[:5], "bigint") | dict.fromkeys(COLUMNS[5:], "string")


def test_null_ids_and_empty_tables(spark, docs_of):
    rows = periodic.run_digests(periodic.collapse_runs(docs_of(["b " * 9, None], [None, None]), periodic.planted)).collect()
    assert sorted((r["doc_id"], r["n_runs"]) for r in rows if r["n_runs"]) == [(None, 1)] and len(rows) == 2
    assert periodic.run_digests(periodic.collapse_runs(docs_of([]))).collect() == []


def test_operator_without_planting(spark, docs_of):
    r = periodic.collapse_runs(docs_of(["go a b a b a b a b stop"])).first()
    assert [tuple(x) for x in r["runs"]] == [(1, 8, 2)] and r["collapsed"] == "go a b stop"

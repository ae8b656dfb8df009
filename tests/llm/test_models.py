import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import decontam, langid, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)]


def test_statistics_against_plain_rules():
    rng = random.Random(1)
    bits = ["a", "b", "é", "#", "|x", "\n", "\n\n", " ", "\t", "日本", " c", "  ", "\x85", "\x1c"]
    for _ in range(800):
        t = "".join(rng.choices(bits, k=rng.randint(0, 60)))
        assert quality.text_statistics(t)[:5] == plain_statistics(t), repr(t)
    assert quality.text_statistics(None) == [0] * 6


def test_quality_verdicts(spark, docs_of, words):
    good = [words(80 + i, i) + ". " + words(20, 900 + i) + "," for i in range(120)]
    bad = [" | ".join(words(90, 500 + i).split()) if i % 2 else " ".join(x + "***" for x in words(90, 500 + i).split()) for i in range(30)]
    texts = [*good, *bad, None, "", "short", "same words here " * 40]
    df = docs_of(texts)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 150, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.judge(df, labels, trees=60).collect()}
    for i, t in enumerate(texts):
        r, s = rows[i], plain_statistics(t)
        assert [r[n] for n in quality.STAT_NAMES] == s
        assert r["base_failed"] == (s[0] < 50 or 100 * s[4] > 50 * s[0]) and not (r["base_failed"] and r["kept"])
    assert sum(rows[i]["kept"] for i in range(120)) >= 118 and sum(rows[i]["kept"] for i in range(120, 150)) == 0
    again = {r["doc_id"]: r["score"] for r in quality.judge(df, labels, trees=60).collect()}
    assert again == {i: r["score"] for i, r in rows.items()}
    assert quality.judge(df, labels.limit(0), trees=20).count() == len(texts)
    assert quality.judge(df.limit(0), labels, trees=20).count() == 0


def test_rare_bad_rows_are_judged_at_any_size(spark):
    from pyspark.sql import functions as F

    clean = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do " * 2
    plain = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(*(F.concat(F.lit(w), F.col("id") * 31 + i, F.lit(" ")) for i, w in enumerate(clean.split() * 3))).alias("text"))
    late = [r[0] for r in spark.range(20_000, 20_100).orderBy(F.xxhash64("id").desc()).limit(2).collect()]  # not among the first by hash
    junk = plain.filter("doc_id < 2").select(F.when(F.col("doc_id") == 0, late[0]).otherwise(late[1]).alias("doc_id"), F.regexp_replace("text", " ", " ### ").alias("text"))
    docs = plain.unionByName(junk).repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 20_000, 100)] + [(late[0], 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge(docs, labels, trees=40).filter("doc_id >= 20000 OR NOT kept").collect()
    assert {r["doc_id"]: r["kept"] for r in rows} == {i: False for i in late}


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 2)), [[60.0, 80.0]]])
    forest = quality.grow(x, 100, 128)
    score = forest.score(x)
    assert score.argmax() == 500 and score[500] > np.median(score) + 0.05
    assert quality.calibrate(np.array([0.1, 0.2]), np.array([0.5, 0.6])) == pytest.approx(0.35)


LANGS = {"aa": "the of and ing tion er", "bb": "der die und ung keit sch", "cc": "el los de que ción ar", "dd": "le les et eux ment ai"}


def tongue(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    parts = LANGS[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    rows = [(i, tongue(lang, 5 + i % 60, i), lang) for i, lang in enumerate(list(LANGS) * 60)]
    extra = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !! 45", "cc"), (1003, tongue("dd", 20000, 7), None), (None, tongue("aa", 30, 3), "zz"), (1000, tongue("bb", 9, 1), None)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumnRenamed("x", "y")
    got = langid.predict_all(df, per_lang=40).collect()
    assert len(got) == len(rows) + len(extra)
    want = {i: lang for i, _, lang in rows}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in want]
    assert sum(want[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] != 1000}
    assert by_id[1001]["lang_pred"] == by_id[1002]["lang_pred"] == "und" and by_id[1002]["score"] == 0 and by_id[1003]["lang_pred"] == "dd"
    assert sorted(r["lang_pred"] for r in got if r["doc_id"] == 1000) == ["bb", "und"] and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] != "zz" for r in got)
    kept = langid.accepted(df, langid.train(df, 40))
    assert kept.columns == df.columns and kept.filter("doc_id in (1001, 1002)").count() == 0 and kept.count() >= len(rows)
    assert langid.predict_all(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.predict_all(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


@pytest.mark.parametrize("k", [2, 4, 6, 20])
def test_codewords_differ(k):
    code = langid.codewords(k)
    assert len({tuple(r) for r in code}) == k and (np.abs(code.sum(axis=0)) < k).all()
    gap = min((a != b).sum() for i, a in enumerate(code) for b in code[:i])
    assert gap >= (2 ** (k - 2) if k <= 6 else 8)


def test_leaks(spark, docs_of, words):
    items = [words(n, 10_000 + n) for n in range(9, 49)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, "too short item")], "item_id long, text string")
    rng = random.Random(2)
    texts, want = [None, "", "x" * 5000, words(6000, 1)], set()
    for i, t in enumerate(items):
        w = t.split()
        around = [words(rng.randint(0, 120), 20_000 + 3 * i), words(rng.randint(0, 120), 20_001 + 3 * i)]
        if i % 4 == 3:  # a paraphrase: a fifth of the words before the answer replaced
            w = [f"swap{j}" if j < len(w) - 8 and j % 5 == 2 else x for j, x in enumerate(w)]
        spoken = " ".join(w)
        texts.append(f"{around[0]} {spoken.upper() + '!!' if i % 4 == 1 else spoken} {around[1]}")
        want.add((len(texts) - 1, i))
    clean = range(len(texts), len(texts) + 150)
    texts += [words(rng.randint(10, 400), 30_000 + i) for i in clean]
    texts += [f"{words(40, 5)} {' '.join(items[30].split()[:12])} {words(40, 6)}"]  # a shared phrase is no leak
    df = docs_of(texts)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench).collect()}
    assert len(want & got) >= 0.95 * len(want) and {d for d, _ in got} <= {d for d, _ in want}
    left = decontam.without_leaks(df, bench)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert decontam.find_leaks(df.limit(0), bench).count() == 0 and decontam.find_leaks(df, bench.limit(0)).count() == 0


def test_copies_in_repetitive_texts(words):
    rng = random.Random(4)
    items = [words(n, 40_000 + i) for i, n in enumerate([*range(15, 60)] * 3)]
    corpus = [words(300, 50_000 + i) for i in range(200)]
    space = space_of(corpus)
    search = decontam.Items.build([{"item_id": i, "text": t} for i, t in enumerate(items)], space)
    texts, spoken, host = [], [], words(20, 3).split() + [f"zq{i}" for i in range(20)]
    for i, t in enumerate(items):
        w = t.split()
        changed = [f"swap{j}" if j < len(w) - 8 and j % 5 == 2 else x for j, x in enumerate(w)]
        for out, body in ((texts, t), (spoken, " ".join(changed))):
            for hosts in ([host[i % 40]], [host[i % 40]] * 9 + words(3, i).split()):
                around = rng.choices(hosts, k=240)
                k = rng.randint(20, 220)
                out.append(" ".join([*around[:k], body, *around[k:]]))
    assert {(t, j) for t, j, *_ in search.find(texts)} >= {(i, i // 2) for i in range(len(texts))}
    found = {(t, j) for t, j, *_ in search.find(spoken)}
    assert sum((i, i // 2) in found for i in range(len(spoken))) >= 0.95 * len(spoken)


def test_common_subsequence_against_table():
    rng = random.Random(3)
    for _ in range(200):
        a, b = [[rng.randrange(6) for _ in range(rng.randint(0, 14))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.lcs_length(decontam._masks(a), len(a), b) == t[-1][-1]


def test_known_words_by_their_first_bits():
    rng = np.random.default_rng(9)
    space = np.zeros((decontam.DIM, decontam.RANK), np.float32)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 400, 40)) for _ in range(20)] + ["one two"]
    items = decontam.Items.build([{"item_id": i, "text": t} for i, t in enumerate(texts)], space)
    words = decontam.plain_words([*texts, " ".join(f"w{i}" for i in range(2000))])[0]
    place = {w: i for i, w in enumerate(items.vocabulary.tolist())}
    assert items.known(words).tolist() == [place.get(w, len(place)) for w in words.tolist()]


def space_of(texts):
    h, first = decontam.plain_words(texts)
    found = decontam.range_sums(h, first, np.arange(len(texts)))
    size = decontam.DIM * decontam.ROWS
    idf = decontam.weights_of(found[size:-1], found[-1])
    basis = decontam.basis_of(found[:size], idf)
    return decontam.scaled(*decontam.decomposed(decontam.projection_sums(h, first, basis), basis, idf), idf)


def plain_matrix(texts):
    """Passages x buckets, weighted, word by word."""
    rows, seen = [], np.zeros(decontam.DIM)
    for t in texts:
        h = decontam.plain_words([t])[0]
        blocks = []
        for k in range(0, len(h), decontam.BLOCK):
            x = np.zeros(decontam.DIM)
            for b, s in zip(*decontam.buckets(h[k : k + decontam.BLOCK]), strict=True):
                x[b] = x[b] or s
            blocks.append(x)
            seen += x != 0
        rows += [x + (blocks[i + 1] if i + 1 < len(blocks) else 0) for i, x in enumerate(blocks)]
    idf = np.log((len(rows) + 1) / (seen + 1)) + 1e-3
    return np.array(rows) * idf, idf


def test_randomised_decomposition_against_the_exact_one(spark, docs_of, words, monkeypatch):
    """Topics make a spectrum that falls; on more rows than its rank the exact decomposition is found."""
    topics = [words(12, 60_000 + k) for k in range(40)]
    rng = random.Random(8)
    texts = [" ".join(rng.choice(topics[i % 40].split()) for _ in range(rng.randint(30, 200))) for i in range(400)] + ["", "word"]
    a, idf = plain_matrix([t for t in texts if t])
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    got = {}
    real = decontam.scaled
    monkeypatch.setattr(decontam, "scaled", lambda v, s, idf: got.update(v=v, s=s, idf=idf) or real(v, s, idf))
    space = decontam.latent_space(docs_of([*texts, None]))
    assert np.allclose(got["idf"], idf) and np.allclose(got["s"][:40], s[:40], rtol=0.01)
    k = 40  # the topics
    assert np.linalg.norm(vt[:k] - vt[:k] @ got["v"] @ got["v"].T) < 0.1 * np.sqrt(k)
    assert (space == decontam.latent_space(docs_of([*texts, None]).repartition(7))).all()  # whatever the layout
    assert not decontam.latent_space(docs_of([None, ""])).any()


def test_candidates_against_all_items(words):
    """Every paraphrase that an exhaustive comparison of all passages and items finds is found, but for a few in a hundred."""
    rng = random.Random(6)
    items = [words(n, 70_000 + i) for i, n in enumerate([15, 25, 35, 45, 59] * 8)]
    corpus = [words(300, 80_000 + i) for i in range(200)]
    space = space_of(corpus)
    rows = [{"item_id": i, "text": t} for i, t in enumerate(items)]
    search = decontam.Items.build(rows, space)
    texts = []
    for share in (0, 0.2, 0.28, 0.38):
        for t in items:
            w = [f"other{rng.randrange(10**6)}" if rng.random() < share else x for x in t.split()]
            around = words(260, rng.randrange(10**6)).split()
            k = rng.randint(0, 200)
            texts.append(" ".join([*around[:k], *w, *around[k:]]))
    got = {(t, j) for t, j, *_ in search.find(texts)}
    least, decontam.COSINE = decontam.COSINE, -2.0
    try:
        want = {(t, j) for t, j, *_ in search.find(texts)}
    finally:
        decontam.COSINE = least
    assert got <= want and {(i, i) for i in range(len(items))} <= got and len(got) >= 0.97 * len(want) > 60

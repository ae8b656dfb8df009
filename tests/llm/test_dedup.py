import collections
import random
import re

import numpy as np
import pytest

from graphloom.llm import common, graph, neardup, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_components(rows, size, threshold):
    """doc_id -> (set size, smallest linked id); rows of one id are one node."""
    sets, parent = {}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, t) in enumerate(rows):
        w = WORD.findall(fold(t))
        sets[k] = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
        parent[k] = k
    keys = [k for k in sets if rows[k][0] is not None and sets[k]]
    for a in keys:
        for b in keys:
            if a < b:
                n = len(sets[a] & sets[b])
                if rows[a][0] == rows[b][0] or 100 * n >= threshold * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    least = collections.defaultdict(lambda: 1 << 60)
    for k in keys:
        least[root(k)] = min(least[root(k)], rows[k][0])
    return [(rows[k][0], len(sets[k]), least[root(k)] if k in keys else rows[k][0]) for k in sets]


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return words


def corpus(words, seed):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "one", "ONE", "a b c", "A  b\nC", "x" * 5000, "y " * 3000]
    for s in range(12):
        base = words(rng.randint(20, 150), seed * 100 + s).split()
        texts += [" ".join(edited(base, rng, rng.randint(0, 1 + len(base) // 30))) for _ in range(6)]
    star = words(120, seed * 100 + 50).split()
    texts += [" ".join(edited(star, rng, rng.randint(0, 8))) for _ in range(60)]  # a group of near copies around the threshold
    texts += [" ".join(star)] * 20
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("seed", "size"), [(1, 4), (2, 5)])
def test_components_against_brute_force(spark, docs_of, words, seed, size):
    rows = corpus(words, seed)
    df = docs_of([t for _, t in rows], [i for i, _ in rows])
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, size, 80).collect())
    assert got == sorted(brute_components(rows, size, 80))
    kept = neardup.one_of_each(df, size, 80)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute_components(rows, size, 80)})


@pytest.mark.parametrize("hot_keys", [500_000, 3])
def test_hot_keys_and_texts_in_many_pairs(spark, docs_of, words, monkeypatch, hot_keys):
    """Few rows make a key hot and few pairs fill a place, so every split is taken; the number of hot keys stays bounded."""
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    monkeypatch.setattr(neardup, "PAIRS_A_COPY", 3)
    rows = corpus(words, 3)
    df = docs_of([t for _, t in rows], [i for i, _ in rows])
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 4, 80).collect())
    assert got == sorted(brute_components(rows, 4, 80))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [1, 5, 10**6])
def test_groups_reach_every_row(spark, monkeypatch, how, hot_rows):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    rows = [(k, i) for k in range(8) for i in range(k * k)] + [(None, 1)]
    groups = [(k, k * k) for k in range(1, 8) if k != 3]
    left, right = spark.createDataFrame(rows, "key long, i long"), spark.createDataFrame(groups, "key long, n long")
    got = sorted(((r["key"], r["i"], r["n"]) for r in common.join_groups(left, right, "key", "n", how).collect()), key=str)
    known = dict(groups)
    assert got == sorted(((k, i, known.get(k)) for k, i in rows if how == "left" or k in known), key=str)


def test_repeated_ids_null_ids_and_empty_tables(spark, docs_of, words):
    a, b = words(60, 1), words(60, 2)
    rows = [(3, a), (5, b), (5, a), (5, a), (None, a), (7, b), (9, None)]
    df = docs_of([t for _, t in rows], [i for i, _ in rows])
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, 4).collect()), key=str)
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 3, False), (5, 3, False), (None, None, True), (7, 3, False), (9, 9, True)], key=str)
    twice = docs_of([a, a, b], [1, 1, 2])
    assert sorted(r["doc_id"] for r in neardup.one_of_each(twice).collect()) == [1, 2]
    assert neardup.near_duplicates(df.limit(0), 4).count() == 0 and neardup.one_of_each(df.limit(0)).count() == 0


def test_signatures_within_the_distance_share_a_key():
    """Pigeonhole: CHUNKS * (ERRORS + 1) - 1 differing slots, however placed, leave a chunk with one error at most."""
    rng = np.random.default_rng(0)
    n = neardup.CHUNKS * neardup.SLOTS
    for _ in range(300):
        differ = np.zeros(n, bool)
        differ[rng.choice(n, neardup.CHUNKS * (neardup.ERRORS + 1) - 1, replace=False)] = True
        assert (differ.reshape(neardup.CHUNKS, neardup.SLOTS).sum(axis=1) <= neardup.ERRORS).any()


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 2**63, k, dtype=np.int64).astype(np.uint64) for k in (800, 100, 100))
    x, y = neardup.signature(np.concatenate([shared, a])), neardup.signature(np.concatenate([shared, b]))
    assert abs((x == y).mean() - 0.8) < 0.2


def test_contraction_against_union_find(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, 200)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert {x: got.get(x, x) for x in linked} == {x: root(x) for x in linked}


def test_word_hashes_split_as_the_rule_says():
    texts = ["a b", "", "a\tb\x0bc\r\n d", "é　x\x1cy", "w" * 9000 + " " + "w" * 9001, "\x85 z"]
    h, first = common.word_hashes(common.encoded(texts), piece=64)
    per = [WORD.findall(t) for t in texts]
    assert np.diff(first).tolist() == [len(p) for p in per]
    flat = [w for p in per for w in p]
    assert len({*flat}) == len(set(h.tolist())) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))
    low, _ = common.word_hashes([b"ABC abc Abc"], lower=True)
    assert common.word_hashes([b"  one two"])[0].tolist() == common.word_hashes([b"one two"])[0].tolist()
    assert len(set(low.tolist())) == 1


def brute_repeats(rows, n):
    seen, out = {}, collections.defaultdict(set)
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - n + 1):
            first = seen.setdefault(tuple(w[j : j + n]), (i, j))
            if first != (i, j):
                out[i].update(range(max(j, first[1] + n) if first[0] == i else j, j + n))
    return {i: s for i, s in out.items() if s}


@pytest.mark.parametrize(("seed", "n", "gram"), [(1, 12, 4), (2, 20, 8), (3, 5, 5), (4, 6, 1)])
def test_repeats_against_brute_force(spark, docs_of, words, seed, n, gram):
    rng = random.Random(seed)
    shared = [words(rng.randint(n - 2, 3 * n), 1000 * seed + k) for k in range(5)]
    texts = [None, "", "few words", "loop " * 60, " ".join(["a", "b"] * 40), "x" * 3000]
    for k in range(40):
        parts = [words(rng.randint(0, 30), 2000 * seed + k)] + [rng.choice(shared) if rng.random() < 0.5 else words(rng.randint(0, 40), 3000 * seed + 10 * k + j) for j in range(3)]
        texts.append("\n".join(parts))
    texts += [texts[8], texts[9] + " tail"]
    rows = list(enumerate(texts))
    found = collections.defaultdict(set)
    for r in suffix.repeated_spans(docs_of(texts), n, gram).collect():
        assert not found[r["doc_id"]] & set(range(r["start_word"] - 1, r["end_word"] + 1)) and r["source_doc_id"] <= r["doc_id"]
        found[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert {i: s for i, s in found.items() if s} == brute_repeats(rows, n)


def test_runs_over_many_ranges(spark, docs_of, words, monkeypatch):
    """One passage in most documents, with borders that differ, in ranges of a few rows: runs cross many of them."""
    monkeypatch.setattr(suffix, "SORT_ROWS", 15)
    passage, copy = words(40, 7), words(60, 8)
    texts = [f"{words(k % 7, 50 + k)} {passage} {words(k % 5, 90 + k)}" for k in range(60)] + [copy] * 40 + ["again " * 50]
    found = collections.defaultdict(set)
    for r in suffix.repeated_spans(docs_of(texts), 12, 4).collect():
        found[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert {i: s for i, s in found.items() if s} == brute_repeats(list(enumerate(texts)), 12)


def test_neighbours_bound_the_extension(spark, docs_of, words, monkeypatch):
    """Texts that share a k-gram only have neighbours, but none that can be extended to a window, but for the two rows at
    the ends of the one range; a shared passage leaves some."""
    counts = {}

    def counting(df, name):
        out = common.materialize(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(suffix, "materialize", counting)
    monkeypatch.setattr(suffix, "_sorted", lambda rows, *by: rows.coalesce(1).sortWithinPartitions(*by))
    gram, shared = words(10, 1), words(60, 9)
    far = docs_of([f"{words(60, 20 + k)} {gram} {words(60, 40 + k)}" for k in range(6)])
    assert suffix.repeated_spans(far).count() == 0 and counts["suffix-array"] > 20 and counts["seeds"] <= 2
    near = docs_of([f"{words(60, 20 + k)} {shared} {words(60, 40 + k)}" for k in range(6)])
    assert suffix.repeated_spans(near).count() == 5 and counts["seeds"] > 6


def test_cut(spark, docs_of, words):
    p = words(60, 1)
    texts = [p, f"before  {p}\n\nafter it", p, None, "", f"{words(60, 2)} {p}"]
    df = docs_of(texts)
    out = suffix.without_repeats(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {0: p, 1: "before\n\nafter it", 3: None, 4: "", 5: words(60, 2)}
    assert suffix.repeated_spans(out).count() == 0 and suffix.without_repeats(df.limit(0)).count() == 0
    same = docs_of([p, p, p], [4, 4, None])
    assert suffix.repeated_spans(same).count() == 0


def test_scratch_tables_can_be_dropped(spark):
    kept = common.materialize(spark.range(5), "probe")
    assert kept.count() == 5
    common.drop_scratch(spark)
    with pytest.raises(Exception):
        common.materialize(spark.range(5), "probe").sparkSession.read.parquet(kept.inputFiles()[0]).count()
    assert common.materialize(spark.range(5), "probe").count() == 5

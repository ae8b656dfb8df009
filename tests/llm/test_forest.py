"""The forest decides, its paths are those of a plain walk, and its verdicts hold on rows it was not calibrated on."""

import random

import numpy as np
import pytest

from graphloom.llm import quality


def walk(forest, row, root):
    """Path length of one row in one tree, node by node."""
    node = root
    while forest.feature[node] >= 0:
        node = forest.left[node] + int(row[forest.feature[node]] >= forest.cut[node])
    return forest.depth[node]


def test_path_lengths_against_a_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.random((300, 6))
    forest = quality.grow(x, 25, 32, weight=np.array([5, 1, 1, 1, 0.01, 1.0]), rare=x[:9] + 1)
    for row, got in zip(x[:40], forest.score(x[:40]), strict=True):
        mean = np.mean([walk(forest, row, r) for r in forest.roots])
        assert got == pytest.approx(2 ** (-mean / quality._expected(32)))
    for root in forest.roots:  # every row of a tree's draw ends in a leaf that is no deeper than the limit and holds it
        assert max(walk(forest, r, root) for r in x) <= 5 + quality._expected(32)


def test_depth_of_a_leaf_is_that_of_its_rows():
    x = np.array([[0.0], [1.0], [1.0], [1.0]])
    forest = quality.grow(x, 20, 4)
    assert {walk(forest, x[0], r) for r in forest.roots} == {1.0} and {walk(forest, x[1], r) for r in forest.roots} == {1 + quality._expected(3)}


def mixed(words, n):
    """Texts and labels: one in nine bad, by marks on some of their words."""
    rng, texts, good = random.Random(5), [], []
    for i in range(n):
        w = words(rng.randint(60, 300), 7000 + i).split()
        bad = i % 9 == 3
        if bad:
            w = [x + "#" if rng.random() < rng.uniform(0.2, 0.9) else x for x in w]
        elif rng.random() < 0.1:
            w = w + w[:20]  # some good texts repeat themselves
        texts.append(" ".join(w) + ("." if i % 3 else ""))
        good.append(int(not bad))
    return texts, good


def test_verdicts_on_rows_without_part_in_calibration(spark, docs_of, words, monkeypatch):
    texts, good = mixed(words, 400)
    labels = spark.createDataFrame([(i, g, 0) for i, g in enumerate(good) if i % 2], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.judge(docs_of(texts), labels).collect()}
    held = range(0, 400, 2)
    assert sum(rows[i]["kept"] for i in held if good[i]) >= 0.97 * sum(good[i] for i in held)
    assert not any(rows[i]["kept"] for i in held if not good[i])
    # A forest whose paths are all alike tells nothing apart.
    leaf = quality.Forest(np.array([-1]), np.array([0.0]), np.array([-1]), np.array([1.0]), np.array([0]), 1.0)
    _, threshold = quality.train(quality.materialize(quality.statistics(docs_of(texts)), "probe"), labels)
    monkeypatch.setattr(quality, "train", lambda *_: (leaf, threshold))
    flat = {r["doc_id"]: r["kept"] for r in quality.judge(docs_of(texts), labels).collect()}
    assert any(flat[i] != rows[i]["kept"] for i in held) and len({flat[i] for i in held}) == 1

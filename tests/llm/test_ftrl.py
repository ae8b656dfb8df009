"""Updates against the plain formulas, vectors against a plain tokeniser, accuracy on rows that were not learned from."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from graphloom.llm import ftrl, queries

DIRT = ["###", "&&&", "$$$", "!!"]


def mixed(words, n):
    rng, rows = random.Random(9), []
    for i in range(n):
        w = words(rng.randint(20, 200), 300 + i).split()
        kind = i % 6
        if kind == 1:
            w = [x + rng.choice(DIRT) for x in w]
        elif kind == 3:
            w = [x for x in w[:20] for _ in range(rng.randint(5, 12))]
        rows.append((" ".join(w), int(kind not in (1, 3))))
    return rows


def test_updates_are_those_of_the_formulas():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(50, 6, replace=False)).astype(np.int32), rng.random(6).astype(np.float32), int(rng.random() < 0.6)) for _ in range(60)]
    weights = ftrl.learn(rows, epochs=2, alpha=0.7, beta=0.9, l1=0.05, l2=0.1)
    z, n = [0.0] * 51, [0.0] * 51  # the last is the bias

    def weight(i):
        if abs(z[i]) <= 0.05:
            return 0.0
        return -(z[i] - math.copysign(0.05, z[i])) / ((0.9 + math.sqrt(n[i])) / 0.7 + 0.1)

    for _ in range(2):
        for at, value, y in rows:
            cells = [*zip(at.tolist(), value.astype(float).tolist(), strict=True), (50, 1.0)]
            w = {i: weight(i) for i, _ in cells}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in cells)))
            for i, v in cells:
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7
                z[i] += g - sigma * w[i]
                n[i] += g * g
    assert weights.bucket[:50] == pytest.approx([weight(i) for i in range(50)]) and weights.bias == pytest.approx(weight(50)) and not weights.bucket[50:].any()
    at, value, _ = rows[0]
    margin = sum(weight(int(i)) * float(v) for i, v in zip(at, value, strict=True)) + weight(50)
    assert weights.scores([(at, value), (at[:0], value[:0])]) == pytest.approx([1 / (1 + math.exp(-margin)), 1 / (1 + math.exp(-weight(50)))])


def test_words_are_those_of_a_plain_tokeniser():
    for text in ("", " \n", "The cat, the ÉCLAIR!! a_b 12x 12", "!!", "x" * 5000 + " y"):
        plain = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^\s0-9A-Za-z\u0080-\U0010ffff]+", text)
        words, forms = ftrl.words_and_forms(np.frombuffer(text.encode(), np.uint8))
        lowered = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in plain]
        assert len(words) == len(plain) == len(forms)
        assert [[a == b for b in words] for a in words] == [[a == b for b in lowered] for a in lowered]
    at, value = ftrl.vector(b"one two one two")
    assert float((value**2).sum()) == pytest.approx(1) and (np.diff(at) > 0).all() and len(ftrl.vector(b"")[0]) == 0


def test_pieces_change_nothing(monkeypatch, words):
    text = (words(900, 4) + " !! ### 12 ABC").encode()
    whole = ftrl.vector(text)
    monkeypatch.setattr(ftrl, "PIECE", 64)
    parts = ftrl.vector(text)
    assert (whole[0] == parts[0]).all() and whole[1] == pytest.approx(parts[1])


def test_held_out_rows(spark, docs_of, words, tmp_path):
    rows = mixed(words, 500)
    docs = docs_of([*(t for t, _ in rows), None, "", "  "])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, y, 0) for i, (_, y) in enumerate(rows)]
    held = {i for i in range(503) if zlib.crc32(str(i).encode()) % 5 == 0}
    wrong = [(i, 1 - y if i in held else y, t) for i, y, t in labels]  # labels of held-out rows are never read
    made = []
    for name, some in (("labels", labels), ("wrong", wrong)):
        spark.createDataFrame([*some, (None, 1, 0), (3, None, 0), (99_999, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        made.append({r["doc_id"]: r for r in queries.op13_ftrl_quality(spark, str(tmp_path / name)).collect()})
    found = made[0]
    assert made[0] == made[1] and len(found) == 503 and {i for i, r in found.items() if r["held_out"]} == held
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    assert len({found[i]["score"] for i in (500, 501, 502)}) == 1
    right = [found[i]["predicted"] == y for i, (_, y) in enumerate(rows) if i in held]
    assert sum(right) >= 0.97 * len(right)
    assert dict(queries.op13_ftrl_quality(spark, str(tmp_path / "labels")).dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}


def test_few_labels_and_no_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ones = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], none.schema)
    docs = docs_of(["a b", "c", None], [1, 2, None])
    assert {r["score"] for r in ftrl.score_all(docs, none).collect()} == {0.5}
    rows = ftrl.score_all(docs, ones).collect()
    assert {r["predicted"] for r in rows} == {1} and min(r["score"] for r in rows) > 0.99
    assert ftrl.score_all(docs_of([]), ones).collect() == []
    both = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 0, 0)], none.schema)
    assert len(ftrl.training_rows(docs, both, 10, ftrl.held_out_rows())) == 2


def test_sample_does_not_depend_on_the_layout(spark, docs_of, words):
    rows = mixed(words, 60)
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    docs = docs_of([t for t, _ in rows])
    one, two = (ftrl.training_rows(d, labels, 25, ftrl.held_out_rows()) for d in (docs, docs.repartition(7)))
    assert len(one) == 25 and all((a[0] == b[0]).all() and (a[1] == b[1]).all() and a[2] == b[2] for a, b in zip(one, two, strict=True))

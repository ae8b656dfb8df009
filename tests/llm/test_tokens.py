import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from graphloom.llm import packing, tokenbin, tokencount, vocab  # noqa: E402

ALPHA = list("ab cde  \n\n é日▁\t\r.,'s0127ABÉß") + ["the", "ing", "x̂", "<s>", "</s>", "<|endoftext|>", "\x00", "It's.", "", "\x85", " ", "Σ", "İ"]


def texts(n, seed, k=40):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHA, k=rng.randint(0, k))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab.tokenizer_path(packing.TOKENIZER))


def ids_of(library, text, end):
    return library.encode(text or "", add_special_tokens=False).ids + [end]


def test_word_memory_equals_the_library(library):
    memory = vocab.word_ids(vocab.tokenizer_path(packing.TOKENIZER))
    for t in texts(3000, 1):
        assert np.frombuffer(memory.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(vocab, "CACHE_WORDS", 50)
    memory = vocab.WordIds(vocab.tokenizer_path(packing.TOKENIZER))
    for i in range(400):
        memory.encode(f"word{i} again")
        assert len(memory) <= 50 and len(memory.old) <= 50


def test_prefix_counts_equal_the_library():
    path = tokencount.tokenizer_path(tokencount.MODEL)
    memory = tokencount.unit_counts(path)
    count = lambda t: len(memory.library.encode(t))
    for k, t in enumerate(texts(1500, 2)):
        table = tokencount.PrefixCounts(t, path)
        assert table.total == memory.total(t) == count(t), repr(t)
        if k < 150:
            every = [count(t[:i]) for i in range(len(t) + 1)]
            assert [table.at(i) for i in range(len(t) + 1)] == every, repr(t)
            for budget in (0, 1, 5, 1000):
                assert table.longest_within(budget) == max(i for i, n in enumerate(every) if n <= budget), repr(t)


def test_token_counts(spark, docs_of):
    sample = [None, "", " ", "x" * 70000, "a b " * 20000, *texts(30, 3)]
    memory = tokencount.unit_counts(tokencount.tokenizer_path(tokencount.MODEL))
    got = {r["doc_id"]: r for r in tokencount.token_counts(docs_of(sample)).collect()}
    for i, t in enumerate(sample):
        n = len(memory.library.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 4096)
    cut = {r["doc_id"]: r for r in tokencount.truncate(docs_of(sample), 7).collect()}
    assert all(r["n_tokens"] == len(memory.library.encode(r["text"])) <= 7 for r in cut.values())
    tables = {r["doc_id"]: r for r in tokencount.prefix_tables(docs_of(sample)).collect()}
    assert tables[4]["counts"][-1] == got[4]["n_tokens"] and len(tables[4]["ends"]) == len(tables[4]["counts"])
    assert tokencount.token_counts(docs_of(["x"]).limit(0)).count() == 0


def test_counts_and_limits_are_read_from_the_tables(monkeypatch):
    import pyarrow as pa

    path = tokencount.tokenizer_path(tokencount.MODEL)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words here", None]})
    right = tokencount.counted(batch, path, 4).to_pydict()
    assert right["n_tokens"] == [len(tokencount.unit_counts(path).library.encode("some words here")), 0] and right["over_limit"] == [False, False]
    vocab._LOADED.pop(("counts", path))
    monkeypatch.setattr(tokencount.UnitCounts, "ask", lambda self, unit: bytes(range(0, 2 * len(unit) + 4, 2)))
    wrong = tokencount.counted(batch, path, 4).to_pydict()
    assert wrong["n_tokens"] == [2 * len(" some words here"), 0] and wrong["over_limit"] == [True, False]
    vocab._LOADED.pop(("counts", path))


def test_long_words_and_many_tokens():
    path = tokencount.tokenizer_path(tokencount.MODEL)
    library = tokencount.unit_counts(path).library
    for text in ("q" * 3000, "\U0001f600" * 200, "x" * 63 + " " + "日" * 400):
        table = tokencount.PrefixCounts(text, path)
        assert [table.at(i) for i in range(0, len(text) + 1, 37)] == [len(library.encode(text[:i])) for i in range(0, len(text) + 1, 37)]


def test_orc_round_trip(spark, docs_of, library, tmp_path):
    sample = [None, "", "one two three", *texts(60, 4), "long text " * 9000]
    ids = [5 * (i % 40) for i in range(len(sample))]  # repeated ids
    out = str(tmp_path / "orc")
    df = docs_of(sample, ids)
    rows = sorted(tokenbin.token_file_digests(df, out).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(ids)
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
    want = sorted((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t in zip(ids, sample, strict=True) for x in [ids_of(library, t, 2)])
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    from pyarrow import orc

    files = sorted(str(p) for p in (tmp_path / "orc").iterdir() if p.suffix == ".orc")
    stored = [d for f in files for d in orc.read_table(f)["doc_id"].to_pylist()]
    assert stored == sorted(ids)
    assert {r["doc_id"] for r in tokenbin.lookup(spark, out, [10]).collect()} == {10}
    assert tokenbin.token_file_digests(df.limit(0), str(tmp_path / "none")).count() == 0


def test_packing(spark, docs_of, library):
    rng = random.Random(5)
    sample = [None, "", *[" ".join(["word"] * rng.randint(1, 900)) for _ in range(120)], "a b " * 3000, *["same text here"] * 40]
    rows = packing.pack(docs_of(sample)).collect()
    by_sequence, pieces = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        pieces[r["doc_id"], r["piece"]] = r
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    assert len(pieces) == len(rows)
    for i, t in enumerate(sample):
        x = ids_of(library, t, 0)
        for k in range(0, len(x), 2048):
            r, part = pieces[i, k // 2048], x[k : k + 2048]
            assert (r["start"], r["length"], r["ids_crc32"]) == (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert len(by_sequence) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack(docs_of(["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_the_histogram_up(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(257, np.int64)
    for n in rng.integers(1, 257, 40):
        hist[n] += rng.integers(0, 500)
    groups = packing.plan(hist, 256)
    used = np.zeros(257, np.int64)
    for p, c in groups:
        assert sum(p) <= 256 and c > 0
        for n in p:
            used[n] += c
    assert (used == hist).all()
    plain = sum(c for _, c in packing.best_fit(hist, 256))
    assert sum(c for _, c in groups) <= 1.02 * plain + 2

"""The pipeline's language stage, and all stages on tables with nulls, ties and no rows."""

import os

import pytest
import regex

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
BENCHMARK = "item_id long, text string"


def test_language_stage(spark):
    import corpus_pipeline as cp
    from graphloom.llm import langid

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, "12 34 !!", "en", "s", 8), (9002, None, "en", "s", 0), (9003, "", None, None, 0)], docs.schema)
    both = docs.unionByName(odd)
    rows = {r["doc_id"]: r for r in both.collect()}
    kept = {r["doc_id"]: r for r in cp.identify_language(spark, both, SF).collect()}
    assert all(kept[i] == rows[i] for i in kept)  # rows stay as they are
    lettered = {i for i, r in rows.items() if r["text"] and regex.search(r"\p{L}", r["text"])}
    assert set(kept) <= lettered and len(kept) >= 0.98 * len(lettered)
    found = {r["doc_id"]: r for r in langid.identify(both, langid.train(both)).collect()}
    assert set(kept) == {i for i, r in found.items() if r["lang_pred"] != "und" and not r["ambiguous"]}
    assert sum(found[i]["lang_pred"] == rows[i]["lang"] for i in kept) >= 0.98 * len(kept)


def test_nulls_ties_and_no_rows(spark, tmp_path, words):
    import corpus_pipeline as cp

    spark.createDataFrame([(1, words(30, 5)), (2, None), (3, "")], BENCHMARK).write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    texts = [words(120, i) for i in range(12)]
    texts += [texts[0], texts[0], None, "", words(60, 77) + " " + words(30, 5) + " " + words(60, 78), "a", texts[3] + " " + words(80, 90)]
    rows = [(i, t, "en" if i % 3 else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    for given in ([*rows, (4, texts[4], "en", "s", 9), (5, words(100, 444), None, None, None)], []):
        docs = spark.createDataFrame(given, schema)
        for k, (_, stage) in enumerate(cp.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if k < len(cp.STAGES) - 1:
                assert docs.columns == schema.names
                docs = spark.createDataFrame(docs.collect(), schema)
        packed = docs.collect()
        ids = {r["doc_id"] for r in packed}
        assert not ids & {12, 13, 14, 15, 16} and (not given) == (not ids)

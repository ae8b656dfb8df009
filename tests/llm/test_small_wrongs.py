import numpy as np
import pytest

from graphloom.llm import chat, common, langid, urlfilter, vocab


def test_ties_go_by_plain_text(spark):
    """Escaped, ``a<`` would come after ``aA``; null turns come first."""
    rows = [(1, 0, "user", "aA"), (1, 0, "user", "a<"), (1, None, "user", "z"), (2, 0, "a#", "x"), (2, 0, "aA", "x")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.parse_conversations(out).collect()}
    assert got == {1: [("user", "z"), ("user", "a<"), ("user", "aA")], 2: [("a#", "x"), ("aA", "x")]}


def test_training_rows_do_not_depend_on_the_layout(spark):
    rows = [(i % 40, f"text number {i} of many", "aa" if i % 3 else "bb") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = [[(r["text"], r["lang"]) for r in langid.training_rows(d, 20, langid.held_out_rows())] for d in (df, df.repartition(7), df.orderBy("text").coalesce(1))]
    assert drawn[0] == drawn[1] == drawn[2] and len(drawn[0]) == 40


def test_doubt_weighs_errors_against_right_predictions():
    doubt = lambda gaps, right: langid.doubt_of(np.array(gaps, float), np.array(right, bool))
    assert doubt([0.1, 0.2, 0.3], [1, 1, 1]) == 0 and doubt([], []) == 0
    assert doubt([0.3, 0.1, 0.2, 0.4], [1, 0, 0, 0]) == 0.2
    assert doubt([0.1, 0.1, 0.2, 0.3], [0, 1, 1, 1]) == 0  # equal gaps are flagged together
    assert doubt([0.1, 0.1, 0.1], [0, 0, 1]) == 0.1


def test_tries_of_other_rules_are_not_taken(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x")], "page_id long, url string").coalesce(1)
    for k in range(6):  # the same worker, new lists that may stand where the old ones were
        verdict = "block" if k % 2 else "allow"
        assert urlfilter.judge_urls(pages, [(verdict, "a.b", "/")]).first()["verdict"] == verdict


def test_long_rule_lists_go_in_blocks_by_characters(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_RULE_CHARS", 12)
    rules = [("block", "a.b", "/x"), ("allow", "a.b", "/x/longer"), ("block", "c.b", "/" + "y" * 40)]
    assert [len(b) for b in urlfilter._blocks(rules)] == [1, 1, 1]
    pages = spark.createDataFrame([(1, "http://a.b/x/longer/z"), (2, "http://a.b/x"), (3, "http://c.b/" + "y" * 41)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urlfilter.judge_urls(pages, rules).collect()} == {1: "allow", 2: "block", 3: "block"}


def test_other_tokenizer_files_encode_whole_texts():
    from tokenizers import Tokenizer

    assert vocab.word_ids(vocab.tokenizer_path("word_bpe_49k.json")).by_word
    path = vocab.tokenizer_path("byte_bpe_50k.json")
    memory, library = vocab.WordIds(path), Tokenizer.from_file(path)
    assert not memory.by_word
    for text in ("Two  spaces\nand UPPER case", "", "it's <|endoftext|> é日"):
        assert np.frombuffer(memory.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError):
        common.scratch_root(Session())


def test_settled_tables_leave_nothing_else(spark):
    mark = common.scratch_mark()
    first = common.materialize(spark.range(9), "first")
    out = common.settle(first.filter("id > 4"), "second", mark)
    assert out.count() == 4 and common.scratch_mark() == mark + 1
    with pytest.raises(Exception):
        spark.read.parquet(first.inputFiles()[0]).count()

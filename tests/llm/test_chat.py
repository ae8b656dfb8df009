import hashlib
import random

from graphloom.llm import chat


def digests(rows):
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(3)
    bits = ["\\", "\\\\", "#", "##", "### ", "<", "</turn>", "</turn>\n", "<|", "|>", ": ", ":", "é", "日", "\n", "x", "\\b", "\\l", "\\h", "\\c", "### assistant: ", "\U0001f600"]
    conversations = {}
    for c in range(60):
        conversations[c] = [(rng.choice(["user", "assistant", "sys: tem", "", "a:", "r\\c"]), "".join(rng.choices(bits, k=rng.randint(0, 12)))) for _ in range(rng.randint(1, 6))]
    rows = [(c, i, r, t) for c, ts in conversations.items() for i, (r, t) in enumerate(ts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    assert got == {c: digests(t) for c, t in conversations.items()}


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, 0, None, None, "x"), (1, 0, "user", "b", "y"), (1, 0, "user", "a", "y"), (1, 0, "user", "a", "y"), (None, None, "assistant", "z", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    assert (got[1]["n_turns"], got[1]["turns_sha256"]) == digests([("", ""), ("user", "a"), ("user", "a"), ("user", "b")])[:2]
    assert got[None]["loss_chars"] == 1
    assert chat.conversation_digests(chat.format_conversations(df.limit(0))).count() == 0


def test_typed_parts(spark):
    part = lambda kind=None, **kw: (kind, kw.get("text"), kw.get("ref"), kw.get("width"), kw.get("height"), kw.get("seconds"), kw.get("pages"))
    rows = [
        (1, 0, "user", [part("text", text="see <|image:9|> "), part("image", ref="a.png", width=29, height=56), part("text", text="<"), part("text", text="/turn>"), part("audio", ref="b.wav", seconds=1.5)]),
        (1, 1, "assistant", [part("text", text="ok")]),
        (1, 2, "user", [part("document", ref="c.pdf", pages=3), part("image", ref="d.png", width=28, height=28)]),
        (2, 0, "user", None),
    ]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("content", T.ArrayType(chat.PART))])
    out = chat.format_conversations(spark.createDataFrame(rows, schema), content="content")
    r = {x["conv_id"]: x for x in out.collect()}
    assert [(a["number"], a["kind"], a["ref"], a["tokens"]) for a in r[1]["attachments"]] == [(1, "image", "a.png", 4), (2, "audio", "b.wav", 38), (3, "document", "c.pdf", 1536), (4, "image", "d.png", 1)]
    assert r[1]["attachment_tokens"] == 4 + 38 + 1536 + 1 and r[2]["attachment_tokens"] == 0
    text = r[1]["formatted"]
    assert text.count("</turn>\n") == 3 and [text.index(f"<|{k}|>") for k in ("image:1", "audio:2", "document:3", "image:4")] == sorted(text.index(f"<|{k}|>") for k in ("image:1", "audio:2", "document:3", "image:4"))
    (span,) = r[1]["loss_spans"]
    assert text[span["start"] : span["start"] + span["length"]] == "ok"
    back = {x["conv_id"]: x["turns"] for x in chat.parse_conversations(out).collect()}
    assert back[1][0]["text"] == "see <|image:9|> <|image:1|></turn><|audio:2|>"


def test_long_conversation_places(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", "é" * (i % 7)) for i in range(200)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    text = out["formatted"]
    assert [text[s : s + 4] for s in out["turn_starts"]] == ["### "] * 200
    assert [text[s["start"] : s["start"] + s["length"]] for s in out["loss_spans"]] == ["é" * (i % 7) for i in range(1, 200, 2)]

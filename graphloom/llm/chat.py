"""Chat formatting with typed content parts, in DataFrame functions only.

A message's content is a list of typed parts. A visitor (one ``transform`` with a branch for each kind)
flattens it into text with ordered placeholders: a text part is itself, escaped; an image, audio or document
part is ``<|kind:k|>`` with k counting the conversation's attachments from 1. Each attachment is recorded with
its reference and the tokens its placeholder stands for after expansion.

The template of a turn is ``### role: content</turn>\\n``. Inside roles and texts each backslash, ``<`` and ``#``
(in roles also the colon) becomes a backslash and a letter, so no control string survives, wherever parts meet,
and putting the characters back gives the text.

Defined results: null text or role counts as empty; a null content list has no parts; turns are ordered by turn
(nulls first), then role and text, so ties and repeated rows have one order; null conv_id is a conversation of
its own; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # text, image, audio or document
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.IntegerType()),
    ]
)

#: Pixels of a patch's side, tokens a second of sound, tokens a page: what a placeholder expands to.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
END = "</turn>\n"


def text_part(text: Column) -> Column:
    """A plain text as a content list of one text part."""
    null = lambda t: F.lit(None).cast(t)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.alias("text"), null("string").alias("ref"), null("int").alias("width"),
            null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages"),
        )
    )


#: What stands for the characters that control strings begin with; the backslash comes first on the way in, last back.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
COLON = (":", "\\c")


def escape(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    for plain, safe in ESCAPES:
        t = F.replace(t, F.lit(plain), F.lit(safe))
    return t


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(COLON[0]), F.lit(COLON[1]))


def unescape(text: Column) -> Column:
    for plain, safe in (COLON, *reversed(ESCAPES)):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _is_text(p: Column) -> Column:
    return p["kind"].isNull() | (p["kind"] == "text")


def _tokens(p: Column) -> Column:
    side = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / F.lit(float(IMAGE_PATCH)))
    return (
        F.when(p["kind"] == "image", side(p["width"]) * side(p["height"]))
        .when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def format_conversations(messages: DataFrame, content: str | None = None) -> DataFrame:
    """One row per conversation: ``formatted``, ``turn_starts`` and ``loss_spans`` (code points from 0 in
    ``formatted``; a span covers an assistant's content), ``attachments`` in order of their placeholders, and
    ``attachment_tokens``, the expanded count. ``messages`` has conv_id, turn, role and text, or with ``content``
    a column of PART lists instead of text. A conversation's rows are gathered once, as they must be for one
    string, put in order by their plain texts, then escaped."""
    parts = F.coalesce(F.col(content), F.array().cast(T.ArrayType(PART))) if content else text_part(F.col("text"))
    rows = messages.select(
        "conv_id",
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.filter(parts, lambda p: p.isNotNull()).alias("parts"),
    )
    visited = rows.select(
        "conv_id", "turn", "role",
        # Each part: its text, or null where a numbered placeholder goes once the order is known.
        F.transform("parts", lambda p: F.struct(
            F.when(_is_text(p), F.coalesce(p["text"], F.lit(""))).alias("text"),
            F.when(_is_text(p), F.lit(None)).otherwise(p["kind"]).alias("kind"),
            p["ref"].alias("ref"), _tokens(p).alias("tokens"))).alias("parts"),
    )
    order = F.struct("turn", "role", "parts")  # plain texts: escaped ones would sort otherwise
    turns = (
        visited.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(order)).alias("turns"))
        .withColumn("found", F.filter(F.flatten(F.col("turns.parts")), lambda p: p["kind"].isNotNull()))
        .withColumn("before", F.transform("turns", lambda t: F.size(F.filter(t["parts"], lambda p: p["kind"].isNotNull()))))
    )

    # The first attachment number of each turn: sums of the counts before it. Only conversations with attachments need it.
    def running(counts: Column, zero: Column, value) -> Column:
        start = F.struct(F.array().cast("array<long>").alias("at"), zero.alias("sum"))
        return F.aggregate(
            counts, start, lambda a, c: F.struct(F.concat(a["at"], F.array(a["sum"])).alias("at"), (a["sum"] + value(c)).alias("sum")), lambda a: a["at"]
        )

    def flatten_parts(t: Column, first: Column) -> Column:
        plain = escape(F.array_join(F.transform(t["parts"], lambda p: p["text"]), ""))
        numbered = F.aggregate(
            t["parts"],
            F.struct(F.lit("").alias("s"), first.cast("long").alias("k")),
            lambda a, p: F.struct(
                F.concat(a["s"], F.when(p["kind"].isNull(), escape(p["text"])).otherwise(F.concat(F.lit("<|"), p["kind"], F.lit(":"), (a["k"] + 1).cast("string"), F.lit("|>")))).alias("s"),
                (a["k"] + p["kind"].isNotNull().cast("long")).alias("k"),
            ),
            lambda a: a["s"],
        )
        return F.when(F.exists(t["parts"], lambda p: p["kind"].isNotNull()), numbered).otherwise(plain)

    firsts = F.when(F.size("found") > 0, running(F.col("before"), F.lit(0).cast("long"), lambda c: c.cast("long")))
    with_text = turns.withColumn("firsts", firsts).withColumn(
        "flat",
        F.transform(
            "turns",
            lambda t, i: F.struct(
                t["role"].alias("role"),
                F.concat(F.lit("### "), escape_role(t["role"]), F.lit(": ")).alias("head"),
                flatten_parts(t, F.coalesce(F.get(F.col("firsts"), i), F.lit(0))).alias("body"),
            ),
        ),
    )
    sized = with_text.withColumn("sizes", F.transform("flat", lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END)))
    placed = sized.withColumn("turn_starts", prefix_sums(F.col("sizes")))
    return placed.select(
        "conv_id",
        F.concat_ws("", F.transform("flat", lambda t: F.concat(t["head"], t["body"], F.lit(END)))).alias("formatted"),
        "turn_starts",
        F.filter(
            F.transform(
                "flat",
                lambda t, i: F.struct(
                    i.cast("long").alias("turn_no"),
                    (F.get(F.col("turn_starts"), i) + F.length(t["head"])).alias("start"),
                    F.length(t["body"]).cast("long").alias("length"),
                    (t["role"] == "assistant").alias("in_loss"),
                ),
            ),
            lambda s: s["in_loss"],
        ).alias("loss_spans"),
        F.transform(
            "found",
            lambda p, i: F.struct((i + 1).alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")),
        ).alias("attachments"),
        F.aggregate("found", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("attachment_tokens"),
    )


def prefix_sums(sizes: Column, block: int = 64) -> Column:
    """Sum of the entries before each entry. Sums of whole blocks first, so an entry adds at most a block's
    entries and the blocks before it, not all entries before it."""
    n_blocks = F.ceil(F.size(sizes) / F.lit(block)).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    blocks = F.when(n_blocks > 0, F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: total(F.slice(sizes, b * block + 1, F.lit(block)))))
    starts = F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b)))
    within = F.transform(
        starts,
        lambda s, b: F.transform(
            F.slice(sizes, b * block + 1, F.lit(block)), lambda _, j: s + total(F.slice(sizes, b * block + 1, j))
        ),
    )
    return F.coalesce(F.flatten(within), F.array().cast("array<bigint>"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: ``turns`` of role and text (unescaped, placeholders as they stand), and
    ``loss_text``, what the loss mask covers, unescaped and joined."""
    pieces = F.split("formatted", END)
    segments = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    cut = formatted.withColumn("segments", segments)
    turns = F.transform(
        "segments",
        lambda s: F.struct(
            unescape(F.substring(s, F.lit(5), F.position(F.lit(": "), s) - 5)).alias("role"),
            unescape(F.substring(s, F.position(F.lit(": "), s) + 2, F.length(s))).alias("text"),
        ),
    )
    # A span lies inside its turn: cut it from that turn's segment, not from the whole string.
    loss = F.transform(
        "loss_spans",
        lambda p: unescape(
            F.substring(
                F.get(F.col("segments"), p["turn_no"].cast("int")),
                (p["start"] - F.get(F.col("turn_starts"), p["turn_no"].cast("int")) + 1).cast("int"),
                p["length"].cast("int"),
            )
        ),
    )
    return cut.select("conv_id", "formatted", turns.alias("turns"), F.concat_ws("", loss).alias("loss_text"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """The contract's digests, all from the formatted strings and masks."""
    read = parse_conversations(formatted)
    plain = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(plain, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("loss_text"), "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation every run adds: its texts hold the template's own control strings.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def with_probe(messages: DataFrame) -> DataFrame:
    s = messages.sparkSession
    probe = s.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    return messages.select("conv_id", "turn", "role", "text").unionByName(probe)

# The escaped lengths: each backslash, < and # adds a character (in roles the colon too); a turn adds "### ", ": " and
# "</turn>\n", 14 characters.
ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 14 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS chars FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

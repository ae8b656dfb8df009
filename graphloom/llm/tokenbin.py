"""Token ids in ORC files: runs of integers, row indexes and Bloom filters on the document id.

``write_tokens`` lays rows out by ranges of document id, sorts each range and writes one ORC file for it: ids are
a list column in ORC's run-length encoding, a row index every ``INDEX_ROWS`` rows and a Bloom filter on doc_id let
a reader skip stripes and row groups, and stripes can be read side by side. Rows are dealt out before they are
encoded, so texts move once and ids never do.

``read_tokens`` reads the files back and ``with_starts`` adds each document's global start: per-file totals are summed
in the files' order (one row a file), and a running sum within each file does the rest. ``lookup`` reads some
documents by id, for which the filter is pushed into the files.

Defined results: a null text counts as empty, so it has the end id alone; repeated doc_ids keep the order of their
texts' hashes (equal rows are interchangeable) and a null doc_id comes first; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import column, map_batches, materialize, scratch_path, small_batches
from graphloom.llm.vocab import tokenizer_path, word_ids

TOKENIZER, END_ID = "word_bpe_49k.json", 2
STRIPE_BYTES, INDEX_ROWS, BLOOM_FPP = 32 << 20, 1000, 0.01
#: Texts of about this many bytes go into one file, until there are so many files; they grow beyond.
FILE_TEXT_BYTES, MAX_FILES = 32 << 20, 50_000


def id_lists(ids: list[bytes], end: int) -> pa.Array:
    """A list column from little-endian ids, each with the end id behind it."""
    tail = end.to_bytes(4, "little")
    flat = np.frombuffer(b"".join(x + tail for x in ids), "<i4")
    bounds = np.cumsum([0] + [len(x) // 4 + 1 for x in ids])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))


def encode_rows(docs: DataFrame, path: str, end: int = END_ID) -> DataFrame:
    """doc_id, tie and ids (with the end id) in the rows' order."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        memory = word_ids(path)
        ids = [memory.encode(t) for t in column(batch, "text").to_pylist()]
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "tie"), id_lists(ids, end)], names=["doc_id", "tie", "ids"])

    return map_batches(docs, encode, "doc_id long, tie long, ids array<int>")


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end: int = END_ID, files: int | None = None) -> None:
    """Encode every text of ``docs`` and write the ids to ORC files under ``out``, in ascending doc_id order."""
    small_batches(docs.sparkSession)
    if files is None:
        chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, min(MAX_FILES, -(-chars // FILE_TEXT_BYTES)), docs.sparkSession.sparkContext.defaultParallelism)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(int(files), "doc_id", "tie")
    writer = encode_rows(rows.sortWithinPartitions("doc_id", "tie"), path or tokenizer_path(TOKENIZER), end).write
    options = {
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": BLOOM_FPP, "orc.create.index": "true", "orc.row.index.stride": INDEX_ROWS,
        "orc.stripe.size": STRIPE_BYTES, "compression": "zstd",
    }
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.orc(out)


def _crcs(ids: pa.Array) -> list[int]:
    """Unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    values = np.asarray(ids.values if ids.offset == 0 else ids.flatten())
    if sys.byteorder != "little":
        values = values.astype("<i4")
    bounds = np.asarray(ids.offsets) - (0 if ids.offset == 0 else ids.offsets[0].as_py())
    view = memoryview(np.ascontiguousarray(values)).cast("B")
    return [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """file, doc_id, n_tokens and ids_crc32 of each stored document; ``with_starts`` adds the starts."""
    small_batches(spark)
    stored = spark.read.schema("doc_id long, tie long, ids array<int>").orc(out).select("doc_id", "tie", "ids", F.col("_metadata.file_name").alias("file"))

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = column(batch, "ids")
        n = [b - a for a, b in zip(ids.offsets.to_pylist()[:-1], ids.offsets.to_pylist()[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [column(batch, "file"), column(batch, "doc_id"), column(batch, "tie"), pa.array(n, pa.int64()), pa.array(_crcs(ids), pa.int64())], names=["file", "doc_id", "tie", "n_tokens", "ids_crc32"]
        )

    return map_batches(stored, digest, "file string, doc_id long, tie long, n_tokens long, ids_crc32 long")


def with_starts(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Global starts for ``read_tokens`` rows."""
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min(F.struct("doc_id", "tie")).alias("first"))  # a row a file
    base = totals.select("file", (F.sum("total").over(Window.orderBy("first", "file")) - F.col("total")).alias("base"))
    within = Window.partitionBy("file").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0).cast("long")))
    return placed.join(base, "file").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, out: str, doc_ids: list[int]) -> DataFrame:
    """Ids of a few documents; ORC's row index and Bloom filter skip the rest."""
    return spark.read.schema("doc_id long, ids array<int>").orc(out).filter(F.col("doc_id").isin(doc_ids))


def token_file_digests(docs: DataFrame, out: str | None = None) -> DataFrame:
    """Write the token files for ``docs`` and digest what is read back from them."""
    spark = docs.sparkSession
    out = out or scratch_path(spark, "tokens-orc")
    write_tokens(docs, out)
    # Two plans read these rows (totals and running sums): keep the few columns, not the ids, between them.
    return with_starts(spark, materialize(read_tokens(spark, out), "tokens-digest"))

"""What the operators of this subpackage share: scratch tables, Arrow batches, hashes of words.

Scratch tables are Parquet in the shared folder of ``spark.checkpoint.dir``, so they outlive any
executor; where that setting is missing in local mode (tests), a temporary folder is set once per session.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import ship

#: Rows and bytes a batch handed to Python holds at most (one longer row makes a batch of its own).
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: A side is broadcast only if its counted rows, times the bytes a row takes there, stay below this.
BROADCAST_BYTES = 48 << 20
#: A key is hot from this many rows on, or from so many that no more than HOT_KEYS keys can be (about 64 bytes each, broadcast).
HOT_ROWS, HOT_KEYS = 10_000, 500_000

U64 = np.uint64


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``. Where that is unset, a temporary folder in local
    mode, an error on a cluster: its executors and driver share no temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table; results that are still lazy can't be computed after that."""
    _delete(spark, f"{scratch_root(spark)}/graphloom")
    _WRITTEN.clear()


#: Scratch tables that this driver wrote and has not dropped, in order.
_WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """How many scratch tables there are so far, for ``settle``."""
    return len(_WRITTEN)


def settle(df: DataFrame, name: str, mark: int) -> DataFrame:
    """``materialize``, and drop the scratch tables written since ``mark``, which only ``df`` was made of."""
    out = materialize(df, name)
    for path in _WRITTEN[mark:-1]:
        _delete(df.sparkSession, path)
    del _WRITTEN[mark:-1]
    return out


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Long texts: fewer rows in each Arrow batch, so that a Python worker's memory stays bounded. The same for all operators, as
    the session has one setting and plans are lazy."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))  # rows that a scan holds decoded


def semi_by_id(rows: DataFrame, ids: DataFrame, on: list[str], row_bytes: int = 64) -> DataFrame:
    """``rows`` with a match in ``ids`` (a materialised, distinct table). ``ids`` is counted: broadcast below
    BROADCAST_BYTES, else a shuffled semi join."""
    small = ids.count() * row_bytes <= BROADCAST_BYTES
    return rows.join(F.broadcast(ids) if small else ids, on, "left_semi")


def hinted(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (materialised) marked for broadcast if its counted size allows it, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """``rows`` with the row of ``groups`` of their ``key``. ``groups`` (materialised) has one short row a key, and in ``n`` how many
    of ``rows`` the key has. Rows of hot keys are not shuffled: what ``groups`` says of those, at most HOT_KEYS rows, is broadcast."""
    total = groups.agg(F.sum(n).alias("n")).first()["n"] or 0
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = groups.filter(F.col(n) >= least)
    if hot.isEmpty():
        return rows.join(groups, key, how)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(F.col(n) < least), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over each Arrow batch; no rows are held between batches."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


# ---- hashes of words -------------------------------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_PLACE = _rng.integers(1, 2**63, 1 << 12, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_STEP = U64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _hash_piece(arr: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~_SPACE[arr]
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, U64), starts
    sizes = ends - starts
    at = np.arange(len(arr), dtype=np.int64)
    at -= np.repeat(starts, np.diff(np.concatenate(([0], starts[1:], [len(arr)]))))  # white space before the first word too
    values = table[arr] * _PLACE[at & 0xFFF]
    values[~word] = 0
    sums = np.add.reduceat(values, starts)
    if sizes.max() > 0x1000:  # places repeat in very long words: hash such a word's pieces in order
        for i in np.flatnonzero(sizes > 0x1000):
            h, piece = U64(0), arr[starts[i] : ends[i]]
            for j in range(0, len(piece), 0x1000):
                part = table[piece[j : j + 0x1000]] * _PLACE[: len(piece[j : j + 0x1000])]
                h = mix64(np.array([h], U64) * _STEP + part.sum(dtype=U64))[0]
            sums[i] = h
    return mix64(sums + sizes.astype(U64) * _STEP), starts


def word_hashes(texts: list[bytes], lower: bool = False, piece: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, one after another, and for each text the
    index of its first word (one more entry than texts). Works through pieces of about ``piece`` bytes, cut
    between texts or, in a longer text, at white space; ``lower`` folds A-Z."""
    table = _BYTE_LOWER if lower else _BYTE
    hashes, counts, group, held = [], np.zeros(len(texts) + 1, np.int64), [], 0

    def flush() -> None:
        nonlocal group, held
        if group:
            data = b"\n".join(t for _, t in group)
            h, starts = _hash_piece(np.frombuffer(data, np.uint8), table)
            bounds = np.cumsum([0] + [len(t) + 1 for _, t in group])
            per = np.diff(np.searchsorted(starts, bounds))
            np.add.at(counts, np.array([i for i, _ in group]) + 1, per)
            hashes.append(h)
        group, held = [], 0

    for i, text in enumerate(texts):
        if len(text) <= piece:
            group.append((i, text))
            held += len(text)
            if held >= piece:
                flush()
            continue
        flush()
        at = 0
        while at < len(text):
            end = min(len(text), at + piece)
            if end < len(text):
                cut = max(text.rfind(bytes([c]), at, end) for c in (32, 10, 9, 13, 11, 12))
                if cut <= at:  # one word longer than a piece: up to its end
                    nexts = [p for c in (32, 10, 9, 13, 11, 12) if (p := text.find(bytes([c]), end)) >= 0]
                    cut = min(nexts, default=len(text))
                end = cut
            group.append((i, text[at:end]))
            flush()
            at = end + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, U64)), np.cumsum(counts)


def encoded(texts: list[str | None]) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


_ODD = (U64(0x9FB21C651E98DF25), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words (one entry fewer than words for each word beyond the first)."""
    if len(words) < n:
        return np.empty(0, U64)
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = out * _ODD[i & 3] + words[i : len(words) - n + 1 + i]
        out ^= out >> U64(29)
    return mix64(out)

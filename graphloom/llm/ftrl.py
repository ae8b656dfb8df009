"""A quality classifier: logistic regression on hashed word n-grams, learned by follow-the-regularised-leader updates.

Words are runs of letters, digits and everything beyond ASCII, in lower case, or runs of other signs. Each word n-gram up to ``GRAMS`` words,
and each n-gram of the words' forms (lower, capital or upper case, digits, which sign; whether one of the ``BACK`` words before is the
same), is a feature: its hash tells the bucket, of ``DIM``. A bucket's value is the square root of its count, and a text's vector has unit length. A score is the logistic
function of the sparse dot product with the weights.

Learning takes a bounded sample: at most ``sample`` labelled rows, the first by a hash of id and text, which is a total order, so neither
file layout nor retried tasks change it. Their sparse vectors, made in tasks from whole texts, reach the driver, which goes through them
``epochs`` times in that order with one update per row: the per-coordinate steps and the L1 and L2 terms of FTRL-proximal.
Predictions read whole texts, in pieces of bounded size; counts and statistics of the corpus are not used.

Defined results: a null text or one without a word has the score of the bias alone; without labels of both kinds every
score is their share of good ones, one half without any; rows with a null doc_id are never learned from; a doc_id with labels of
both kinds is learned with each; repeated rows are scored one by one; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import U64, column, encoded, gram_hashes, map_batches, mix64, small_batches

BITS, GRAMS, BACK, SAMPLE, EPOCHS, CUT = 18, 2, 4, 6_000, 4, 0.3
DIM = 1 << BITS
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 18

_rng = np.random.default_rng(20250307)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_VALUE[65:91] = _VALUE[97:123]
_PLACE = _rng.integers(1, 2**63, 1 << 8, dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: 0: white space, 1: part of a word, 2: other signs.
_CLASS = np.array([0 if b in b" \t\n\v\f\r" else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.int8)
_UPPER, _DIGIT = (np.array([x(chr(b)) and b < 128 for b in range(256)]) for x in (str.isupper, str.isdigit))


def words_and_forms(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, and numbers of their forms (of words of letters and digits below 16)."""
    kind = _CLASS[data]
    starts = np.flatnonzero((kind > 0) & (np.diff(kind, prepend=np.int8(0)) != 0))
    if not len(starts):
        return np.empty(0, U64), np.empty(0, np.int64)
    at = np.arange(len(data)) - np.repeat(np.concatenate(([0], starts[1:])), np.diff(np.concatenate(([0], starts[1:], [len(data)]))))
    value = _VALUE[data] * _PLACE[at & 0xFF]
    value[kind == 0] = 0
    count = lambda flags: np.add.reduceat(flags.astype(np.int64), starts)
    size, upper, digits = count(kind > 0), count(_UPPER[data]), count(_DIGIT[data])
    signs = kind[starts] == 2
    case = np.where(upper == 0, 1, np.where(upper == size, 2, np.where((upper == 1) & _UPPER[data[starts]], 3, 4)))
    form = np.where(signs, 16 + data[starts].astype(np.int64) * 4 + np.minimum(size, 3), np.where(digits > 0, 8 + (digits == size), case))
    return mix64(np.add.reduceat(value, starts)), form


def vector(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in order and their values, of one text."""
    hashed = []
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):  # cut at a space, or, in a longer word, anywhere
            end = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end)) + 1 or end
        hashed.append(words_and_forms(np.frombuffer(text[at:end], np.uint8)))
        at = end
    if not hashed:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    words, forms = (np.concatenate([h[i] for h in hashed]) for i in (0, 1))
    seen = np.zeros(len(words), bool)
    for k in range(1, BACK + 1):
        seen[k:] |= words[k:] == words[:-k]
    forms = mix64((forms * 2 + (seen & (forms < 16))).astype(U64) + U64(0x51ED270B))
    grams = [words, forms]
    for n in range(2, GRAMS + 1):
        grams += [gram_hashes(words, n), gram_hashes(forms, n) ^ U64(n)]
    bucket, times = np.unique(np.concatenate(grams) >> U64(64 - BITS), return_counts=True)
    value = np.sqrt(times.astype(np.float32))
    return bucket.astype(np.int32), value / np.linalg.norm(value) if len(value) else value


@dataclass
class Weights:
    """Of every bucket, and the bias."""

    bucket: np.ndarray
    bias: float

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probabilities of label 1: sparse dot products, all rows at once."""
        sizes = np.array([len(v) for _, v in vectors], np.int64)
        row = np.repeat(np.arange(len(vectors)), sizes)
        at, value = (np.concatenate([v[i] for v in vectors]) if len(vectors) else np.empty(0, np.int64) for i in (0, 1))
        margin = np.bincount(row, self.bucket[at] * value, len(vectors)) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


class Leader:
    """FTRL-proximal: for each coordinate the sum of gradients, less what past weights explain (z), and the sum of their squares (n)."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 2e-2, l2: float = 1e-3) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def weight(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def update(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        """One row; the last of ``at`` is the bias."""
        w = self.weight(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, **options: float) -> Weights:
    """Weights from (buckets, values, label) rows, in order."""
    labels = {y for *_, y in rows}
    if len(labels) < 2:
        return Weights(np.zeros(DIM), 35.0 * (2 * labels.pop() - 1) if labels else 0.0)
    leader = Leader(**options)
    ready = [(np.append(at, DIM).astype(np.int64), np.append(value, 1.0).astype(float), float(y)) for at, value, y in rows]
    for _ in range(epochs):
        for row in ready:
            leader.update(*row)
    every = leader.weight(np.arange(DIM + 1))
    return Weights(every[:DIM], float(every[DIM]))


def held_out_rows() -> Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, held_out: Column) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Vectors and labels of at most ``sample`` rows, by a hash of id and text."""
    small_batches(docs.sparkSession)
    plain = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out)
    plain = plain.select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    order = F.xxhash64(F.lit(13), "doc_id")
    chosen = F.broadcast(plain.orderBy(order, "doc_id", "label").limit(sample))  # ``sample`` rows at most
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").withColumn("key", F.xxhash64(F.lit(13), "doc_id", "text"))

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [vector(t) for t in encoded(column(batch, "text").to_pylist())]
        cells = [pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32()))]
        return pa.RecordBatch.from_arrays([column(batch, "key"), column(batch, "doc_id"), column(batch, "label"), *cells], names=["key", "doc_id", "label", "at", "value"])

    first = rows.select("key", "doc_id", "label", "text")
    vectors = map_batches(first, build, "key long, doc_id long, label int, at array<int>, value array<float>")
    found = vectors.orderBy("key", "doc_id", "label", "at").limit(sample).toArrow()
    at, value, label = (found[c].combine_chunks() if found.num_rows else [] for c in ("at", "value", "label"))
    return [(at[i].values.to_numpy(), value[i].values.to_numpy(), label[i].as_py()) for i in range(found.num_rows)]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, held_out: Column | None = None) -> Weights:
    """Learn from the labelled rows that are not held out."""
    return learn(training_rows(docs, labels, sample, held_out_rows() if held_out is None else held_out), epochs)


def score(docs: DataFrame, weights: Weights, cut: float = CUT) -> DataFrame:
    """doc_id, score and predicted (1 from ``cut`` on) of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # DIM numbers, whatever the corpus

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value.scores([vector(t) for t in encoded(column(batch, "text").to_pylist())])
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(found), pa.array((found >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return map_batches(docs.select("doc_id", "text"), judge, "doc_id long, score double, predicted int")


def score_all(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the labelled rows that are not held out, score every row."""
    return score(docs, train(docs, labels, sample)).select("doc_id", held_out_rows().alias("held_out"), "score", "predicted")


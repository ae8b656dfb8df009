"""Benchmark decontamination by latent semantic retrieval.

Texts fall into passages: two neighbouring blocks of ``BLOCK`` words, words in lower case without punctuation. A block is the
set of its words, so a word repeated next to an item does not hide it; a passage is the sum of its two blocks, weighted by the
inverse document frequencies of ``DIM`` signed hash buckets that stand for the vocabulary. The latent space is a randomised
singular value decomposition of this matrix A of all passages, in two passes over all texts:

1. Range: every passage is added with a random sign to one of ``ROWS`` columns, which is A' times a sparse random matrix. The
   document frequencies come from the same pass (they scale A's columns, so they can be applied to the sum). Q is an
   orthonormal basis of the result, rounded to 1 / ``STEP`` (any basis of the range will do).
2. Projection: every passage is projected on Q. The sum Z = A' A Q over all passages, with T = Q' Z, gives A' A as
   Z T^-1 Z' (which counts as a power iteration), and from it the singular vectors and values.

All sums are of integers, so neither file layout nor retried tasks change them; tasks' sums are added in two steps. The ``RANK`` first singular vectors are scaled by the inverse singular values, so that what all
texts share (function words, a language) does not hide what an item says. A third pass projects passages and takes those with a
cosine of at least ``COSINE`` to an item as candidates. And every run of ``MIN_ITEM`` words of an item that stands in
a text word for word makes its passage a candidate whatever the cosine, so verbatim copies are never lost.

A candidate is a leak if the longest common subsequence of the item's words and the words around the passage covers
``LCS`` of the item, or ``LCS_WITH_ANSWER`` of it while the item's last ``ANSWER`` words, its answer, are there to
``ANSWER_LCS``: a paraphrase that keeps the answer counts, shared phrases do not.

Sizes: sums and projection have fixed size. Items are broadcast in groups of ``ITEMS``, one scan each.

Defined results: null and empty texts leak nothing; items of fewer than ``MIN_ITEM`` words leak where
their words stand one after another anywhere in a text (cosine, LCS and answer 1), items without words nowhere; rows with a null doc_id are searched too; repeated rows are searched one by one (a pair of ids comes once); an
empty documents or benchmark table gives no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import U64, column, encoded, gram_hashes, map_batches, materialize, mix64, schema_of, small_batches, word_hashes
from graphloom.session import ship

BLOCK, DIM, ROWS, RANK, STEP = 24, 1024, 112, 96, 256.0
COSINE, LCS, LCS_WITH_ANSWER, ANSWER, ANSWER_LCS = 0.28, 0.7, 0.6, 8, 0.85
MIN_ITEM, ITEMS = 8, 1000
#: Rows that a task's sums travel in, and groups of tasks that are added first.
LINES, SALTS = 16, 256
#: Passages that are projected at once, and words around candidates that are compared at once.
PASSAGES, WINDOW_WORDS = 2048, 500_000

_PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def plain_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words in lower case without ASCII punctuation, and where each text's begin."""
    return word_hashes([t.translate(_PLAIN) for t in encoded([None if t is None else t.lower() for t in texts])])


def buckets(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mixed = mix64(words ^ U64(0x2545F4914F6CDD1D))
    return (mixed % U64(DIM)).astype(np.int64), np.where(mixed >> U64(63), 1.0, -1.0)


def blocks_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block number of each word, the text of each block, and each block's number in its text."""
    n = np.diff(first)
    per = -(-n // BLOCK)
    start = np.concatenate(([0], np.cumsum(per)))
    text_no = np.repeat(np.arange(len(n)), per)
    place = np.arange(start[-1]) - start[text_no]
    word_text = np.repeat(np.arange(len(n)), n)
    return start[word_text] + (np.arange(first[-1]) - first[word_text]) // BLOCK, text_no, place


def entries(words: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, bucket and sign of each different bucket in each block, by block; the block's first word of a bucket gives the sign."""
    bucket, sign = buckets(words)
    at = np.unique(block * DIM + bucket, return_index=True)[1]
    return block[at], bucket[at], sign[at]


def _chunks(first: np.ndarray, words: int = 100_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many words."""
    a = 0
    for b in range(1, len(first)):
        if first[b] - first[a] >= words or b == len(first) - 1:
            yield a, b
            a = b


def projected(words: np.ndarray, block: np.ndarray, text_no: np.ndarray, space: np.ndarray) -> Iterator[tuple]:
    """(lo, hi, vectors of passages lo to hi, joins, and the matrix of blocks lo to hi + 1) for ranges of passages. ``joins`` are
    the passages, counted from lo, that have a second block."""
    for lo in range(0, len(text_no), PASSAGES):  # with one block more, for the last passage
        hi = min(len(text_no), lo + PASSAGES)
        end = min(len(text_no), hi + 1)
        x, y = np.searchsorted(block, [lo, end])
        own, bucket, sign = entries(words[x:y], block[x:y] - lo)
        matrix = np.zeros((end - lo, DIM), np.float32)
        matrix[own, bucket] = sign
        blocks = matrix @ space
        joins = np.flatnonzero(text_no[lo : end - 1] == text_no[lo + 1 : end])
        joins = joins[joins < hi - lo]
        passages = blocks[: hi - lo].copy()
        passages[joins] += blocks[joins + 1]
        yield lo, hi, passages, joins, matrix


def range_sums(words: np.ndarray, first: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of a batch of texts (``ids``: a hash each): A' times the random matrix before weighting (DIM x ROWS), blocks with each
    bucket, and the number of blocks, one after another."""
    block, text_no, place = blocks_of(first)
    key = mix64(mix64(ids[text_no].view(U64) + U64(1)) + place.astype(U64) * U64(0x9E3779B97F4A7C15))
    row, flip = (key % U64(ROWS)).astype(np.int64), np.where(key >> U64(63), 1.0, -1.0)
    own, bucket, sign = entries(words, block)
    total = np.bincount(bucket * ROWS + row[own], weights=sign * flip[own], minlength=ROWS * DIM)
    inner = place[own] > 0  # the passage that begins a block earlier has these words too
    before = own[inner] - 1
    total += np.bincount(bucket[inner] * ROWS + row[before], weights=sign[inner] * flip[before], minlength=ROWS * DIM)
    return np.concatenate([total, np.bincount(bucket, minlength=DIM), [len(text_no)]])


def projection_sums(words: np.ndarray, first: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Of a batch of texts: the passages' unweighted entries times their projections (DIM x ROWS). ``basis`` is weighted, in
    whole steps."""
    block, text_no, _ = blocks_of(first)
    z = np.zeros((DIM, ROWS))
    for _, _, passages, joins, matrix in projected(words, block, text_no, basis):
        weight = np.zeros((len(matrix), ROWS))
        weight[: len(passages)] = passages
        weight[joins + 1] += passages[joins]
        kind = np.float32 if np.abs(weight).sum(axis=0).max() < 1 << 24 else float  # sums stay exact
        z += matrix.astype(kind, copy=False).T @ weight.astype(kind, copy=False)
    return z.ravel()


def _summed(docs: DataFrame, size: int, batch_sums: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``batch_sums`` of words, texts' bounds and hashes, added over all texts of ``docs``."""
    small_batches(docs.sparkSession)
    ship(docs.sparkSession)
    cut = -(-size // LINES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(cut * LINES), False
        for batch in batches:
            words, first = plain_words(column(batch, "text").to_pylist())
            keys = np.asarray(column(batch, "key"))
            for a, b in _chunks(first):
                if first[b] > first[a]:
                    total[:size] += batch_sums(words[first[a] : first[b]], first[a : b + 1] - first[a], keys[a:b])
                    some = True
        if some:
            rows = [x.astype("<f8").tobytes() for x in total.reshape(LINES, cut)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(LINES, dtype=np.int32)), pa.array(rows, pa.binary())], names=["line", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return group.head(1).assign(sums=sum(np.frombuffer(x, "<f8") for x in group["sums"]).tobytes())

    keyed = docs.select("text", F.xxhash64("doc_id", "text").alias("key")).filter("text IS NOT NULL")
    parts = keyed.mapInArrow(sums, "line int, sums binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = parts.groupBy("line", "salt").applyInPandas(add, "line int, sums binary, salt int")
    found = some.groupBy("line").applyInPandas(add, "line int, sums binary, salt int").collect()  # LINES rows
    total = np.zeros((LINES, cut))
    for r in found:
        total[r["line"]] = np.frombuffer(r["sums"], "<f8")
    return total.ravel()[:size]


def weights_of(df: np.ndarray, n: float) -> np.ndarray:
    """Inverse document frequencies of the buckets."""
    return np.log((n + 1) / (df + 1)) + 1e-3


def basis_of(sums: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """DIM x ROWS: a basis of the range, weighted, in whole steps."""
    return np.rint(np.linalg.qr(sums.reshape(DIM, ROWS) * idf[:, None])[0] * idf[:, None] * STEP).astype(np.float32)


def decomposed(z: np.ndarray, basis: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The RANK first right singular vectors of A (DIM x RANK) and its singular values, from A' A Q before weighting, in steps,
    and the weighted basis."""
    z = z.reshape(DIM, ROWS)
    z, t = z * idf[:, None] / STEP, basis.astype(float).T @ z / STEP**2
    values, vectors = np.linalg.eigh((t + t.T) / 2)
    held = values > 1e-9 * max(values[-1], 1e-300)
    root = vectors[:, held] / np.sqrt(values[held])
    u, s, _ = np.linalg.svd(z @ root, full_matrices=False)
    return u[:, :RANK], s[:RANK]


def latent_space(docs: DataFrame) -> np.ndarray:
    """DIM x RANK: weights of buckets and scaled singular vectors of all passages of ``docs``."""
    found = _summed(docs, DIM * ROWS + DIM + 1, range_sums)
    n = found[-1]
    if not n:
        return np.zeros((DIM, RANK), np.float32)
    idf = weights_of(found[-1 - DIM : -1], n)
    basis = basis_of(found[: DIM * ROWS], idf)
    shared = docs.sparkSession.sparkContext.broadcast(basis)  # DIM x ROWS
    z = _summed(docs, DIM * ROWS, lambda words, first, _: projection_sums(words, first, shared.value))
    return scaled(*decomposed(z, basis, idf), idf)


def scaled(vectors: np.ndarray, values: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights and vectors in one, so that all kept directions count alike; those with next to nothing in them are left out."""
    out = np.zeros((DIM, RANK), np.float32)
    held = values > 1e-3 * max(values.max(initial=0.0), 1e-300)
    out[:, : len(values)][:, held] = idf[:, None] * vectors[:, held] / values[held]
    return out


def lcs_length(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Longest common subsequence of ``words`` and a sequence of ``size`` words given as word -> bits of its places."""
    state = full = (1 << size) - 1
    for w in words:
        if m := masks.get(w):
            both = state & m
            state = ((state + both) | (state - both)) & full
    return size - state.bit_count()


@dataclass
class Items:
    """Benchmark items ready for search."""

    ids: list[int | None]
    sizes: list[int]
    masks: list[dict[int, int]]
    answers: list[tuple[dict[int, int], int]]
    vectors: np.ndarray
    space: np.ndarray
    vocabulary: np.ndarray  # all items' words, sorted
    has: np.ndarray  # items x (vocabulary and one column for other words): whether the item has the word
    runs: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> sorted hashes of the items' runs of so many words, the item of each

    def __post_init__(self) -> None:
        bits = (16 * len(self.vocabulary)).bit_length()
        self.shift = U64(64 - max(1, bits))
        slots = self.vocabulary >> self.shift
        self.starts = np.searchsorted(slots, np.arange(1 << max(1, bits), dtype=U64)).astype(np.int32)  # the first word by its first bits
        self.deepest = int(np.unique(slots, return_counts=True)[1].max(initial=0))
        self.padded = np.append(self.vocabulary, ~U64(0))

    def known(self, words: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary, or its length."""
        at = self.starts[words >> self.shift]
        for _ in range(self.deepest):
            at = at + (self.padded[at] < words)
        return np.where(self.padded[at] == words, at, len(self.vocabulary))

    @classmethod
    def build(cls, rows: list, space: np.ndarray) -> Items:
        words, first = plain_words([r["text"] for r in rows])
        ids, sizes, masks, answers, vectors, runs, short = [], [], [], [], [], {}, []
        for r, a, b in zip(rows, first[:-1].tolist(), first[1:].tolist(), strict=True):
            own = words[a:b].tolist()
            if len(own) < MIN_ITEM:
                short += [(r["item_id"], words[a:b])] if own else []
                continue
            tail = own[-ANSWER:]
            ids.append(r["item_id"])
            sizes.append(len(own))
            masks.append(_masks(own))
            answers.append((_masks(tail), len(tail)))
            _, bucket, sign = entries(words[a:b], np.zeros(b - a, np.int64))
            vector = sign @ space[bucket]
            vectors.append(vector / max(float(np.linalg.norm(vector)), 1e-12))
            runs.setdefault(MIN_ITEM, []).append((np.unique(gram_hashes(words[a:b], MIN_ITEM)), len(ids) - 1))
        vocabulary = np.array(sorted({w for m in masks for w in m} | {w for _, own in short for w in own.tolist()}), U64)
        has = np.zeros((len(ids), len(vocabulary) + 1), bool)
        for j, m in enumerate(masks):
            has[j, np.searchsorted(vocabulary, np.array(list(m), U64))] = True
        vectors = np.array(vectors, np.float32).reshape(len(ids), space.shape[1])
        for item_id, own in short:  # after the others
            ids.append(item_id)
            runs.setdefault(len(own), []).append((gram_hashes(own, len(own)), len(ids) - 1))
        table = {}
        for n, found in runs.items():
            flat, item = np.concatenate([h for h, _ in found]), np.repeat([j for _, j in found], [len(h) for h, _ in found])
            order = np.argsort(flat, kind="stable")
            table[n] = flat[order], item[order]
        return cls(ids, sizes, masks, answers, vectors, space, vocabulary, has, table)

    def copied(self, n_words: int, own: np.ndarray, start: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words (places in ``own``) and items of all runs of ``n_words`` words that a text shares with an item."""
        strange = np.concatenate(([0], np.cumsum(known == len(self.vocabulary))))
        at = np.flatnonzero(strange[n_words:] == strange[:-n_words])
        at = at[at + n_words <= start[np.searchsorted(start, at, side="right")]]  # inside one text
        if n_words not in self.runs or not len(at):
            return at[:0], at[:0]
        runs, items = self.runs[n_words]
        h = gram_hashes(own, n_words)[at]
        lo, hi = np.searchsorted(runs, h), np.searchsorted(runs, h, side="right")
        n = hi - lo
        return np.repeat(at, n), items[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def overlaps(self, own: np.ndarray, known: np.ndarray, item: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Of candidates (an item and words w0 to w1 of ``own`` each): the number of each that may pass, and the words there that the
        item has. They, and the places in the item of the different ones, are no fewer than the common subsequence has."""
        ends = np.cumsum(w1 - w0)
        a = 0
        while a < len(item):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + WINDOW_WORDS, side="right")))
            long = w1[a:b] - w0[a:b]
            cand = np.repeat(np.arange(b - a), long)
            at = np.arange(len(cand)) + np.repeat(w0[a:b] - np.cumsum(long) + long, long)
            hit = np.flatnonzero(self.has[item[a:b][cand], known[at]])
            cand, at = cand[hit], at[hit]
            bounds = np.searchsorted(cand, np.arange(b - a + 1))
            for c in np.flatnonzero(np.diff(bounds) >= LCS_WITH_ANSWER * np.array(self.sizes)[item[a:b]]).tolist():
                j = int(item[a + c])
                around, masks = own[at[bounds[c] : bounds[c + 1]]].tolist(), self.masks[j]
                if sum(masks[w].bit_count() for w in set(around)) >= LCS_WITH_ANSWER * self.sizes[j]:
                    yield a + c, around
            a = b

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, float, float, float]]:
        """(text number, item number, first word of the passage, cosine, LCS share, answer share) of the leaks, the best
        passage for each text and item."""
        best: dict[tuple[int, int], tuple] = {}
        if not self.ids:
            return []
        words, first = plain_words(texts)
        for a, b in _chunks(first):
            own, start = words[first[a] : first[b]], first[a : b + 1] - first[a]
            block, text_no, place = blocks_of(start)
            known = self.known(own)
            for n_words in self.runs:
                if n_words < MIN_ITEM:  # the whole item
                    run_at, run_item = self.copied(n_words, own, start, known)
                    run_text = np.searchsorted(start, run_at, side="right") - 1
                    for i in np.unique(run_text * len(self.ids) + run_item, return_index=True)[1]:  # its first place in each text
                        t = int(run_text[i])
                        best[a + t, int(run_item[i])] = 1.0, 1.0, 1.0, int(start[t] - run_at[i])
            run_at, run_item = self.copied(MIN_ITEM, own, start, known)
            run_block, lengths = block[run_at], np.array(self.sizes, np.int64)
            for lo, hi, passages, *_ in projected(own, block, text_no, self.space):
                cos = (passages / np.maximum(np.linalg.norm(passages, axis=1, keepdims=True), 1e-12)) @ self.vectors.T
                near = cos >= COSINE
                here = (run_block >= lo) & (run_block < hi)
                near[run_block[here] - lo, run_item[here]] = True
                passage, item = np.nonzero(near)
                t, at, size = text_no[lo + passage], place[lo + passage] * BLOCK, lengths[item]
                w0, w1 = start[t] + np.maximum(0, at - size), np.minimum(start[t + 1], start[t] + at + 2 * BLOCK + size)
                for c, around in self.overlaps(own, known, item, w0, w1):
                    i, j, t, at = int(passage[c]), int(item[c]), int(text_no[lo + passage[c]]), int(place[lo + passage[c]]) * BLOCK
                    size = self.sizes[j]
                    share = lcs_length(self.masks[j], size, around) / size
                    if share < LCS_WITH_ANSWER:
                        continue
                    masks, n = self.answers[j]
                    answer = lcs_length(masks, n, around) / n
                    if share >= LCS or answer >= ANSWER_LCS:
                        found = (share, answer, float(cos[i, j]), -at)
                        key = (a + t, int(j))
                        best[key] = max(best.get(key, found), found)
        return [(t, j, -f[3], f[2], f[0], f[1]) for (t, j), f in sorted(best.items())]


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _item_groups(benchmark: DataFrame, space: np.ndarray) -> Iterator[Items]:
    """Items in groups of ITEMS, by ranges of the id's hash."""
    items = materialize(benchmark.select("item_id", "text").filter("text IS NOT NULL").distinct(), "items")
    groups = max(1, -(-items.count() // (ITEMS // 2)))
    for k in range(groups):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == k).collect()  # about ITEMS / 2 rows
        yield Items.build(rows, space)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, cosine, lcs and answer of every document with a passage of an item."""
    space = latent_space(docs)
    out = None
    for items in _item_groups(benchmark, space):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def search(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            hits = shared.value.find(column(batch, "text").to_pylist())
            cols = list(zip(*hits, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id").take(pa.array(cols[0], pa.int64())), pa.array([shared.value.ids[j] for j in cols[1]], pa.int64()),
                    *(pa.array(c, t) for c, t in zip(cols[2:], (pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)),
                ],
                names=["doc_id", "item_id", "start_word", "cosine", "lcs", "answer"],
            )

        found = map_batches(docs.select("doc_id", "text"), search, "doc_id long, item_id long, start_word long, cosine double, lcs double, answer double")
        out = found if out is None else out.unionByName(found)
    # Rows alike in doc_id: the best passage of each pair.
    best = F.max(F.struct("lcs", "answer", "cosine", (-F.col("start_word")).alias("back"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.back")).alias("start_word"), F.col("best.cosine").alias("cosine"), F.col("best.lcs").alias("lcs"), F.col("best.answer").alias("answer")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item leaks, in one scan for each group of items."""
    space = latent_space(docs)
    schema = schema_of(docs)
    for items in _item_groups(benchmark, space):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            bad = {h[0] for h in shared.value.find(column(batch, "text").to_pylist())}
            return batch.filter(pa.array([i not in bad for i in range(batch.num_rows)]))

        docs = map_batches(docs, clean, schema)
    return docs

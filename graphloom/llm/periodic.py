"""Periodic runs of words: stretches that repeat a block of ``q`` words four times or more.

A run of period q and length L has L - q places where the word q further on is the same, all in a row. So for each text the
places that agree are counted at every lag first, exactly: a frequent word adds the autocorrelation of its places, by FFT; of a
rare word the differences of all pairs of places are counted. Only lags with at least as many matches as the shortest run
needs are looked at. There, a run of three equal blocks at multiples of the lag is sought by rolling hashes, and a lag that has one
outside all runs of smaller period gets a scan for islands of matches, word by word: hashes only save scans, they find nothing.

An island whose three first whole blocks lie in a run of smaller period has that smaller period itself (they share more words than both
periods together), so it is no run of this one; any other is one.

Texts don't meet, so this is a map; the work on a text of n words is about n log n but for n times the frequency of the rarest
frequent word, and its memory a few arrays of n numbers.

Defined results: a null or empty text has no words and no runs, and so has one of fewer than six; rows with a null doc_id are worked on
like others; repeated rows are worked on one by one; an empty table gives an empty one; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import U64, column, map_batches, mix64, small_batches

LEAST, POWER = 6, 4
#: Numbers that a block of indicator rows holds at most.
BLOCK = 1 << 20

Change = Callable[[int | None, list[bytes]], list[bytes]]


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number below their count for each word, equal for equal words."""
    n = len(words)
    last = dict(zip(words, range(n), strict=True))
    return np.fromiter(map(last.__getitem__, words), np.int64, n)


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """At index q, up to ``most``, how many places i have ids[i] = ids[i + q] (index 0 is of no use)."""
    n = len(ids)
    size = 1 << (n + most - 1).bit_length()
    size = size * 3 // 4 if size * 3 // 4 >= n + most else size
    freq = np.bincount(ids, minlength=n)
    rare = max(8, int((size * size.bit_length() / 8) ** 0.5))  # up to here the pairs cost less than a transform
    total = np.zeros(most + 1, np.int64)
    frequent = np.flatnonzero(freq > rare)
    if len(frequent):
        power = np.zeros(size // 2 + 1)
        step = max(1, BLOCK // size)
        for k in range(0, len(frequent), step):
            seen = np.fft.rfft((ids == frequent[k : k + step, None]).astype(float), size)
            power += (seen.real**2 + seen.imag**2).sum(axis=0)
        total += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    order = order[(freq[ids[order]] > 1) & (freq[ids[order]] <= rare)]
    word, left, k, gaps, held = ids[order], np.arange(len(order)), 1, [], 0
    while True:  # the k-th next place of the same word
        left = left[left + k < len(order)]
        gap = order[left + k] - order[left]
        near = (word[left + k] == word[left]) & (gap <= most)
        left = left[near]
        if not len(left):
            break
        gaps.append(gap[near])
        held += len(left)
        if held > BLOCK:
            total += np.bincount(np.concatenate(gaps), minlength=most + 1)
            gaps, held = [], 0
        k += 1
    return total + np.bincount(np.concatenate(gaps), minlength=most + 1) if gaps else total


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n, runs = len(ids), []
    if n < LEAST:
        return runs
    lags = np.arange(1, n // POWER + 1)
    least = np.maximum(LEAST, POWER * lags) - lags
    enough = lag_counts(ids, len(lags))[1:] >= least
    if not enough.any():
        return runs
    powers = np.full(n + 1, 0x9E3779B97F4A7C15, U64)
    powers[0] = 1
    powers = np.cumprod(powers)
    prefix = np.concatenate((np.zeros(1, U64), np.cumsum(mix64(ids.astype(U64) + U64(1)) * powers[:-1])))
    reach = np.zeros(n, np.int64)  # the furthest end of a run that holds the place
    for q, need in zip(lags[enough].tolist(), least[enough].tolist(), strict=True):
        edges = prefix[::q]
        blocks = edges[1:] - edges[:-1]
        same = blocks[1:] == blocks[:-1] * powers[q]
        thrice = np.flatnonzero(same[1:] & same[:-1])
        if not (reach[thrice * q] < (thrice + 3) * q).any():
            continue
        breaks = np.concatenate(([-1], np.flatnonzero(ids[q:] != ids[:-q]), [n - q]))
        found = []
        for k in np.flatnonzero(np.diff(breaks) > need):
            start, end = int(breaks[k]) + 1, int(breaks[k + 1]) + q
            block = -(-start // q)
            if reach[block * q] < (block + 3) * q:
                found.append((start, end - start, q))
        for start, length, _ in found:
            np.maximum(reach[start : start + length], start + length, out=reach[start : start + length])
        runs += found
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def collapse_runs(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """doc_id, ``runs`` (by start, then period) and ``collapsed``, the words that stay, of every row of ``docs``. ``change`` gets a
    row's doc_id and words first and returns the words to take."""
    small_batches(docs.sparkSession)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def collapse(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = column(batch, "doc_id")
        bounds, flat, texts = [0], [], []
        for doc, text in zip(ids.to_pylist(), column(batch, "text").to_pylist(), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            if change is not None:
                words = change(doc, words)
            runs = find_runs(word_ids(words)) if len(words) >= LEAST else []
            flat += runs
            bounds.append(len(flat))
            if runs:
                words = [w for w, stays in zip(words, kept_words(len(words), runs).tolist(), strict=True) if stays]
            texts.append(b" ".join(words))
        table = np.array(flat, np.int64).reshape(-1, 3)
        cells = pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(3)], fields=list(run_type.value_type))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), cells)
        return pa.RecordBatch.from_arrays([ids, lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_batches(docs.select("doc_id", "text"), collapse, schema)


def run_digests(rows: DataFrame) -> DataFrame:
    """``collapse_runs`` rows with the run of the greatest length in periods (compared exactly; ties: the first) and digests."""
    larger = F.reduce(
        "runs",
        F.get("runs", F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = rows.withColumn("best", larger)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The query's change: the words from a place on repeat a block, in a tenth of the documents by crc32 of the id."""
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]

"""Repeated passages by sparse suffix arrays.

Only suffixes at minimisers are kept: of every ``min_words``-word window, the one that starts at the window's smallest
k-gram (leftmost on ties). The choice depends on the words of the window alone, so wherever a passage of ``min_words``
words stands, the same suffix is kept, about one for twenty words. Each kept suffix owns a run of consecutive windows,
its block, with ``left`` words before the suffix and the rest from it on.

1. Sort. Suffixes are sorted by their words: the k-gram they begin with, then fingerprints of longer and longer prefixes
   (``DEPTHS``, ended by the block's end), then the block, then the place. Equal words are neighbours, and the more two
   suffixes share, the nearer they stand.
2. Compare neighbours. A suffix with its neighbour's block is a repeat of the first of that run, as a whole. Between runs
   the depth up to which neighbours agree bounds how far any other suffix can agree to the right (the longest common
   prefix with any suffix is that with a neighbour).
3. Extend. The first of each run that shares its k-gram is sorted once more by the words before it, from right to left;
   neighbours there bound the extension to the left. A window of the block can stand elsewhere only if it fits between the two
   bounds, so most k-grams that meet by chance end here.
4. Matches that can make ``min_words`` words are settled word by word: their windows are sorted by fingerprint (64 bits,
   exact but for collisions) and place, and one with an equal predecessor is a repeat of the first of its run.
5. Overlapping repeats of a document merge into maximal spans.

So each word of every passage of at least ``min_words`` words that stands somewhere earlier is found, and nothing else.
Sorts are range shuffles whose key ends with the place, so a group of equal suffixes, however large, is dealt over as many tasks
as its rows need; tasks compare neighbours in one stream and hold one run's first row. Runs that cross the border of two
tasks: in steps 1 to 3 the first row of each task counts as the first of a run with unbounded neighbours, which only sends a few
windows more to step 4; there one row for each task carries the first of a run on. Where a repeat overlaps its own
first occurrence, the first occurrence stays whole.

Defined results: null and short texts have no repeats; rows with a null doc_id take no part; rows alike in doc_id and
text are one document; an empty table gives no spans; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import U64, column, encoded, gram_hashes, hinted, map_batches, materialize, mix64, schema_of, semi_by_id, small_batches, word_hashes
from graphloom.session import ship

MIN_WORDS, GRAM = 50, 8
#: Depths at which neighbours are compared, on each side; a fingerprint of 16 bits for each (equal ones loosen a bound only).
DEPTHS = 4
#: Rows of a sort that one task takes (about 25 MB), until there are so many ranges; tasks grow beyond.
SORT_ROWS, MAX_RANGES = 400_000, 100_000
_BASE = U64(0x9E3779B97F4A7C55)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


class Passages:
    """Words of a batch's texts, one after another, and fingerprints of any run of them."""

    def __init__(self, texts: list[str | None]) -> None:
        self.words, self.first = word_hashes(encoded(texts))
        n = len(self.words)
        power, back = np.full(n + 1, _BASE), np.full(n + 1, _INVERSE)
        power[0] = back[0] = 1
        self.back = np.cumprod(back, dtype=U64)
        self.sums = np.concatenate((np.zeros(1, U64), np.cumsum(self.words * np.cumprod(power, dtype=U64)[:n], dtype=U64)))

    def prints(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix64((self.sums[start + size] - self.sums[start]) * self.back[start] + np.asarray(size).astype(U64)).view(np.int64)


def kept_suffixes(p: Passages, min_words: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, k-gram, place, first window's word, windows) of every kept suffix."""
    n, width = len(p.words), min_words - gram + 1
    none = tuple(np.empty(0, np.int64) for _ in range(5))
    if n < min_words:
        return none
    grams = gram_hashes(p.words, gram)
    low = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    text_no = np.repeat(np.arange(len(p.first) - 1), np.diff(p.first))
    window = np.flatnonzero(text_no[: n - min_words + 1] == text_no[min_words - 1 :])
    if not len(window):
        return none
    owner = (low[window] & U64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.ones(len(window), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(fresh)
    return text_no[window[at]], grams[owner[at]].view(np.int64), owner[at], window[at], np.diff(np.append(at, len(window)))


def depths(low: int, high: int) -> list[int]:
    """``DEPTHS`` depths above ``low``, the last one ``high``; what agrees up to one and not up to the next agrees in fewer
    words than the next."""
    return [low + -(-(high - low) * k // DEPTHS) for k in range(1, DEPTHS + 1)]


def _levels(found: list[np.ndarray]) -> np.ndarray:
    """16 bits of each fingerprint, the shallowest first, as one integer: so sorting it sorts by depth."""
    out = np.zeros(len(found[0]), U64)
    for f in found:
        out = (out << U64(16)) | (f.view(U64) & U64(0xFFFF))
    return out.view(np.int64)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many depths two such integers share."""
    differ = (a ^ b).view(U64)
    return sum((differ >> U64(16 * k) == 0).astype(np.int64) for k in range(DEPTHS))


def _with_tie(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).filter("doc_id IS NOT NULL AND text IS NOT NULL")


_SUFFIX = "doc_id long, tie long, gram long, right long, left long, block long, at int, windows int, before int"
_FOUND = ("depth", "first_doc", "first_tie", "first_at")
_WINDOW = ("print", "doc_id", "tie", "at", "first_doc", "first_tie", "first_at")


def suffixes(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    """doc_id, tie, gram, right and left (fingerprints by depth of the words from the suffix on, and before it), block
    (fingerprint of all words the suffix owns), at (first owned word), windows, before (owned words before the suffix)."""
    small_batches(docs.sparkSession)
    names = [f.split()[0] for f in _SUFFIX.split(", ")]

    def sample(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = Passages(column(batch, "text").to_pylist())
        text_no, grams, place, at, windows = kept_suffixes(p, min_words, gram)
        before, behind = place - at, at + windows + (min_words - 1) - place
        right, left = [], []
        for d in depths(gram, min_words):
            right.append(p.prints(place, np.minimum(behind, d)))
        for d in depths(0, min_words - gram):
            size = np.minimum(before, d)
            left.append(p.prints(place - size, size))
        take = pa.array(text_no)
        return pa.RecordBatch.from_arrays(
            [
                column(batch, "doc_id").take(take), column(batch, "tie").take(take), pa.array(grams), pa.array(_levels(right)), pa.array(_levels(left)),
                pa.array(p.prints(at, windows + (min_words - 1))), pa.array((at - p.first[text_no]).astype(np.int32)), pa.array(windows.astype(np.int32)),
                pa.array(before.astype(np.int32)),
            ],
            names=names,
        )

    return map_batches(_with_tie(docs), sample, _SUFFIX)


def _sorted(rows: DataFrame, *by: str) -> DataFrame:
    """Materialised ``rows`` in ranges of ``by``, sorted; the number of ranges follows the rows."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, min(MAX_RANGES, 1 + rows.count() // SORT_ROWS))
    return rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def compared(rows: DataFrame, by: str) -> DataFrame:
    """Neighbours among ``rows`` sorted by (gram, ``by``, block, place). First rows of a run with one block: the rows with
    ``depth``, how many depths they share with the nearest other run (-1: not even the k-gram). All other rows are equal to
    the first of their run: ``depth`` null and its place in first_doc, first_tie, first_at."""
    rows = rows.select([c for c in rows.columns if c not in _FOUND])
    names = rows.columns
    words, key, place = [names.index(n) for n in ("gram", by, "block")], names.index(by), [names.index(n) for n in ("doc_id", "tie", "at")]
    kinds = {"bigint": pa.int64(), "int": pa.int32()}
    types = [*(kinds[t] for _, t in rows.dtypes), pa.int32(), pa.int64(), pa.int64(), pa.int32()]

    def batch_of(first: np.ndarray, depth: np.ndarray, rest: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
        """First rows of runs, then other rows with the first row of their run."""
        n, m = first.shape[1], rest.shape[1]
        cols = [pa.array(c) for c in np.concatenate([first, rest], axis=1)]
        cols.append(pa.concat_arrays([pa.array(depth, pa.int64()), pa.nulls(m, pa.int64())]))
        cols += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(head[i])]) for i in place]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, types, strict=True)], names=[*names, *_FOUND])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, above = None, DEPTHS  # the first row of the run so far, and the depths it shares with the run before it
        for batch in batches:
            if not batch.num_rows:
                continue
            got = np.stack([np.asarray(column(batch, n)).astype(np.int64) for n in names])
            if held is not None:
                got = np.concatenate([held, got], axis=1)
            fresh = np.ones(got.shape[1], bool)
            fresh[1:] = (got[words, 1:] != got[words, :-1]).any(axis=0)
            start = np.flatnonzero(fresh)
            run, rest = got[:, start], np.flatnonzero(~fresh)
            between = np.where(run[words[0], 1:] == run[words[0], :-1], _agree(run[key, 1:], run[key, :-1]), -1)
            depth = np.maximum(np.concatenate(([above], between[:-1])), between) if len(between) else between
            if len(between) or len(rest):
                yield batch_of(run[:, :-1], depth, got[:, rest], run[:, np.cumsum(fresh)[rest] - 1])
            held, above = run[:, -1:], int(between[-1]) if len(between) else above
        if held is not None:  # the next range may go on with it
            yield batch_of(held, np.array([DEPTHS]), held[:, :0], held[:, :0])

    ship(rows.sparkSession)
    schema = f"{schema_of(rows)}, depth int, first_doc long, first_tie long, first_at int"
    return _sorted(rows, "gram", by, "block", "doc_id", "tie", "at").mapInArrow(neighbours, schema)


def windows_of(texts_with_runs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, tie, at and fingerprint of each window in a text's runs (a list of at and windows)."""

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = Passages(column(batch, "text").to_pylist())
        runs = column(batch, "runs").to_pylist()
        text_no = np.repeat(np.arange(len(runs)), [sum(r["windows"] for r in rs) for rs in runs])
        at = np.concatenate([np.arange(r["at"], r["at"] + r["windows"]) for rs in runs for r in rs] or [np.empty(0, int)]).astype(np.int64)
        take = pa.array(text_no)
        return pa.RecordBatch.from_arrays(
            [column(batch, "doc_id").take(take), column(batch, "tie").take(take), pa.array(at.astype(np.int32)), pa.array(p.prints(at + p.first[text_no], min_words))],
            names=["doc_id", "tie", "at", "print"],
        )

    return map_batches(texts_with_runs, spread, "doc_id long, tie long, at int, print long")


def equal_windows(windows: DataFrame) -> DataFrame:
    """doc_id, tie, at of each window with an equal one before it, and the place of the first in first_doc, first_tie, first_at."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, edge = None, True  # the first row of the run so far; whether that is the first run of this range
        for batch in batches:
            if not batch.num_rows:
                continue
            got = np.stack([np.asarray(column(batch, n)).astype(np.int64) for n in ("print", "doc_id", "tie", "at")])
            n_held = 0 if held is None else 1
            if n_held:
                got = np.concatenate([held, got], axis=1)
            fresh = np.ones(got.shape[1], bool)
            fresh[1:] = got[0, 1:] != got[0, :-1]
            number = np.cumsum(fresh) - 1
            start = np.flatnonzero(fresh)
            first = got[:, start[number]]
            at_edge = (number == 0) & edge
            out = [*got[:, n_held:], *first[1:, n_held:]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c).cast(k) for c, k in zip(out, kinds, strict=True)), pa.array(at_edge[n_held:])], names=[*_WINDOW, "edge"])
            edge = edge and number[-1] == 0
            held = got[:, start[-1:]]

    ship(windows.sparkSession)
    schema = "print long, doc_id long, tie long, at int, first_doc long, first_tie long, first_at int, edge boolean"
    rows = _sorted(windows, "print", "doc_id", "tie", "at").mapInArrow(runs, schema).withColumn("range", F.spark_partition_id())
    rows = materialize(rows, "window-runs")
    # One row for each range of the sort, however many rows there are.
    place = F.struct("print", "doc_id", "tie", "at", "first_doc", "first_tie", "first_at")
    ends = rows.groupBy("range").agg(F.min("print").alias("low"), F.max(place).alias("last")).collect()
    carried, before = [], None  # the first place of the run that goes on into a range
    for r in sorted(ends, key=lambda r: (r["low"], r["last"]["print"], r["range"])):
        last = r["last"]
        if before is not None and before[0] == r["low"]:
            carried.append((r["range"], *before[1:]))
            if last["print"] == r["low"]:  # all of one run
                continue
        before = last["print"], last["first_doc"], last["first_tie"], last["first_at"]
    carry = windows.sparkSession.createDataFrame(carried, "range int, c_doc long, c_tie long, c_at int")
    fixed = rows.join(F.broadcast(carry), (rows["range"] == carry["range"]) & rows["edge"], "left")
    known = F.col("c_doc").isNotNull()
    names = {"first_doc": "c_doc", "first_tie": "c_tie", "first_at": "c_at"}
    return fixed.select("doc_id", "tie", "at", *(F.when(known, F.col(c)).otherwise(F.col(n)).alias(n) for n, c in names.items()))


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """doc_id, tie (hash of the text), start_word, end_word (exclusive), n_words and source_doc_id (a document with an
    earlier occurrence of some of it) of every maximal repeated span."""
    if not 1 <= gram <= min_words:
        raise ValueError("gram must be between 1 and min_words")
    docs = docs.select("doc_id", "text")
    kept = materialize(suffixes(docs, min_words, gram), "suffixes")

    def spans(rows: DataFrame, size) -> DataFrame:
        own = (F.col("doc_id") == F.col("first_doc")) & (F.col("tie") == F.col("first_tie"))
        return rows.filter(~(own & (F.col("at") == F.col("first_at")))).select(
            "doc_id", "tie", F.when(own, F.greatest(F.col("at"), F.col("first_at") + min_words)).otherwise(F.col("at")).alias("start"),
            (F.col("at") + size).alias("end"), F.col("first_doc").alias("source"),
        )

    def most(found: list[int]) -> Column:
        """The most words that can agree with any other suffix, from the depths shared with a neighbour."""
        return F.element_at(F.array(*(F.lit(d - 1) for d in found), F.lit(found[-1])), F.col("depth") + 1)

    def blocks(rows: DataFrame) -> DataFrame:
        return spans(rows.filter("depth IS NULL"), F.col("windows") + (min_words - 1))

    # A window with l words before the suffix takes l words in common to the left and min_words - l to the right.
    array = materialize(compared(kept, "right"), "suffix-array")
    fewest = F.greatest(F.col("before") - F.col("windows") + 1, min_words - most(depths(gram, min_words)))
    seeds = array.filter("depth >= 0").withColumn("fewest", fewest).filter("fewest <= before")
    extended = materialize(compared(materialize(seeds, "seeds"), "left"), "extended")
    largest = F.least("before", most(depths(0, min_words - gram)))
    open_ = extended.filter("depth >= 0").withColumn("most", largest).filter("fewest <= most")
    run = F.struct((F.col("at") + F.col("before") - F.col("most")).alias("at"), (F.col("most") - F.col("fewest") + 1).alias("windows"))
    runs = materialize(open_.groupBy("doc_id", "tie").agg(F.collect_set(run).alias("runs")), "open-runs")  # of one text
    texts = semi_by_id(_with_tie(docs), runs.select("doc_id", "tie"), ["doc_id", "tie"]).join(runs.hint("merge"), ["doc_id", "tie"])
    windows = materialize(windows_of(texts, min_words), "windows")
    found = blocks(array).unionByName(blocks(extended)).unionByName(spans(equal_windows(windows), F.lit(min_words))).filter("end > start")

    text = Window.partitionBy("doc_id", "tie")
    order = text.orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(order))
    return islands.groupBy("doc_id", "tie", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("source").alias("source_doc_id")).select(
        "doc_id", "tie", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "source_doc_id"
    )


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; white space before a cut word goes with it."""
    import re

    ends = [0]
    ends += [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at : ends[a]])
        at = max(at, ends[b])
    return "".join([*out, text[at:]])


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """``docs`` with every repeated span cut from ``text`` (first occurrences stay). Documents of which no word is left
    go; all other columns stay as they are."""
    spans = repeated_spans(docs, min_words, gram)
    names, tie, cuts = docs.columns, "__graphloom_tie", "__graphloom_cuts"
    listed = spans.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start_word", "end_word")).alias(cuts))
    listed = materialize(listed.withColumnRenamed("tie", tie).withColumnRenamed("doc_id", "__graphloom_id"), "cuts")
    marked = docs.withColumn(tie, F.xxhash64("text"))
    joined = marked.join(hinted(listed, 256), (marked["doc_id"] == listed["__graphloom_id"]) & (marked[tie] == listed[tie]), "left")
    joined = joined.select(*(marked[f"`{n}`"] for n in names), listed[cuts])
    schema = schema_of(docs)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts, keep = [], []
        for text, spans in zip(column(batch, "text").to_pylist(), column(batch, cuts).to_pylist(), strict=True):
            if spans:
                text = cut_words(text, [(s["start_word"], s["end_word"]) for s in spans])
            keep.append(not spans or bool(text.encode("utf-8", "surrogatepass").split(None, 1)))
            texts.append(text)
        cols = [pa.array(texts, pa.string()) if n == "text" else column(batch, n) for n in names]
        return pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

    return map_batches(joined, cut, schema)

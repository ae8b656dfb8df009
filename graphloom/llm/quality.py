"""Quality rules and an isolation forest on their statistics.

Every whole text gives the base statistics of the rules; the forest sees all of them, as shares: of symbols and punctuation
among characters (damped where a text is short), of repeated words and lines among words, mean word length, and the number of words. The
forest isolates a document by random splits on these; short paths mean anomalies.

Labels calibrate it twice, over all labelled rows that pass the base rules. How well a statistic alone tells bad rows from
good ones (its area under the curve, from histograms of ``BINS`` bins) is how often a split takes it: without labels all
count alike. And the threshold on the score is the one with the best balanced accuracy, from a histogram of scores in steps of
1 / ``STEPS``.

Each of ``trees`` trees has a draw of its own of ``leaf_sample`` rows, by a hash over all rows that pass the base rules;
``RARE`` of them are rows labelled bad, so that a statistic in which these differ can be split on, however rare they
are in the corpus. Small draws keep many alike anomalies from hiding each other. Only these draws and histograms, of
bounded size, reach the driver.

Defined results: a null text has no words and fails the base rules; without labels of both kinds the threshold
is the share ``contamination`` of all scores; rows with a null doc_id are judged and counted but never drawn; repeated
rows are judged one by one; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import column, map_batches, materialize, small_batches
from graphloom.session import ship

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
BINS, STEPS, RARE, LEAF_SAMPLE, LEAST_WEIGHT = 1 << 12, 10_000, 2, 64, 0.01
STAT_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA_NAMES = ("n_punct",)

_PUNCT = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])


def text_statistics(text: str | None, window: int = WINDOW) -> list[int]:
    """The base statistics, then punctuation characters, of one text."""
    if not text:
        return [0] * (len(STAT_NAMES) + len(EXTRA_NAMES))
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    white = int(counts[[9, 10, 11, 12, 13, 32]].sum())
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    last = dict(zip(words, range(n), strict=True))
    repeats = 0
    if n >= window:
        ids = np.fromiter(map(last.__getitem__, words), np.int64, n)
        key = ids[: n - window + 1].copy()
        for i in range(1, window):  # exact: each step renumbers the runs so far
            if i > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * n + ids[i : n - window + 1 + i]
        inverse, times = np.unique(key, return_inverse=True, return_counts=True)[1:]
        twice = times[inverse] >= 2
        covered = np.zeros(n, bool)
        for i in range(window):
            covered[i : n - window + 1 + i] |= twice
        repeats = int(covered.sum())
    return [
        n,
        int(counts[_LEAD].sum()) - white,
        int(sum(counts[b] for b in SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        int(counts[_PUNCT].sum()),
    ]


def shares(s: np.ndarray) -> np.ndarray:
    """Features of statistics rows, each from 0 to 1."""
    words, chars, symbols, lines, repeats, punct = (s[:, i].astype(float) for i in range(6))
    n = np.maximum(words, 1)
    cols = [symbols / (chars + 100), punct / (chars + 100), chars / n / 64, repeats / n, 10 * lines / n, np.log2(1 + words) / 32]
    return np.minimum(np.column_stack(cols), 1)


@dataclass
class Forest:
    """Trees as arrays: node i splits on ``feature[i]`` (-1: a leaf) at ``cut[i]``, to ``left[i]`` or left[i] + 1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected length): near 1 for anomalies."""
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            live = np.arange(len(x))
            while len(live):
                f = self.feature[at[live]]
                live = live[f >= 0]
                if not len(live):
                    break
                node = at[live]
                at[live] = self.left[node] + (x[live, self.feature[node]] >= self.cut[node])
            total += self.depth[at]
        return 2.0 ** (-total / len(self.roots) / self.norm)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int, leaf_sample: int, seed: int = 11, weight: np.ndarray | None = None, rare: np.ndarray | None = None) -> Forest:
    """Trees on rows ``x`` in random order, each on rows of its own while they last, with ``RARE`` of the rows ``rare``. A split
    takes a feature, of those that still vary, with odds ``weight``."""
    rng = np.random.default_rng(seed)
    rare = x[:0] if rare is None else rare
    weight = np.ones(x.shape[1]) if weight is None else weight
    base = len(x)
    x = np.concatenate([x, rare])
    feature, cut, left, depth, roots = [], [], [], [], []
    few = min(RARE, len(rare))
    size = min(leaf_sample - few, base)
    limit = max(1, int(np.ceil(np.log2(max(size + few, 2)))))
    for k in range(trees):
        rows = np.arange(k * size, (k + 1) * size) if base >= trees * size else rng.choice(base, size, replace=False)
        rows = np.concatenate([rows, base + rng.choice(len(rare), few, replace=False)]) if few else rows
        roots.append(len(feature))
        feature.append(-1), cut.append(0.0), left.append(-1), depth.append(0.0)
        stack = [(roots[-1], rows, 0)]
        while stack:
            node, rows, d = stack.pop()
            spread = np.ptp(x[rows], axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
            usable = np.flatnonzero(spread > 0)
            if d >= limit or not len(usable):
                depth[node] = d + _expected(len(rows))
                continue
            f = int(rng.choice(usable, p=weight[usable] / weight[usable].sum()))
            at = float(rng.uniform(x[rows, f].min(), x[rows, f].max()))
            side = x[rows, f] >= at
            child = len(feature)
            feature[node], cut[node], left[node] = f, at, child
            for i, part in enumerate((rows[~side], rows[side])):
                feature.append(-1), cut.append(0.0), left.append(-1), depth.append(0.0)
                stack.append((child + i, part, d + 1))
    return Forest(np.array(feature), np.array(cut), np.array(left), np.array(depth), np.array(roots), max(_expected(size + few), 1.0))


def calibrate(good: np.ndarray, bad: np.ndarray, good_times: np.ndarray | None = None, bad_times: np.ndarray | None = None, step: float = 1e-9) -> float:
    """The score from which on a row is rejected, with the best balanced accuracy; ties go to the higher one. Scores may
    come with how often each is there."""

    def below(scores: np.ndarray, times: np.ndarray | None) -> np.ndarray:
        order = np.argsort(scores, kind="stable")
        upto = np.concatenate(([0], np.cumsum(np.ones(len(scores)) if times is None else times[order])))
        return upto[np.searchsorted(scores[order], cuts, side="left")] / upto[-1]

    cuts = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([(cuts[:-1] + cuts[1:]) / 2, [cuts[-1] + step]])
    kept, caught = below(good, good_times), 1 - below(bad, bad_times)
    best = (kept + caught).max()
    return float(cuts[np.flatnonzero(kept + caught >= best - 1e-12)[-1]])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and all counts of every row."""
    small_batches(docs.sparkSession)
    names = (*STAT_NAMES, *EXTRA_NAMES)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([text_statistics(t) for t in column(batch, "text").to_pylist()], np.int64)
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c) for c in rows.T)], names=["doc_id", *names])

    return map_batches(docs.select("doc_id", "text"), count, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def _matrix(rows: list) -> np.ndarray:
    return np.array([[r[n] for n in (*STAT_NAMES, *EXTRA_NAMES)] for r in rows], np.int64).reshape(-1, len(STAT_NAMES) + len(EXTRA_NAMES))


def base_fails(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < MIN_WORDS) | (100 * s[:, 4] > REPEAT_PERCENT * s[:, 0])


#: The same as a condition on rows.
PASSES = f"n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= {REPEAT_PERCENT} * n_words"


def _counts(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([np.asarray(column(batch, n)) for n in (*STAT_NAMES, *EXTRA_NAMES)])


def feature_weights(labelled: DataFrame) -> np.ndarray:
    """How well each feature alone tells the two labels apart: |2 * area under the curve - 1|, ``LEAST_WEIGHT`` at least."""

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            b = np.minimum(shares(_counts(batch)) * BINS, BINS - 1).astype(np.int64)
            label = np.asarray(column(batch, "label"))
            for y in (0, 1):
                total[y] = total.get(y, 0) + np.stack([np.bincount(c, minlength=BINS) for c in b[label == y].T])
        for y, counts in total.items():
            f, b = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), y)), pa.array(f), pa.array(b), pa.array(counts[f, b])], names=["label", "feature", "bin", "n"])

    width = shares(np.zeros((1, len(STAT_NAMES) + len(EXTRA_NAMES)))).shape[1]
    ship(labelled.sparkSession)
    parts = labelled.mapInArrow(bins, "label long, feature long, bin long, n long").groupBy("label", "feature", "bin").agg(F.sum("n").alias("n"))
    table = np.zeros((2, width, BINS))
    for y, f, b, n in parts.collect():  # BINS rows a label and feature at most
        table[y, f, b] = n
    if not (table.sum(axis=2) > 0).all():
        return np.ones(width)
    good, bad = table[1] / table[1].sum(axis=1, keepdims=True), table[0] / table[0].sum(axis=1, keepdims=True)
    area = (bad * (np.cumsum(good, axis=1) - good / 2)).sum(axis=1)
    return np.maximum(np.abs(2 * area - 1), LEAST_WEIGHT)


def _drawn(rows: DataFrame, wanted: int) -> np.ndarray:
    """Features of ``wanted`` rows, or all, the first by hash."""
    n, names = rows.count(), (*STAT_NAMES, *EXTRA_NAMES)
    below = -(2**63) + int(2**64 * min(1.0, 1.1 * (wanted + 50) / max(n, 1))) - 1
    keyed = rows.filter("doc_id IS NOT NULL").select("doc_id", *names, F.xxhash64("doc_id", *STAT_NAMES).alias("hash")).filter(F.col("hash") <= below)
    return shares(_matrix(keyed.orderBy("hash", "doc_id", *names).limit(wanted).collect()))


def score_histogram(rows: DataFrame, forest: Forest) -> list[tuple[int, int, int]]:
    """(label, score in steps, rows) of ``rows``."""
    model = rows.sparkSession.sparkContext.broadcast(forest)

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        steps = np.rint(model.value.score(shares(_counts(batch))) * STEPS).astype(np.int64)
        return pa.RecordBatch.from_arrays([column(batch, "label"), pa.array(steps)], names=["label", "step"])

    found = map_batches(rows, scored, "label long, step long").groupBy("label", "step").count().collect()  # STEPS rows a label at most
    return [tuple(r) for r in found]


def train(stats: DataFrame, labels: DataFrame, trees: int = 200, leaf_sample: int = LEAF_SAMPLE, contamination: float = 0.05) -> tuple[Forest, float]:
    """The forest and the score from which on a row is rejected. ``stats`` is materialised; ``labels`` has doc_id and quality."""
    passing = stats.filter(PASSES)
    plain = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("long").alias("label")).distinct()
    labelled = materialize(passing.join(plain, "doc_id"), "labelled")
    forest = grow(
        _drawn(passing, trees * leaf_sample), trees, leaf_sample, weight=feature_weights(labelled), rare=_drawn(labelled.filter("label = 0"), trees * RARE)
    )
    known = score_histogram(labelled, forest)
    good, bad = ({v: n for y, v, n in known if y == label} for label in (1, 0))
    if good and bad:
        values = [np.array(list(h)) / STEPS for h in (good, bad)]
        return forest, calibrate(*values, *(np.array(list(h.values())) for h in (good, bad)), step=1 / STEPS)
    every = sorted((v, n) for _, v, n in score_histogram(passing.withColumn("label", F.lit(0).cast("long")), forest))
    upto = np.cumsum([n for _, n in every])
    return forest, (every[int(np.searchsorted(upto, (1 - contamination) * upto[-1]))][0] + 0.5) / STEPS if every else 1.0


def judge(docs: DataFrame, labels: DataFrame, trees: int = 200, leaf_sample: int = LEAF_SAMPLE, contamination: float = 0.05) -> DataFrame:
    """doc_id, the base statistics, base_failed, the anomaly ``score`` and kept of every row of ``docs``."""
    stats = materialize(statistics(docs), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(train(stats, labels, trees, leaf_sample, contamination))  # trees of a bounded sample

    def verdict(batch: pa.RecordBatch) -> pa.RecordBatch:
        forest, threshold = model.value
        s = _counts(batch)
        failed, score = base_fails(s), forest.score(shares(s))
        out = [column(batch, n) for n in ("doc_id", *STAT_NAMES)]
        return pa.RecordBatch.from_arrays(
            [*out, pa.array(failed), pa.array(score), pa.array(~failed & (score < threshold))],
            names=["doc_id", *STAT_NAMES, "base_failed", "score", "kept"],
        )

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in STAT_NAMES) + ", base_failed boolean, score double, kept boolean"
    return map_batches(stats, verdict, schema)

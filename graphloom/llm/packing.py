"""Best-fit packing by patterns and non-negative least squares.

A document is its ids and the end id, cut into pieces of ``capacity`` tokens only where it is longer. All planning
happens on the histogram of piece lengths (at most ``capacity`` entries, whatever the corpus):

1. enumerate patterns of up to four pieces that fill a sequence, from the lengths that occur;
2. fit repeat counts x >= 0 to the histogram by least squares (cyclic coordinate descent on the sparse patterns);
3. round down, never using more pieces than there are;
4. pack what remains by best fit, longest pieces first, whole groups of equal sequences at a time.

The plan is a list of (pattern, repeats). A piece finds its place by its rank among the pieces of its length: ranks
are counted within (length, salt) groups and offset by the groups' sums. A length has as many salts as its pieces need
(groups of about ``GROUP_ROWS``, larger ones only where that would make more than ``GROUPS``), so a length that a third of all
pieces share is no task of its own.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; an empty table packs
nothing; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import column, map_batches, materialize, small_batches
from graphloom.llm.vocab import tokenizer_path, word_ids

TOKENIZER, END_ID, CAPACITY = "word_bpe_49k.json", 0, 2048
GROUP_ROWS, GROUPS = 5_000, 100_000
#: Of the histogram, the shares that patterns are fitted to (the rest keeps short pieces for best fit), sweeps of
#: the fit, and patterns kept for each longest piece.
FIT_SHARES, SWEEPS, PER_LENGTH, SPARE = (0.9, 0.75, 0.5, 0.25, 0.1, 0.05), 40, 5, 500

Group = tuple[tuple[int, ...], int]  # lengths in order, repeats


def patterns(hist: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths, each closed by the longest length that still fits, that leave at most 1/SPARE of a
    sequence empty: for each longest length, with the longest partner, and with the most frequent ones."""
    there = [int(n) for n in np.flatnonzero(hist[:capacity]) if n]
    out: set[tuple[int, ...]] = set()
    frequent = sorted(there, key=lambda n: (-hist[n], n))[:64]

    def closed(parts: tuple[int, ...]) -> tuple[int, ...]:
        i = bisect_right(there, min(capacity - sum(parts), parts[0])) - 1
        return tuple(sorted((*parts, there[i]), reverse=True)) if i >= 0 else parts

    for a in there:
        out.add(closed((a,)))
        found, spare = 0, []
        for b in (b for b in frequent if b <= min(a, capacity - a)):
            p = closed((a, b))
            if sum(p) == capacity and found < PER_LENGTH:
                out.add(p)
                found += 1
            spare.append(p)
        out.update(sorted(spare, key=sum, reverse=True)[:2])
        fours = [closed((a, b, c)) for i, b in enumerate(frequent[:12]) if b <= a for c in frequent[i : i + 6] if c <= a and a + b + c <= capacity]
        out.update(sorted(fours, key=sum, reverse=True)[:PER_LENGTH])
    return sorted((p for p in out if sum(p) >= capacity - capacity // SPARE), reverse=True)


def fit(hist: np.ndarray, pats: list[tuple[int, ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """x >= 0 that makes sum of x[j] * pattern j close to ``hist`` in least squares."""
    left = hist.astype(float).tolist()
    x = [0.0] * len(pats)
    columns = []
    for p in pats:
        used = {n: p.count(n) for n in p}
        columns.append((list(used.items()), float(sum(c * c for c in used.values()))))
    for _ in range(sweeps):
        moved = 0.0
        for j, (entries, norm) in enumerate(columns):
            step = max(-x[j], sum(c * left[n] for n, c in entries) / norm)
            if step:
                x[j] += step
                moved += abs(step)
                for n, c in entries:
                    left[n] -= c * step
        if moved < 1e-3 * (1 + sum(x)):
            break
    return np.array(x)


def best_fit(hist: np.ndarray, capacity: int) -> list[Group]:
    """Best fit, longest first, over a histogram: equal sequences are one group with a count."""
    caps: list[int] = []  # capacities that open groups have, sorted
    open_: dict[int, list[list]] = {}  # capacity left -> [pattern, count]

    def put(left: int, pattern: tuple[int, ...], count: int) -> None:
        if left not in open_:
            open_[left] = []
            insort(caps, left)
        open_[left].append([pattern, count])

    for n in range(capacity, 0, -1):
        count = int(hist[n])
        while count:
            at = bisect_left(caps, n)
            if at == len(caps):
                per = min(count, capacity // n)
                put(capacity - per * n, (n,) * per, count // per)
                count %= per
                continue
            left = caps[at]
            group = open_[left][-1]
            take = min(count, group[1])
            group[1] -= take
            if not group[1]:
                open_[left].pop()
                if not open_[left]:
                    del open_[left]
                    caps.pop(at)
            put(left - n, (*group[0], n), take)
            count -= take
    return [(p, c) for groups in open_.values() for p, c in groups]


def _fitted(left: np.ndarray, pats: list[tuple[int, ...]], share: float, capacity: int) -> list[Group]:
    """Fit, round down, and pack what is left."""
    left, out = left.copy(), []
    for p, x in sorted(zip(pats, fit(left * share, pats), strict=True), key=lambda t: (-sum(t[0]), -t[1])):
        repeats = min(int(x), min(int(left[n]) // p.count(n) for n in set(p)))
        if repeats > 0:
            out.append((p, repeats))
            for n in p:
                left[n] -= repeats
    return out + best_fit(left, capacity)


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[Group]:
    """Groups of equal sequences that use up the histogram (index: length): of the fits to several shares of it, the one
    with the fewest sequences."""
    left = np.array(hist, np.int64)
    full: list[Group] = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    least = -(-int((left * np.arange(len(left))).sum()) // capacity)
    pats, best, fewest = patterns(left, capacity), [], None
    for share in FIT_SHARES:
        groups = _fitted(left, pats, share, capacity)
        n = sum(c for _, c in groups)
        if fewest is None or n < fewest:
            best, fewest = groups, n
        if fewest <= least:
            break
    return full + best


def slots(groups: list[Group], capacity: int) -> dict[str, np.ndarray]:
    """The plan as ranges of ranks: rows sorted by (length, first rank) with the first sequence and the offset."""
    used, first_sequence, rows = np.zeros(capacity + 1, np.int64), 0, []
    for pattern, repeats in groups:
        offset = 0
        for n in pattern:
            rows.append((n, int(used[n]), first_sequence, offset))
            used[n] += repeats
            offset += n
        first_sequence += repeats
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    base = np.concatenate(([0], np.cumsum(used)))  # ranks of all shorter lengths come before
    return {"start": base[table[:, 0]] + table[:, 1], "sequence": table[:, 2], "offset": table[:, 3], "base": base}


def pieces(docs: DataFrame, path: str | None = None, end: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every text."""
    path = path or tokenizer_path(TOKENIZER)
    tail = end.to_bytes(4, "little")
    small_batches(docs.sparkSession)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        memory, rows = word_ids(path), []
        for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
            ids = memory.encode(text) + tail
            for k in range(0, len(ids), 4 * capacity):
                part = ids[k : k + 4 * capacity]
                rows.append((doc_id, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
        )

    return map_batches(docs.select("doc_id", "text"), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str | None = None, end: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and offset there."""
    spark = docs.sparkSession
    stored = materialize(pieces(docs, path, end, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    hist = np.zeros(capacity + 1, np.int64)
    for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most capacity rows
        hist[r["length"]] = r["n"]
    table = slots(plan(hist, capacity), capacity)
    # At most four ranges for each pattern, and there are fewer than 20 patterns for each length.
    shared = spark.sparkContext.broadcast(table)
    group = max(GROUP_ROWS, -(-int(hist.sum()) // GROUPS))
    salts = spark.createDataFrame([(n, -(-int(hist[n]) // group)) for n in np.flatnonzero(hist).tolist()], "length long, salts long")
    rows = stored.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row"), "salts")).drop("salts")
    counted = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))  # at most capacity + GROUPS rows
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1)
    placed = ranked.join(F.broadcast(bases), ["length", "salt"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).cast("long").alias("rank")
    )

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = shared.value
        at = t["base"][np.asarray(column(batch, "length"))] + np.asarray(column(batch, "rank"))
        i = np.searchsorted(t["start"], at, side="right") - 1
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays(
            [*(column(batch, n) for n in names), pa.array(t["sequence"][i] + at - t["start"][i]), pa.array(t["offset"][i])], names=[*names, "sequence_id", "offset"]
        )

    return map_batches(placed, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

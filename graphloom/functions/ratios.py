"""Ratios of two names by edits, for whole columns at a time.

The indel ratio is 200 * (longest common subsequence) / (both lengths); the subsequence's length comes from a bit-parallel walk over all pairs
of a batch at once, a machine word a pair (longer names take Python's integers). On it rest the ratio of sorted tokens, that of token
sets, that of the shorter name with the best stretch of the longer one, and the weighted ratio, which takes the largest of them with
weights by how much the lengths differ.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Pairs = list[tuple[str, str]]

WORD = 64
#: Pairs compared at a time.
BLOCK = 4096
# Weights of the weighted ratio.
TOKEN_WEIGHT, NEAR, FAR, NEAR_WEIGHT, FAR_WEIGHT = 0.95, 1.5, 8.0, 0.9, 0.6


def _codes(texts: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(texts), width), pad, np.int64)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = [ord(c) for c in text]
    return out


def _one(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        met = state & masks.get(c, 0)
        state = (state + met | state - met) & full
    return len(a) - state.bit_count()


def subsequences(pairs: Pairs) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    out = np.zeros(len(pairs), np.int64)
    short = [i for i, (a, b) in enumerate(pairs) if a and b and min(len(a), len(b)) <= WORD]
    for i, (a, b) in enumerate(pairs):
        if min(len(a), len(b)) > WORD:
            out[i] = _one(a, b)
    short.sort(key=lambda i: max(map(len, pairs[i])))
    bits = np.uint64(1) << np.arange(WORD, dtype=np.uint64)
    for k in range(0, len(short), BLOCK):
        rows = short[k : k + BLOCK]
        a, b = zip(*(sorted(pairs[i], key=len) for i in rows), strict=True)
        own, other = _codes(a, WORD, -1), _codes(b, max(map(len, b)), -2)
        state = np.full(len(rows), 2**64 - 1, np.uint64)
        for column in other.T:
            met = state & ((own == column[:, None]) * bits).sum(axis=1, dtype=np.uint64)
            state = (state + met) | (state - met)
        sizes = np.array([len(x) for x in a], np.uint64)
        inside = np.where(sizes == WORD, np.uint64(2**64 - 1), (np.uint64(1) << (sizes % np.uint64(WORD))) - np.uint64(1))
        out[rows] = np.bitwise_count(~state & inside)
    return out


def indel_ratios(pairs: Pairs) -> np.ndarray:
    both = np.array([len(a) + len(b) for a, b in pairs], float)
    return np.where(both == 0, 100.0, 200.0 * subsequences(pairs) / np.maximum(both, 1))


def _best_of(groups: list[Pairs], score: Callable[[Pairs], np.ndarray]) -> np.ndarray:
    """The best score of each group; 0 for none."""
    sizes = np.array([len(g) for g in groups], np.int64)
    out = np.zeros(len(groups))
    if sizes.sum():
        np.maximum.at(out, np.repeat(np.arange(len(groups)), sizes), score([p for g in groups for p in g]))
    return out


def _stretches(a: str, b: str) -> Pairs:
    """The shorter name with each stretch of the longer one: of its own length, or less at either end."""
    short, long = sorted((a, b), key=len)
    m, n = len(short), len(long)
    ends = [long[:k] for k in range(1, m)] + [long[n - k :] for k in range(1, m)]
    found = {*(long[i : i + m] for i in range(n - m + 1)), *ends}
    swapped = [(long, short[:k]) for k in range(1, m)] + [(long, short[m - k :]) for k in range(1, m)] if m == n else []
    return [(short, x) for x in found] + swapped


def partial_ratios(pairs: Pairs) -> np.ndarray:
    return _best_of([_stretches(a, b) if a and b else [] for a, b in pairs], indel_ratios)


def _token_sets(a: str, b: str) -> tuple[str, str, str]:
    """Shared tokens, and those of one side only, sorted and joined."""
    left, right = set(a.split()), set(b.split())
    return " ".join(sorted(left & right)), " ".join(sorted(left - right)), " ".join(sorted(right - left))


def token_set_ratios(pairs: Pairs) -> np.ndarray:
    sets = [_token_sets(a, b) for a, b in pairs]
    common = subsequences([(x, y) for _, x, y in sets])
    out = np.zeros(len(pairs))
    for i, ((shared, x, y), n) in enumerate(zip(sets, common.tolist(), strict=True)):
        if not pairs[i][0].split() or not pairs[i][1].split():
            continue
        if shared and (not x or not y):
            out[i] = 100.0
            continue
        gap = bool(shared)
        whole = 2 * (len(shared) + gap) + len(x) + len(y)
        best = 100.0 - 100.0 * (len(x) + len(y) - 2 * n) / whole
        if shared:
            best = max(best, *(100.0 - 100.0 * (gap + len(d)) / (2 * len(shared) + gap + len(d)) for d in (x, y)))
        out[i] = best
    return out


def _sorted_tokens(pairs: Pairs) -> Pairs:
    return [(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) for a, b in pairs]


def partial_token_ratios(pairs: Pairs) -> np.ndarray:
    """100 if a token is shared, else the best stretch among sorted tokens, repeated or not."""
    groups = []
    for (a, b), (x, y) in zip(pairs, _sorted_tokens(pairs), strict=True):
        shared, left, right = _token_sets(a, b)
        groups.append([("=", "=")] if shared else [(x, y), (left, right)])
    return _best_of(groups, partial_ratios)


def weighted_ratios(pairs: Pairs) -> np.ndarray:
    """The largest of the ratios, with weights by how much the lengths differ; 0 if a name is empty."""
    out = np.zeros(len(pairs))
    some = [i for i, (a, b) in enumerate(pairs) if a and b]
    given = [pairs[i] for i in some]
    if not given:
        return out
    apart = np.array([max(len(a), len(b)) / min(len(a), len(b)) for a, b in given])
    best = indel_ratios(given)
    near, far = np.flatnonzero(apart < NEAR), np.flatnonzero(apart >= NEAR)
    pick = lambda at: [given[i] for i in at]
    tokens = np.maximum(indel_ratios(_sorted_tokens(pick(near))), token_set_ratios(pick(near)))
    best[near] = np.maximum(best[near], tokens * TOKEN_WEIGHT)
    scale = np.where(apart[far] <= FAR, NEAR_WEIGHT, FAR_WEIGHT)
    best[far] = np.maximum.reduce([best[far], partial_ratios(pick(far)) * scale, partial_token_ratios(pick(far)) * TOKEN_WEIGHT * scale])
    out[some] = best
    return out


def name_ratio(a: Column, b: Column) -> Column:
    """The larger of the weighted ratio and that of token sets, of two normalised names; in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = [*zip(x.fillna(""), y.fillna(""), strict=True)]
        return pd.Series(np.maximum(weighted_ratios(pairs), token_set_ratios(pairs)))

    return ratio(a, b)

"""Language identification with error-correcting output codes.

Each learned language has a codeword; one linear classifier over hashed byte n-grams for each bit of the code tells
which half of the languages a text's belongs to. A text's language is the codeword with the least weighted loss over
all bits: a bit's loss is log(1 + exp(-bit * margin)), weighted by that bit's accuracy in training. The relative distance
to the runner-up is the ambiguity flag; the losses turned into probabilities give the score.

Few languages get the exhaustive code (all 2^(k-1) - 1 splits), more get random codewords that are far apart.
Training takes a bounded sample: at most ``per_lang`` labelled rows of each language, the first by a hash of id and text (a
total order, so neither file layout nor retried tasks change it), whole texts and short cuttings of them. A text is ambiguous if
its distance to the runner-up is below the one under which predictions are more often wrong than right; that is measured in
training, on a quarter of the sample that a first model has not seen. Predictions read whole texts.

Defined results: a null text or one without a letter is ``und`` with score 0 (ambiguous); if no language is
learned, all is ``und``; rows without lang or doc_id are never learned from; repeated rows are predicted one by one; ties
go to the first language in order; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import column, map_batches, schema_of, small_batches

DIM = 1 << 12
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_KEEP = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def features(text: str) -> np.ndarray:
    """Hashed counts of byte 1- to 3-grams of a text in lower case with everything but letters as spaces, square
    roots, unit length."""
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass").translate(_KEEP), np.uint8)
    data = data[np.concatenate(([True], (data[1:] != 32) | (data[:-1] != 32)))].astype(np.uint32)
    x = np.bincount(data, minlength=DIM)
    if len(data) > 1:
        two = data[:-1] * np.uint32(257) + data[1:]
        x = x + np.bincount((two * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
        if len(data) > 2:
            three = two[:-1] * np.uint32(263) + data[2:] + np.uint32(77)
            x = x + np.bincount((three * np.uint32(2246822519)) >> np.uint32(20), minlength=DIM)
    x = np.sqrt(x.astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-9)


def codewords(k: int, seed: int = 3) -> np.ndarray:
    """k rows of +1 and -1."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        cols = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(cols, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, far = None, -1
    for _ in range(50):
        code = rng.choice([1.0, -1.0], (k, bits))
        gap = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2)) if k <= 64 else 0
        gap = gap if (np.abs(code.sum(axis=0)) < k).all() else -1
        if gap > far or best is None:
            best, far = code, gap
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # DIM x bits
    bias: np.ndarray
    trust: np.ndarray  # of bits
    doubt: float = 0.0  # loss to the runner-up, in parts of the bits' total trust, under which a text is ambiguous

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of each row of features against each language's codeword."""
        margins = x @ self.weights + self.bias
        return (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(axis=2)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        if not self.langs:
            return out
        usable = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        for k in range(0, len(usable), 128):
            part = usable[k : k + 128]
            loss = self.losses(np.stack([features(texts[i]) for i in part]))
            order = np.argsort(loss, axis=1, kind="stable")
            odds = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
            prob = odds.max(axis=1) / odds.sum(axis=1)
            for j, i in enumerate(part):
                gap = loss[j, order[j, 1]] - loss[j, order[j, 0]] if len(self.langs) > 1 else 1.0
                out[i] = (self.langs[order[j, 0]], float(prob[j]), bool(gap <= self.doubt * self.trust.sum()))
        return out


def doubt_of(gaps: np.ndarray, right: np.ndarray) -> float:
    """The distance up to which flagging gains most: wrong predictions flagged less right ones. Ties go to the smaller one; no
    gain is 0, so that only equal losses are flagged."""
    order = np.argsort(gaps, kind="stable")
    gain = np.cumsum(np.where(right[order], -1, 1))
    gain = np.where(np.append(gaps[order][1:] != gaps[order][:-1], True), gain, -len(gaps))[: len(gaps)]  # equal gaps go together
    return float(gaps[order][int(np.argmax(gain))]) if len(gaps) and gain.max() > 0 else 0.0


def fit(texts: list[str], langs: list[str], seed: int = 5, rounds: int = 80) -> Model:
    """Regularised logistic regression of every bit at once, by accelerated gradient steps; ``doubt`` from a model of three
    quarters of the rows on the others."""
    names = sorted(set(langs))
    code = codewords(len(names))
    rng = np.random.default_rng(seed)
    rows, y, held = [], [], []
    for k, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        cuts = [text]
        for size in (12, 40, 120):
            if len(text) > size:
                at = int(rng.integers(0, len(text) - size))
                cuts.append(text[at : at + size])
        for cut in cuts:
            if LETTER.search(cut):
                rows.append(features(cut))
                y.append(names.index(lang))
                held.append(k % 4 == 0)
    if not rows:
        return Model([], np.ones((0, 1)), np.zeros((DIM, 1), np.float32), np.zeros(1), np.ones(1))
    x, y, held = np.stack(rows), np.array(y), np.array(held)
    doubt = 0.0
    if len(names) > 1 and held.any() and len(set(y[~held])) == len(names):
        first = _fitted(x[~held], y[~held], names, code, rounds)
        loss = np.sort(first.losses(x[held]), axis=1)
        doubt = doubt_of((loss[:, 1] - loss[:, 0]) / first.trust.sum(), first.losses(x[held]).argmin(axis=1) == y[held])
    model = _fitted(x, y, names, code, rounds)
    model.doubt = doubt
    return model


def _fitted(x: np.ndarray, y: np.ndarray, names: list[str], code: np.ndarray, rounds: int) -> Model:
    target = code[y].astype(np.float32)
    share = np.bincount(y, minlength=len(names))[y].astype(np.float32)
    weight = (1 / share)[:, None] / len(names)  # languages count alike
    w, b = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    look_w, look_b, t = w, b, 1.0
    for _ in range(rounds):
        pull = weight * target / (1 + np.exp(np.clip(target * (x @ look_w + look_b), -30, 30)))
        new_w, new_b = look_w + 8.0 * (x.T @ pull - 1e-5 * look_w), look_b + 2.0 * pull.sum(axis=0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look_w, look_b = new_w + (t - 1) / t_next * (new_w - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new_w, new_b, t_next
    right = (weight * ((x @ w + b) * target > 0)).sum(axis=0)
    return Model(names, code, w, b, np.clip(2 * right - 1, 0.05, 1.0))


def training_rows(docs: DataFrame, per_lang: int, held_out: Column) -> list:
    """(text, lang) of at most ``per_lang`` labelled rows a language, the first by a hash of id and text."""
    pool = docs.filter(~held_out & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    pool = pool.select("text", "lang", "doc_id", F.xxhash64("doc_id", "text").alias("hash"))
    draw = F.pmod("hash", F.lit(1_000_000))  # a bound on what is sorted
    rows = []
    for lang, n in sorted(counts.items()):
        share = min(1_000_000, int(1.3 * per_lang / n * 1_000_000) + 1)
        rows += pool.filter((F.col("lang") == lang) & (draw < share)).orderBy(draw, "hash", "doc_id", "text").limit(per_lang).collect()
    return rows


def held_out_rows() -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_lang: int = 150, held_out: Column | None = None) -> Model:
    rows = training_rows(docs, per_lang, held_out_rows() if held_out is None else held_out)
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x bits, whatever the corpus

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value.predict(column(batch, "text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
            names=["doc_id", "lang_pred", "score", "ambiguous"],
        )

    return map_batches(docs.select("doc_id", "text"), predict, "doc_id long, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that have a language and are not ambiguous, with their columns as they are."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value.predict(column(batch, "text").to_pylist())
        return batch.filter(pa.array([lang != UNKNOWN and not ambiguous for lang, _, ambiguous in found], pa.bool_()))

    return map_batches(docs, keep, schema_of(docs))


def predict_all(docs: DataFrame, per_lang: int = 150) -> DataFrame:
    """Learn from the rows that are not held out, predict every row."""
    return identify(docs, train(docs, per_lang)).select("doc_id", held_out_rows().alias("held_out"), "lang_pred", "score", "ambiguous")

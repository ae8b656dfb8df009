"""How sources of a language differ in the terms they use: an audit over all documents, in whole numbers.

Terms are runs of letters (ASCII letters and everything beyond ASCII), A-Z lower-cased. A language keeps the terms of at
least ``least`` of its documents. Each group (language, source), and each language, gives each kept term a share in parts of
10^9, counts raised by one; two groups differ by the sum of (p - q)^2 / q, rounded down term by term.

Tasks count terms of their documents, a row for each group and term, and hand those to the task of that (language, term), sorted. There
terms are numbered in chunks: the kept terms of a chunk are a sorted array, a row's id is found in it by searchsorted, and counts of a
group are one bincount over ids. A chunk is one row of a scratch table, with sparse vectors of all its sources. Totals
by group and language, which shares need, come from the chunks; then each chunk is compared alone, as dense vectors of a
bounded number of cells, and what a task finds is added up before it is shuffled. Ids ascend with the terms' UTF-8 bytes, so ties among a
chunk's terms are in order already.

What meets in one place: for a term, one row a source and counting task; for a language, its list of sources (S), which is broadcast
only if all lists are small, by count; results have S * (S - 1) rows a language, as the audit asks for them.

Defined results: null text, lang and source count as empty strings; a group without terms is compared too, with
counts of zero; languages without kept terms give pairs of value 0 and no terms; repeated rows are documents of their own, whatever
their doc_id; a language of one source has no pairs; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import column, hinted, materialize, small_batches
from graphloom.session import ship

LEAST, TOP, PARTS = 3, 200, 10**9
#: Counted pairs of group and term, and terms, that a counting task holds at most before it hands them on.
PAIRS, TERMS = 1 << 21, 1 << 19
#: Rows that make a chunk of sorted terms, cells of dense vectors at a time, and the largest table of sums a task keeps.
CHUNK_ROWS, CELLS, KEPT_SUMS = 1 << 16, 1 << 20, 1 << 22

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts in order, and the row of each."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    folded = pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_FOLD)), None, 0, texts.offset)
    lists = pc.ascii_split_whitespace(folded)
    flat, rows = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.not_equal(flat, "")
    return flat.filter(some), rows.filter(some).to_numpy()


class Counter:
    """Occurrences and documents by group and term, in arrays that are merged when they grow."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, batch: pa.RecordBatch) -> None:
        langs, sources = (pc.fill_null(column(batch, c), "").to_pylist() for c in ("lang", "source"))
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)], np.int64)
        flat, row = terms_of(column(batch, "text"))
        if not len(flat):
            return
        coded = flat.dictionary_encode()
        width = len(coded.dictionary)
        pairs, times = np.unique(row * width + coded.indices.to_numpy(), return_counts=True)  # of documents and terms
        number = np.array([self.terms.setdefault(t, len(self.terms)) for t in coded.dictionary.to_pylist()], np.int64)
        self.parts.append((group[pairs // width] << 32 | number[pairs % width], times, np.ones(len(pairs), np.int64)))
        self.held += len(pairs)
        if self.held > PAIRS:
            self.merge()

    def merge(self) -> None:
        key, times, docs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        key, at = np.unique(key, return_inverse=True)
        self.parts = [(key, *(np.bincount(at, x, len(key)).astype(np.int64) for x in (times, docs)))]
        self.held = len(key)

    def full(self) -> bool:
        return self.held > PAIRS // 2 and len(self.parts) == 1 or len(self.terms) > TERMS

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Rows of all pairs, and one without a term for each group."""
        names = list(self.groups)
        key, times, docs = np.arange(len(names)) << 32 | len(self.terms), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        if self.parts:
            self.merge()
            key, times, docs = (np.concatenate(x) for x in zip((key, times, docs), self.parts[0], strict=True))
        words = pa.array([*self.terms, ""], pa.string())
        lang, source = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
        for k in range(0, len(key), CHUNK_ROWS):
            part = slice(k, k + CHUNK_ROWS)
            group, term = pa.array(key[part] >> 32), pa.array(key[part] & 0xFFFFFFFF)
            cells = [lang.take(group), source.take(group), words.take(term), pa.array(times[part]), pa.array(docs[part])]
            yield pa.RecordBatch.from_arrays(cells, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents by group and term, in parts to be added up; term '' marks a group."""
    small_batches(docs.sparkSession)
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            if batch.num_rows:
                counter.add(batch)
            if counter.full():
                yield from counter.batches()
                counter = Counter()
        yield from counter.batches()

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where a sorted table's rows differ from the row before."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


CHUNKS = "lang string, kept long, terms array<string>, sources array<string>, sums array<long>, source array<int>, id array<int>, n array<long>"


def chunk_of(lang: str, rows: pa.Table, least: int) -> dict:
    """The chunk of complete terms of one language, sorted."""
    starts = _starts(rows["term"].combine_chunks())
    docs, times = rows["docs"].to_numpy(), rows["n"].to_numpy()
    words = rows["term"].take(pa.array(starts)).combine_chunks()
    good = (np.add.reduceat(docs, starts) >= least) & pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    coded = rows["source"].combine_chunks().dictionary_encode()
    place = np.flatnonzero(np.repeat(good, np.diff(np.append(starts, len(docs)))))
    ids = np.searchsorted(starts[good], place, side="right") - 1  # the array of kept terms begins at these rows
    kept, names = int(good.sum()), len(coded.dictionary)
    key, at = np.unique(coded.indices.to_numpy()[place].astype(np.int64) * max(kept, 1) + ids, return_inverse=True)
    n = np.bincount(at, times[place], len(key)).astype(np.int64)
    source = key // max(kept, 1)
    return {
        "lang": lang, "kept": kept, "terms": words.filter(pa.array(good)), "sources": coded.dictionary, "sums": np.bincount(source, n, names).astype(np.int64),
        "source": source.astype(np.int32), "id": (key % max(kept, 1)).astype(np.int32), "n": n,
    }


def _added(rows: pa.Table) -> pa.Table:
    """Rows of one term, added up by source."""
    names = ["lang", "source", "term"]
    out = rows.group_by(names).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select([*names, "n_sum", "docs_sum"]).rename_columns([*names, "n", "docs"])


def encode(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """Chunks of the kept terms with the counts of all sources that have them; all sources of a language are named in some chunk."""
    order = ["lang", "term"]

    def cut(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        starts = np.append(_starts(rows["lang"].combine_chunks()), rows.num_rows)
        found = [chunk_of(rows["lang"][int(a)].as_py(), rows.slice(a, b - a), least) for a, b in zip(starts, starts[1:], strict=False)]
        lists = {k: pa.array([f[k] for f in found], pa.list_(pa.string())) for k in ("terms", "sources")}
        numbers = {k: pa.array([f[k] for f in found], pa.list_(t)) for k, t in (("sums", pa.int64()), ("source", pa.int32()), ("id", pa.int32()), ("n", pa.int64()))}
        cells = {"lang": pa.array([f["lang"] for f in found]), "kept": pa.array([f["kept"] for f in found])} | lists | numbers
        yield pa.RecordBatch.from_pydict(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK_ROWS:
                rows = pa.Table.from_batches(held)
                last = int(_starts(*(rows[c].combine_chunks() for c in order))[-1])  # the last term may go on
                yield from cut(rows.slice(0, last))
                rest = _added(rows.slice(last)).combine_chunks()
                held, size = rest.to_batches(), rest.num_rows
        if held:
            yield from cut(pa.Table.from_batches(held))

    return counts.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, CHUNKS)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * count / total), by long division, three digits at a time: exact for totals up to 9 * 10^15."""
    out, rest = np.divmod(count, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return 1 + out


class Comparison:
    """Sums and best terms of one language's groups over the chunks of a task."""

    def __init__(self, lang: str, names: list[str], totals: np.ndarray, kept: int, top: int) -> None:
        self.lang, self.names, self.totals, self.kept, self.top = lang, names, totals, kept, top
        self.at = {s: i for i, s in enumerate(names)}
        self.sums = np.zeros((len(names), len(names)), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in names]

    def add(self, terms: pa.Array, sources: list[str], source: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        group = np.array([self.at[s] for s in sources], np.int64)[source]
        order = np.argsort(ids, kind="stable")
        group, ids, n = group[order], ids[order], n[order]
        width = max(1, CELLS // len(self.names))
        for k in range(0, len(terms), width):
            part = slice(*np.searchsorted(ids, [k, k + width]))
            counts = np.zeros((len(self.names), min(width, len(terms) - k)), np.int64)
            counts[group[part], ids[part] - k] = n[part]
            p = share(counts + 1, (self.totals + self.kept)[:, None])
            q = share(counts.sum(axis=0) + 1, np.array(self.totals.sum() + self.kept))
            for i, own in enumerate(p):
                self.sums[i] += ((own - p) ** 2 // p).sum(axis=1)
            for i, (own, c) in enumerate(zip(p, counts, strict=True)):
                over = np.flatnonzero((c > 0) & (own > q))
                value = (own[over] - q[over]) ** 2 // q[over]
                first = np.argsort(-value, kind="stable")[: self.top]  # ids ascend, so ties stay in order
                words = terms.take(pa.array(over[first] + k)).to_pylist()
                both = self.best[i] + [(-int(v), w.encode()) for v, w in zip(value[first], words, strict=True)]
                self.best[i] = sorted(both)[: self.top]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for i, name in enumerate(self.names):
            items = [*(s for s in self.names if s != name), *(w.decode() for _, w in self.best[i])]
            values = [*np.delete(self.sums[i], i).tolist(), *(-v for v, _ in self.best[i])]
            part = np.repeat(["pair", "term"], [len(self.names) - 1, len(self.best[i])])
            cells = [pa.array([c] * len(items), pa.string()) for c in (self.lang, name)]
            cells += [pa.array(part.tolist(), pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, names=["lang", "source", "part", "item", "value"])


def compare(chunks: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value of each pair of a language's sources, in parts to be added up, and of the best terms of each
    task's chunks. ``chunks`` is materialised."""
    listed = chunks.select("lang", "kept", F.explode(F.arrays_zip(F.col("sources").alias("s"), F.col("sums").alias("n"))).alias("x"))
    groups = listed.groupBy("lang", F.col("x.s").alias("s")).agg(F.sum("x.n").alias("n"))
    kept = chunks.groupBy("lang").agg(F.sum("kept").alias("all_kept"))
    lists = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("groups")).join(kept, "lang")
    lists = materialize(lists.select("lang", "all_kept", F.col("groups.s").alias("names"), F.col("groups.n").alias("totals")), "groups")
    most = lists.agg(F.max(F.size("names"))).first()[0] or 0
    joined = chunks.drop("kept").join(hinted(lists, 64 * (most + 1)), "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Comparison] = {}
        for batch in batches:
            get = {c: column(batch, c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                lang = get["lang"][i].as_py()
                own = known.get(lang)
                if own is None:
                    own = known[lang] = Comparison(lang, get["names"][i].as_py(), get["totals"][i].values.to_numpy(), get["all_kept"][i].as_py(), top)
                own.add(get["terms"][i].values, get["sources"][i].as_py(), *(get[c][i].values.to_numpy() for c in ("source", "id", "n")))
                if sum(c.sums.size for c in known.values()) > KEPT_SUMS:
                    for c in known.values():
                        yield from c.batches()
                    known = {}
        for c in known.values():
            yield from c.batches()

    ship(chunks.sparkSession)
    return joined.mapInArrow(run, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its differences from the language's other sources (``pair``) and the
    ``top`` terms that it uses more than its language does (``term``)."""
    found = compare(materialize(encode(term_counts(docs), least), "chunks"), top)
    added = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return added.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= top))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
filled AS (SELECT grp.lang, grp.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM grp JOIN kept k USING (lang) LEFT JOIN c ON c.lang = grp.lang AND c.source = grp.source AND c.term = k.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER g + count(*) OVER g)::HUGEINT AS p FROM filled WINDOW g AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM filled GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER g + count(*) OVER g)::HUGEINT AS q FROM whole WINDOW g AS (PARTITION BY lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
both_parts AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs
          UNION ALL SELECT lang, source, 'term', item, value::BIGINT FROM terms)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_parts) x WHERE part = 'pair' OR rank <= 200
"""

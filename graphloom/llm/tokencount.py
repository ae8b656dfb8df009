"""Token counts with the exact count at every prefix.

The tokenizer merges within units only: a run of spaces with the word after it (a line feed starts a unit too), so
count(prefix) = counts of the units before + count of the begun unit's prefix. A dynamic program fills a unit's table, the
count at each of its characters: the last token of a prefix is the longest vocabulary piece that ends there and that the
library keeps next to the last token of the shorter prefix (byte-pair merges make that token unique), and
count[i] = count[i - its length] + 1. ``PrefixCounts`` of a text holds its units' tables and their running sums: together the
count at every prefix, from which totals, limits, truncation and budgets are read. The library is asked about pairs of pieces
only; no text is encoded.

Tables of distinct units are kept in a worker's bounded memory, one byte a character where counts are below 256.

Defined results: a null text counts as empty (0 bytes, 0 tokens); an empty text has 0 tokens; a text of one very
long word is one unit; repeated rows are counted one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import column, map_batches, small_batches
from graphloom.llm.vocab import _LOADED, CACHE_WORDS, Memory, tokenizer_path

MODEL, LIMIT = "piece_bpe_32k.model", 4096
SPACE = "▁"


class UnitCounts(Memory):
    """A unit, as ``split_units`` gives it, -> the token counts of its prefixes, the empty one first; the mark of a unit that
    has one is its first character."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        spanning = [p for p in pieces if SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n")]
        if spanning or len(self.library.encode("\n", num_threads=1)) != 2 or len(self.library.encode("", num_threads=1)):
            raise ValueError(f"this model merges across units: {spanning[:3]}")
        self.pieces = {p for i, p in enumerate(pieces) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))}
        self.reach: dict[str, int] = {}  # a character -> the longest piece that ends with it
        for p in self.pieces:
            self.reach[p[-1]] = max(self.reach.get(p[-1], 0), len(p))
        self.fits: dict[tuple[str, str], bool] = {}

    def _pair(self, key: tuple[str, str]) -> bool:
        """Whether the library, given these two pieces' characters, keeps the two pieces."""
        if len(self.fits) >= CACHE_WORDS:
            self.fits.clear()
        got = self.library.encode("\n" + "".join(key).replace(SPACE, " "), out_type=str, num_threads=1)[2:]
        self.fits[key] = fits = got == [*key]
        return fits

    def ask(self, unit: str) -> bytes | array:
        s = unit if unit.startswith("\n") else SPACE + unit.replace(" ", SPACE)
        counts, last, pieces, fits, reach = [0], [""], self.pieces, self.fits, self.reach
        for i in range(1, len(s) + 1):
            for a in range(max(0, i - reach.get(s[i - 1], 0)), i):
                piece = s[a:i]
                if piece not in pieces:
                    continue
                left = last[a]
                fit = True if not left else fits.get((left, piece))
                if fit or (fit is None and self._pair((left, piece))):
                    counts.append(counts[a] + 1)
                    last.append(piece)
                    break
            else:  # a character outside the vocabulary: its bytes, which merge with nothing
                counts.append(counts[i - 1] + len(s[i - 1].encode("utf-8", "surrogatepass")))
                last.append("")
        return bytes(counts) if counts[-1] < 256 else array("I", counts)

    def total(self, text: str | None) -> int:
        """Tokens of a whole text."""
        return sum(self[u][-1] for u in split_units(text or ""))


def unit_counts(path: str) -> UnitCounts:
    key = ("counts", path)
    if key not in _LOADED:
        _LOADED[key] = UnitCounts(path)
    return _LOADED[key]  # type: ignore[return-value]


_RUNS = re.compile(r" +[^ \n]*|\n[^ \n]*")


def split_units(text: str) -> list[str]:
    """Units of a text. Each stands for one space (the library's mark) and itself; one that begins with a line
    feed stands for itself alone. Further spaces of a run are at the unit's start."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " ":
        return [u if u[0] == "\n" else u[1:] for u in _RUNS.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


class PrefixCounts:
    """Exact token counts of every prefix of one text: the tables of its units and their running sums."""

    def __init__(self, text: str | None, path: str) -> None:
        units = split_units(text or "")
        self.tables = list(map(unit_counts(path).__getitem__, units))
        # Characters of the text before each unit; the mark before the first unit is not one of them.
        self.ends = list(accumulate((len(u) + (not u.startswith("\n")) for u in units), initial=-1))
        self.sums = list(accumulate((t[-1] for t in self.tables), initial=0))

    @property
    def total(self) -> int:
        return self.sums[-1]

    def fits(self, budget: int) -> bool:
        """Whether the whole text is within ``budget`` tokens."""
        return self.sums[-1] <= budget

    def at(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters."""
        if chars <= 0 or not self.tables:
            return 0
        i = bisect_right(self.ends, chars) - 1
        if i >= len(self.tables):
            return self.total
        return self.sums[i] + self.tables[i][chars - self.ends[i]]

    def longest_within(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens. Counts of prefixes may fall where a merge ends, so all
        units that a prefix within the budget can end in are read, from the last one."""
        if self.fits(budget):
            return max(0, self.ends[-1])
        for i in range(len(self.tables) - 1, -1, -1):
            if self.sums[i] <= budget:
                for j in range(len(self.tables[i]) - 1, 0, -1):
                    if self.sums[i] + self.tables[i][j] <= budget:
                        return max(0, self.ends[i] + j)
        return 0


def counted(batch: pa.RecordBatch, path: str, limit: int) -> pa.RecordBatch:
    n_bytes, n_tokens, over = [], [], []
    for text in column(batch, "text").to_pylist():
        table = PrefixCounts(text, path)
        n_bytes.append(len(text.encode("utf-8", "surrogatepass")) if text else 0)
        n_tokens.append(table.at(len(text)) if text else 0)
        over.append(not table.fits(limit))
    return pa.RecordBatch.from_arrays(
        [column(batch, "doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_())],
        names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
    )


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, both read from the text's prefix table."""
    path = path or tokenizer_path(MODEL)
    small_batches(docs.sparkSession)
    return map_batches(docs.select("doc_id", "text"), lambda b: counted(b, path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_tables(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ``ends`` (characters before each unit border) and ``counts`` (tokens of that prefix)."""
    path = path or tokenizer_path(MODEL)
    small_batches(docs.sparkSession)

    def tables(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [PrefixCounts(t, path) for t in column(batch, "text").to_pylist()]
        kind = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array([[max(0, e) for e in f.ends] for f in found], kind), pa.array([f.sums for f in found], kind)],
            names=["doc_id", "ends", "counts"],
        )

    return map_batches(docs.select("doc_id", "text"), tables, "doc_id long, ends array<int>, counts array<int>")


def truncate(docs: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """doc_id, the longest prefix of the text within ``budget`` tokens, and its exact count."""
    path = path or tokenizer_path(MODEL)
    small_batches(docs.sparkSession)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, kept, counts = column(batch, "text").to_pylist(), [], []
        for text in texts:
            table = PrefixCounts(text, path)
            n = table.longest_within(budget)
            kept.append((text or "")[:n])
            counts.append(table.at(n))
        return pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array(kept, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "text", "n_tokens"]
        )

    return map_batches(docs.select("doc_id", "text"), cut, "doc_id long, text string, n_tokens long")

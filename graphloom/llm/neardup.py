"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct word shingles; its signature is ``CHUNKS * SLOTS`` min-hashes of 16 bits. The
distance of two signatures is the number of slots that differ. Cut into CHUNKS chunks, two signatures within
CHUNKS * (ERRORS + 1) - 1 slots have a chunk with at most ERRORS = 1 differing slot (pigeonhole). Each chunk is
indexed under every key that leaves one of its slots out, so such a pair shares a key: no pair within that distance
is missed. A pair at similarity 0.8 agrees in a chunk but for one slot with probability 0.655, so it escapes all
ten chunks once in 40,000 times. Every candidate link is confirmed on the full sets.

Work on a hot bucket does not go with its square. Documents with the same set are one node. Of each bucket a node first
meets only the hub, the node that shares most keys with others; confirmed meetings merge most of a group. What is left are
nodes that share a key but not yet a component. For those the exact prefix and position rules apply: with shingles from
rare to frequent, sets with 100 |A & B| >= t |A | B| share one of the first |A| - ceil(t |A| / 100) + 1 of each, and
behind the first common one enough are left in both; a shingle that occurs once links nothing. Only nodes outside the
bucket's largest component look for partners.

Defined results: null text, text without words: the empty set, linked with nothing; fewer words than a shingle has:
the whole sequence is the one shingle. Rows that share a doc_id are one node, whatever their texts. A null doc_id
takes no part in links: component_id null, kept true. Empty tables and other columns do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import (
    U64, column, encoded, gram_hashes, hinted, join_groups, map_batches, materialize, mix64, semi_by_id, small_batches, word_hashes,
)
from graphloom.llm.graph import components

CHUNKS, SLOTS, ERRORS = 10, 6, 1
#: Pairs that one copy of a text is compared in.
PAIRS_A_COPY = 256
_rng = np.random.default_rng(7)
_MULTIPLIERS = _rng.integers(1, 2**63, CHUNKS * SLOTS, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_SLOT_SALT = _rng.integers(1, 2**63, CHUNKS * SLOTS, dtype=np.int64).astype(U64)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z folded."""
    hashes, first = word_hashes(encoded(texts), lower=True)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        words = hashes[a:b]
        if len(words) >= size:
            out.append(np.unique(gram_hashes(words, size)))
        elif len(words):  # the sequence as one: its length keeps it apart from real shingles
            out.append(mix64(gram_hashes(words, len(words)) + U64(len(words))))
        else:
            out.append(words)
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """16-bit min-hashes, one for each multiplier."""
    low = np.full(len(_MULTIPLIERS), ~U64(0))
    for k in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[k : k + 2048, None] * _MULTIPLIERS[None, :]).min(axis=0), out=low)
    return (mix64(low) & U64(0xFFFF)).astype("<u2")


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of the set."""
    a = mix64(shingles ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
    b = mix64(shingles + U64(0x14057B7EF767814F)).sum(dtype=U64)
    return int(np.int64(a)), int(np.int64(b))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (null for the empty set) and the signature of every row."""
    small_batches(docs.sparkSession)

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(column(batch, "text").to_pylist(), shingle)
        prints = [_fingerprint(s) if len(s) else (None, None) for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                column(batch, "doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "fp1", "fp2", "sig"],
        )

    return map_batches(docs.select("doc_id", "text"), sketch, "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary")


def index_keys(nodes: DataFrame) -> DataFrame:
    """key, node: for each chunk, a key for every slot left out."""

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), "<u2").reshape(-1, CHUNKS, SLOTS).astype(U64)
        mixed = mix64(sig * U64(0x9E3779B97F4A7C15) ^ _SLOT_SALT.reshape(1, CHUNKS, SLOTS))
        out = mix64(mixed.sum(axis=2, keepdims=True) - mixed + _SLOT_SALT.reshape(1, CHUNKS, SLOTS))
        node = np.repeat(np.asarray(column(batch, "node")), CHUNKS * SLOTS)
        return pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(node)], names=["key", "node"])

    return map_batches(nodes.select("node", "sig"), keys, "key long, node long")


def confirm(pairs: DataFrame, docs: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """Of ``pairs`` (a, b; materialised, distinct) those whose full sets are similar enough. Only texts of documents
    in pairs are moved; the text of a ``b`` in many pairs goes to as many places as these fill, once to each."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    texts = semi_by_id(docs.select("doc_id", "text"), ids, ["doc_id"])
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    shared = materialize(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    salts = F.ceil(F.col("n") / PAIRS_A_COPY)
    copies = right.join(shared, "b").select("b", "text_b", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    dealt = join_groups(pairs, shared, "b", "n").select("a", "b", F.pmod(F.xxhash64("a"), salts).alias("salt"))
    both = dealt.join(left, "a").join(copies, ["b", "salt"])

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts_a, texts_b = column(batch, "text_a").to_pylist(), column(batch, "text_b").to_pylist()
        distinct = list(dict.fromkeys([*texts_a, *texts_b]))
        sets = dict(zip(distinct, shingle_sets(distinct, shingle), strict=True))
        good = []
        for x, y in zip(texts_a, texts_b, strict=True):
            a, b = sets[x], sets[y]
            common = len(np.intersect1d(a, b, assume_unique=True))
            good.append(common > 0 and 100 * common >= threshold * (len(a) + len(b) - common))
        return pa.RecordBatch.from_arrays([column(batch, n).filter(pa.array(good)) for n in ("a", "b")], names=["a", "b"])

    return map_batches(both, check, "a long, b long").distinct()


def _rare_pairs(rows: DataFrame, docs: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """Candidate pairs among nodes that share a bucket but not a component, by the prefix rule.

    ``rows``: node, comp, seeks (outside the largest component of some shared bucket).
    """
    ids = materialize(rows.select(F.col("node").alias("doc_id")).distinct(), "open-ids")
    texts = semi_by_id(docs.select("doc_id", "text"), ids, ["doc_id"])

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(column(batch, "text").to_pylist(), shingle)
        n = np.array([len(s) for s in sets], np.int64)
        node = np.repeat(np.asarray(column(batch, "doc_id")), n)
        every = np.concatenate(sets).view(np.int64) if n.sum() else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(every), pa.array(node), pa.array(np.repeat(n, n))], names=["shingle", "node", "size"])

    # A node whose doc_id has several texts: the union of its shingles, with the smallest size, keeps the rule safe.
    each = map_batches(texts, explode, "shingle long, node long, size long").groupBy("shingle", "node").agg(F.min("size").alias("size"))
    each = materialize(each, "open-shingles")
    frequent = materialize(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "open-counts")
    counted = join_groups(each, frequent, "shingle", "df", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    # At least this many common shingles with a set of size n; with any set at all: as for one of the size threshold % of it.
    enough = lambda x, y: F.ceil(threshold * (x + y) / F.lit(100.0 + threshold) - F.lit(1e-9))
    need = F.ceil(F.col("size") * threshold / F.lit(100.0) - F.lit(1e-9))
    at = F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle"))
    total = F.count(F.lit(1)).over(Window.partitionBy("node"))
    placed = counted.select("shingle", "node", "df", "size", at.alias("at"), total.alias("total")).filter((F.col("at") <= F.col("total") - need + 1) & (F.col("df") > 1))
    known = materialize(placed.join(rows, "node").select("shingle", "node", "comp", "seeks", "size", (F.col("total") - F.col("at") + 1).alias("left")), "prefixes")
    seek = known.filter("seeks").select("shingle", *(F.col(c).alias(f"{c}_x") for c in ("node", "comp", "size", "left")))
    # The first common shingle of a similar pair has enough shingles behind it in both sets.
    fits = F.least("left", "left_x") >= enough(F.col("size"), F.col("size_x"))
    pairs = seek.join(known.hint("merge"), (seek["shingle"] == known["shingle"]) & (F.col("comp") != F.col("comp_x")) & fits)
    return pairs.select(F.greatest("node_x", "node").alias("a"), F.least("node_x", "node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text): documents are linked if
    100 * intersection >= threshold * union of their sets of ``shingle``-word shingles."""
    docs = docs.select("doc_id", "text")
    drawn = materialize(sketches(docs, shingle), "sketches")
    usable = drawn.filter("fp1 IS NOT NULL AND doc_id IS NOT NULL")
    nodes = materialize(usable.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"), F.max("sig").alias("sig")), "nodes")
    member = materialize(usable.select("doc_id", "fp1", "fp2").distinct().join(nodes.drop("sig"), ["fp1", "fp2"]), "members")

    # Buckets of two nodes or more. A node first meets the hub of its buckets: the node that meets most others, which in a
    # group of copies is the one that they were made from, or close to it.
    keys = materialize(index_keys(nodes), "keys")
    sizes = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    buckets = materialize(join_groups(keys, sizes, "key", "n"), "buckets")
    degree = buckets.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = buckets.join(degree, "node").select("key", "node", F.struct("degree", (-F.col("node")).alias("back")).alias("rank"))
    hubs = materialize(ranked.groupBy("key").agg(F.max("rank").alias("hub"), F.count(F.lit(1)).alias("n")), "hubs")
    met = join_groups(buckets.drop("n"), hubs, "key", "n").filter(F.col("node") != -F.col("hub.back"))
    nearest = met.groupBy(F.col("node").alias("a")).agg(F.max("hub").alias("hub")).select("a", (-F.col("hub.back")).alias("b"))
    links = materialize(confirm(materialize(nearest, "nearest"), docs, shingle, threshold), "confirmed")
    # Rows with one doc_id and different sets are one node.
    lowest = member.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("top")).filter("b < top").drop("top")
    same = member.join(lowest, "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b")
    links = materialize(links.unionByName(same), "links-1")
    roots = components(links)

    # Pairs that share a bucket but not a component.
    named = buckets.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    named = materialize(named.distinct(), "named")
    parts = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"))
    mixed = materialize(mixed.filter("comps > 1").select("key", "n", F.col("top.comp").alias("largest")), "mixed")
    open_rows = join_groups(named, mixed, "key", "n").groupBy("node", "comp").agg(F.max(F.col("comp") != F.col("largest")).alias("seeks"))
    open_rows = materialize(open_rows, "open")
    if not open_rows.isEmpty():
        pairs = materialize(_rare_pairs(open_rows, docs, shingle, threshold), "rare-pairs")
        more = confirm(pairs, docs, shingle, threshold)
        links = materialize(links.unionByName(more), "links-2")
        roots = components(links)

    placed = member.join(roots, "node", "left").select("fp1", "fp2", F.coalesce("root", "node").alias("root")).distinct()
    out = drawn.select("doc_id", "n_shingles", "fp1", "fp2").join(placed, ["fp1", "fp2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def one_of_each(docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest doc_id, its columns as they are; of rows
    that share this doc_id, one. Rows with a null doc_id stay."""
    verdict = near_duplicates(docs, shingle, threshold)
    gone = materialize(verdict.filter("NOT kept").select("doc_id").distinct(), "gone")
    kept = docs.join(hinted(gone, 64), "doc_id", "left_anti").select(docs.columns)
    twice = materialize(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    single = kept.join(hinted(twice, 64), "doc_id", "left_anti").select(docs.columns)
    repeated = kept.join(hinted(twice, 64), "doc_id", "left_semi").withColumn("__graphloom_rank", rank)
    return single.unionByName(repeated.filter("__graphloom_rank = 1").select(docs.columns))

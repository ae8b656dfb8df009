"""Resolve the ends of call edges to project functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import UNKNOWN_SUFFIX


def distinct_defs(defs: DataFrame) -> DataFrame:
    """One definition for each key: the first by file, line and name."""
    w = Window.partitionBy("function_key").orderBy("file", "line", "function")
    return defs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def unique_names(defs: DataFrame) -> DataFrame:
    """name -> key for names with exactly one key."""
    found = defs.groupBy("function").agg(F.min("function_key").alias("only_key"), F.max("function_key").alias("other_key"))
    return found.filter("only_key = other_key").drop("other_key")


def dedupe_edges(edges: DataFrame, per_unit: bool = True) -> DataFrame:
    """Distinct call sites. Across units (export) a header's site stays once for each unit."""
    keys = ["loc", "caller_key", "callee_key"]
    return edges.dropDuplicates((["translation_unit"] if per_unit else []) + keys)


def inferred_defs(edges: DataFrame) -> DataFrame:
    """Definitions implied by the callers of edges, for when none are given."""
    known = edges.filter((F.col("caller_key") != "") & ~F.col("caller_key").endswith(UNKNOWN_SUFFIX) & (F.col("caller_key") != "<unknown>"))
    return known.groupBy(F.col("caller_key").alias("function_key")).agg(
        F.min("caller").alias("function"), F.lit("").alias("file"), F.lit(0).alias("line")
    )


def resolve_end(edges: DataFrame, defs: DataFrame, side: str) -> DataFrame:
    """``edges`` with <side>_project_key and <side>_resolution (resolved_key, name_fallback or unresolved).

    An exact key wins. A key that is empty or ends in "@<unknown>" falls back to the name if one function has it.
    Two equi-joins against narrow tables; whether they are broadcast is left to the optimizer's sizes.
    """
    key, name = F.col(f"{side}_key"), side
    by_key = defs.select(F.col("function_key").alias("_exact")).distinct()
    by_name = unique_names(defs).select(F.col("function").alias("_name"), F.col("only_key").alias("_only"))
    open_key = (key == "") | key.isNull() | key.endswith(UNKNOWN_SUFFIX)
    joined = edges.join(by_key, key == F.col("_exact"), "left").join(by_name, (F.col(name) == F.col("_name")) & open_key, "left")
    kind = F.when(F.col("_exact").isNotNull(), "resolved_key").when(F.col("_only").isNotNull(), "name_fallback").otherwise("unresolved")
    return (
        joined.withColumn(f"{side}_project_key", F.coalesce("_exact", "_only"))
        .withColumn(f"{side}_resolution", kind)
        .drop("_exact", "_name", "_only")
    )


def resolve_edges(edges: DataFrame, defs: DataFrame) -> DataFrame:
    return resolve_end(resolve_end(edges, defs, "caller"), defs, "callee")


def project_filter(rows: DataFrame, roots: list[str], column: str = "file") -> DataFrame:
    """Rows whose file is under one of the roots; a plain prefix disjunction that reaches the scan."""
    if not roots:
        return rows
    hit = F.lit(False)
    for root in roots:
        root = root.rstrip("/")
        hit = hit | (F.col(column) == root) | F.col(column).startswith(root + "/")
    return rows.filter(hit)


#: Places that are never a project.
SYSTEM_PREFIXES = ("/usr/", "/lib/", "/lib64/", "/opt/", "/System/", "/Library/")
TOO_WIDE = ("/", "/home", "/Users")


def outside_system(rows: DataFrame, column: str = "file") -> DataFrame:
    hit = F.lit(False)
    for p in SYSTEM_PREFIXES:
        hit = hit | F.col(column).startswith(p)
    return rows.filter(~hit)


def common_root(rows: DataFrame, column: str = "file") -> str | None:
    """The deepest folder all files share, unless it is too wide to mean a project. Smallest and largest path decide."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None:
        return None
    a, b = low.split("/")[:-1], high.split("/")[:-1]
    shared = []
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        shared.append(x)
    root = "/".join(shared) or "/"
    return None if root in TOO_WIDE else root

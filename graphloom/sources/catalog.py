"""API catalogs, header groups and scored-row files."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.schemas import CATALOG, HELPERS


def load_catalog(spark: SparkSession, path: str, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog of api, header, grp; helpers of kind, pattern, is_regex; thin aliases of api) from a YAML file.

    ``categories`` maps a header to a list, or to a mapping with ``apis``. A header's group comes from ``groups`` (header, grp);
    without one the header is its own group. Names under ``libc`` and ``system_calls`` belong to groups of those names
    unless categorised. A catalog is a few thousand rows of configuration, read on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    rows: list[tuple[str, str, str]] = []
    for header, value in (data.get("categories") or {}).items():
        names = value.get("apis", []) if isinstance(value, dict) else value or []
        rows += [(str(n), str(header), str(header)) for n in names]
    for group in ("libc", "system_calls"):
        names = data.get(group if group == "libc" else "syscalls") or data.get(group) or []
        rows += [(str(n), "", group) for n in names]
    for family in (data.get("families") or {}).values():
        rows += [(str(n), "", "unknown") for k in ("apis", "aliases") for n in (family or {}).get(k, [])]
    catalog = spark.createDataFrame(rows, CATALOG)
    if groups is not None:
        named = groups.select("header", F.col("grp").alias("_grp"))
        catalog = catalog.join(named, "header", "left").select("api", "header", F.coalesce("_grp", "grp").alias("grp"))
    first = Window.partitionBy("api").orderBy(F.col("header") == "", F.col("grp") == "unknown", "header", "grp")
    catalog = catalog.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    helpers = data.get("helpers") or {}
    listed = [(kind.removesuffix("_regex"), str(p), kind.endswith("_regex")) for kind, ps in helpers.items() for p in ps or []]
    thin = data.get("thin_alias") or data.get("thin-alias") or []
    return catalog, spark.createDataFrame(listed, HELPERS), spark.createDataFrame([(str(t),) for t in thin], "api string")


def target_subset(catalog: DataFrame, which: str) -> DataFrame:
    """``libc``: the categories but ``system_calls``, or without categories the names listed under libc. ``system_calls``: that category,
    or without it the names listed as system calls."""
    if which == "libc":
        return catalog.filter("grp = 'libc'") if catalog.filter("header <> ''").isEmpty() else catalog.filter("header NOT IN ('', 'system_calls')")
    named = catalog.filter("header = 'system_calls'")
    return catalog.filter("grp = 'system_calls'") if named.isEmpty() else named


def _lists(value: object) -> Iterator[str]:
    """The entries of a list, or of every list among a mapping's values."""
    for entries in value.values() if isinstance(value, dict) else [value]:
        if isinstance(entries, list):
            yield from map(str, entries)


def load_canon(spark: SparkSession, paths: list[str | None]) -> DataFrame:
    """api: all names that names are compared with, from the first of the files that can be read: libc, system calls, families' APIs
    and aliases, and every list of a category."""
    import yaml

    path = first_readable(paths)
    if path is None:
        raise ValueError("no catalog can be read")
    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    families = [v for family in (data.get("families") or {}).values() for k, v in (family or {}).items() if k in ("apis", "aliases")]
    found = {n for part in (data.get("libc"), data.get("syscalls"), *families, *(data.get("categories") or {}).values()) for n in _lists(part)}
    return spark.createDataFrame([(n,) for n in sorted(found)], "api string")


def load_groups(spark: SparkSession, path: str) -> DataFrame:
    """header, grp: a line at the margin names a group, indented words are its headers, a header's first group holds."""
    with open(path, encoding="utf-8") as f:
        lines = f.read().splitlines()
    found: dict[str, str] = {}
    group = None
    for line in lines:
        if not line.strip():
            continue
        if not line[0].isspace():
            group = line.strip().rstrip(":")
        elif group:
            for header in line.replace(",", " ").split():
                found.setdefault(header.strip("-*"), group)
    return spark.createDataFrame(sorted(found.items()), "header string, grp string")


#: Accepted spellings of the columns of a wrapper CSV, in order of preference.
ALIASES = {
    "function": ("function", "func", "symbol"),
    "location": ("file", "filepath", "path", "filename", "source", "source_file", "location"),
    "function_loc": ("function_loc", "functionloc", "function_location"),
    "fan_in": ("fan_in", "fanin"),
    "fan_out": ("fan_out", "fanout"),
    "callee": ("callee",),
    "api_called": ("api_called", "api", "target", "called_api"),
    "category": ("category", "cat", "group"),
    "reason": ("reason",),
    "arg_pass": ("arg_pass", "argpass", "arg_passed", "args_pass"),
    "ret_pass": ("ret_pass", "retpass", "return_pass", "ret_passed"),
}


def read_wrapper_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a wrapper CSV under fixed names whatever the header calls them; short rows and missing columns give "",
    bad numbers 0, an empty location ``<unknown>``. A file without a function column is an error."""
    import re

    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE")
    tidy = {c: re.sub("_+", "_", c.lstrip("﻿").strip().lower().replace("-", "_").replace(" ", "_")) for c in raw.columns}

    def pick(name: str) -> str | None:
        return next((c for c in raw.columns if tidy[c] in ALIASES[name]), None)

    if pick("function") is None:
        raise ValueError("no function column")

    def text(name: str):
        c = pick(name)
        return F.coalesce(F.col(f"`{c}`"), F.lit("")) if c else F.lit("")

    place = F.trim(F.when(text("location") != "", text("location")).otherwise(text("function_loc")))
    place = F.when((place == "") | F.lower(place).isin("none", "null", "n/a", "na", "-"), "<unknown>").otherwise(place)
    number = lambda n: F.coalesce(F.trim(text(n)).try_cast("int"), F.lit(0)).alias(n)
    plain = [text(n).alias(n) for n in ("function", "callee", "api_called", "category", "reason", "arg_pass", "ret_pass")]
    return raw.select(*plain, number("fan_in"), number("fan_out"), place.alias("location"))


def first_readable(paths: list[str | None]) -> str | None:
    return next((p for p in paths if p and os.path.isfile(p)), None)

"""Name, list and location expressions; all built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

API_SEPARATOR = " - "
UNKNOWN_SUFFIX = "@<unknown>"

# Fixed values.
PREFIXES, SUFFIXES = ("ngx_", "redis_", "__"), ("_impl", "_locked")


def normalize(c: Column) -> Column:
    """Words of a name in lower case: camel case split, everything but ASCII letters and digits as one space."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")))


def strip_affixes(c: Column) -> Column:
    """Each known prefix, then each known suffix, taken off once, in order."""
    for p in PREFIXES:
        c = F.regexp_replace(c, f"^{p}", "")
    for s in SUFFIXES:
        c = F.regexp_replace(c, f"{s}$", "")
    return c


def tokenize(c: Column) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda t: t != "")


def unique_in_order(names: Column) -> Column:
    """Trimmed names without empty ones and "other", the first of each kept."""
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: (n != "") & (F.lower(n) != "other")))


def split_api_names(c: Column) -> Column:
    return unique_in_order(F.split(F.coalesce(c, F.lit("")), API_SEPARATOR))


def join_api_names(names: Column) -> Column:
    return F.array_join(unique_in_order(names), API_SEPARATOR)


def split_callees(c: Column) -> Column:
    parts = F.split(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit(API_SEPARATOR), F.lit("|")), r"[|;,\s]+")
    return F.filter(parts, lambda p: p != "")


_SITE = r"(?s)^(.*):([^:]*):([^:]*)$"


def parse_callsite(loc: Column) -> Column:
    """(file, line, column) of "file:line:column"; what does not parse is (itself, 0, 0)."""
    line = F.regexp_extract(loc, _SITE, 2).try_cast("int")
    col = F.regexp_extract(loc, _SITE, 3).try_cast("int")
    good = line.isNotNull() & col.isNotNull()
    return F.struct(
        F.when(good, F.regexp_extract(loc, _SITE, 1)).otherwise(loc).alias("file"),
        F.when(good, line).otherwise(0).alias("line"),
        F.when(good, col).otherwise(0).alias("column"),
    )


def callsite_order(loc: Column) -> Column:
    """(line, column) to sort by; what does not parse comes last."""
    line = F.regexp_extract(loc, _SITE, 2).try_cast("int")
    col = F.regexp_extract(loc, _SITE, 3).try_cast("int")
    good = line.isNotNull() & col.isNotNull()
    return F.struct(F.when(good, line).otherwise(1_000_000_000).alias("line"), F.when(good, col).otherwise(1_000_000_000).alias("column"))


def serialize_hit_locs(locs: Column) -> Column:
    clean = F.transform(F.coalesce(locs, F.array().cast("array<string>")), lambda x: F.regexp_replace(F.trim(x), r"[\s,;]+", "_"))
    return F.array_join(F.filter(clean, lambda x: x != ""), "|")


def safe_stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")


def syscall_selector(callee: Column, first_argument: Column) -> Column:
    """The call's name behind syscall(SYS_x) or syscall(__NR_x); null for other calls."""
    name = F.regexp_extract(F.coalesce(first_argument, F.lit("")), r"(?:SYS|__NR)_(\w+)", 1)
    return F.when((callee == "syscall") & (name != ""), name)


def severity_bucket(severity: Column) -> Column:
    return (
        F.when(severity <= 0, "ignored").when(severity == 1, "note").when(severity == 2, "warning").when(severity == 3, "error").otherwise("fatal")
    )


def provenance(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")


def likelihood(score: Column) -> Column:
    """Whole percent, halves to even."""
    return F.concat(F.bround(score * 100).cast("int").cast("string"), F.lit("%"))


def is_na_category(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "n/a", "na", "none", "-")


def common_substring(a: Column, b: Column) -> Column:
    """Length of the longest common substring. From each start the match grows while it is found in ``b``."""
    from_start = lambda i: F.aggregate(
        F.sequence(F.lit(1), F.length(a) - i + 1),
        F.lit(0),
        lambda best, n: F.when((best == n - 1) & F.contains(b, F.substring(a, i, n)), n).otherwise(best),
    )
    found = F.array_max(F.transform(F.sequence(F.lit(1), F.length(a)), from_start))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(found)


def pair_ratio(a: Column, b: Column) -> Column:
    """100 for equal names, else 100 * common substring / the shorter length; 0 if a name is empty."""
    n = common_substring(a, b)
    ratio = F.lit(100.0) * F.greatest(n / F.greatest(F.lit(1), F.length(a)), n / F.greatest(F.lit(1), F.length(b)))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 100.0).otherwise(ratio)


def token_overlap(a: Column, b: Column) -> Column:
    """Of the distinct tokens of ``b``, the share that ``a`` has too."""
    other = F.array_distinct(b)
    return F.when(F.size(other) == 0, 0.0).otherwise(F.size(F.array_intersect(a, other)) / F.size(other))

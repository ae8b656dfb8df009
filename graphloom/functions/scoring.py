"""How likely a function is a wrapper, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import normalize, provenance, split_callees, strip_affixes, token_overlap, tokenize

# Weights, penalties and bounds of the score.
WEIGHTS = {"thin": 0.24, "position": 0.24, "coverage": 0.18, "fuzzy": 0.18, "fan": 0.08, "catalog": 0.08}
STRONG_RATIO, STRONG_COMBINED, STRONG_OVERLAP = 92.0, 82.0, 0.75


def has_catalog_api(api_called: Column, category: Column) -> Column:
    return ~normalize(api_called).isin("", "other") & ~normalize(category).isin("", "n/a", "na", "none")


def strong_without_api(function: Column, fuzzy_key: Column, combined: Column, ratio: Column) -> Column:
    name, key = normalize(strip_affixes(function)), normalize(fuzzy_key)
    overlap = token_overlap(tokenize(strip_affixes(function)), tokenize(fuzzy_key))
    return (name != "") & (key != "") & (ratio >= STRONG_RATIO) & (combined >= STRONG_COMBINED) & (overlap >= STRONG_OVERLAP)


def _position(name: Column, token: Column) -> Column:
    return (
        F.when(token == "", 0.0)
        .when(F.startswith(name, token) | F.endswith(name, token), 1.0)
        .when(F.contains(F.concat(F.lit(" "), name, F.lit(" ")), F.concat(F.lit(" "), token, F.lit(" "))), 0.7)
        .when(F.contains(name, token), 0.4)
        .otherwise(0.0)
    )


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _bonus(verdict: Column, full: float, each: float, most: float) -> Column:
    some = F.regexp_extract(verdict, r"^yes\s*-\s*(\d+)", 1).try_cast("int")
    return F.when(verdict == "yes - all", full).otherwise(F.when(some.isNotNull(), F.least(F.lit(most), some * F.lit(each))).otherwise(0.0))


def wrapper_score(
    function: Column, api_called: Column, callee: Column, fan_out: Column, fuzzy_key: Column, combined: Column, ratio: Column,
    category: Column, reason: Column, arg_pass: Column, ret_pass: Column,
) -> Column:
    name = normalize(strip_affixes(function))
    tokens = F.array_distinct(tokenize(strip_affixes(function)))
    traced = has_catalog_api(api_called, category)
    api, fuzzy = normalize(F.when(traced, api_called).otherwise(fuzzy_key)), normalize(fuzzy_key)
    api_tokens = tokenize(F.when(traced, api_called).otherwise(fuzzy_key))
    callees = F.transform(split_callees(callee), normalize)
    n = F.size(F.array_distinct(callees))
    thin = F.when(n <= 0, 0.0).otherwise(F.pow(n.cast("double"), F.lit(-0.8)))
    position = F.coalesce(F.array_max(F.concat(F.array(_position(name, api)), F.transform(callees, lambda c: _position(name, c)))), F.lit(0.0))
    covered = F.size(F.filter(F.array_distinct(api_tokens), lambda t: F.array_contains(tokens, t))) / F.size(api_tokens)
    coverage = F.when(F.size(api_tokens) > 0, covered).otherwise(0.0)
    at_edge = F.when((api != "") & (F.startswith(name, api) | F.endswith(name, api)), 0.1).otherwise(0.0)
    domain, s_fuzzy, s_ratio = F.least(F.lit(1.0), coverage + at_edge), _unit(combined / 100), _unit(ratio / 100)

    weak = F.greatest(F.lit(0.0), F.least(F.lit(0.24), F.lit(0.02) + s_ratio * 0.16))
    strong = F.greatest(F.lit(0.0), F.least(F.lit(0.82), s_ratio * 0.58 + s_fuzzy * 0.22 + position * 0.12 + thin * 0.08))
    untraced = F.when(strong_without_api(function, fuzzy_key, combined, ratio), strong).otherwise(weak)

    w = {k: F.lit(v) for k, v in WEIGHTS.items()}
    fan = F.lit(1.0) / (F.lit(1.0) + F.greatest(F.lit(0), F.coalesce(fan_out, F.lit(0))))
    w_domain = F.when(F.size(api_tokens) > 0, w["coverage"]).otherwise(0.0)
    aligned = F.when((api == fuzzy) & (fuzzy != ""), 1.0).otherwise(0.35)
    base = w["thin"] * thin + w["position"] * position + w_domain * domain + (w["fuzzy"] + w["coverage"] - w_domain) * s_fuzzy + w["fan"] * fan + w["catalog"] * aligned
    callee_tokens = F.flatten(F.transform(split_callees(callee), tokenize))
    first = F.get(api_tokens, F.lit(0))
    unseen = (F.size(api_tokens) > 0) & ~F.array_contains(tokens, first) & ~F.array_contains(callee_tokens, first)
    penalty = (
        F.when(unseen, 0.9).otherwise(1.0)
        * F.when(n >= 10, 0.85).when(n == 0, 0.55).otherwise(1.0)
        * F.when(s_fuzzy < 0.40, 0.85).when((s_fuzzy < 0.60) & (position == 0.4), 0.90).otherwise(1.0)
    )
    said = F.lower(F.trim(F.coalesce(reason, F.lit(""))))
    parts = F.size(F.filter(F.split(said, r"\+"), lambda p: F.trim(p) != ""))
    verdict = F.when(said == "ok", 1.05).when(said != "", F.lit(1.0) - F.least(F.lit(0.12), parts * F.lit(0.03))).otherwise(1.0)
    arg, ret = provenance(arg_pass), provenance(ret_pass)
    passed = F.when((arg == "yes - all") & (ret == "yes - all"), 1.0).otherwise(
        F.least(F.lit(1.0), base * penalty * verdict + _bonus(arg, 0.12, 0.02, 0.10) + _bonus(ret, 0.08, 0.02, 0.06))
    )
    return F.when(traced, _unit(passed)).otherwise(untraced)

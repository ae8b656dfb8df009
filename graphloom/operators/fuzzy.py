"""Match function names to canonical API names by their longest common substring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.ratios import name_ratio
from graphloom.functions.text import common_substring, normalize, strip_affixes, tokenize
from graphloom.session import ship

GRAM = 3


def canon_table(names: DataFrame, column: str = "api") -> DataFrame:
    """key, norm, tokens of every distinct name with a non-empty normal form."""
    out = names.select(F.col(column).alias("key")).distinct().withColumn("norm", normalize(F.col("key")))
    return out.filter("norm <> ''").withColumn("tokens", F.split("norm", " "))


def _grams(text) -> F.Column:
    n = F.length(text) - (GRAM - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM)))))


def fuzzy_scores(functions: DataFrame, canon: DataFrame, key: str = "function", ratio: str = "substring") -> DataFrame:
    """key and, for every canonical name that shares at least three characters in a row with one of its tokens (or is
    equal), exact, token_equal, lcs_len, combined and rf_score: ``combined`` again, or with ``ratio`` "weighted" the larger of the
    weighted and the token-set ratio, in Arrow batches.

    The common substring of at least three characters is an equi-join on 3-grams, so no pair without one is made; names are
    compared once, however many rows have them."""
    names = functions.select(F.col(key).alias("function")).distinct().withColumn("fn_norm", normalize(strip_affixes(F.col("function"))))
    names = names.withColumn("fn_tokens", tokenize(strip_affixes(F.col("function"))))
    grams = names.select("function", F.explode(F.array_distinct(F.flatten(F.filter(F.transform("fn_tokens", _grams), lambda g: g.isNotNull())))).alias("gram"))
    theirs = canon.select("key", F.explode(_grams(F.col("norm"))).alias("gram"))
    pairs = grams.join(theirs, "gram").select("function", "key").distinct()
    same = names.join(canon, F.col("fn_norm") == F.col("norm")).select("function", "key")
    pairs = pairs.unionByName(same).distinct().join(names, "function").join(canon, "key")
    walked = F.aggregate(
        "fn_tokens",
        F.struct(F.lit(0).alias("lcs"), F.lit(0.0).alias("ratio")),
        lambda best, t: F.aggregate(  # a one-element fold names the token's substring length, so it is computed once
            F.array(common_substring(t, F.col("norm"))),
            best,
            lambda b, n: F.when(
                n > b["lcs"], F.struct(n.alias("lcs"), F.greatest(n / F.greatest(F.lit(1), F.length(t)), n / F.greatest(F.lit(1), F.length("norm"))).alias("ratio"))
            ).otherwise(b),
        ),
    )
    exact = F.col("fn_norm") == F.col("norm")
    if ratio not in ("substring", "weighted"):
        raise ValueError(f"ratio must be substring or weighted: {ratio}")
    ship(functions.sparkSession)
    weighted = name_ratio(F.col("fn_norm"), F.col("norm")) if ratio == "weighted" else F.lit(None).cast("double")
    return (
        pairs.withColumn("weighted", weighted)
        .withColumn("w", walked)
        .select(
            "function", "key", exact.alias("exact"),
            (F.array_sort(F.array_distinct("fn_tokens")) == F.array_sort(F.array_distinct("tokens"))).alias("token_equal"),
            F.col("w.lcs").alias("lcs_len"),
            F.when(exact, 100.0).otherwise(F.least(F.lit(100.0), F.lit(100.0) * F.col("w.ratio"))).alias("combined"), "weighted",
        )
        .filter("lcs_len >= 3 OR exact")
        .withColumn("rf_score", F.coalesce("weighted", "combined"))
        .drop("weighted")
    )


def top_matches(scores: DataFrame, k: int = 3) -> DataFrame:
    """The k best canonical names of each function, with rank."""
    order = [F.desc("rf_score"), F.desc("exact"), F.desc("token_equal"), F.desc("lcs_len"), F.desc("combined"), F.asc("key")]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("function").orderBy(*order))).filter(F.col("rank") <= k)

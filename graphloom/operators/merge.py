"""Merging of a function's rows from several units, categories of their APIs, thresholds and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.checkpoints import cut_lineage
from graphloom.functions.ratios import name_ratio
from graphloom.functions.text import join_api_names, normalize, pair_ratio, split_api_names, token_overlap, tokenize
from graphloom.session import ship

NO_TEXT = ("", "-", "n/a", "N/A")


def row_identity() -> Column:
    key = F.coalesce(F.col("function_key"), F.lit(""))
    return F.when((key != "") & (key != "<unknown>"), key).otherwise(F.concat("function", F.lit("@"), "function_loc"))


def _first(column: str, order: Column, missing: tuple[str, ...]) -> Column:
    """The first value that is not a stand-in for none, else the first value."""
    c = F.col(column)
    real = F.when(c.isNotNull() & ~c.isin(*missing), order)
    return F.coalesce(F.min_by(c, real), F.min_by(c, order)).alias(column)


def merge_rows(rows: DataFrame) -> DataFrame:
    """One row for each function. ``ord`` numbers the units: lists keep its order, and the last unit's pass verdicts hold."""
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c]))
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    o = F.col("ord")
    grouped = rows.withColumn("identity", row_identity()).withColumn("_apis", split_api_names(F.col("api_called"))).groupBy("identity")
    return grouped.agg(
        F.min_by("function", o).alias("function"), F.min_by("function_key", o).alias("function_key"),
        join_api_names(ordered("_apis")).alias("api_called"),
        F.max("total_target_calls").alias("total_target_calls"),
        united("hit_locs"), united("derivation_trace"), united("ignored_helpers"),
        F.bool_or("derived_from_params").alias("derived_from_params"), F.bool_and("per_path_single").alias("per_path_single"),
        F.bool_or("pair_used").alias("pair_used"), F.bool_or("via_helper_hop").alias("via_helper_hop"), F.bool_or("is_thin_alias").alias("is_thin_alias"),
        _first("family", o, ("", "-")), _first("reason", o, NO_TEXT), _first("category", o, ("", "unknown", "N/A")),
        _first("file", o, ("", "-")), _first("function_loc", o, ("", "-")),
        F.max_by("arg_pass", o).alias("arg_pass"), F.max_by("ret_pass", o).alias("ret_pass"),
    )


def category_of(apis: DataFrame, catalog: DataFrame, column: str = "api") -> DataFrame:
    """``apis`` with category: the catalog's group of the name, else unknown."""
    known = catalog.groupBy(F.col("api").alias(column)).agg(F.min("grp").alias("category"))
    return apis.join(known, column, "left").withColumn("category", F.coalesce("category", F.lit("unknown")))


def majority_category(rows: DataFrame, catalog: DataFrame, key: str = "function_key", default: str = "unknown") -> DataFrame:
    """key, category: the most frequent category of the row's APIs, the one seen first on ties."""
    exploded = rows.select(key, F.posexplode_outer(split_api_names(F.col("api_called"))).alias("pos", "api"))
    counted = category_of(exploded, catalog).groupBy(key, "category").agg(F.count("api").alias("n"), F.min("pos").alias("first"))
    best = counted.groupBy(key).agg(F.max_by("category", F.struct("n", -F.coalesce("first", F.lit(0)))).alias("category"), F.max("n").alias("n"))
    return best.select(key, F.when(F.col("n") == 0, default).otherwise(F.col("category")).alias("category"))


def fan_in_threshold(rows: DataFrame, column: str = "fan_in") -> DataFrame:
    """One row: the value at index int(0.7 * (n - 1)) of the sorted non-negative fan-ins, at least 1; 0 for no rows.

    Counts per value first, so the ordered pass is over distinct values only."""
    values = rows.select(F.greatest(F.lit(0), F.coalesce(F.col(column), F.lit(0))).cast("long").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    run = values.select("v", F.sum("n").over(Window.orderBy("v")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    hit = run.filter(F.col("upto") > F.floor(F.lit(0.7).cast("double") * (F.col("total") - 1)))
    low = F.min("v")
    return hit.agg(F.when(low.isNull(), 0).otherwise(F.greatest(F.lit(1), low)).cast("long").alias("threshold"))


API_RATIO_MIN, API_COMBINED_MIN, API_OVERLAP_MIN = 86.0, 72.0, 0.60


def best_api(rows: DataFrame, key: str = "function_key", ratio: str = "substring") -> DataFrame:
    """key, best_api: of the row's APIs the one most like the function's name (ratio, common substring, overlap, then order),
    empty unless it is strong. ``ratio`` as in ``fuzzy.fuzzy_scores``."""
    apis = rows.select(key, "function", F.posexplode(split_api_names(F.col("api_called"))).alias("pos", "api"))
    combined = pair_ratio(normalize(F.col("function")), normalize(F.col("api")))
    overlap = F.when(normalize(F.col("function")) == "", 0.0).otherwise(token_overlap(tokenize(F.col("function")), tokenize(F.col("api"))))
    ship(rows.sparkSession)
    rf = name_ratio(normalize(F.col("function")), normalize(F.col("api"))) if ratio == "weighted" else F.col("combined")
    scored = apis.withColumn("combined", combined).withColumn("overlap", overlap).withColumn("rf", rf)
    rank = F.struct("rf", "combined", "overlap", (-F.col("pos")).alias("back"))
    best = scored.groupBy(key).agg(F.max_by(F.struct("api", "rf", "combined", "overlap"), rank).alias("best"))
    strong = (F.col("best.rf") >= API_RATIO_MIN) & (F.col("best.combined") >= API_COMBINED_MIN) & (F.col("best.overlap") >= API_OVERLAP_MIN)
    return best.select(key, F.when(strong, F.col("best.api")).otherwise("").alias("best_api"))


def tiered(rows: DataFrame, threshold: int) -> DataFrame:
    """Rows with tier (0: good score and high fan-in, 1: good score, 2: high fan-in, 3: the rest) in rank order. Scores are
    written before the sort, which reads its input twice."""
    good = F.col("score") >= 0.5
    high = F.col("fan_in") >= threshold
    tier = F.when(good & high, 0).when(good, 1).when(high, 2).otherwise(3)
    return cut_lineage(rows.withColumn("tier", tier)).orderBy("tier", F.desc("fan_in"), F.desc("score"), "function")

"""The three pipelines end to end: wrappers, call graph, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.scoring import has_catalog_api, strong_without_api, wrapper_score
from graphloom.operators import ast, callgraph, closure, fuzzy, merge
from graphloom.operators.resolve import distinct_defs, project_filter


def definitions(nodes: DataFrame) -> DataFrame:
    roots = ast.callable_definitions(nodes)
    return distinct_defs(roots.select("function_key", F.col("spelling").alias("function"), F.col("translation_unit").alias("file"), "line"))


def find_wrappers(nodes: DataFrame, catalog: DataFrame, mode: str = "accurate", roots: list[str] | None = None, helpers: list | None = None, thin_aliases: list[str] | None = None, thin_policy: str = "default") -> DataFrame:
    """Wrapper rows: classified per unit, merged over units, with fan-in and fan-out, reached names and APIs, categories."""
    nodes = project_filter(nodes, roots or [], "translation_unit")
    edges, defs = ast.call_edges(nodes), definitions(nodes)
    found = ast.classify(ast.function_summaries(nodes, catalog.select("api"), helpers), mode, thin_aliases, thin_policy).filter("kept")
    units = nodes.select("translation_unit").distinct()
    order = units.select("translation_unit", F.dense_rank().over(Window.orderBy("translation_unit")).alias("ord"))
    empty = F.lit("-")
    rows = found.join(order, "translation_unit").select(
        "ord", "function", "function_key", "api_called", F.size("resolved").alias("total_target_calls"), "hit_locs", F.col("trace").alias("derivation_trace"), "ignored_helpers",
        "derived_from_params", "per_path_single", "pair_used", F.col("via_hop").alias("via_helper_hop"), (F.col("api_called").isin(*thin_aliases) if thin_aliases else F.lit(False)).alias("is_thin_alias"),
        empty.alias("family"), "reason", F.lit("unknown").alias("category"), F.col("translation_unit").alias("file"),
        F.concat_ws(":", "translation_unit", F.col("line").cast("string")).alias("function_loc"), "arg_pass", "ret_pass",
    )
    merged = merge.merge_rows(rows)
    enriched = callgraph.enriched_edges(edges, defs)
    fans = callgraph.fan_summary(enriched, defs).select("function_key", "fan_in", "fan_out")
    calls = closure.resolved_calls(edges, defs, caller_as_is=True)
    targets = found.select("function_key", F.posexplode("resolved").alias("pos", "api"), "translation_unit")
    targets = targets.groupBy("function_key", "api").agg(F.min(F.struct("translation_unit", "pos")).alias("ord"))
    out = closure.enrich_rows(merged, closure.reached_targets(calls, targets))
    category = merge.majority_category(out, catalog)
    names = closure.reached_names(edges, defs).withColumnRenamed("names", "callees")
    out = out.drop("category").join(category, "function_key", "left").join(fans, "function_key", "left").join(names, "function_key", "left")
    return out.na.fill(0, ["fan_in", "fan_out"]).na.fill("unknown", ["category"])


def score_rows(rows: DataFrame, catalog: DataFrame, ratio: str = "substring", names: DataFrame | None = None) -> DataFrame:
    """Scored and ranked wrapper rows (function, api_called, callee, category, fan_in, fan_out, reason, arg_pass, ret_pass, location).
    ``ratio`` as in ``fuzzy.fuzzy_scores``; ``names`` (api): what functions are compared with, if not the catalog's."""
    threshold = merge.fan_in_threshold(rows).first()["threshold"]  # one row, of the input: scores do not change fan_in
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    best = fuzzy.top_matches(fuzzy.fuzzy_scores(rows, fuzzy.canon_table(catalog if names is None else names), ratio=ratio), 1).select("function", F.col("key").alias("fuzzy_key"), "combined", "rf_score")
    rows = rows.join(best, "function", "left").na.fill("", ["fuzzy_key"]).na.fill(0.0, ["combined", "rf_score"])
    strong = merge.best_api(rows, "_id", ratio)
    rows = rows.join(strong, "_id", "left").na.fill("", ["best_api"])
    for column in ("best_api", "fuzzy_key"):
        rows = _with_group(rows, catalog, column)
    by_name = F.when(F.col("best_api") != "", F.col("_grp_best_api")).when(X.is_na_category(F.col("category")) & (F.col("fuzzy_key") != ""), F.col("_grp_fuzzy_key"))
    rows = rows.withColumn("category", F.coalesce(by_name, F.col("category")))
    args = [F.col(c) for c in ("function", "api_called", "callee", "fan_out", "fuzzy_key", "combined", "rf_score", "category", "reason", "arg_pass", "ret_pass")]
    rows = rows.withColumn("score", wrapper_score(*args))
    shown = has_catalog_api(F.col("api_called"), F.col("category")) | strong_without_api(F.col("function"), F.col("fuzzy_key"), F.col("combined"), F.col("rf_score"))
    rows = rows.withColumn("fuzzy_match", F.when(shown, F.col("fuzzy_key")).otherwise("NO_MATCH")).withColumn("likelihood_score", X.likelihood(F.col("score")))
    return merge.tiered(rows, threshold)


def _with_group(rows: DataFrame, catalog: DataFrame, column: str) -> DataFrame:
    """``rows`` with the group of a name, null where the catalog does not know it."""
    known = catalog.filter("grp <> 'unknown'").groupBy(F.col("api").alias(column)).agg(F.min("grp").alias(f"_grp_{column}"))
    return rows.join(known, column, "left")

"""Command line: entries (compile databases), finder (wrappers, call graph, edge evidence), fuzzy (scores), pipeline and run (both)."""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom import sinks
from graphloom.checkpoints import cut_lineage
from graphloom.operators import ast, callgraph, resolve
from graphloom.plans import pipelines
from graphloom.sources import catalog as catalogs
from graphloom.sources import compile_db


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)

    def finder(name: str) -> argparse.ArgumentParser:
        f = sub.add_parser(name)
        f.add_argument("--ast-nodes", required=True, help="table of syntax-tree nodes (Parquet)")
        f.add_argument("--diagnostics", help="table of translation_unit and severity (Parquet)")
        f.add_argument("--yaml", required=True, help="API catalog")
        f.add_argument("--groups", help="header groups")
        only = f.add_mutually_exclusive_group()
        only.add_argument("--only-libc", action="store_true")
        only.add_argument("--only-syscalls", action="store_true")
        f.add_argument("--mode", choices=("accurate", "relaxed", "all"), default="accurate")
        f.add_argument("--output", choices=("csv", "json", "jsonl"), default="csv")
        f.add_argument("--out")
        f.add_argument("--out-dir")
        f.add_argument("--callgraph-out")
        f.add_argument("--callgraph-only", action="store_true")
        f.add_argument("--edge-evidence", metavar="FUNCTION")
        f.add_argument("--unique-callers", action="store_true")
        f.add_argument("--all-columns", action="store_true")
        f.add_argument("--project-root", action="append", default=[])
        f.add_argument("--project-only", action="store_true", help="without --project-root: only what lies under the folder that all units outside the system share")
        f.add_argument("--treat-thin-alias", choices=("default", "direct-only", "allow-1-hop"), default="default")
        return f

    finder("finder")
    ratio = {"choices": ("substring", "weighted"), "default": "substring", "help": "how names are compared"}
    for name in ("pipeline", "run"):
        f = finder(name)
        f.add_argument("--ratio", **ratio)
        f.add_argument("--fuzzy-out")
        if name == "run":
            f.add_argument("--no-fuzzy", action="store_true")
    e = sub.add_parser("entries", help="cleaned arguments of a compile database's sources")
    e.add_argument("--compile-commands", required=True, help="JSON list of entries")
    e.add_argument("--out", required=True, help="table of src, args and ord (Parquet)")
    e.add_argument("--path-map", action="append", default=[], metavar="OLD=NEW", help="where sources that are not known may be; needs --known-files")
    e.add_argument("--known-files", help="table of path (Parquet)")
    e.add_argument("--response-files", help="folder of files named by @file arguments")
    e.add_argument("--verbose", action="store_true", help="print how many entries were left out, and why")
    z = sub.add_parser("fuzzy")
    z.add_argument("csv")
    z.add_argument("--ratio", **ratio)
    z.add_argument("--yaml", required=True)
    z.add_argument("--groups")
    z.add_argument("--out")
    z.add_argument("--out-dir")
    return p


def safe_stem(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", name).strip("._") or "output"


def _catalog(spark: SparkSession, args: argparse.Namespace):
    groups = catalogs.load_groups(spark, args.groups) if args.groups else None
    catalog, helpers, thin = catalogs.load_catalog(spark, args.yaml, groups)
    if getattr(args, "only_libc", False):
        catalog = catalogs.target_subset(catalog, "libc")
    if getattr(args, "only_syscalls", False):
        catalog = catalogs.target_subset(catalog, "system_calls")
    return catalog, [tuple(r) for r in helpers.collect()], [r["api"] for r in thin.collect()]  # configuration


def _target(args: argparse.Namespace, name: str) -> str:
    path = args.out or name
    if args.out_dir and path != "-":
        os.makedirs(args.out_dir, exist_ok=True)
        path = os.path.join(args.out_dir, os.path.basename(path))
    return path


def run_finder(spark: SparkSession, args: argparse.Namespace) -> str | None:
    if args.callgraph_only and not (args.callgraph_out or args.edge_evidence):
        raise SystemExit("--callgraph-only needs --callgraph-out or --edge-evidence")
    nodes = spark.read.parquet(args.ast_nodes)
    roots = args.project_root
    if args.project_only and not roots:
        root = resolve.common_root(resolve.outside_system(nodes.select("translation_unit"), "translation_unit"), "translation_unit")
        roots = [root] if root else []
    edges, defs = ast.call_edges(nodes), pipelines.definitions(nodes)
    if args.edge_evidence:
        asked = spark.createDataFrame([callgraph.resolve_edge_query(defs, args.edge_evidence)], defs.schema)
        path = _target(args, f"{safe_stem(args.edge_evidence)}_edges.{args.output}")
        sinks.write_report(callgraph.edge_evidence(asked, edges), path, args.output)
        return path
    if args.callgraph_out:
        rich = callgraph.enriched_edges(edges, defs)
        nothing = spark.createDataFrame([], "translation_unit string, severity int")
        units = callgraph.unit_report(spark.read.parquet(args.diagnostics) if args.diagnostics else nothing, rich)
        sinks.write_callgraph(args.callgraph_out, callgraph.edge_rows(rich), callgraph.call_counts(rich, defs, args.unique_callers), callgraph.fan_summary(rich, defs), units)
    if args.callgraph_only:
        return None
    catalog, helpers, thin = _catalog(spark, args)
    rows = pipelines.find_wrappers(nodes, catalog, args.mode, roots, helpers, thin, args.treat_thin_alias)
    path = _target(args, f"wrappers.{args.output}")
    sinks.write_report(sinks.wrapper_report(rows, args.all_columns), path, args.output)
    if path != "-":
        for column in ("fan_in", "fan_out"):
            print(f"top {column}:", *(f"{r['function']}={r[column]}" for r in callgraph.top(rows.select("function", column), column, "function").collect()))
    return path


def run_entries(spark: SparkSession, args: argparse.Namespace) -> None:
    maps = [tuple(m.split("=", 1)) for m in args.path_map]
    if any(len(m) != 2 for m in maps) or (maps and not args.known_files):
        raise ValueError("--path-map takes OLD=NEW and needs --known-files")
    known = spark.read.parquet(args.known_files) if args.known_files else None
    responses = compile_db.read_response_files(spark, args.response_files) if args.response_files else None
    checked = cut_lineage(compile_db.checked_entries(compile_db.read_compile_db(spark, args.compile_commands), maps, known, responses))
    compile_db.accepted_entries(checked).write.parquet(args.out)
    if args.verbose:
        for r in compile_db.rejected_entries(checked).orderBy("problem").collect():  # a row a problem
            print(f"left out, {r['problem']}: {r['entries']}", file=sys.stderr)


def run_fuzzy(spark: SparkSession, args: argparse.Namespace, source: str, out: str | None = None) -> str:
    catalog, _, _ = _catalog(spark, args)
    rows = pipelines.score_rows(catalogs.read_wrapper_csv(spark, source), catalog, args.ratio, catalogs.load_canon(spark, [args.yaml]))
    stem = os.path.splitext(os.path.basename(source))[0] + "._fuzzy_scored.csv"
    path = out or os.path.join(args.out_dir or os.path.dirname(os.path.abspath(source)), stem)
    sinks.write_report(rows.select(*sinks.SCORED_COLUMNS), path)
    return path


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    try:
        if args.command == "entries":
            run_entries(spark, args)
            return 0
        if args.command == "fuzzy":
            run_fuzzy(spark, args, args.csv, args.out)
            return 0
        path = run_finder(spark, args)
        if args.command != "finder" and path and path != "-" and not getattr(args, "no_fuzzy", False):
            if args.output != "csv":
                raise ValueError("scores are made from a CSV")
            run_fuzzy(spark, args, path, args.fuzzy_out)
        return 0
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

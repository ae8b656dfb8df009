"""Compile databases: entries, tokenised commands, cleaned arguments, one row for each source.

Arguments are cleaned by a fold over the tokens: a table of rules tells what an option does, the first that fits holds, and an option
that takes a value waits for the next token. Paths are made absolute by name alone; files are not looked at. Response files
come as a table of their tokens.
"""

from __future__ import annotations

import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schemas import COMPILE_ENTRIES
from graphloom.session import ship

# Options by how they are treated.
DROPPED = ("-c", "-E", "-S", "-pipe", "-static", "-shared", "-rdynamic", "-s", "-g", "-ggdb", "-gsplit-dwarf", "-save-temps")
DROPPED_PREFIXES = (
    "-Wl,", "-Xlinker", "-l", "-L", "-fuse-ld", "-T", "-u", "-flto", "-fwhole-program-vtables", "-fprofile", "-fcoverage", "--coverage", "-fprofile-",
    "-fsanitize", "-fno-sanitize", "-fmodules", "-fmodule-file=", "-fmodule-map-file=", "-fmodules-cache-path",
)
OUTPUT_PAIRS = ("-o", "-MF", "-MT", "-MQ", "-MJ")
PATH_PAIRS = ("-I", "-isystem", "-iquote", "-idirafter", "-include", "-imacros", "-isysroot", "--sysroot", "--gcc-toolchain", "-B")
PLAIN_PAIRS = ("-x", "-resource-dir", "-target", "-D", "-U", "-std", "-stdlib")
GLUED_PATHS = ("-I", "-isystem", "-iquote", "-idirafter")
EQUALS_PATHS = ("-isysroot=", "--sysroot=", "-resource-dir=", "--gcc-toolchain=")
KEPT = ("-pthread", "-ansi", "-fsigned-char", "-pedantic", "-nostdinc", "-nostdinc++", "-nostdlibinc")
KEPT_PREFIXES = ("-std=", "-D", "-U", "-m", "-f", "-stdlib=", "-O")
OBJECTS = (".o", ".obj", ".lo", ".a", ".lib", ".so", ".dylib", ".bc", ".ll")
SOURCES = (".c", ".cc", ".cpp", ".cxx", ".c++", ".m", ".mm")
COMPILERS = ("clang", "clang-20", "clang-19", "clang-18", "clang-17", "clang-16", "gcc", "cc", "c99", "c11")
LANGUAGES = {".c": "c", ".cc": "c++", ".cpp": "c++", ".cxx": "c++", ".c++": "c++", ".m": "objective-c", ".mm": "objective-c++"}
SYSTEM_INCLUDE = "/usr/include"


#: What tokens do, in order: the first rule that fits holds, and a token without one goes. ``is``, ``begins`` and ``ends`` (in lower
#: case) say how the text is met.
RULES = [
    (test, text, action)
    for test, texts, action in (
        ("is", DROPPED, "drop"), ("ends", OBJECTS + SOURCES, "drop"), ("begins", (*DROPPED_PREFIXES, "-W"), "drop"), ("is", OUTPUT_PAIRS, "output"), ("is", PATH_PAIRS, "path"),
        ("is", PLAIN_PAIRS, "value"), ("begins", GLUED_PATHS, "glued"), ("begins", EQUALS_PATHS, "equals"), ("is", KEPT, "keep"), ("begins", KEPT_PREFIXES, "keep"),
    )
    for text in texts
]
#: Larger response files are left out.
RESPONSE_BYTES = 2 << 20


def read_compile_db(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON array file with their positions, read as a stream. Anything but an array of objects is an error: at
    once if it is no array, else when the entries are read (a list that is cut off, elements that are no objects)."""
    start = spark.read.text(path).select(F.ltrim("value").alias("v")).filter("v <> ''").first()
    if start is None or not start["v"].startswith("["):
        raise ValueError("a compile database is a JSON list")
    entries = spark.read.schema(COMPILE_ENTRIES).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return entries.select(F.monotonically_increasing_id().alias("ord"), *COMPILE_ENTRIES.names)


def read_response_files(spark: SparkSession, path: str) -> DataFrame:
    """path, tokens of the files under a folder that are not too large and can be split."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("length") <= RESPONSE_BYTES)
    ship(spark)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, _split(bytes(c).decode("utf-8", "ignore"))) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame([r for r in rows if r[1] is not None], columns=["path", "tokens"])

    local = F.regexp_replace("path", "^file:/*", "/").alias("path")
    return files.select(local, "content").mapInPandas(split, "path string, tokens array<string>")


def _split(command: str) -> list[str] | None:
    """A command's words; None if its quotes don't close."""
    try:
        return shlex.split(command)
    except ValueError:
        return None


def absolute(path: Column, base: Column) -> Column:
    """A path from ``base``, without ``.`` and ``..``."""
    parts = F.split(F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path)), "/")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", up(done)).otherwise(F.concat(done, F.array(part)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def _folder(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(path, "/[^/]*$", ""), F.lit("")), F.lit("/"))


def clean_arguments(tokens: Column, source: Column, directory: Column) -> Column:
    """Arguments that matter to a parser: languages, macros, include paths made absolute; outputs, warnings, linking and
    everything unknown go, and so do options without the value they need."""
    none = F.array().cast("array<string>")
    rules = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("test", "text", "action"), strict=True))) for r in RULES))
    named = F.element_at(F.split(F.get(tokens, F.lit(0)), "/"), F.lit(-1)).isin(*COMPILERS)
    tokens = F.when((F.size(tokens) > 0) & ~F.get(tokens, F.lit(0)).startswith("-") & named, F.slice(tokens, F.lit(2), F.size(tokens))).otherwise(tokens)

    def rule(t: Column) -> Column:
        fits = lambda r: ((r["test"] == "is") & (t == r["text"])) | ((r["test"] == "begins") & t.startswith(r["text"])) | ((r["test"] == "ends") & F.lower(t).endswith(r["text"]))
        return F.get(F.filter(rules, fits), F.lit(0))

    def met(state: Column, x: Column) -> Column:
        t, action = x["t"], x["rule"]["action"]
        value = state["open"].isNotNull() & ~t.startswith("-")
        kept = F.when(state["action"] == "path", F.array(state["open"], absolute(t, directory))).when(state["action"] == "value", F.array(state["open"], t))
        rest = absolute(F.substring(t, F.length(x["rule"]["text"]) + 1, F.length(t)), directory)
        own = F.when(action == "keep", F.array(t)).when(action == "glued", F.array(x["rule"]["text"], rest)).when(action == "equals", F.array(F.concat(x["rule"]["text"], rest)))
        out = F.concat(state["out"], F.coalesce(F.when(value, kept).otherwise(own), none))
        waits = ~value & action.isin("output", "path", "value")
        language = state["language"] | F.coalesce(value & (state["open"] == "-x"), F.lit(False))
        return F.struct(out.alias("out"), F.when(waits, t).alias("open"), F.when(waits, action).alias("action"), language.alias("language"))

    state = F.struct(none.alias("out"), F.lit(None).cast("string").alias("open"), F.lit(None).cast("string").alias("action"), F.lit(False).alias("language"))
    folded = F.aggregate(F.transform(tokens, lambda t: F.struct(t.alias("t"), rule(t).alias("rule"))), state, met)

    def finished(s: Column) -> Column:
        out = s["out"]
        includes = F.filter(out, lambda _, i: F.coalesce(F.get(out, i - 1).isin(*GLUED_PATHS), F.lit(False)))
        place = F.when(F.exists(out, lambda t: t.startswith("-working-directory")), none).otherwise(F.array(F.concat(F.lit("-working-directory="), directory)))
        more = lambda path, wanted: F.when(wanted & ~F.array_contains(includes, path), F.array(F.lit("-I"), path)).otherwise(none)
        suffix = F.lower(F.regexp_extract(source, r"(\.[^./]*)$", 1))
        language = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), suffix), F.lit("c"))
        first = F.when(s["language"], none).otherwise(F.array(F.lit("-x"), language))
        return F.concat(first, out, place, more(_folder(source), _folder(source) != directory), more(F.lit(SYSTEM_INCLUDE), F.lit(True)))

    return F.get(F.transform(F.array(folded), finished), F.lit(0))


def retry_arguments(arguments: Column) -> Column:
    """For a second parse: without outputs and machine options."""
    previous = lambda i: F.get(arguments, i - 1)
    value = lambda t, i: ~t.startswith("-") & F.coalesce(previous(i).isin(*OUTPUT_PAIRS), F.lit(False))
    return F.filter(arguments, lambda t, i: ~(t.isin(*OUTPUT_PAIRS) | t.startswith("-m") | value(t, i)))


def expand_responses(rows: DataFrame, responses: DataFrame) -> DataFrame:
    """``rows`` (ord, directory, tokens) with ``@file`` tokens replaced by the tokens of that file (path, tokens), once; files that
    are not there drop out. Only rows with such a token are taken apart."""
    has = F.exists("tokens", lambda t: t.startswith("@"))
    names = rows.columns
    one = rows.filter(has).select(*names, F.posexplode("tokens").alias("_pos", "_token"))
    path = F.when(F.col("_token").startswith("@"), absolute(F.expr("substring(_token, 2)"), F.col("directory")))
    known = responses.select(F.col("path").alias("_path"), F.col("tokens").alias("_more"))
    found = one.withColumn("_file", path).join(known, F.col("_file") == F.col("_path"), "left")
    part = F.when(F.col("_file").isNull(), F.array("_token")).otherwise(F.coalesce("_more", F.array().cast("array<string>")))
    listed = found.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct(F.col("_pos").alias("p"), part.alias("t")))).alias("_parts"))
    opened = rows.filter(has).join(listed, "ord").withColumn("tokens", F.flatten(F.transform("_parts", lambda x: x["t"])))
    return rows.filter(~has).select(*names).unionByName(opened.select(*names))


def checked_entries(entries: DataFrame, path_maps: list[tuple[str, str]] | None = None, known_files: DataFrame | None = None, responses: DataFrame | None = None) -> DataFrame:
    """ord, src, directory, tokens and ``problem`` of every entry (null: none; ``no file``, ``no command``, ``open quote`` or
    ``unknown source``). With ``known_files`` (path), sources not among them are remapped by the first prefix that
    gives a known file."""
    ship(entries.sparkSession)
    base = F.coalesce(F.when(F.col("directory") != "", F.col("directory")), F.lit("/"))
    no_file = F.coalesce(F.col("file"), F.lit("")) == ""
    rows = entries.withColumn("directory", base).withColumn("src", F.when(~no_file, absolute(F.col("file"), base)))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [list(a) if a is not None else _split(c or "") for a, c in zip(pdf["arguments"], pdf["command"], strict=True)]
            yield pdf[["ord", "src", "directory"]].assign(tokens=[w or [] for w in words], open=[w is None for w in words])

    out = rows.select("ord", "src", "directory", "arguments", "command").mapInPandas(split, "ord long, src string, directory string, tokens array<string>, open boolean")
    moved = F.lit(False)
    if known_files is not None:
        files = known_files.select(F.col("path").alias("_path")).distinct()
        choices = [F.struct(F.lit(0).alias("rank"), F.col("src").alias("to"))]
        for i, (old, new) in enumerate(path_maps or []):
            choices.append(F.when(F.col("src").startswith(old), F.struct(F.lit(i + 1).alias("rank"), F.concat(F.lit(new), F.expr(f"substring(src, {len(old) + 1})")).alias("to"))))
        tried = out.filter("src IS NOT NULL").select("ord", F.explode(F.array_compact(F.array(*choices))).alias("try")).join(files, F.col("try.to") == F.col("_path"))
        out = out.join(tried.groupBy("ord").agg(F.min("try").alias("try")), "ord", "left")
        moved = F.col("try.rank") > 0
        out = out.withColumn("lost", F.col("try").isNull()).withColumn("src", F.coalesce("try.to", "src")).withColumn("directory", F.when(moved, _folder(F.col("src"))).otherwise(F.col("directory"))).drop("try")
    lost = F.col("lost") if known_files is not None else F.lit(False)
    problem = F.when(F.col("src").isNull(), "no file").when(lost, "unknown source").when(F.col("open"), "open quote").when(F.size("tokens") == 0, "no command")
    out = out.select("ord", "src", "directory", "tokens", problem.alias("problem"))
    return out if responses is None else expand_responses(out, responses)


def rejected_entries(checked: DataFrame) -> DataFrame:
    """problem and entries: how many entries each problem keeps out."""
    return checked.filter("problem IS NOT NULL").groupBy("problem").agg(F.count(F.lit(1)).alias("entries"))


def accepted_entries(checked: DataFrame) -> DataFrame:
    """src, args and ord, one row for each source of the entries without a problem: the last entry of a source holds, at the place
    of its first."""
    good = checked.filter("problem IS NULL")
    args = good.select("ord", "src", clean_arguments(F.col("tokens"), F.col("src"), F.col("directory")).alias("args"))
    return args.groupBy("src").agg(F.max_by("args", "ord").alias("args"), F.min("ord").alias("ord"))


def normalize_entries(entries: DataFrame, path_maps: list[tuple[str, str]] | None = None, known_files: DataFrame | None = None, responses: DataFrame | None = None) -> DataFrame:
    """Cleaned arguments of every source; entries with a problem are left out."""
    return accepted_entries(checked_entries(entries, path_maps, known_files, responses))

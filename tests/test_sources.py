import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.sources import catalog, compile_db


def cleaned(spark, rows):
    """Cleaned arguments of (tokens, source, directory) rows."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, tokens array<string>, source string, directory string")
    out = df.select("i", compile_db.clean_arguments(F.col("tokens"), F.col("source"), F.col("directory")).alias("args"))
    return [r["args"] for r in sorted(out.collect(), key=lambda r: r["i"])]


def test_arguments(spark):
    args = ["clang", "-std=c11", "-DX=1", "-Iinc", "-isystem", "/sys", "-m64", "-fPIC", "-Wall", "-O2", "-c", "-o", "x.o", "-lfoo", "-weird", "src/x.c"]
    got, other, empty = cleaned(spark, [(args, "/p/src/x.c", "/p"), (["-x", "c++", "-Wl,-z", "a.c"], "/p/a.c", "/p"), ([], "/x.MM", "/")])
    assert got[:2] == ["-x", "c"] and got[2:11] == ["-std=c11", "-DX=1", "-I", "/p/inc", "-isystem", "/sys", "-m64", "-fPIC", "-O2"]
    assert "-o" not in got and "x.o" not in got and "-lfoo" not in got and "-weird" not in got
    assert got[-5:] == ["-working-directory=/p", "-I", "/p/src", "-I", "/usr/include"]
    assert other[:2] == ["-x", "c++"]
    assert empty == ["-x", "objective-c++", "-working-directory=/", "-I", "/usr/include"]
    retried = spark.range(1).select(compile_db.retry_arguments(F.array(*map(F.lit, ["-m64", "-DX", "-o", "y.o", "-march=native", "-MF", "-I", "/a"])))).first()[0]
    assert retried == ["-DX", "-I", "/a"]


#: Pieces of command lines and what is left of each.
PIECES = [
    (["-I", "inc"], ["-I", "/p/d/inc"]), (["-I../up"], ["-I", "/p/up"]), (["-isystem/s/./t"], ["-isystem", "/s/t"]), (["-iquote", "q"], ["-iquote", "/p/d/q"]), (["-idirafterz"], ["-idirafter", "/p/d/z"]),
    (["-include", "a.h"], ["-include", "/p/d/a.h"]), (["-isysroot=r"], ["-isysroot=/p/d/r"]), (["--sysroot", "/"], ["--sysroot", "/"]), (["--gcc-toolchain=t/../u"], ["--gcc-toolchain=/p/d/u"]),
    (["-target", "arm"], ["-target", "arm"]), (["-D", "A=1"], ["-D", "A=1"]), (["-DB"], ["-DB"]), (["-U", "C"], ["-U", "C"]), (["-std=c99"], ["-std=c99"]), (["-std", "c11"], ["-std", "c11"]),
    (["-o", "out"], []), (["-MF", "x.d"], []), (["-c"], []), (["-g"], []), (["-Wall"], []), (["-Wl,-s"], []), (["-lm"], []), (["-L/x"], []), (["-flto=thin"], []), (["-fPIC"], ["-fPIC"]),
    (["-mavx"], ["-mavx"]), (["-O3"], ["-O3"]), (["-pthread"], ["-pthread"]), (["file.CC"], []), (["lib.a"], []), (["stray"], []), (["@gone"], []), (["-unknown"], []), (["-qqq"], []), (["-stdlib=x"], ["-stdlib=x"]),
]
DANGLING = ["-I", "-D", "-o", "-isysroot", "-MT"]


def test_arguments_in_any_order(spark):
    rng, rows, want = random.Random(7), [], []
    for _ in range(150):
        tokens, out = (["/usr/bin/gcc"] if rng.random() < 0.5 else []), []
        for _ in range(rng.randint(0, 25)):
            given, left = rng.choice(PIECES)
            if rng.random() < 0.2 and given[0].startswith("-"):
                tokens.append(rng.choice(DANGLING))  # an option follows, so the value is missing
            tokens += given
            out += left
        includes = {b for a, b in zip(out, out[1:], strict=False) if a in ("-I", "-isystem", "-iquote", "-idirafter")}
        ends = [x for path in ("/p/d/src", "/usr/include") if path not in includes for x in ("-I", path)]
        rows.append((tokens, "/p/d/src/f.cpp", "/p/d"))
        want.append(["-x", "c++", *out, "-working-directory=/p/d", *ends])
    assert cleaned(spark, rows) == want


def test_response_files(spark, tmp_path):
    (tmp_path / "rsp").mkdir()
    (tmp_path / "rsp" / "a.rsp").write_text("-DONE '-D TWO' -I inc @nested")
    (tmp_path / "rsp" / "bad.rsp").write_text("'open")
    responses = compile_db.read_response_files(spark, str(tmp_path / "rsp"))
    folder = str(tmp_path)
    rows = [(0, folder, "x.c", ["cc", "-DZERO", "@rsp/a.rsp", "-DLAST", "@rsp/bad.rsp", "@none"], None), (1, folder, "y.c", ["cc", "-DY"], None)]
    entries = spark.createDataFrame(rows, "ord long, directory string, file string, arguments array<string>, command string")
    got = {r["src"]: r["args"] for r in compile_db.normalize_entries(entries, responses=responses).collect()}
    assert got[f"{folder}/x.c"][2:8] == ["-DZERO", "-DONE", "-D TWO", "-I", f"{folder}/inc", "-DLAST"] and "-DY" in got[f"{folder}/y.c"]
    assert not any("@" in a for args in got.values() for a in args)


def test_rejected_entries(spark):
    rows = [(0, "/p", "a.c", None, "cc a.c"), (1, "/p", None, None, "cc"), (2, "/p", "", [], ""), (3, "/p", "b.c", None, "cc 'x"), (4, "/p", "c.c", None, None), (5, None, "d.c", ["cc"], None)]
    entries = spark.createDataFrame(rows, "ord long, directory string, file string, arguments array<string>, command string")
    got = {r["problem"]: r["entries"] for r in compile_db.rejected_entries(compile_db.checked_entries(entries)).collect()}
    assert got == {"no file": 2, "open quote": 1, "no command": 1}
    known = spark.createDataFrame([("/p/a.c",), ("/p/b.c",)], "path string")
    got = {r["problem"]: r["entries"] for r in compile_db.rejected_entries(compile_db.checked_entries(entries, known_files=known)).collect()}
    assert got == {"no file": 2, "unknown source": 2, "open quote": 1}


def test_command_line(spark, tmp_path, capsys):
    from graphloom import cli

    rows = [{"directory": "/p", "file": "a.c", "command": "cc -DONE a.c"}, {"directory": "/p", "command": "cc"}, {"directory": "/p", "file": "gone.c", "command": "cc"}]
    (tmp_path / "cc.json").write_text(json.dumps(rows))
    spark.createDataFrame([("/q/a.c",)], "path string").write.parquet(str(tmp_path / "known"))
    given = ["entries", "--compile-commands", str(tmp_path / "cc.json"), "--out", str(tmp_path / "args"), "--path-map", "/p=/q", "--verbose"]
    assert cli.main(given, spark) == 1
    assert cli.main([*given, "--known-files", str(tmp_path / "known")], spark) == 0
    assert [(r["src"], "-DONE" in r["args"]) for r in spark.read.parquet(str(tmp_path / "args")).collect()] == [("/q/a.c", True)]
    assert "left out, no file: 1" in (err := capsys.readouterr().err) and "left out, unknown source: 1" in err


def test_broken_databases(spark, tmp_path):
    for k, text in enumerate(['[{"file": "a.c", "directory": "/p"}, {"file": "b', "[1, 2]", '[{"file": "a.c"}']):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        with pytest.raises(Exception, match="(?i)malformed|parse"):
            compile_db.read_compile_db(spark, str(path)).collect()
    (tmp_path / "empty.json").write_text("")
    with pytest.raises(ValueError):
        compile_db.read_compile_db(spark, str(tmp_path / "empty.json"))
    (tmp_path / "none.json").write_text("  \n []")
    assert compile_db.read_compile_db(spark, str(tmp_path / "none.json")).collect() == []


def test_entries(spark, tmp_path):
    rows = [
        {"directory": "/p", "file": "a.c", "command": "cc -DONE 'q r.c' a.c"},
        {"directory": "/p", "file": "b.cc", "arguments": ["cc", "-DB", "b.cc"]},
        {"directory": "/p", "file": "./a.c", "arguments": ["cc", "-DTWO", "a.c"]},
        {"directory": "/p", "command": "cc x.c"},
        {"directory": "/p", "file": "c.c", "command": "cc 'broken"},
    ]
    path = tmp_path / "cc.json"
    path.write_text(json.dumps(rows))
    got = {r["src"]: r["args"] for r in compile_db.normalize_entries(compile_db.read_compile_db(spark, str(path))).orderBy("ord").collect()}
    assert list(got) == ["/p/a.c", "/p/b.cc"] and "-DTWO" in got["/p/a.c"] and "-DONE" not in got["/p/a.c"] and got["/p/b.cc"][1] == "c++"
    known = spark.createDataFrame([("/q/a.c",)], "path string")
    moved = compile_db.normalize_entries(compile_db.read_compile_db(spark, str(path)), [("/p", "/q")], known).collect()
    assert [r["src"] for r in moved] == ["/q/a.c"]
    path.write_text("{}")
    with pytest.raises(ValueError):
        compile_db.read_compile_db(spark, str(path))


def test_wrapper_csv(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text("﻿Func,Fan-In,path,API\nf,3,/a.c,open\ng,x,none\n")
    rows = [r.asDict() for r in catalog.read_wrapper_csv(spark, str(p)).collect()]
    assert rows[0]["function"] == "f" and rows[0]["fan_in"] == 3 and rows[0]["location"] == "/a.c" and rows[0]["api_called"] == "open" and rows[0]["reason"] == ""
    assert rows[1]["fan_in"] == 0 and rows[1]["location"] == "<unknown>" and rows[1]["api_called"] == ""
    p.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        catalog.read_wrapper_csv(spark, str(p))


def test_catalog_subsets_and_names(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(
        "libc: [open, exit]\nsyscalls: [read]\nfamilies: {f: {apis: [fam], aliases: [fam2], notes: [no]}}\n"
        "categories:\n  stdio.h: [fopen]\n  mixed: {apis: [send], more: [recv], count: 3}\n  system_calls: [read, write]\n"
    )
    names = {r["api"] for r in catalog.load_canon(spark, [None, str(tmp_path / "none.yaml"), str(tmp_path / "c.yaml")]).collect()}
    assert names == {"open", "exit", "read", "fam", "fam2", "fopen", "send", "recv", "write"}
    with pytest.raises(ValueError):
        catalog.load_canon(spark, [None])
    whole = catalog.load_catalog(spark, str(tmp_path / "c.yaml"))[0]
    subset = lambda df, which: {r["api"] for r in catalog.target_subset(df, which).collect()}
    assert subset(whole, "libc") == {"fopen", "send"} and subset(whole, "system_calls") == {"read", "write"}
    (tmp_path / "d.yaml").write_text("libc: [open]\nsyscalls: [read]\n")
    plain = catalog.load_catalog(spark, str(tmp_path / "d.yaml"))[0]
    assert subset(plain, "libc") == {"open"} and subset(plain, "system_calls") == {"read"}

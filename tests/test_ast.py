import itertools

import pytest
from pyspark.sql import functions as F

from graphloom.operators import ast, paths
from graphloom.plans import pipelines
from graphloom.schemas import AST_NODES


class Fn:
    """Builds the rows of one function from nested tuples (kind, {attributes}, child, ...)."""

    def __init__(self, name, *kids, unit="u.c", result="int"):
        self.rows, self.ids, self.unit, self.key = [], itertools.count(), unit, f"c:@F@{name}"
        self.add(("FUNCTION_DECL", {"spelling": name, "tokens": result}, *kids), None, 0, 0)

    def add(self, node, parent, pos, depth):
        kind, attrs, kids = node[0], {}, node[1:]
        if kids and isinstance(kids[0], dict):
            attrs, kids = kids[0], kids[1:]
        i = next(self.ids)
        base = dict.fromkeys(AST_NODES.names)
        base |= {"translation_unit": self.unit, "function_key": self.key, "node_id": i, "parent_id": parent, "child_pos": pos, "pre": i, "depth": depth, "kind": kind, "line": 10 + i, "col": 1}
        self.rows.append(tuple((base | attrs)[n] for n in AST_NODES.names))
        for k, c in enumerate(kids):
            self.add(c, i, k, depth + 1)


def ref(key, kind="PARM_DECL"):
    return ("DECL_REF_EXPR", {"var_key": key, "ref_kind": kind})


def call(name, *args, key=None):
    return ("CALL_EXPR", {"callee": name, "callee_key": key or f"c:@F@{name}"}, ("UNEXPOSED_EXPR",), *args)


def parm(key):
    return ("PARM_DECL", {"var_key": key, "spelling": key})


def body(*stmts):
    return ("COMPOUND_STMT", *stmts)


def summary(spark, *fns, **kw):
    nodes = spark.createDataFrame([r for f in fns for r in f.rows], AST_NODES)
    targets = spark.createDataFrame([("open",), ("close",), ("read",)], "api string")
    rows = ast.function_summaries(nodes, targets, kw.get("helpers"))
    return nodes, rows


def masks(spark, *stmts):
    _, rows = summary(spark, Fn("f", parm("p"), body(*stmts)))
    r = rows.first()
    return {i for i in range(3) if r["mask"] >> i & 1}, r["unknown"]


OPEN = call("open", ref("p"))


@pytest.mark.parametrize(
    ("stmts", "counts", "unknown"),
    [
        ([], {0}, False),
        ([OPEN], {1}, False),
        ([OPEN, OPEN, OPEN], {2}, False),
        ([("IF_STMT", ref("p"), OPEN)], {0, 1}, False),
        ([("IF_STMT", OPEN, OPEN, OPEN)], {1}, False),
        ([("IF_STMT", ref("p"), OPEN), OPEN], {1, 2}, False),
        ([("RETURN_STMT", ("UNEXPOSED_EXPR", OPEN)), OPEN], {2}, False),
        ([("SWITCH_STMT", ref("p"), ("CASE_STMT", ("INTEGER_LITERAL",), OPEN))], {1}, False),
        ([("SWITCH_STMT", ref("p"), body(("CASE_STMT", ("INTEGER_LITERAL",), OPEN)))], {0}, False),
        ([("WHILE_STMT", ref("p"), body(OPEN))], {0, 1}, False),
        ([("WHILE_STMT", ref("p"), body(OPEN, OPEN))], {2}, True),
        ([("WHILE_STMT", ref("p"), OPEN)], {2}, True),
        ([("DECL_STMT", ("VAR_DECL", {"var_key": "v"}, OPEN))], {0, 1}, False),
        ([("CONDITIONAL_OPERATOR", ref("p"), OPEN, ref("p"))], {0, 1}, False),
    ],
)
def test_path_counts(spark, stmts, counts, unknown):
    assert masks(spark, *stmts) == (counts, unknown)


def test_reasons(spark):
    guard = ("IF_STMT", ref("p"), body(("RETURN_STMT", ref("p"))))
    fns = [
        Fn("plain", parm("p"), body(("RETURN_STMT", ("UNEXPOSED_EXPR", OPEN)))),
        Fn("nobody"),
        Fn("never", body(call("other"))),
        Fn("loop", parm("p"), body(("WHILE_STMT", ref("p"), OPEN))),
        Fn("half", parm("p"), body(("IF_STMT", ref("p"), OPEN))),
        Fn("guarded", parm("p"), body(guard, OPEN)),
        Fn("twice", parm("p"), body(OPEN, call("read", ref("p")))),
        Fn("both", parm("p"), body(OPEN, call("close", ref("p")))),
        Fn("hopper", parm("p"), body(call("inner", ref("p")))),
        Fn("inner", parm("p"), body(OPEN)),
        Fn("far", parm("p"), body(call("hopper", ref("p")))),
    ]
    nodes, rows = summary(spark, *fns)
    got = {r["function"]: (r["kept"], r["reason"], r["api_called"]) for r in ast.classify(rows).collect()}
    assert got["plain"] == (True, "ok", "open") and got["nobody"][1] == "no-body" and got["never"][1] == "path-counts=[0]"
    assert got["loop"][1] == "unknown-control-flow" and got["half"][1] == "path-counts=[0, 1]" and got["twice"][1] == "reject: multi-call-per-path"
    assert got["both"] == (True, "ok+atomic-pair", "open") and got["hopper"] == (True, "ok+via-hop", "open")
    assert got["far"][1] == "ok+via-hop" and got["far"][0] is False  # two hops away there is no name for the target
    relaxed = {r["function"]: r["kept"] for r in ast.classify(rows, "relaxed").collect()}
    assert relaxed["half"] and relaxed["twice"] and not relaxed["never"] and not relaxed["far"]
    every = {r["function"]: (r["api_called"], r["reason"]) for r in ast.classify(rows, "all").collect()}
    assert every["never"] == ("other", "N/A") and len(every) == len(fns)
    thin = {r["function"]: r["reason"] for r in ast.classify(rows, thin_aliases=["open"]).collect()}
    assert thin["hopper"] == "reject: thin-alias-via-helper"
    assert {r["function"]: r["reason"] for r in ast.classify(rows, thin_aliases=["open"], thin_policy="allow-1-hop").collect()}["hopper"] == "ok+via-hop"


def test_taint_and_passing(spark):
    local = ("DECL_STMT", ("VAR_DECL", {"var_key": "v"}, ref("p")))
    fns = [
        Fn("direct", parm("p"), parm("q"), body(("RETURN_STMT", call("open", ("PAREN_EXPR", ref("p")), ("CSTYLE_CAST_EXPR", ref("q")))))),
        Fn("through", parm("p"), body(local, call("open", ref("v", "VAR_DECL")))),
        Fn("constant", parm("p"), body(call("open", ("INTEGER_LITERAL",)), ("RETURN_STMT", ref("p")))),
        Fn("member", parm("p"), body(call("open", ("UNARY_OPERATOR", ("MEMBER_REF_EXPR", ref("p")))))),
        Fn("nothing", parm("p"), body(call("open")), result="void"),
    ]
    _, rows = summary(spark, *fns)
    got = {r["function"]: r for r in rows.collect()}
    assert (got["direct"]["arg_pass"], got["direct"]["ret_pass"], got["direct"]["derived"]) == ("yes - all", "yes - all", True)
    assert got["through"]["derived"] and got["through"]["arg_pass"] == "no" and got["through"]["trace"] == ["arg0:tainted [p is param]"]
    assert not got["constant"]["derived"] and got["constant"]["ret_pass"] == "no" and got["constant"]["trace"] == ["arg0:clean"]
    assert got["member"]["arg_pass"] == "yes - all" and got["nothing"]["arg_pass"] == "no" and got["nothing"]["derived"]


def test_helpers_and_syscalls(spark):
    selector = ("UNEXPOSED_EXPR", {"tokens": "SYS_open"})
    fns = [Fn("sys", body(("CALL_EXPR", {"callee": "syscall", "callee_key": "k"}, ("UNEXPOSED_EXPR",), selector))), Fn("log", parm("p"), body(call("log_it"), OPEN))]
    nodes, rows = summary(spark, *fns, helpers=[("helpers", "^log", True)])
    got = {r["function"]: r for r in rows.collect()}
    assert got["sys"]["apis"] == ["open"] and got["log"]["ignored_helpers"] == ["log_it"]
    e = {(r["caller"], r["callee"], r["loc"].split(":")[0]) for r in ast.call_edges(nodes).collect()}
    assert e == {("sys", "syscall", "u.c"), ("log", "log_it", "u.c"), ("log", "open", "u.c")}


def test_masks():
    for a in range(8):
        for b in range(8):
            want = {min(2, i + j) for i in range(3) for j in range(3) if a >> i & 1 and b >> j & 1}
            assert {i for i in range(3) if paths.add_masks(a, b) >> i & 1} == want


def test_wrappers_end_to_end(spark, tmp_path):
    fns = [Fn("my_open", parm("p"), body(call("open", ref("p")))), Fn("user", parm("p"), body(call("my_open", ref("p")))), Fn("my_open", parm("p"), body(call("open", ref("p"))), unit="v.c")]
    nodes = spark.createDataFrame([r for f in fns for r in f.rows], AST_NODES)
    catalog = spark.createDataFrame([("open", "fcntl.h", "files"), ("close", "unistd.h", "files")], "api string, header string, grp string")
    rows = {r["function"]: r for r in pipelines.find_wrappers(nodes, catalog).collect()}
    assert (rows["my_open"]["api_called"], rows["my_open"]["category"], rows["my_open"]["fan_in"], rows["my_open"]["arg_pass"]) == ("open", "files", 1, "yes - all")
    assert rows["user"]["api_called"] == "open" and rows["user"]["callees"] == ["my_open", "open"]

    from graphloom import cli

    nodes.write.parquet(str(tmp_path / "nodes"))
    (tmp_path / "c.yaml").write_text("categories:\n  fcntl.h: [open]\n  unistd.h: {apis: [close]}\nhelpers:\n  helpers: [log_it]\n")
    (tmp_path / "g.txt").write_text("Files\n  fcntl.h unistd.h\nOther\n  fcntl.h\n")
    common = ["--ast-nodes", str(tmp_path / "nodes"), "--yaml", str(tmp_path / "c.yaml"), "--groups", str(tmp_path / "g.txt")]
    assert cli.main(["run", *common, "--out", str(tmp_path / "w.csv"), "--callgraph-out", str(tmp_path / "cg")], spark) == 0
    lines = (tmp_path / "w.csv").read_text().splitlines()
    assert lines[0].startswith("file,function,api_called,category") and len(lines) == 3 and "Files" in lines[1]
    scored = (tmp_path / "w._fuzzy_scored.csv").read_text().splitlines()
    assert scored[0].startswith("likelihood_score,function") and any(x.startswith("100%,my_open,open,open,Files") for x in scored)
    assert sorted(p.name for p in (tmp_path / "cg").iterdir()) == ["call_counts.csv", "callgraph_edges.csv", "function_fan_summary.csv", "translation_units.csv"]
    assert cli.main(["finder", *common, "--edge-evidence", "my_open", "--out", str(tmp_path / "e.jsonl"), "--output", "jsonl"], spark) == 0
    assert len((tmp_path / "e.jsonl").read_text().splitlines()) >= 3
    assert cli.main(["finder", *common, "--edge-evidence", "missing"], spark) == 1
    moved = nodes.withColumn("translation_unit", F.when(F.col("translation_unit") == "u.c", "/src/lib/u.c").otherwise("/usr/include/v.c"))
    moved.unionByName(nodes.filter("translation_unit = 'v.c'").withColumn("translation_unit", F.lit("/src/app/v.c"))).write.parquet(str(tmp_path / "moved"))
    only = ["finder", "--ast-nodes", str(tmp_path / "moved"), *common[2:], "--project-only", "--out", str(tmp_path / "own.csv")]
    assert cli.main(only, spark) == 0 and "/usr/include" not in (own := (tmp_path / "own.csv").read_text()) and "/src/" in own


def test_deep_bodies(spark):
    """No recursion: a call under 5,000 nested blocks and parentheses."""
    f = Fn("deep", parm("p"))
    ids, n = itertools.count(len(f.rows)), len(f.rows)
    base = dict.fromkeys(AST_NODES.names) | {"translation_unit": "u.c", "function_key": f.key, "line": 1, "col": 1}

    def add(parent, pos, kind, **kw):
        i = next(ids)
        f.rows.append(tuple((base | {"node_id": i, "parent_id": parent, "child_pos": pos, "pre": i, "kind": kind} | kw)[c] for c in AST_NODES.names))
        return i

    at = 0
    for k in range(5000):
        at = add(at, 1 if not k else 0, "COMPOUND_STMT")
    at = add(at, 0, "CALL_EXPR", callee="open", callee_key="c:@F@open")
    add(at, 0, "UNEXPOSED_EXPR")
    for k in range(5000):
        at = add(at, 0 if k else 1, "PAREN_EXPR")
    add(at, 0, "DECL_REF_EXPR", var_key="p", ref_kind="PARM_DECL")
    _, rows = summary(spark, f)
    r = rows.first()
    assert (r["mask"], r["arg_pass"], r["derived"], r["apis"]) == (paths.ONE, "yes - all", True, ["open"])

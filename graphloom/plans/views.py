"""The domain tables as views over the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFS = """
SELECT concat('c:@F@', p_partkey) AS function_key,
       concat(replace(p_name, ' ', '_'), CASE WHEN p_partkey % 3 = 0 THEN concat('_', p_partkey) ELSE '' END) AS function,
       concat('/repo/', lower(replace(p_type, ' ', '_')), '/', p_brand, '.c') AS file, p_size AS line, p_partkey AS part
FROM part
"""

#: Consecutive lines of an order call each other; every fifth callee has an unknown key.
EDGES = """
SELECT concat('c:@F@', e.caller_part) AS caller_key,
       CASE WHEN e.callee_part % 5 = 0 THEN concat(d2.function, '@<unknown>') ELSE concat('c:@F@', e.callee_part) END AS callee_key,
       d1.function AS caller, d2.function AS callee,
       concat('/repo/f.c:', e.l_orderkey, ':', e.l_linenumber) AS loc, concat(e.l_returnflag, e.l_linestatus) AS translation_unit, e.l_quantity AS quantity
FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_partkey AS caller_part,
             lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS callee_part
      FROM lineitem) e
JOIN all_defs d1 ON d1.part = e.caller_part
JOIN all_defs d2 ON d2.part = e.callee_part
WHERE e.callee_part IS NOT NULL
"""

DIAGNOSTICS = """
SELECT cast(user_id AS varchar(20)) AS translation_unit,
       CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS severity
FROM events
"""

# Names of the C library with their headers and groups.
APIS = (
    ("open", "fcntl.h", "files"), ("close", "unistd.h", "files"), ("read", "unistd.h", "files"), ("write", "unistd.h", "files"), ("fopen", "stdio.h", "stdio"),
    ("fclose", "stdio.h", "stdio"), ("fread", "stdio.h", "stdio"), ("fwrite", "stdio.h", "stdio"), ("printf", "stdio.h", "stdio"), ("malloc", "stdlib.h", "memory"),
    ("calloc", "stdlib.h", "memory"), ("realloc", "stdlib.h", "memory"), ("free", "stdlib.h", "memory"), ("socket", "sys/socket.h", "network"),
    ("connect", "sys/socket.h", "network"), ("accept", "sys/socket.h", "network"), ("listen", "sys/socket.h", "network"), ("send", "sys/socket.h", "network"),
    ("recv", "sys/socket.h", "network"), ("memcpy", "string.h", "strings"), ("memset", "string.h", "strings"), ("strlen", "string.h", "strings"),
    ("strcpy", "string.h", "strings"), ("pthread_create", "pthread.h", "threads"), ("pthread_join", "pthread.h", "threads"),
    ("pthread_mutex_lock", "pthread.h", "threads"), ("pthread_mutex_unlock", "pthread.h", "threads"), ("getenv", "stdlib.h", "process"),
    ("execve", "unistd.h", "process"), ("waitpid", "sys/wait.h", "process"),
)
CATALOG = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{h}', '{g}')" for i, (a, h, g) in enumerate(APIS)) + ") AS c(n, api, header, grp)"

#: A function for each part, its name made from an API's.
NAMED = """
SELECT p_partkey AS part, concat('c:@F@', p_partkey) AS function_key, c.api, c.header, c.grp, p_size AS size,
       CASE p_partkey % 7 WHEN 0 THEN concat('ngx_', c.api) WHEN 1 THEN concat(c.api, '_impl') WHEN 2 THEN concat('my', upper(substr(c.api, 1, 1)), substr(c.api, 2), 'Safe')
            WHEN 3 THEN concat('do_', c.api, '_', p_size) WHEN 4 THEN concat('x', substr(c.api, 1, 4)) WHEN 5 THEN concat('__', c.api, '_locked') ELSE lower(replace(p_type, ' ', '_')) END AS function,
       CASE p_partkey % 4 WHEN 0 THEN c.api WHEN 1 THEN concat(c.api, ' - ', d.api) WHEN 2 THEN concat(d.api, ' - other - ', c.api, ' - ', d.api) ELSE '' END AS api_called,
       CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat(c.api, '; log_error') WHEN 2 THEN concat(d.api, ' - ', c.api) ELSE concat(c.api, '|check,', d.api) END AS callee,
       CASE p_partkey % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN '' ELSE c.grp END AS category,
       CASE p_partkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok+via-hop' WHEN 2 THEN '' ELSE 'reject: multi-call-per-path' END AS reason,
       CASE p_partkey % 3 WHEN 0 THEN 'yes - all' WHEN 1 THEN 'Yes  -  2' ELSE 'no' END AS arg_pass,
       CASE p_partkey % 4 WHEN 0 THEN 'yes - all' WHEN 1 THEN 'yes - 1' ELSE 'no' END AS ret_pass,
       p_partkey % 11 AS fan_in, p_partkey % 9 AS fan_out
FROM part JOIN catalog c ON c.n = p_partkey % 30 JOIN catalog d ON d.n = (p_partkey * 7 + 3) % 30
"""

#: Flat function bodies: a statement for each line of an order. A: a call, N: a call under a condition, R: none.
BODIES = "SELECT l_orderkey AS func, l_linenumber AS pos, CASE l_returnflag WHEN 'A' THEN 'CALL' WHEN 'N' THEN 'IF' ELSE 'OTHER' END AS kind, l_partkey AS part FROM lineitem"

#: The lines of an order are the statements of a function: k is the statement's form, j what it calls (under 30: an API, under
#: 40: a logging helper, 44: syscall, else the function three orders before, in the same unit).
STATEMENTS = """
SELECT f, r, part, (part + r) % 6 AS k, part % 45 AS j FROM (
  SELECT l_orderkey AS f, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r
  FROM lineitem) x
"""
_CALLED = "CASE k WHEN 0 THEN 10 * r WHEN 1 THEN 10 * r + 2 WHEN 2 THEN 10 * r + 1 ELSE 10 * r + 3 END"
_NODE = "concat('u', f % 3, '.c') AS translation_unit, concat('c:@F@f', f) AS function_key"
#: Each form's nodes in preorder: a call; an if with a call; a return of a call; a loop around a call; a declaration; a guard.
AST = f"""
SELECT translation_unit, function_key, cast(node_id AS int) AS node_id, cast(parent_id AS int) AS parent_id, cast(child_pos AS int) AS child_pos, cast(node_id AS int) AS pre,
       cast(NULL AS int) AS depth, kind, spelling, ref_kind, var_key, callee, callee_key, cast(f % 1000 AS int) AS line, cast(node_id AS int) AS col, tokens
FROM (
SELECT DISTINCT f, {_NODE}, 0 AS node_id, NULL AS parent_id, 0 AS child_pos, 'FUNCTION_DECL' AS kind, concat('f', f) AS spelling, NULL AS ref_kind, NULL AS var_key, NULL AS callee,
       NULL AS callee_key, CASE WHEN f % 5 = 0 THEN 'void' ELSE 'int' END AS tokens FROM statements
UNION ALL SELECT DISTINCT f, {_NODE}, 1, 0, 0, 'PARM_DECL', 'p', NULL, 'p', NULL, NULL, NULL FROM statements
UNION ALL SELECT DISTINCT f, {_NODE}, 2, 0, 1, 'PARM_DECL', 'q', NULL, 'q', NULL, NULL, NULL FROM statements WHERE f % 2 = 0
UNION ALL SELECT DISTINCT f, {_NODE}, 3, 0, 2, 'COMPOUND_STMT', '', NULL, NULL, NULL, NULL, NULL FROM statements
UNION ALL SELECT f, {_NODE}, 10 * r, 3, r, CASE k WHEN 1 THEN 'IF_STMT' WHEN 2 THEN 'RETURN_STMT' WHEN 3 THEN 'WHILE_STMT' WHEN 4 THEN 'DECL_STMT' ELSE 'IF_STMT' END,
       '', NULL, NULL, NULL, NULL, NULL FROM statements WHERE k <> 0
UNION ALL SELECT f, {_NODE}, 10 * r + 1, 10 * r, 0, 'DECL_REF_EXPR', 'p', 'PARM_DECL', 'p', NULL, NULL, NULL FROM statements WHERE k IN (1, 3, 5)
UNION ALL SELECT f, {_NODE}, 10 * r + 2, 10 * r, 1, 'COMPOUND_STMT', '', NULL, NULL, NULL, NULL, NULL FROM statements WHERE k IN (3, 5)
UNION ALL SELECT f, {_NODE}, 10 * r + 3, 10 * r + 2, 0, 'RETURN_STMT', '', NULL, NULL, NULL, NULL, NULL FROM statements WHERE k = 5
UNION ALL SELECT f, {_NODE}, 10 * r + 1, 10 * r, 0, 'VAR_DECL', 'v', NULL, 'v', NULL, NULL, NULL FROM statements WHERE k = 4
UNION ALL SELECT f, {_NODE}, 10 * r + 2, 10 * r + 1, 0, 'DECL_REF_EXPR', 'p', 'PARM_DECL', 'p', NULL, NULL, NULL FROM statements WHERE k = 4
UNION ALL SELECT s.f, {_NODE}, {_CALLED}, CASE k WHEN 0 THEN 3 WHEN 3 THEN 10 * r + 2 ELSE 10 * r END, CASE k WHEN 0 THEN r WHEN 1 THEN 1 ELSE 0 END, 'CALL_EXPR', '', NULL, NULL,
       CASE WHEN j < 30 THEN c.api WHEN j < 40 THEN 'log_it' WHEN j = 44 THEN 'syscall' ELSE concat('f', f - 3) END,
       CASE WHEN j < 30 THEN concat('c:@F@', c.api) WHEN j < 40 THEN 'c:@F@log_it' WHEN j = 44 THEN 'c:@F@syscall' ELSE concat('c:@F@f', f - 3) END, NULL
       FROM statements s LEFT JOIN catalog c ON c.n = s.j WHERE k < 4
UNION ALL SELECT f, {_NODE}, {_CALLED} + 1, {_CALLED}, 0, 'UNEXPOSED_EXPR', '', NULL, NULL, NULL, NULL, NULL FROM statements WHERE k < 4
UNION ALL SELECT f, {_NODE}, {_CALLED} + 2, {_CALLED}, 1, CASE WHEN j = 44 THEN 'UNEXPOSED_EXPR' WHEN part % 2 = 0 THEN 'DECL_REF_EXPR' ELSE 'INTEGER_LITERAL' END, '',
       CASE WHEN j <> 44 AND part % 2 = 0 THEN 'PARM_DECL' END, CASE WHEN j <> 44 AND part % 2 = 0 THEN 'p' END, NULL, NULL, CASE WHEN j = 44 THEN 'SYS_open' END FROM statements WHERE k < 4
) n
"""

# Statement forms as trees: form, offset of the node, offset of its parent (-1: the body), position, kind, variable, which call it is.
_FORMS = {
    "a switch over a call and nothing": ["-1 0 SWITCH_STMT", "0 0 DECL_REF_EXPR p", "0 1 CASE_STMT", "2 0 INTEGER_LITERAL", "2 1 CALL_EXPR - a", "4 0 UNEXPOSED_EXPR", "0 2 DEFAULT_STMT", "6 0 INTEGER_LITERAL", "6 1 DECL_REF_EXPR p"],
    "a call, else two": ["-1 0 IF_STMT", "0 0 DECL_REF_EXPR p", "0 1 CALL_EXPR - a", "2 0 UNEXPOSED_EXPR", "0 2 COMPOUND_STMT", "4 0 CALL_EXPR - b", "5 0 UNEXPOSED_EXPR", "4 1 CALL_EXPR - b", "7 0 UNEXPOSED_EXPR"],
    "a declaration by one call or another": ["-1 0 DECL_STMT", "0 0 VAR_DECL u", "1 0 CONDITIONAL_OPERATOR", "2 0 DECL_REF_EXPR p", "2 1 CALL_EXPR - a", "4 0 UNEXPOSED_EXPR", "4 1 INTEGER_LITERAL", "2 2 CALL_EXPR - b", "7 0 UNEXPOSED_EXPR"],
    "a loop of two calls": ["-1 0 DO_STMT", "0 0 COMPOUND_STMT", "1 0 CALL_EXPR - a", "2 0 UNEXPOSED_EXPR", "1 1 CALL_EXPR - b", "4 0 UNEXPOSED_EXPR", "0 1 DECL_REF_EXPR p"],
    "a loop of one call": ["-1 0 FOR_STMT", "0 0 DECL_REF_EXPR p", "0 1 COMPOUND_STMT", "2 0 CALL_EXPR - a", "3 0 UNEXPOSED_EXPR"],
    "a return of a call of a call": ["-1 0 RETURN_STMT", "0 0 UNEXPOSED_EXPR", "1 0 CALL_EXPR - a", "2 0 UNEXPOSED_EXPR", "2 1 CALL_EXPR - b", "4 0 UNEXPOSED_EXPR"],
    "v from p": ["-1 0 BINARY_OPERATOR", "0 0 DECL_REF_EXPR v", "0 1 PAREN_EXPR", "2 0 DECL_REF_EXPR p"],
    "w from v": ["-1 0 DECL_STMT", "0 0 VAR_DECL w", "1 0 CSTYLE_CAST_EXPR", "2 0 DECL_REF_EXPR v"],
    "a call with w": ["-1 0 CALL_EXPR - a", "0 0 UNEXPOSED_EXPR", "0 1 DECL_REF_EXPR w"],
    "a call with a member of p and a cast of q": ["-1 0 CALL_EXPR - a", "0 0 UNEXPOSED_EXPR", "0 1 UNARY_OPERATOR", "2 0 MEMBER_REF_EXPR", "3 0 DECL_REF_EXPR p", "0 2 CSTYLE_CAST_EXPR", "5 0 DECL_REF_EXPR q"],
    "a return of a sum": ["-1 0 RETURN_STMT", "0 0 BINARY_OPERATOR", "1 0 CALL_EXPR - a", "2 0 UNEXPOSED_EXPR", "1 1 INTEGER_LITERAL"],
    "a call of a call": ["-1 0 CALL_EXPR - a", "0 0 UNEXPOSED_EXPR", "0 1 CALL_EXPR - b", "2 0 UNEXPOSED_EXPR", "2 1 DECL_REF_EXPR p"],
}


def _form_rows() -> str:
    cells = ([m, o, *(*node.split(), "-", "-")[:5]] for m, nodes in enumerate(_FORMS.values()) for o, node in enumerate(nodes))
    return ", ".join(f"({m}, {o}, {up}, {pos}, '{kind}', '{var}', '{call}')" for m, o, up, pos, kind, var, call in cells)


FORMS = f"SELECT * FROM (VALUES {_form_rows()}) AS t(m, o, up, pos, kind, var, which)"

#: The statements with one of the forms each (m) and what its calls are: under 30 an API, else a logging helper.
SHAPED = f"SELECT f, r, part, (part + r) % {len(_FORMS)} AS m, part % 40 AS a, (part * 7 + 3) % 40 AS b FROM statements"

#: Bodies of these statements as nodes, a call with its number j.
DEEP_NODES = """
SELECT s.f, s.r, s.m, 40 * s.r + t.o AS node_id, CASE WHEN t.up < 0 THEN 3 ELSE 40 * s.r + t.up END AS parent_id, CASE WHEN t.up < 0 THEN s.r ELSE t.pos END AS child_pos,
       t.kind, t.var, t.o, t.which, CASE t.which WHEN 'a' THEN s.a WHEN 'b' THEN s.b END AS j
FROM shaped s JOIN forms t ON t.m = s.m
"""
DEEP = f"""
SELECT translation_unit, function_key, cast(node_id AS int) AS node_id, cast(parent_id AS int) AS parent_id, cast(child_pos AS int) AS child_pos, cast(node_id AS int) AS pre,
       cast(NULL AS int) AS depth, kind, spelling, ref_kind, var_key, callee, callee_key, cast(f % 1000 AS int) AS line, cast(node_id AS int) AS col, tokens
FROM (
SELECT DISTINCT f, {_NODE}, 0 AS node_id, NULL AS parent_id, 0 AS child_pos, 'FUNCTION_DECL' AS kind, concat('f', f) AS spelling, NULL AS ref_kind, NULL AS var_key, NULL AS callee,
       NULL AS callee_key, CASE WHEN f % 5 = 0 THEN 'void' ELSE 'int' END AS tokens FROM shaped
UNION ALL SELECT DISTINCT f, {_NODE}, 1, 0, 0, 'PARM_DECL', 'p', NULL, 'p', NULL, NULL, NULL FROM shaped
UNION ALL SELECT DISTINCT f, {_NODE}, 2, 0, 1, 'PARM_DECL', 'q', NULL, 'q', NULL, NULL, NULL FROM shaped WHERE f % 2 = 0
UNION ALL SELECT DISTINCT f, {_NODE}, 3, 0, 2, 'COMPOUND_STMT', '', NULL, NULL, NULL, NULL, NULL FROM shaped
UNION ALL SELECT d.f, {_NODE}, d.node_id, d.parent_id, d.child_pos, d.kind, CASE d.kind WHEN 'VAR_DECL' THEN d.var ELSE '' END,
       CASE WHEN d.kind = 'DECL_REF_EXPR' THEN CASE WHEN d.var IN ('p', 'q') THEN 'PARM_DECL' ELSE 'VAR_DECL' END END, CASE WHEN d.var <> '-' THEN d.var END,
       CASE WHEN d.j < 30 THEN c.api WHEN d.j >= 30 THEN 'log_it' END, CASE WHEN d.j < 30 THEN concat('c:@F@', c.api) WHEN d.j >= 30 THEN 'c:@F@log_it' END, NULL
       FROM deep_nodes d LEFT JOIN catalog c ON c.n = d.j
) n
"""

VIEWS = {"catalog": CATALOG, "all_defs": DEFS, "defs": "SELECT * FROM all_defs WHERE part % 10 < 7", "edges": EDGES, "diagnostics": DIAGNOSTICS, "named": NAMED, "bodies": BODIES, "statements": STATEMENTS, "ast": AST, "forms": FORMS, "shaped": SHAPED, "deep_nodes": DEEP_NODES, "deep": DEEP}
_NEEDS = {
    "defs": ("all_defs",), "edges": ("all_defs",), "named": ("catalog",), "ast": ("catalog", "statements"), "shaped": ("statements",),
    "deep_nodes": ("statements", "shaped", "forms"), "deep": ("catalog", "statements", "shaped", "forms", "deep_nodes"),
}
_TABLES = {"all_defs": ("part",), "defs": ("part",), "edges": ("part", "lineitem"), "diagnostics": ("events",), "named": ("part",), "catalog": (), "bodies": ("lineitem",), "statements": ("lineitem",), "ast": (), "forms": (), "shaped": (), "deep_nodes": (), "deep": ()}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table; temporary views carry the folder in their names, so folders do not mix."""
    import re

    text = VIEWS[name]
    for need in (*_NEEDS.get(name, ()), *_TABLES[name]):
        df = view(spark, sf_dir, need) if need in VIEWS else spark.read.parquet(f"{sf_dir}/{need}.parquet")
        alias = f"{need}_{abs(hash(sf_dir)):x}"
        df.createOrReplaceTempView(alias)
        text = re.sub(rf"\b(FROM|JOIN) {need}\b", rf"\1 {alias}", text)
    return spark.sql(text)


def prelude(*names: str) -> str:
    """The views as the beginning of a DuckDB query, each after what it needs."""
    order: list[str] = []
    for name in names:
        for n in (*_NEEDS.get(name, ()), name):
            if n not in order:
                order.append(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)

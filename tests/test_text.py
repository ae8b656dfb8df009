import random

from pyspark.sql import functions as F

from graphloom.functions import text as X


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first().asDict(recursive=True)


def test_names(spark):
    L = F.lit
    r = one(
        spark,
        a=X.normalize(L("  myOpen_File--v2 ")), b=X.normalize(L("Größe")), c=X.strip_affixes(L("__ngx_open_impl_locked")), d=X.strip_affixes(L("ngx_redis_open_locked")),
        e=X.tokenize(L("fooBar_baz")), f=X.split_api_names(L("open - other -  open - close - ")), g=X.join_api_names(F.array(L("a"), L("Other"), L("b"), L("a"))),
        h=X.split_callees(L("a - b; c,d|e  f")), i=X.normalize(L(None).cast("string")),
    )
    assert r["a"] == "my open file v2" and r["b"] == "gr e" and r["i"] == ""
    assert r["c"] == "ngx_open_impl" and r["d"] == "open"
    assert r["e"] == ["foo", "bar", "baz"] and r["f"] == ["open", "close"] and r["g"] == "a - b" and r["h"] == list("abcdef")


def test_locations(spark):
    r = one(spark, a=X.parse_callsite(F.lit("/a:b/f.c:17:9")), b=X.parse_callsite(F.lit("odd:x:1")), c=X.callsite_order(F.lit("nothing")), d=X.serialize_hit_locs(F.array(F.lit("1:2 ,3"), F.lit("")))
            , e=X.safe_stem(F.lit("..a b/c_")), f=X.syscall_selector(F.lit("syscall"), F.lit("__NR_openat")), g=X.syscall_selector(F.lit("open"), F.lit("SYS_x")))
    assert r["a"] == {"file": "/a:b/f.c", "line": 17, "column": 9} and r["b"] == {"file": "odd:x:1", "line": 0, "column": 0}
    assert r["c"]["line"] == 10**9 and r["d"] == "1:2_3" and r["e"] == "a_b_c" and r["f"] == "openat" and r["g"] is None


def test_formats(spark):
    r = one(spark, a=X.likelihood(F.lit(0.125)), b=X.likelihood(F.lit(0.135)), c=X.provenance(F.lit("  Yes  -   All ")), d=X.severity_bucket(F.lit(-1)), e=X.severity_bucket(F.lit(7)))
    assert (r["a"], r["c"], r["d"], r["e"]) == ("12%", "yes - all", "ignored", "fatal") and r["b"] in ("13%", "14%")


def common(a, b):
    return max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0)


def test_common_substring_against_brute_force(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", X.common_substring(F.col("a"), F.col("b")).alias("n")).collect():
        assert r["n"] == common(r["a"], r["b"]), r

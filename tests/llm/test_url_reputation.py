"""Parts of a url, rules, and posteriors."""

from pyspark.sql import functions as F

from veritrim.llm import url_reputation as U

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_parts_and_rules(spark):
    rows = [
        ("https://A.B.example.NET/en/x?y#z", "a.b.example.net", "/en/x", "example.net/en/"),
        ("http://example.net", "example.net", "", None),
        ("http://example.net/", "example.net", "/", "net/"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None),
        ("http://m.example.com/de/1", "m.example.com", "/de/1", "example.com/de/"),
        ("x://org/fr/?://b/c", "org", "/fr/", "org/fr/"),
        ("ftp://h?q=/en/", "h", "", None),
        ("a://b\nc/d\ne#f", "b\nc", "/d\ne", None),
        ("no scheme/net/", "", "", None),
        ("://", "", "", None),
        ("", "", "", None),
        (None, "", "", None),
    ]
    df = spark.createDataFrame([(i, r[0], "mine") for i, r in enumerate(rows)], "page_id long, url string, host string")
    got = U.judge(df, F.lit(None).cast("int"), RULES).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in got] == [r[1:] for r in rows]
    assert all(r.verdict == ("allow" if r.rule is None else dict(RULES)[r.rule]) for r in got)
    assert U.judge(df.filter("false"), F.lit(1), RULES).collect() == []


def test_reputation_shrinks_and_bounds(spark):
    rows = [("bad.spam.com", 1)] * 200 + [("good.fine.com", 0)] * 400 + [("few.fine.com", 1)] * 2 + [("new.spam.com", None)] + [(None, 0)]
    got = {r.host: r for r in U.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.spam.com"].blocked and not got["good.fine.com"].blocked
    assert not got["few.fine.com"].blocked and 0 < got["few.fine.com"].mean < 1
    assert got["new.spam.com"].n == 0 and got["new.spam.com"].mean > got["good.fine.com"].mean
    assert all(r.bound < r.mean for r in got.values()) and "" in got


def test_named_suffixes(spark):
    limits = U.Limits(suffixes=("co.uk",))
    df = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.uk",), ("",)], "host string")
    suffix = U.suffix_of(F.col("host"), limits)
    got = [tuple(r) for r in df.select(suffix, U.domain_of(F.col("host"), suffix)).collect()]
    assert got == [("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("uk", "x.uk"), ("", "")]

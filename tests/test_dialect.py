"""Golden rows of the dialect, and a randomised comparison of scalar functions with the sqlite3 of the standard library."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from brindle.functions import datetimes as dt
from brindle.functions import dialect as d
from brindle.functions import jsonfn, mathfn, strings
from brindle.operators import recursion, search, setops, windows
from brindle.plans import frontend
from brindle.sources import tvf


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_substr_like_sqlite(spark):
    con = sqlite3.connect(":memory:")
    cases = [("hello", y, z) for y in range(-7, 8) for z in (None, *range(-7, 8))] + [("", 1, 2), ("é日本", -2, 1)]
    df = spark.createDataFrame([(i, s, y, z) for i, (s, y, z) in enumerate(cases)], "i int, s string, y int, z int")
    both = df.select("i", F.when(F.col("z").isNull(), strings.substr(F.col("s"), F.col("y"))).otherwise(strings.substr(F.col("s"), F.col("y"), F.col("z"))).alias("v"))
    got = {r["i"]: r["v"] for r in both.collect()}
    for i, (s, y, z) in enumerate(cases):
        want = con.execute("select substr(?,?)", (s, y)).fetchone()[0] if z is None else con.execute("select substr(?,?,?)", (s, y, z)).fetchone()[0]
        assert got[i] == want, (s, y, z)


def test_patterns_like_sqlite(spark):
    con, r = sqlite3.connect(":memory:"), random.Random(3)
    words = ["".join(r.choice("aAbB%_*?[]^\\.c") for _ in range(r.randint(0, 7))) for _ in range(150)]
    df = spark.createDataFrame([(w,) for w in words], "w string").coalesce(1)
    for p in ("a%", "%B_", "_", "", "%\\%", "A.b", "a\\%"):
        got = [x[0] for x in df.select(d.flag(d.like(F.col("w"), p))).collect()]
        assert got == [con.execute("select ? like ?", (w, p)).fetchone()[0] for w in words], p
    for p in ("a*", "*[ab]?", "[^a]*", "*", "?", "a.b*"):
        got = [x[0] for x in df.select(d.flag(d.glob(F.col("w"), p))).collect()]
        assert got == [con.execute("select ? glob ?", (w, p)).fetchone()[0] for w in words], p
    assert one(spark, d.flag(d.like(F.lit("a%b"), "A!%_", "!"))) == 1


def test_arithmetic(spark):
    lit = lambda v: F.lit(v).cast("bigint")
    assert one(spark, d.divide(lit(-7), lit(2), integers=True)) == -3
    assert one(spark, d.divide(lit(1), lit(0), integers=True)) is None
    assert one(spark, d.modulo(lit(-7), lit(3))) == -1
    assert one(spark, d.modulo(lit(7), lit(0))) is None
    assert one(spark, d.add(F.lit(2**63 - 1), lit(1))) == 2.0**63
    assert [one(spark, d.shift_left(lit(1), F.lit(n))) for n in (-1, 3, 63, 64)] == [0, 8, -(2**63), 0]
    assert [one(spark, d.shift_right(lit(-8), F.lit(n))) for n in (-1, 1, 64)] == [0, -4, -1]
    assert one(spark, d.numeric_prefix(F.lit(" 12.5abc"))) == 12.5
    assert one(spark, d.numeric_prefix(F.lit("abc"))) == 0.0


def test_casts(spark):
    assert [d.affinity(t) for t in ("VARCHAR(10)", "FLOATING POINT", "CHARINT", "DOUBLE", "DECIMAL(10,2)", "", "BLOB")] == ["text", "integer", "integer", "real", "numeric", "blob", "blob"]
    assert one(spark, d.cast(F.lit("12abc"), "INTEGER", "text")) == 12
    assert one(spark, d.cast(F.lit("x"), "INT", "text")) == 0
    assert one(spark, d.cast(F.lit(1.0), "TEXT", "real")) == "1.0"
    assert one(spark, d.cast(F.lit(1e20), "TEXT", "real")) == "1.0e+20"
    assert one(spark, d.cast(F.lit(1e30), "INTEGER", "real")) == 2**63 - 1


def test_strings(spark):
    assert one(spark, strings.char(F.lit(955), F.lit(None).cast("int"), F.lit(128512), F.lit(0x110000))) == "λ😀�"
    assert one(spark, strings.quote(F.lit("it's"))) == "'it''s'"
    assert one(spark, strings.unhex(F.lit("4G"))) is None
    assert one(spark, strings.soundex(F.lit(" "))) == "?000"
    assert one(spark, strings.printf("%q|%Q|%c|%z%%|%.3s|%g|%y", F.lit("a'b"), F.lit(None).cast("string"), F.lit("xyz"), F.lit("abcdef"), F.lit(0.5), F.lit(1))).startswith("a''b|NULL|x|")
    assert one(spark, strings.instr(F.lit("héllo"), F.lit("l"))) == 3
    assert one(spark, strings.highlight(F.lit("The cat sat"), "CAT")) == "The <b>cat</b> sat"


def test_math(spark):
    assert [one(spark, mathfn.rounded(F.lit(v))) for v in (2.5, -2.5, 0.4)] == [3, -3, 0]
    assert one(spark, mathfn.rounded(F.lit(1.25), 1)) == 1.3
    assert one(spark, mathfn.trunc(F.lit(-2.7))) == -2
    assert str(one(spark, mathfn.ln(F.lit(-1.0)))) == "nan"
    assert one(spark, mathfn.ceil(F.lit(1.2))) == 2.0


def test_dates(spark):
    assert one(spark, dt.datetime(F.lit("2003-10-22 15:30:45"), "+1 month", "start of day")) == "2003-11-22 00:00:00"
    assert one(spark, dt.date(F.lit("2000-01-31"), "+1 month")) == "2000-03-02"
    assert one(spark, dt.julianday(F.lit("2000-01-01 12:00"))) == 2451545.0
    assert one(spark, dt.unixepoch(F.lit("1970-01-01"))) == 0
    assert one(spark, dt.datetime(F.lit(946684800), "unixepoch", kind="number")) == "2000-01-01 00:00:00"
    assert one(spark, dt.date(F.lit("2024-02-14"), "weekday 0")) == "2024-02-18"
    assert one(spark, dt.strftime("%Y/%m|%f|%j|%q", F.lit("2024-02-14 01:02:03.25"))) == "2024/02|03.250|045|%q"
    assert one(spark, dt.date(F.lit("2024-13-01"))) is None
    assert one(spark, dt.time(F.lit("10:20"), "+01:30")) == "11:50:00"


def test_json(spark):
    doc = F.lit('{"b":[1,2,{"c":null}],"a":"x"}')
    assert one(spark, jsonfn.minify(F.lit('{ "b": 1, "a": [ 2 ] }'))) == '{"a":[2],"b":1}'
    assert one(spark, jsonfn.valid(F.lit("{bad"))) == 0
    assert [one(spark, jsonfn.kind(doc, p)) for p in ("$.a", "$.b", "$.b[0]", "$")] == ["text", "array", "integer", "object"]
    assert json.loads(one(spark, jsonfn.upsert(doc, "$.b[0]", F.lit(9))))["b"][0] == 9
    assert json.loads(one(spark, jsonfn.insert(doc, "$.a", F.lit(1))))["a"] == "x"
    assert json.loads(one(spark, jsonfn.remove(doc, "$.b[1]")))["b"] == [1, {"c": None}]
    assert one(spark, jsonfn.patch(F.lit('{"a":1,"b":2}'), F.lit('{"a":null,"c":{"d":3}}'))) == '{"b":2,"c":{"d":3}}'
    assert one(spark, jsonfn.array_length(doc, "$.b")) == 3
    assert one(spark, jsonfn.extract(doc, "$.a", "$.b[0]")) == '["x",1]'
    rows = list(tvf.tree_rows('{"b":[1],"a":null}'))
    assert [(r[0], r[2], r[6]) for r in rows] == [(None, "object", "$"), ("a", "null", "$.a"), ("b", "array", "$.b"), ("0", "integer", "$.b[0]")]
    assert list(tvf.each_rows("{bad")) == []


def test_series(spark):
    assert [r[0] for r in tvf.generate_series(spark, 3).collect()] == [0, 1, 2, 3]
    assert [r[0] for r in tvf.generate_series(spark, 5, 1, -2).collect()] == [5, 3, 1]
    with pytest.raises(ValueError):
        tvf.generate_series(spark, 1, 2, 0)


def test_recursion_limit(spark):
    start = spark.createDataFrame([(0,)], "n int")
    with pytest.raises(recursion.RecursionLimit):
        recursion.recursive_union(start, lambda f: f.select(F.col("n") + 1), max_rounds=2)
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 2)], "id int, parent_id int")
    found = recursion.recursive_union(tree.filter("id = 2").select("id"), lambda f: f.alias("f").join(tree.alias("t"), F.col("t.parent_id") == F.col("f.id")).select("t.id"))
    assert sorted(r[0] for r in found.collect()) == [2, 4, 5]


def test_set_width(spark):
    with pytest.raises(ValueError, match="UNION"):
        setops.union(spark.range(1), spark.range(1).selectExpr("id", "id as b"))


def test_search(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox", "x"), (2, "brown quick", "fox"), (3, None, "foxes run")], "id int, title string, body string")
    index = search.tokens(docs, "id", ["title", "body"])
    find = lambda s: sorted(r[0] for r in search.match(index, s).collect())
    assert find('"quick brown"') == [1]
    assert find("quick fox") == [1, 2]
    assert find("fox*") == [1, 2, 3]
    assert find("title:fox") == [1]
    assert find("(quick OR run) NOT title:fox") == [2, 3]
    assert find('"fox fox"') == []
    assert sorted(r[0] for r in search.delete_docs(index, docs.filter("id = 1")).select("doc").distinct().collect()) == [2, 3]


def test_exclude_matches_definition(spark):
    rows = [(i, v) for i, v in enumerate([1, 1, 2, 3, 3, 3])]
    df = spark.createDataFrame(rows, "i int, v int")
    out = windows.excluding(df, [], [F.col("v")], F.col("i"), F.col("v"), lambda w: w.rangeBetween(-1, 0), "GROUP", windows.array_sum, "s")
    assert [r["s"] for r in out.orderBy("i").collect()] == [None, None, 2, 2, 2, 2]


def test_frontend():
    assert frontend.split("select ';' ; -- a;b\nselect 2") == ["select ';'", "-- a;b\nselect 2"]
    assert frontend.rewrite('select "a""b" == [c d], 0x10') == 'select `a"b` = `c d`, 16'
    assert frontend.rewrite("select total(x+(1)) from t limit 2,3") == "select coalesce(sum(cast(x+(1) as double)), 0.0D) from t LIMIT 3 OFFSET 2"

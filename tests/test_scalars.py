"""Scalar expressions on malformed input: month keys, lenient date and
number parsing, null-safe flags and ratios (X1-X6, X38, X39, F11)."""

from pyspark.sql import functions as F

from closurelens.functions import dates, numeric
from closurelens.operators import clean


def test_months_between_keys(spark):
    rows = [("2022-01", "2023-03", 14), ("2022-05", "2022-02", -3), ("202201", "2022-03", None),
            (None, "2022-03", None), ("2022-x", "2022-03", None), ("2022-1", "2022-03", 2)]
    df = spark.createDataFrame(rows, "a string, b string, exp int")
    got = [(r["m"], r["exp"]) for r in df.select(dates.months_between_keys("a", "b").alias("m"), "exp").collect()]
    assert all(m == e for m, e in got)


def test_compact_key_and_month_number(spark):
    df = spark.createDataFrame([("202309",)], "ym string")
    r = df.select(dates.compact_to_key("ym").alias("k")).select("k", dates.month_number("k").alias("m")).first()
    assert (r["k"], r["m"]) == ("2023-09", 9)


def test_lenient_parsing(spark):
    df = spark.createDataFrame([("1,234,567",), ("n/a",), (None,), (" 12 ",), ("1e3",)], "t string")
    got = [r["v"] for r in df.select(numeric.parse_numeric("t").alias("v")).collect()]
    assert got == [1234567.0, None, None, 12.0, 1000.0]
    ts = spark.createDataFrame([("2001-02-28",), ("2001-02-30",), ("unknown",)], "t string")
    got = [r["d"] for r in ts.select(clean.lenient_timestamp("t").alias("d")).collect()]
    assert got[0] is not None and got[1] is None and got[2] is None


def test_flags_ratios_and_blanks(spark):
    df = spark.createDataFrame([(3, 0, None, ""), (0, 4, 2.0, "x")], "a int, t int, v double, s string")
    r = df.select(numeric.guarded_ratio("a", "t").alias("q"), numeric.flag(F.col("v") > 0).alias("f"),
                  numeric.empty_to_null("s").alias("n"), numeric.null_to_empty("v").alias("e")).collect()
    assert [(x["q"], x["f"], x["n"], x["e"]) for x in r] == [(0.0, 0, None, ""), (0.0, 1, "x", "2.0")]
    z = spark.createDataFrame([(1, 3), (2, 3)], "a int, t int").select(numeric.guarded_ratio("a", "t").alias("q"))
    assert [x["q"] for x in z.collect()] == [0.33, 0.67]

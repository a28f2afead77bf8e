"""Stand-ins for the reference's inputs, derived by Spark from the driver
tables (FIXTURES.md section 2).  Every frame here is a lazy plan over the
whole driver tables; nothing is sampled or capped.

The same definitions are written in SQL in :mod:`closurelens.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# fixed values of the fixture (FIXTURES.md section 2)
WINDOW_START = "2000-01"
WINDOW_END = "2001-09"
# metres: station buffer radius and the two matching bands
STATION_RADIUS_M = 500.0


def _month_key(c):
    return F.date_format(c, "yyyy-MM")


def _nation_region(spark, d) -> DataFrame:
    # 25 x 5 rows by definition of the schema: a broadcast of fixed size
    n = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = table(spark, d, "region", "r_regionkey", "r_name")
    return F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
                       .select("n_nationkey", "n_name", "r_name"))


def stores(spark: SparkSession, d: str) -> DataFrame:
    """F1b establishments: one row per order.

    Lineitem is reduced to one row per order (partial + final aggregation on
    the order key) before it meets orders, so the big side is shuffled once
    and the join reuses that partitioning."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
              "o_orderdate", "o_orderpriority")
    last_ship = (table(spark, d, "lineitem", "l_orderkey", "l_shipdate")
                 .groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship")))
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    nr = _nation_region(spark, d)
    j = (o.join(last_ship, o.o_orderkey == last_ship.l_orderkey, "left")
         .join(c, o.o_custkey == c.c_custkey)
         .join(nr, F.col("c_nationkey") == nr.n_nationkey))
    return j.select(
        F.col("o_orderkey").alias("store_id"),
        F.col("r_name").alias("district"),
        F.col("n_name").alias("dong"),
        F.concat_ws("/", "c_mktsegment", "o_orderpriority").alias("industry"),
        _month_key("o_orderdate").alias("open_month"),
        F.when(F.col("o_orderstatus") != "O", _month_key("last_ship")).alias("close_month"),
        (F.col("o_orderkey") % 3 == 0).cast("int").alias("affiliated"),
        (F.col("o_custkey") % 4 == 0).cast("int").alias("near_station"),
    )


def tx_raw(spark: SparkSession, d: str) -> DataFrame:
    """F4 monthly transactions in the source form (``year_month`` YYYYMM)."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_shipdate")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    nr = _nation_region(spark, d)
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(c, o.o_custkey == c.c_custkey)
         .join(nr, F.col("c_nationkey") == nr.n_nationkey))
    return (j.groupBy(F.date_format("l_shipdate", "yyyyMM").alias("year_month"),
                      F.col("n_name").alias("dong"),
                      F.concat_ws("/", "c_mktsegment", "o_orderpriority").alias("industry"))
            .agg(F.count(F.lit(1)).alias("tx_count"),
                 F.round(F.sum("l_extendedprice"), 2).alias("tx_amount")))


def population_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line-level input of F5: ship month x supplier nation, with the three
    band columns that are pivoted into ratios (status 2, flag 3, line 7)."""
    li = table(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_extendedprice",
               "l_returnflag", "l_linestatus", "l_linenumber", "l_shipdate")
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    nr = _nation_region(spark, d)
    j = (li.join(s, li.l_suppkey == s.s_suppkey)
         .join(nr, F.col("s_nationkey") == nr.n_nationkey))
    return j.select(
        _month_key("l_shipdate").alias("month"),
        F.col("r_name").alias("district"),
        F.col("n_name").alias("dong"),
        F.col("l_linestatus").alias("status"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("spend"),
    )


# pivot layout of F5 (our stand-in for sex / time-band / age-band ratios)
POPULATION_PIVOTS = {
    "status": ["F", "O"],
    "flag": ["A", "N", "R"],
    "line": [1, 2, 3, 4, 5, 6, 7],
}


def geo_points(spark: SparkSession, d: str, side: str) -> DataFrame:
    """``geo_est`` (side='est', p_size<=25) and ``geo_mer`` (side='mer')."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_size")
    if side == "est":
        p = p.where(F.col("p_size") <= 25)
        off = 0.0
    else:
        p = p.where(F.col("p_size") > 25)
        off = 0.0001
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        (F.lit(35.1) + (F.col("p_partkey") % 40) * F.lit(0.0003) + F.lit(off)).alias("lat"),
        (F.lit(129.0) + (F.floor(F.col("p_partkey") / 40) % 25) * F.lit(0.0003)).alias("lon"),
    )


def est_points(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_custkey")
    return c.select(
        F.col("c_custkey").alias("id"),
        (F.lit(35.1) + (F.col("c_custkey") % 100) * F.lit(0.002)).alias("lat"),
        (F.lit(129.0) + F.floor(F.col("c_custkey") / 100) * F.lit(0.002)).alias("lon"),
    )


def stations(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier", "s_suppkey")
    return s.select(
        F.col("s_suppkey").alias("station_id"),
        (F.lit(35.1) + (F.col("s_suppkey") % 10) * F.lit(0.02)).alias("lat"),
        (F.lit(129.0) + F.floor(F.col("s_suppkey") / 10) * F.lit(0.003)).alias("lon"),
    )


def raw_names(spark: SparkSession, d: str) -> DataFrame:
    """F2 merchant names: ``p_name`` decorated by ``p_partkey % 10`` so every
    cleaning rule fires (company marks, branch suffix, glued branch -> HOLD,
    English in brackets, bracket-only English -> recovered, temporary mark,
    symbol -> null, null, plain glued name)."""
    p = table(spark, d, "part", "p_partkey", "p_name")
    n = F.col("p_name")
    glued = F.replace(n, F.lit(" "), F.lit(""))
    k = F.col("p_partkey") % 10
    raw = (F.when(k == 0, F.concat(F.lit("(주)"), n))
           .when(k == 1, F.concat(n, F.lit(" 서면점")))
           .when(k == 2, F.concat(glued, F.lit("점")))
           .when(k == 3, F.concat(n, F.lit("(brand)")))
           .when(k == 4, F.concat(F.lit("("), F.upper(n), F.lit(")")))
           .when(k == 5, F.concat(F.lit("주식회사  "), n))
           .when(k == 6, F.concat(n, F.lit("(한시적)")))
           .when(k == 7, F.lit("!"))
           .when(k == 8, F.lit(None).cast("string"))
           .otherwise(glued))
    return p.select(F.col("p_partkey").alias("uid"), raw.alias("raw_name"))


def text_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as text with thousands separators; every 7th key unparseable."""
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    txt = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(
        F.format_number(F.floor("o_totalprice").cast("long"), 0))
    return o.select(F.col("o_orderkey").alias("id"), txt.alias("amount_text"))


def mode_src(spark: SparkSession, d: str) -> DataFrame:
    """Rows for the mode fill (A4/J11/J12): legal-dong code = nation key,
    name = market segment, code = segment initial; every 5th customer has
    an empty dong/code that the mode fills."""
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    blank = F.col("c_custkey") % 5 == 0
    return c.select(
        F.col("c_custkey").alias("unique_id"),
        F.col("c_nationkey").cast("string").alias("legal_dong_code"),
        F.when(blank, F.lit("")).otherwise(F.col("c_mktsegment")).alias("dong"),
        F.when(blank, F.lit("")).otherwise(F.substring("c_mktsegment", 1, 2)).alias("dong_code"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Labels and scores with ties for the exact metric operators."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.round(F.col("o_totalprice") / 500000, 2).alias("p"),
    )


def json_src(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "props")
    return e.select(F.col("event_id").alias("uid"), "user_id", F.col("props").alias("response"))


def licences(spark: SparkSession, d: str) -> DataFrame:
    """Licence rows for the study-window filter: open = order date; close
    text = a date for finished orders, unparseable text for pending ones,
    null for open ones."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    close = (F.when(F.col("o_orderstatus") == "F",
                    F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 900).cast("int")),
                                  "yyyy-MM-dd"))
             .when(F.col("o_orderstatus") == "P", F.lit("unknown")))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("open_date"),
                    close.alias("close_text"))


# fixed values: dong name stems (Hangul) for the name-normalisation fixture
DONG_STEMS = ["대저", "명지", "서대신", "안락", "명장", "반여", "좌", "우"]


def dong_names(spark: SparkSession, d: str) -> DataFrame:
    """Hangul dong names from customer rows: stem by nation, number 1-3 by
    key, half of them already carrying the "제" infix."""
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    stem = F.element_at(F.array(*[F.lit(s) for s in DONG_STEMS]),
                        (F.col("c_nationkey") % len(DONG_STEMS) + 1).cast("int"))
    je = F.when(F.col("c_custkey") % 2 == 0, F.lit("제")).otherwise(F.lit(""))
    num = (F.col("c_custkey") % 3 + 1).cast("string")
    return c.select(F.col("c_custkey").alias("id"), F.concat(stem, je, num, F.lit("동")).alias("dong_raw"))


# fixed values: market segment (industry code) -> major industry group
INDUSTRY_GROUPS = [
    ("AUTOMOBILE", "retail"),
    ("BUILDING", "construction"),
    ("FURNITURE", "retail"),
    ("HOUSEHOLD", "services"),
    ("MACHINERY", "manufacturing"),
]


def industry_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INDUSTRY_GROUPS, "industry_code string, industry_group string")

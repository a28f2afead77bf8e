"""Neighbourhood x industry x month panel.

The reference cross-joins every month with every establishment and filters
the alive ones.  Here each establishment is expanded only to the months it is
alive (``sequence`` + ``explode``, output-sized, no product) and alive and
closed rows are counted in ONE grouped aggregation, so the panel costs one
shuffle of partially aggregated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_to_key, key_to_date, months_between_keys
from ..functions.numeric import guarded_ratio

KEYS = ("district", "dong", "industry")


def month_keys(start: str, end: str) -> list[str]:
    """Month keys from ``start`` to ``end`` inclusive (a bounded dimension)."""
    y, m = map(int, start.split("-"))
    ey, em = map(int, end.split("-"))
    out = []
    while (y, m) <= (ey, em):
        out.append(f"{y:04d}-{m:02d}")
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


def month_dim(stores: DataFrame, start: str, end: str, *, open_col="open_month",
              close_col="close_month", month_col="month") -> DataFrame:
    """Month dimension of the study window with the number of establishments
    opening and closing in each month (S4 generated from the window, enriched
    from the data; months without events keep zero counts)."""
    spark = stores.sparkSession
    dim = spark.createDataFrame([(k,) for k in month_keys(start, end)], [month_col])
    # one pass: each establishment emits its open event and its close event
    ev = F.explode(F.array(F.struct(F.col(open_col).alias("m"), F.lit(1).alias("o"), F.lit(0).alias("c")),
                           F.struct(F.col(close_col).alias("m"), F.lit(0).alias("o"), F.lit(1).alias("c"))))
    events = (stores.select(ev.alias("_e"))
              .select(F.col("_e.m").alias(month_col), F.col("_e.o").alias("_o"), F.col("_e.c").alias("_c"))
              .where(F.col(month_col).between(start, end))
              .groupBy(month_col).agg(F.sum("_o").cast("long").alias("opened"),
                                      F.sum("_c").cast("long").alias("closed")))
    return (F.broadcast(dim).join(events, month_col, "left")
            .select(month_col, F.coalesce("opened", F.lit(0)).cast("long").alias("opened"),
                    F.coalesce("closed", F.lit(0)).cast("long").alias("closed")))


def _alive_bounds(start: str, end: str, open_col: str, close_col: str):
    """First and last alive month inside the window.  ``greatest`` and ``least``
    skip nulls, so an unknown open month, or a close month that is given but not
    a month, is made a null bound: such a row is alive in no month."""
    return _bounds_of(start, end, key_to_date(open_col), key_to_date(close_col), F.col(close_col).isNull())


def _bounds_of(start: str, end: str, open_d: Column, close_d: Column, stays: Column):
    end_d = key_to_date(F.lit(end))
    lo = F.when(open_d.isNotNull(), F.greatest(open_d, key_to_date(F.lit(start))))
    hi = (F.when(stays, end_d)
          .when(close_d.isNotNull(), F.least(F.add_months(close_d, -1), end_d)))
    return lo, hi


def alive_rows(stores: DataFrame, start: str, end: str, *, open_col="open_month",
               close_col="close_month", month_col="month") -> DataFrame:
    """One row per (establishment, month) alive in the window (J2 + F7):
    ``open <= m`` and ``(close IS NULL OR close > m)``.  ``sequence`` raises
    when its bounds are reversed, so reversed (close < open) rows give a null
    array and explode nothing."""
    lo, hi = _alive_bounds(start, end, open_col, close_col)
    months = F.when(lo <= hi, F.sequence(lo, hi, F.expr("INTERVAL 1 MONTH")))
    return (stores.withColumn("_m", F.explode(months))
            .withColumn(month_col, date_to_key("_m")).drop("_m")
            .withColumn("months_open", months_between_keys(open_col, month_col)))


def closed_rows(stores: DataFrame, start: str, end: str, *, close_col="close_month",
                month_col="month") -> DataFrame:
    """Establishments whose close month is a window month (J3 equi-join with
    the month dimension, expressed as a literal IN list of bounded size)."""
    return (stores.where(F.col(close_col).isin(month_keys(start, end)))
            .withColumn(month_col, F.col(close_col)))


def _is1(c: str) -> Column:
    return F.coalesce(F.col(c) == 1, F.lit(False))


def panel_alive(stores: DataFrame, start: str, end: str, keys: Sequence[str] = KEYS,
                *, affiliated_col="affiliated", station_col="near_station",
                month_col="month", **kw) -> DataFrame:
    """A1-A3 on alive rows: alive count, affiliated and near-station counts,
    mean months in operation."""
    a = alive_rows(stores, start, end, month_col=month_col, **kw)
    return a.groupBy(month_col, *keys).agg(
        F.count(F.lit(1)).alias("alive"),
        F.count_if(_is1(affiliated_col)).alias("affiliated"),
        F.count_if(_is1(station_col)).alias("near_station"),
        F.avg("months_open").alias("avg_months"),
    )


def panel_closed(stores: DataFrame, start: str, end: str, keys: Sequence[str] = KEYS,
                 *, close_col="close_month", month_col="month") -> DataFrame:
    c = closed_rows(stores, start, end, close_col=close_col, month_col=month_col)
    return c.groupBy(month_col, *keys).agg(F.count(F.lit(1)).alias("closed"))


def panel_counts(stores: DataFrame, start: str, end: str, keys: Sequence[str] = KEYS,
                 *, affiliated_col="affiliated", station_col="near_station",
                 open_col="open_month", close_col="close_month", month_col="month") -> DataFrame:
    """Alive and closed counts per cell with full-outer-join semantics (J4 +
    zero fill, X7, X8) in ONE pass over the establishments: each row emits an
    array of (month, alive, closed) events -- its alive months and, when it
    falls in the window, its closing month -- which is exploded once and
    aggregated once (partial aggregation before the single shuffle).

    In an outer join null keys never match, so a cell with a null key keeps
    separate alive-side and closed-side rows: the side tag joins the grouping
    key only for such rows."""
    # each key is parsed once, and months are numbers until the cells are counted: an
    # exploded row costs a few integer operations
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    s = stores.select(*keys, any_null.alias("_null"), _is1(affiliated_col).cast("int").alias("_f"),
                      _is1(station_col).cast("int").alias("_s"), F.col(close_col).isNull().alias("_stays"),
                      F.col(close_col).isin(month_keys(start, end)).alias("_ends"),
                      key_to_date(open_col).alias("_open"), key_to_date(close_col).alias("_close"))
    lo, hi = _bounds_of(start, end, F.col("_open"), F.col("_close"), F.col("_stays"))
    # alive months are all strictly before the close month, so an event is a
    # closing event exactly when its month is the (in-window) close month
    s = s.select(*keys, "_null", "_f", "_s", F.col("_open").alias("_od"), F.when(F.col("_ends"), F.col("_close")).alias("_cd"),
                 lo.alias("_lo"), hi.alias("_hi"))
    s = s.withColumns({c: F.year(c) * 12 + F.month(c) - 1 for c in ("_od", "_cd", "_lo", "_hi")})
    empty = F.array().cast("array<int>")
    alive = F.when(F.col("_lo") <= F.col("_hi"), F.sequence("_lo", "_hi"))
    closed = F.when(F.col("_cd").isNotNull(), F.array("_cd"))
    u = s.withColumn("_d", F.explode(F.concat(F.coalesce(alive, empty), F.coalesce(closed, empty))))
    is_c = F.coalesce(F.col("_d") == F.col("_cd"), F.lit(False)).cast("int")
    u = u.select("_d", *keys, "_null", (1 - is_c).alias("_a"), is_c.alias("_c"),
                 (F.col("_f") * (1 - is_c)).alias("_f"), (F.col("_s") * (1 - is_c)).alias("_s"),
                 F.when(is_c == 0, F.col("_d") - F.col("_od")).alias("months_open"))
    u = u.withColumn("_side", F.when(F.col("_null"), F.col("_c")).otherwise(F.lit(0)))
    g = u.groupBy("_d", *keys, "_side").agg(
        F.sum("_a").cast("long").alias("alive"),
        F.sum("_c").cast("long").alias("closed"),
        F.sum("_f").cast("long").alias("affiliated"),
        F.sum("_s").cast("long").alias("near_station"),
        F.coalesce(F.avg("months_open"), F.lit(0.0)).alias("avg_months"),
    )
    first = F.make_date(F.floor(F.col("_d") / 12).cast("int"), F.col("_d") % 12 + 1, F.lit(1))
    return g.select(
        date_to_key(first).alias(month_col), *keys, "alive", "closed", (F.col("alive") + F.col("closed")).alias("total"),
        "affiliated", "near_station",
        F.round(F.col("avg_months") / 12.0, 2).alias("avg_years"),
    )


def panel_rates(counts: DataFrame, keys: Sequence[str] = KEYS, month_col="month") -> DataFrame:
    """Guarded rates rounded to 2 decimals (X5).  Affiliation and station
    counts come from alive rows but divide by alive + closed, as in the
    reference."""
    t = F.col("total")
    return counts.select(
        month_col, *keys, "total",
        guarded_ratio("alive", t).alias("survival_rate"),
        guarded_ratio("closed", t).alias("closure_rate"),
        guarded_ratio("near_station", t).alias("station_rate"),
        guarded_ratio("affiliated", t).alias("affiliation_rate"),
        "avg_years",
    )

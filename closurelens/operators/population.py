"""Population / spending side of the panel: ratio pivots (A23), dong-name
normalisation (X12, X13, F6) and conditional key repair (X14)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the reference's dong names that gain the "제" infix, and the
# dong removed from the panel
DONG_TARGETS = ["대저1동", "대저2동", "명지1동", "명지2동"]
DONG_DROP = ["신호동"]

# fixed values: the reference's dong pattern (anchored, for listed names) and
# its unanchored form with a look-behind that keeps it idempotent
# ("대저제1동" stays as it is)
_ANCHORED = r"([가-힣]+)(\d+)동$"
_ALL = r"([가-힣]+)(?<!제)(\d+)동"


def insert_je(c, targets: Sequence[str] | None = DONG_TARGETS) -> Column:
    """``N동`` -> ``제N동``.  With ``targets`` only those exact names are
    rewritten (X12, anchored); with ``targets=None`` every value is (X13)."""
    c = F.col(c) if isinstance(c, str) else c
    if targets is None:
        return F.regexp_replace(c, _ALL, "$1제$2동")
    return F.when(c.isin(list(targets)), F.regexp_replace(c, _ANCHORED, "$1제$2동")).otherwise(c)


def normalize_dong(df: DataFrame, col: str = "dong", targets: Sequence[str] | None = DONG_TARGETS,
                   drop: Sequence[str] = DONG_DROP) -> DataFrame:
    """Rewrite dong names and drop the excluded ones.  ``!=`` drops null
    dongs as Spark's ``=!=`` does in the reference."""
    out = df.withColumn(col, insert_je(col, targets))
    return out.where(~F.col(col).isin(list(drop))) if drop else out


def ratio_pivot(lines: DataFrame, keys: Sequence[str], pivots: Mapping[str, Sequence],
                measure: str, *, count_name: str = "visitors", total_name: str = "residents",
                extra: Mapping[str, Column] | None = None, scale: int = 4) -> DataFrame:
    """Pivot several band columns into share-of-total columns in ONE grouped
    aggregation (A23): ``<band>_<value>_ratio = sum(measure | band=value) /
    sum(measure)``.  Pivot values are given, so no extra job discovers them;
    this is what ``groupBy().pivot(col, values)`` compiles to, for several
    pivot columns at once."""
    m = F.col(measure)
    aggs = [F.count(F.lit(1)).alias(count_name), F.sum(m).alias(total_name)]
    for band, values in pivots.items():
        for v in values:
            aggs.append(F.sum(F.when(F.col(band) == F.lit(v), m).otherwise(F.lit(0.0)))
                        .alias(f"_{band}_{v}"))
    for name, expr in (extra or {}).items():
        aggs.append(expr.alias(name))
    g = lines.groupBy(*keys).agg(*aggs)
    ratios = {f"{band}_{str(v).lower()}_ratio":
              F.round(F.coalesce(F.try_divide(F.col(f"_{band}_{v}"), F.col(total_name)), F.lit(0.0)), scale)
              for band, values in pivots.items() for v in values}
    drop = [f"_{band}_{v}" for band, values in pivots.items() for v in values]
    return g.withColumns(ratios).drop(*drop)


def repair_keys(df: DataFrame, rules: Sequence[tuple[Sequence[str], str | None, str]],
                match_col: str = "dong", fix_col: str = "district") -> DataFrame:
    """Conditional key repair (X14): for each rule ``(values, required, new)``
    rows whose ``match_col`` is in ``values`` (and whose ``fix_col`` equals
    ``required`` when given) get ``fix_col = new``.  First matching rule wins,
    like the reference's ``when`` chain."""
    expr = None
    for values, required, new in rules:
        cond = F.col(match_col).isin(list(values))
        if required is not None:
            cond = cond & (F.col(fix_col) == F.lit(required))
        expr = F.when(cond, F.lit(new)) if expr is None else expr.when(cond, F.lit(new))
    if expr is None:
        return df
    return df.withColumn(fix_col, expr.otherwise(F.col(fix_col)))

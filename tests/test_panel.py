"""Panel construction on hand-written establishments: interval expansion vs
the literal cross-join definition, outer-join null-key semantics, traps 13-15
and 29."""

from pyspark.sql import functions as F

from closurelens.operators import impute, panel

COLS = "store_id long, district string, dong string, industry string, open_month string, " \
       "close_month string, affiliated int, near_station int"

ROWS = [
    (1, "D1", "A", "I1", "2021-06", None, 1, 0),        # open before the window, never closed
    (2, "D1", "A", "I1", "2022-03", "2022-05", 0, 1),   # closes inside: alive 03,04; closed in 05
    (3, "D1", "A", "I1", "2022-05", "2022-02", 1, 1),   # close < open: never alive, counted closed
    (4, "D1", "A", "I2", "2022-04", "2022-04", 0, 0),   # close = open: never alive, closed in 04
    (5, "D1", None, "I1", "2022-01", "2022-02", 1, 0),  # null key: sides kept apart
    (6, "D2", "B", "I1", "2023-12", None, 0, 0),        # opens after the window
    (7, "D2", "B", "I1", "2022-01", "2023-11", 1, 0),   # closes after the window
]
START, END = "2022-01", "2022-06"


def _brute(rows):
    months = panel.month_keys(START, END)
    alive = {}
    for r in rows:
        sid, dist, dong, ind, o, c, aff, st = r
        for m in months:
            if o <= m and (c is None or c > m):
                k = (m, dist, dong, ind)
                a = alive.setdefault(k, [0, 0, 0, []])
                a[0] += 1
                a[1] += aff == 1
                a[2] += st == 1
                y1, m1 = map(int, o.split("-"))
                y2, m2 = map(int, m.split("-"))
                a[3].append((y2 - y1) * 12 + m2 - m1)
    return alive


def test_alive_matches_cross_join_definition(spark):
    df = spark.createDataFrame(ROWS, COLS)
    got = {(r["month"], r["district"], r["dong"], r["industry"]): (r["alive"], r["affiliated"], r["near_station"], r["avg_months"])
           for r in panel.panel_alive(df, START, END).collect()}
    exp = {k: (v[0], v[1], v[2], sum(v[3]) / len(v[3])) for k, v in _brute(ROWS).items()}
    assert got == exp


def test_counts_outer_join_semantics(spark):
    df = spark.createDataFrame(ROWS, COLS)
    rows = panel.panel_counts(df, START, END).collect()
    by = {}
    for r in rows:
        by.setdefault((r["month"], r["district"], r["dong"], r["industry"]), []).append(r)
    # store 3 (close < open) and 2 close in different months; store 4 closes in its open month
    assert by[("2022-02", "D1", "A", "I1")][0]["closed"] == 1
    assert by[("2022-04", "D1", "A", "I2")][0]["alive"] == 0
    assert by[("2022-04", "D1", "A", "I2")][0]["closed"] == 1
    # null-key cell: the alive-side row and the closed-side row stay separate (outer join)
    null_rows = by[("2022-02", "D1", None, "I1")]
    assert sorted((r["alive"], r["closed"]) for r in null_rows) == [(0, 1)]
    assert sorted((r["alive"], r["closed"]) for r in by[("2022-01", "D1", None, "I1")]) == [(1, 0)]
    # sum of alive = sum of interval lengths
    assert sum(r["alive"] for r in rows) == sum(v[0] for v in _brute(ROWS).values())
    # only-closed cells have avg_years 0 (zero fill)
    assert by[("2022-04", "D1", "A", "I2")][0]["avg_years"] == 0.0


def test_rates_and_label_rounding(spark):
    # 1 closure among 300 establishments: rate rounds to 0.00 -> label 0 (trap 29)
    rows = [(i, "D", "A", "I", "2022-01", "2022-03" if i == 0 else None, 0, 0) for i in range(300)]
    df = spark.createDataFrame(rows, COLS)
    r = panel.panel_rates(panel.panel_counts(df, START, END))
    march = r.where(F.col("month") == "2022-03").first()
    assert march["total"] == 300 and march["closure_rate"] == 0.0 and march["survival_rate"] == 1.0
    from closurelens.operators.features import closure_label
    assert closure_label(r).where("month = '2022-03'").first()["closed_label"] == 0
    # rates within [0,1]; survival + closure = 1 +- 0.01 where total > 0
    for x in r.collect():
        assert 0 <= x["closure_rate"] <= 1 and abs(x["survival_rate"] + x["closure_rate"] - 1) <= 0.011


def test_imputation_branches(spark):
    cols = "month string, district string, dong string, industry string, affiliation_rate double, " \
           "tx_count long, tx_amount double, avg_ticket double"
    rows = [
        ("m1", "D", "A", "I", 0.0, None, None, None),    # structural zero
        ("m2", "D", "A", "I", 0.0, 5, 50.0, 10.0),       # present value overwritten by zero
        ("m3", "D", "A", "I", 0.5, None, None, None),    # imputed: mean of (0, 0, 4) = 4/3
        ("m4", "D", "A", "I", 0.5, 4, 40.0, 10.0),       # present
        ("m1", "D", "B", "I", 0.5, None, None, None),    # no mean
        ("m1", "D", "C", "I", 0.0, None, None, None),    # zero mean group
        ("m2", "D", "C", "I", 0.3, None, None, None),    # zero mean -> excluded
        ("m2", "E", "C", "I", 0.3, 7, 70.0, 10.0),       # same (month, dong, industry) in another district
    ]
    df = spark.createDataFrame(rows, cols)
    imp = {(r["month"], r["district"], r["dong"]): r for r in impute.impute_group_mean(df).collect()}
    assert imp[("m1", "D", "A")]["impute_status"] == "structural_zero"
    assert imp[("m2", "D", "A")]["impute_status"] == "zero_override" and imp[("m2", "D", "A")]["tx_count"] == 0
    assert imp[("m3", "D", "A")]["impute_status"] == "imputed"
    assert abs(imp[("m3", "D", "A")]["tx_count"] - 4 / 3) < 1e-12
    assert imp[("m1", "D", "B")]["impute_status"] == "no_mean" and imp[("m1", "D", "B")]["tx_count"] == 0
    # group C mean over (0, null, 7) = 3.5 > 0 -> imputed; structural zero counted in the mean (trap 8)
    assert imp[("m2", "D", "C")]["impute_status"] == "imputed"
    kept = impute.impute_exclude(impute.impute_group_mean(df))
    assert {(r["month"], r["dong"]) for r in kept.collect()} == {
        ("m1", "A"), ("m2", "A"), ("m3", "A"), ("m4", "A"), ("m1", "C"), ("m2", "C")}
    audit = {r["impute_status"]: r["rows"] for r in impute.impute_audit(impute.impute_group_mean(df)).collect()}
    assert sum(audit.values()) == len(rows)


def test_exclusion_keys_omit_district(spark):
    cols = "month string, district string, dong string, industry string, affiliation_rate double, " \
           "tx_count long, tx_amount double, avg_ticket double"
    rows = [("m1", "D", "X", "I", 0.5, None, None, None),   # no mean -> excluded
            ("m1", "E", "X", "I", 0.0, None, None, None)]   # same keys without district: removed too
    df = spark.createDataFrame(rows, cols)
    assert impute.impute_exclude(impute.impute_group_mean(df)).count() == 0

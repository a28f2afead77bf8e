"""Exact ranks over range shards, sample and folds on them, and the mutual
information estimators, against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from closurelens.operators import features as fe
from closurelens.operators import information as info
from closurelens.operators import metrics as mt
from closurelens.operators import ranks


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_auc_and_codes_do_not_depend_on_exchange_reuse(spark, reuse):
    rng = random.Random(1)
    rows = [(i, rng.random() + 0.2 * (i % 3 == 0), int(i % 3 == 0)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "i long, p double, y int")
    s = sorted((p, y) for _, p, y in rows)
    negatives = wins = 0
    for _, y in s:
        negatives += 1 - y
        wins += negatives * y
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        assert math.isclose(mt.roc_auc(df).first()[0], wins / (negatives * (len(rows) - negatives)))
        hits, ap = 0, 0.0
        for k, (_, y) in enumerate(reversed(s), 1):
            hits += y
            ap += y * hits / k
        assert math.isclose(mt.average_precision(df).first()[0], ap / hits, rel_tol=1e-9)
        codes = fe.label_codes(df.withColumn("c", F.col("i").cast("string")), ["c"])
        got = {r.c: r.c_code for r in codes.select("c", "c_code").collect()}
        assert got == {c: i for i, c in enumerate(sorted(str(i) for i in range(20_000)))}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)


def test_row_numbers_per_group_over_shards(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.random()) for _ in range(3_000)]
    got = ranks.row_numbers(spark.createDataFrame(rows, "g string, v double"), ["g"], [F.col("v").asc()], "r", 13).collect()
    for g in ("a", "b", None):
        assert [r.r for r in sorted((r for r in got if r.g == g), key=lambda r: r.v)] == list(range(1, sum(x == g for x, _ in rows) + 1))
    assert ranks.row_numbers(spark.createDataFrame([], "g string, v double"), ["g"], [F.col("v").asc()], "r").count() == 0


def test_sample_is_the_n_least_and_folds_differ_by_one(spark):
    df = spark.createDataFrame([(f"k{i}", i, int(i % 5 == 0)) for i in range(5_000)], "k string, j long, y int")
    hashed = sorted((r.h, r.k) for r in df.select("k", fe.key_hash(["k", "j"], 7).alias("h")).collect())
    for n in (0, 1, 777, 6_000):
        assert {r.k for r in fe.hash_sample(df, ["k", "j"], n, 7).collect()} == {k for _, k in hashed[:n]}
    sizes = fe.stratified_folds(df, ["k"], "y", 3).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in sizes if r.y == y]
        assert len(counts) == 3 and max(counts) - min(counts) <= 1


def neighbours_by_hand(x, y, k):
    from math import fsum
    psi = lambda n: -0.5772156649015329 + fsum(1 / j for j in range(1, int(n)))
    size = {c: int((y == c).sum()) for c in set(y)}
    use = np.array([size[c] > 1 for c in y])
    x, y = x[use], y[use]
    total = psi(len(x))
    for i in range(len(x)):
        d = np.sort(np.abs(x[y == y[i]] - x[i]))[1:][min(k, size[y[i]] - 1) - 1]
        if d == 0:
            same, m = ((x == x[i]) & (y == y[i])).sum(), (x == x[i]).sum()
        else:
            same, m = min(k, size[y[i]] - 1), ((x > x[i] - d) & (x < x[i] + d)).sum()
        total += (psi(same) - psi(size[y[i]]) - psi(m)) / len(x)
    return max(total, 0.0)


def test_neighbour_information_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 2_000
    y = (rng.random(n) < 0.3).astype(int)
    y[0] = 2  # a class of one row takes no part
    data = {"shift": rng.normal(y, 1.0), "noise": rng.random(n), "zeros": np.where(rng.random(n) < 0.6, 0.0, rng.normal(y, 1.0)),
            "grid": rng.integers(0, 40, n) / 8.0, "flat": np.full(n, 3.0), "far": rng.normal(0, 1, n) ** 9 + y}
    rows = [(*(float(data[c][i]) for c in data), int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data) + ", y int")
    got = {r.feature: r.mutual_info for r in info.mutual_info_neighbours(df, list(data), "y").collect()}
    for c in data:
        assert got[c] == pytest.approx(neighbours_by_hand(data[c], y, 3), abs=2e-6), c
    assert got["shift"] > got["noise"]


def test_information_of_odd_inputs(spark):
    df = spark.createDataFrame([(None, 1, 0), (float("nan"), 1, 1), (0.0, None, 0), (-0.0, 2, None)], "a double, b int, y int")
    for f in (info.mutual_info_neighbours, info.mutual_info_quantiles):
        got = {r.feature: r.mutual_info for r in f(df, ["a", "b"], "y").collect()}
        assert set(got) == {"a", "b"} and all(0 <= v < 1 for v in got.values())
        assert f(df.limit(0), ["a", "b"], "y").count() == 0

"""Exact metrics vs direct computation, with ties and more partitions than
distinct scores."""

import random

import numpy as np

from closurelens.operators import metrics as mt


def _auc(y, p):
    pos = [s for s, t in zip(p, y) if t == 1]
    neg = [s for s, t in zip(p, y) if t == 0]
    u = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return u / (len(pos) * len(neg))


def _ap(y, p):
    order = sorted(set(p), reverse=True)
    P = sum(y)
    ap, tp, fp = 0.0, 0, 0
    for s in order:
        g = [t for t, q in zip(y, p) if q == s]
        tp += sum(g)
        fp += len(g) - sum(g)
        ap += sum(g) / P * tp / (tp + fp)
    return ap


def test_auc_ap_exact(spark):
    rnd = random.Random(3)
    y = [rnd.randint(0, 1) for _ in range(600)]
    p = [round(rnd.random() * 0.5 + 0.3 * t, 2) for t in y]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p double")
    assert abs(mt.roc_auc(df).first()["roc_auc"] - _auc(y, p)) < 1e-12
    assert abs(mt.average_precision(df).first()["average_precision"] - _ap(y, p)) < 1e-12


def test_prefix_sums_across_partitions(spark):
    vals = [(i, float(i % 7)) for i in range(1000)]
    df = spark.createDataFrame(vals, "k long, v double")
    got = {r["k"]: r["cum_v"] for r in mt.prefix_sums(df, "k", ["v"], partitions=13).collect()}
    exp = np.cumsum([v for _, v in vals])
    assert all(abs(got[i] - exp[i]) < 1e-9 for i in range(1000))


def test_class_report(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] * 1 + [(0, 1)] * 2 + [(0, 0)] * 4
    df = spark.createDataFrame(rows, "y int, pred int")
    r = {x["class"]: x for x in mt.class_report(df).collect()}
    assert r["1"]["precision"] == round(3 / 5, 6) and r["1"]["recall"] == round(3 / 4, 6)
    assert r["0"]["support"] == 6 and r["weighted avg"]["support"] == 10

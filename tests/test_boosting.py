"""Histogram boosting against a direct search over all cuts, in one chunk and in many."""

import random

import numpy as np
import pytest

from closurelens.operators import boosting as bo
from closurelens.operators import explain as ex
from closurelens.operators import metrics as mt
from closurelens.operators import models as md


def rows_of(n, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 6, n).astype(float), rng.random(n)
    y = ((a * (b > 2) + 0.5 * c + rng.normal(0, 0.4, n)) > 0.5).astype(int)
    return [(float(x), float(z), float(w), int(t), int(i % 3)) for i, (x, z, w, t) in enumerate(zip(a, b, c, y))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "a double, b double, c double, y int, fold int").repartition(4)


def by_trying_all(x, y, s, weight):
    """Margins after level-wise boosting in which every cut of every node is tried."""
    margin = np.zeros(len(y))
    w = np.where(y == 1, weight, 1.0)
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)

        def value(i):
            return -s.rate * g[i].sum() / (h[i].sum() + s.l2)

        def grow(i, depth):
            best = (1e-9, None)
            for f in range(x.shape[1]) if depth < s.depth else ():
                for cut in np.unique(x[i, f])[:-1]:
                    go = x[i, f] <= cut
                    left, right = i[go], i[~go]
                    if min(h[left].sum(), h[right].sum()) < s.min_hessian:
                        continue
                    part = lambda j: g[j].sum() ** 2 / (h[j].sum() + s.l2)
                    gain = part(left) + part(right) - part(i)
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
            if best[1] is None:
                margin_new[i] += value(i)
            else:
                for j in best[1]:
                    grow(j, depth + 1)

        margin_new = margin.copy()
        grow(np.arange(len(y)), 0)
        margin = margin_new
    return margin


@pytest.mark.parametrize("chunk", [65_536, 60])
def test_cuts_equal_a_search_over_all(spark, chunk):
    rng = random.Random(2)
    rows = [(float(rng.randrange(12)), float(rng.randrange(9)), float(rng.randrange(5)), 0, i % 3) for i in range(240)]
    rows = [(*r[:3], int(r[0] + 2 * (r[1] > 4) * r[2] + rng.gauss(0, 3) > 9), r[4]) for r in rows]
    s = bo.Settings(trees=4, depth=3, rate=0.4)
    grown = bo.Boosting(frame(spark, rows), ["a", "b", "c"], "y", chunk_rows=chunk)
    model, = grown.fit([s])
    x, y = np.array([r[:3] for r in rows]), np.array([r[3] for r in rows])
    assert grown.table.count() == 1 if chunk > 240 else grown.table.count() > 3
    assert np.allclose(model.margins(x), by_trying_all(x, y, s, (y == 0).sum() / (y == 1).sum()), atol=1e-4)


def test_chunks_and_lockstep_do_not_change_the_trees(spark):
    df = frame(spark, rows_of(1_500))
    settings = [bo.Settings(trees=3, depth=4), bo.Settings(trees=2, depth=0, leaves=9, rate=0.1, l2=0.0, min_rows=20, weight="balanced"),
                bo.Settings(trees=3, depth=3, hold=1, colsample=0.7)]
    one = bo.Boosting(df, ["a", "b", "c"], "y", "fold").fit(settings)
    many = bo.Boosting(df, ["a", "b", "c"], "y", "fold", chunk_rows=200).fit(settings)
    assert [m.trees for m in one] == [m.trees for m in many]
    leaves = [sum(x[4] < 0 for x in t.values()) for t in one[1].trees]
    assert max(leaves) == 9
    assert one[0].trees == bo.Boosting(df, ["a", "b", "c"], "y").fit(settings[:1])[0].trees


def test_search_scores_save_and_attributions(spark, tmp_path):
    df = frame(spark, rows_of(900))
    space = md.SEARCH_SPACE | {"trees": (3, 6)}
    table, best = md.random_search(df, ["a", "b", "c"], "y", "fold", 5, space=space)
    got = table.orderBy("trial").collect()
    assert len(got) == 5 and all(0.7 < r.mean_auc <= 1 for r in got)
    top = max(got, key=lambda r: r.mean_auc)
    assert (best.depth, best.trees) == (top.max_depth, top.trees) and best.hold == -1
    # the held-out AUC is that of the model without the fold
    s = bo.Settings(trees=4, depth=3, hold=0)
    grown = bo.Boosting(df, ["a", "b", "c"], "y", "fold")
    model, = grown.fit([s])
    held = bo.score(model, df.where("fold = 0"))
    assert grown.held_out_auc([s]).first().auc == pytest.approx(mt.roc_auc(held, "y", "p1").first()[0], abs=1e-6)
    model.save(spark, str(tmp_path / "m"))
    again = bo.BoostedModel.load(spark, str(tmp_path / "m"))
    assert again == model
    x = np.array([r[:3] for r in rows_of(50, 9)])
    phi, fx = ex.shap_matrix(x, ex.compile_boosted(model))
    assert np.allclose(fx, model.margins(x)) and np.allclose(ex.compile_boosted(model)["base"] + phi.sum(axis=1), fx)
    assert sum(model.importances().values()) == pytest.approx(1.0)


def test_odd_inputs(spark):
    none = spark.createDataFrame([], "a double, y int")
    model, = bo.Boosting(none, ["a"], "y").fit([bo.Settings(trees=2)])
    assert bo.score(model, none).count() == 0
    flat = spark.createDataFrame([(1.0, 1), (None, 0), (float("nan"), 0), (2.0, None)], "a double, y int")
    model, = bo.Boosting(flat, ["a"], "y").fit([bo.Settings(trees=2, min_hessian=0.0)])
    p = {r.a: r.p1 for r in bo.score(model, flat.where("a is null or a = 1")).collect()}
    assert p[1.0] > 0.5 > p[None]
    one = spark.createDataFrame([(float(i), 1) for i in range(9)], "a double, y int")
    model, = bo.Boosting(one, ["a"], "y").fit([bo.Settings(trees=2)])
    assert bo.score(model, one).select("p1").distinct().count() == 1

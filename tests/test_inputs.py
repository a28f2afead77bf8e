"""Null, malformed and NaN inputs, and stores that must not be appended to."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from closurelens.operators.features import closure_label
from closurelens.operators.panel import alive_rows
from closurelens.operators.stats import vif
from closurelens.session import checkpoint_dir
from closurelens.sources.io import incremental_append


def test_unknown_months_are_not_alive(spark):
    df = spark.createDataFrame([(1, None, None), (2, "2000-01", "soon"), (3, "2000-02", None), (4, "1998-01", "2000-03")],
                               "id int, open_month string, close_month string")
    got = {(r.id, r.month) for r in alive_rows(df, "2000-01", "2000-03").collect()}
    assert got == {(3, "2000-02"), (3, "2000-03"), (4, "2000-01"), (4, "2000-02")}


def test_nan_rate_is_no_closure(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.0,), (0.1,)], "closure_rate double")
    assert [r.closed_label for r in closure_label(df).collect()] == [0, 0, 0, 1]


def test_vif_of_badly_scaled_and_dependent_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4)) + 1.0
    x[:, 1] = x[:, 0] + 0.1 * x[:, 1]
    scaled = x * np.array([1e9, 1e-6, 1.0, 1e4])
    cols = [f"c{i}" for i in range(6)]
    rows = np.column_stack([scaled, 2 * scaled[:, 3], np.zeros(500)])
    got = {r.feature: r.vif for r in vif(spark.createDataFrame(rows.tolist(), cols), cols).collect()}
    for i in range(3):
        rest = np.delete(x, i, 1)
        fit = rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        assert got[f"c{i}"] == pytest.approx((x[:, i] ** 2).sum() / ((x[:, i] - fit) ** 2).sum(), rel=1e-6)
    assert got["c3"] == got["c4"] == got["c5"] == float("inf")


def test_append_raises_on_a_damaged_or_foreign_store(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.lit(1)).coalesce(1)
    ok = str(tmp_path / "ok")
    incremental_append(df.union(df.withColumn("v", F.lit(0))), ok, "id")
    incremental_append(df.union(spark.createDataFrame([(99, 5)], "id long, v int")), ok, "id")
    stored = spark.read.parquet(ok)
    assert stored.count() == 11 and stored.where("id < 10").agg(F.max("v")).first()[0] == 0
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"PAR1 truncated")
    with pytest.raises(Exception):
        incremental_append(df, str(bad), "id")
    other = str(tmp_path / "other")
    spark.range(3).withColumnRenamed("id", "k").write.parquet(other)
    with pytest.raises(ValueError):
        incremental_append(df, other, "id")


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        checkpoint_dir(Session())

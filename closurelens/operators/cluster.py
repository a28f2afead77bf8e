"""k-means clustering of the panel (M1-M3b).  The standardised matrix is
written once to the shared folder; every fit of the k sweep reads it instead
of recomputing the panel plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .features import standardize


def scaled_matrix(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
                  out: str = "features") -> DataFrame:
    """Drop rows with a null feature (the clustering notebook's ``dropna``),
    z-score with the population std, assemble into a vector (M1)."""
    z = standardize(df.na.drop(subset=list(cols)), cols)
    va = VectorAssembler(inputCols=[f"{c}_z" for c in cols], outputCol=out)
    return va.transform(z).select(*keep, *cols, out)


def kmeans_fit(matrix: DataFrame, k: int, seed: int = 42, features: str = "features",
               max_iter: int = 50):
    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster", maxIter=max_iter).fit(matrix)


def assign(df: DataFrame, cols: Sequence[str], k: int = 4, seed: int = 42,
           keep: Sequence[str] = ()) -> DataFrame:
    """Cluster id per row (M2)."""
    m = materialize(scaled_matrix(df, cols, keep), "cluster-matrix")
    model = kmeans_fit(m, k, seed)
    return model.transform(m).drop("features").withColumn("cluster", F.col("cluster").cast("int"))


def silhouette(pred: DataFrame, features: str = "features", cluster: str = "cluster") -> float:
    """Spark's silhouette uses squared Euclidean distance (the reference's
    library uses plain Euclidean), computed distributed in O(n k)."""
    ev = ClusteringEvaluator(featuresCol=features, predictionCol=cluster,
                             distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(pred))


def k_sweep(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(2, 11),
            seed: int = 42, parallelism: int = 3) -> DataFrame:
    """Elbow SSE and silhouette for each k from ONE fit per k (M3, O8) over a
    materialised matrix.  ``best`` marks the smallest k with the top
    silhouette."""
    from concurrent.futures import ThreadPoolExecutor
    m = materialize(scaled_matrix(df, cols), "k-sweep-matrix")

    def one(k):
        model = kmeans_fit(m, k, seed)
        return int(k), float(model.summary.trainingCost), silhouette(model.transform(m))

    # independent fits submitted concurrently (as CrossValidator's parallelism)
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        rows = sorted(pool.map(one, ks))
    spark = df.sparkSession
    out = spark.createDataFrame(rows, "k int, sse double, silhouette double")
    best = out.orderBy(F.col("silhouette").desc(), "k").select("k").limit(1).scalar()
    return out.withColumn("best", (F.col("k") == best).cast("int"))

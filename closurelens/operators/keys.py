"""Key coverage between two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_diff(left: DataFrame, right: DataFrame, keys: Sequence[str],
             left_name: str = "left", right_name: str = "right") -> DataFrame:
    """Distinct key tuples present on one side only, with the side's name.

    Equals ``left EXCEPT right`` union ``right EXCEPT left`` (distinct
    semantics, nulls compare equal) but runs as one aggregation over the
    union of both key sets instead of two set operations."""
    lk = left.select(*keys).withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0))
    rk = right.select(*keys).withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1))
    g = lk.unionByName(rk).groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return (g.where(F.col("_l") != F.col("_r"))
            .select(*keys, F.when(F.col("_l") == 1, F.lit(f"{left_name}_only"))
                    .otherwise(F.lit(f"{right_name}_only")).alias("side")))

"""Exact ranks, running sums and neighbours of rows in a global order, per group.

The rows are range-sorted once and written with the number of their range shard.
Every later step reads the written shards, so that totals and rows always come
from the same cut, whatever Spark recomputes or reuses.  A group may span many
shards and a shard may hold many groups; a task works on one (group, shard) at a
time, which the shard bounds, and only one total row per (group, shard) meets
its neighbours.

Nulls are a group and sort first; no rows give no rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SHARD = "_shard"


def shards(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str,
           partitions: int | None = None) -> DataFrame:
    """``df`` range-sorted by group and order, written with its shard number."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.asc_nulls_first(c) for c in group], *order]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return materialize(ranged.withColumn(SHARD, F.spark_partition_id()), name)


def running_sums(sharded: DataFrame, group: Sequence[str], order: Sequence[Column],
                 sums: Mapping[str, Column]) -> DataFrame:
    """Adds inclusive running sums in group order to the written shards: a sum inside
    each (group, shard) plus the totals of the group's earlier shards."""
    inside = Window.partitionBy(*group, SHARD).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy(SHARD).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, SHARD]
    total = sharded.groupBy(*keys).agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    offset = total.select(*[F.col(c).alias(f"_k_{c}") for c in keys],
                          *[F.sum(f"_t_{k}").over(earlier).alias(f"_o_{k}") for k in sums])
    rows = sharded.withColumns({f"_i_{k}": F.sum(v).over(inside) for k, v in sums.items()})
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    out = {k: F.col(f"_i_{k}") + F.coalesce(F.col(f"_o_{k}"), F.lit(0)) for k in sums}
    return rows.join(offset, same).withColumns(out).drop(
        SHARD, *[f"_k_{c}" for c in keys], *[f"_{p}_{k}" for k in sums for p in "io"])


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str,
                partitions: int | None = None) -> DataFrame:
    """Adds ``name``, the row's exact number from 1 in its group's order."""
    return running_sums(shards(df, group, order, name, partitions), group, order, {name: F.lit(1)})


def with_halo(sharded: DataFrame, group: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    """The written shards with, for each (group, shard), the ``rows`` rows before and
    after it in its group, flagged by ``_halo``.

    The first and last rows of every (group, shard) stand in order in one small
    table, where the rows beside a shard are its neighbours even if they lie
    several shards away."""
    parts = Window.partitionBy(*group, SHARD)
    numbered = sharded.withColumn("_a", F.row_number().over(parts.orderBy(*order))).withColumn(
        "_z", F.row_number().over(parts.orderBy(*[F.desc(c) for c in order])))
    rim = numbered.where((F.col("_a") <= rows) | (F.col("_z") <= rows))
    line = Window.partitionBy(*group).orderBy(*order)
    out = sharded.withColumn("_halo", F.lit(False))
    names = sharded.columns
    for step, edge in ((F.lag, "_a"), (F.lead, "_z")):
        for k in range(1, rows + 1):
            # the row k before a shard's first one (k after its last), taken to that shard
            near = rim.select(*group, SHARD, edge, step(F.struct(*names), k).over(line).alias("_n"))
            near = near.where((F.col(edge) == 1) & F.col("_n").isNotNull())
            out = out.unionByName(near.select(
                *[F.col(SHARD) if c == SHARD else F.col("_n")[c].alias(c) for c in names], F.lit(True).alias("_halo")))
    return out

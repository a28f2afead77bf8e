"""Sources and sinks (S3, S5-S9, X37): CSV round trip with an explicit
schema, versioned and sorted writes, schema check, idempotent incremental
append, JSON flatten.  Paths are expected under a shared folder (the session's
``spark.checkpoint.dir`` in tests)."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def csv_roundtrip(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as CSV with a header and read it back with the same
    explicit schema (S3): no schema inference pass; a UTF-8 BOM in front of
    the header is tolerated by the reader."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
    return df.sparkSession.read.option("header", True).schema(df.schema).csv(path)


def versioned_path(spark: SparkSession, name: str, root: str | None = None) -> str:
    """A new path per write (S5): the reference overwrites the table it
    reads, which parquet cannot do; every version gets its own folder."""
    root = root or os.path.join(checkpoint_dir(spark), "closurelens", "tables")
    return os.path.join(root, name, f"v-{uuid.uuid4().hex}")


def write_sorted(df: DataFrame, path: str, keys: list[str], partitions: int | None = None) -> None:
    """Sorted write (S8) without a global sort: range partition on the keys
    and sort inside each partition -- files come out in key order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def check_schema(df: DataFrame, expected) -> DataFrame:
    """Schema replacement on overwrite (S7) is checked against a declared
    schema instead of being silently accepted."""
    exp = [(f.name, f.dataType.simpleString()) for f in expected.fields]
    got = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    if exp != got:
        raise ValueError(f"schema mismatch: expected {exp}, got {got}")
    return df


#: folders of an incremental store
KEY_BUCKETS = 16


def incremental_append(df: DataFrame, path: str, key: str) -> None:
    """Idempotent append (S6): only rows whose ``key`` is not stored yet are
    appended (of rows with one key the smallest by all columns), so a retried
    or repeated run adds nothing twice.  Only a missing path is a first run: a
    damaged store or one without the key or with other columns raises.  Stored
    files are laid out by a hash bucket of the key, and the stored keys are
    read for the buckets of the new rows only."""
    spark = df.sparkSession
    rest = [c for c in df.columns if c != key]
    new = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(
        key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns) if rest else df.distinct()
    new = new.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int"))
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        if sorted(set(stored.columns) - {"_bucket"}) != sorted(df.columns):
            raise ValueError(f"stored columns {stored.columns} differ from {df.columns}")
        seen = stored.select(key, "_bucket") if "_bucket" in stored.columns else stored.select(
            key, F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int").alias("_bucket"))
        new = new.join(seen, [key, "_bucket"], "left_anti")
    new.select(*df.columns, "_bucket").write.partitionBy("_bucket").mode("append").parquet(path)


def read_incremental(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an incremental store without its layout column."""
    return spark.read.parquet(path).drop("_bucket")


def json_flatten(df: DataFrame, col: str, schema: str, prefix: str = "") -> DataFrame:
    """Parse a JSON text column with a declared schema and flatten its
    fields (X37); missing fields and malformed text give nulls."""
    parsed = df.withColumn("_j", F.from_json(F.col(col), schema))
    fields = parsed.schema["_j"].dataType.fieldNames()
    return parsed.select(*[c for c in df.columns if c != col],
                         *[F.col(f"_j.{f}").alias(f"{prefix}{f}") for f in fields])

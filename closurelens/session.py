"""Session helpers: build a local session for tests/bench, resolve the shared
checkpoint folder, and materialise a DataFrame to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "closurelens") -> SparkSession:
    """Local session for tests and the bench (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    b = b.config("spark.driver.memory", os.environ.get("CLOSURELENS_DRIVER_MEM", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and is read as is; executors there
    do not share the driver's folders, so an unset one raises.  Only with a local
    master is a fresh scratch folder created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder (master {master!r})")
        d = tempfile.mkdtemp(prefix="closurelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:  # classic sessions: also register it for DataFrame.checkpoint()
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
    except Exception:  # Spark Connect has no SparkContext; materialize() does not need it
        pass
    return d


#: Spark removes the shuffle files of a query when it ends, not when the driver next collects its garbage
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, sort_keys: list[str] | None = None, files: int | None = None) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back: cuts lineage so a lost executor recomputes from the written files,
    not from the whole upstream plan.  Used before iterative ML fits and for
    gold tables.  ``sort_keys`` writes range-partitioned, sorted files (S8)
    so later filters on the leading key skip row groups.  ``files`` is the most
    files to write, for tables too small for all the shuffle's partitions.
    The shuffle files of the write are removed with its end."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "closurelens", f"{name}-{uuid.uuid4().hex}")
    if sort_keys:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(n, *sort_keys).sortWithinPartitions(*sort_keys)
    if files:
        df = df.coalesce(files)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table that ``materialize`` wrote and nothing reads any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.basename(os.path.dirname(folder)) == "closurelens":
            fs, path = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
            if fs.get_file_info(path).type == pafs.FileType.Directory:
                fs.delete_dir(path)

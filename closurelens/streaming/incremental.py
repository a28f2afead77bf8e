"""Incremental append as a Structured Streaming sink.

The reference appends geocoded chunks of 300 rows from a driver loop.  Here a
stream of new coordinates (any streaming source, e.g. a parquet folder that
receives files) is processed with ``foreachBatch``: each micro-batch is
transformed and appended only for keys not stored yet, so a batch that is
re-executed after a failure (the same epoch id) appends nothing twice.  The
checkpoint location keeps the source offsets: a restarted query resumes where
it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.io import incremental_append


def append_new_keys(path: str, key: str,
                    transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: transform the micro-batch, then append the
    rows whose ``key`` is not in the table at ``path``."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        out = transform(batch) if transform else batch
        incremental_append(out, path, key)

    return run


def start_incremental(stream: DataFrame, path: str, key: str, checkpoint: str,
                      transform: Callable[[DataFrame], DataFrame] | None = None,
                      available_now: bool = True) -> StreamingQuery:
    """Start the streaming append.  ``available_now`` processes everything
    present and stops (a scheduled incremental job); otherwise it runs until
    stopped."""
    w = (stream.writeStream.foreachBatch(append_new_keys(path, key, transform))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()

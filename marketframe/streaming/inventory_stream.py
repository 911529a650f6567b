"""The bulk-add route as a stream.  Inventory change lines land as
files; every micro-batch is folded and applied with the D5 rule
(``marketframe.operators.changes.bulk_upsert``) to the stored rows of its keys,
and only the rows it touched are written, as a delta of a log-structured table
(``marketframe.streaming.inventory_log``).

Exactly-once without a table format: a micro-batch's id is its version.  A
batch that is replayed after a failure finds its version committed and changes
nothing, or finds it missing and writes the same rows from the same input and
the same older versions.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from marketframe.operators.changes import INVENTORY_KEY, fold_bulk_lines, merge_bulk, valid_lines
from marketframe.schemas import INVENTARIO, INVENTORY_LINES
from marketframe.session import checkpoint_dir
from marketframe.streaming.inventory_log import BUCKETS, KeyedLog


def inventory_log(spark: SparkSession, root: str, buckets: int = BUCKETS) -> KeyedLog:
    return KeyedLog(spark, root, INVENTARIO, INVENTORY_KEY, buckets)


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """The current inventory."""
    return inventory_log(spark, root).read()


def apply_bulk_batches(log: KeyedLog, now_fn: Callable[[int], _dt.datetime] | None = None):
    """``foreachBatch`` function applying each micro-batch of change lines."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if log.committed(batch_id):                  # replayed: nothing to do
            return
        now = now_fn(batch_id) if now_fn else None
        checkpoint_dir(batch.sparkSession)
        folded = fold_bulk_lines(valid_lines(batch)[0], now=now).checkpoint()   # read and folded once
        if log.apply(batch_id, folded, lambda stored: merge_bulk(stored, folded, now=now).affected):
            log.compact()

    return run


def start_bulk_stream(spark: SparkSession, source_dir: str, initial: DataFrame, root: str,
                      checkpoint_location: str, fmt: str = "parquet",
                      now_fn: Callable[[int], _dt.datetime] | None = None,
                      available_now: bool = True, max_files_per_trigger: int | None = None
                      ) -> StreamingQuery:
    """Start the stream over files of ``INVENTORY_LINES`` rows in
    ``source_dir``; ``initial`` is stored as the first base if there is none."""
    log = inventory_log(spark, root)
    log.create(initial)
    reader = spark.readStream.schema(INVENTORY_LINES).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(source_dir)
    writer = (lines.writeStream.foreachBatch(apply_bulk_batches(log, now_fn))
                   .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()

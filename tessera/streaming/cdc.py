"""Change data capture as a stream: record files in, generations out.

A file source feeds micro-batches; replayed events are dropped within the
watermark; of each record a batch keeps the last change. ``ingest_stream``
brings each batch to a store as changes (only buckets of changed records are
written) under the stream's name and the batch's number: the generation keeps
the number, so a batch that is run again after a crash, its generation
published or not, changes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.plans.ingest import ingest
from tessera.providers.ports import Providers
from tessera.store.generation import Store
from tessera.store.shared import cut


def change_stream(spark: SparkSession, folder: str, schema: StructType, *, key: str = "record_id", stamp: str = "ts", delay: str = "1 hour", max_files: int = 100) -> DataFrame:
    """Changes from JSON files of a folder; a key's event with one stamp passes once."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)
    return rows.withWatermark(stamp, delay).dropDuplicatesWithinWatermark([key, stamp])


def latest(changes: DataFrame, *, key: str = "record_id", stamp: str = "ts") -> DataFrame:
    """The last change of each key in a batch."""
    rest = [c for c in changes.columns if c not in (key, stamp)]
    return changes.groupBy(key).agg(F.max_by(F.struct(stamp, *rest), stamp).alias("r")).select(key, "r.*")


def run(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, *, key: str = "record_id", stamp: str = "ts", available_now: bool = True):
    """Start the query: ``apply(changes, batch_id)`` gets each batch's last changes."""

    def batch(df: DataFrame, number: int) -> None:
        apply(latest(df, key=key, stamp=stamp), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_stream(spark: SparkSession, stream: DataFrame, store: Store, checkpoint: str, *, name: str, providers: Providers | None = None, key: str = "record_id", stamp: str = "ts", available_now: bool = True):
    """Start the query that brings changes (key, stamp, deleted, entry) to ``store``.

    ``entry`` has the columns that ``ingest`` takes. Of a record's changes in a
    batch the last counts: ``deleted`` removes it. Across batches the order is
    the stream's.
    """

    def apply(changes: DataFrame, number: int) -> None:
        changes = cut(changes)
        gone = F.coalesce(F.col("deleted"), F.lit(False))
        named = F.col(key).cast("string").alias("record_id")
        last = changes.agg(F.max(stamp).cast("string")).first()[0] or ""
        with store.writing():
            ingest(spark, store, changes.where(~gone).select(named, "entry.*"), providers, now=last, removed=changes.where(gone).select(named), whole=False, batch=(name, number))

    return run(stream, apply, checkpoint, key=key, stamp=stamp, available_now=available_now)


def upsert_stream(stream: DataFrame, store: Store, table: str, checkpoint: str, *, name: str, order: list[str], available_now: bool = True):
    """Start the query that keeps the last row of each key, by ``order``, in a table of ``store``."""

    def batch(df: DataFrame, number: int) -> None:
        store.upsert(table, cut(df), order, (name, number))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(stream: DataFrame, *, stamp: str = "ts", window: str = "10 minutes", slide: str | None = None, delay: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of changes per window (and ``by``), late ones up to ``delay`` included."""
    return stream.withWatermark(stamp, delay).groupBy(F.window(stamp, window, slide), *by).agg(F.count("*").alias("changes"))

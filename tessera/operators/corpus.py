"""Snapshots of active chunks: from tables of chunks and records, or a plain document table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_snapshot(documents: DataFrame) -> DataFrame:
    """A document table seen as a snapshot: a document is a chunk, its source the record."""
    path = F.when(F.col("doc_id") % 7 == 0, "decision.chosen").otherwise(F.concat(F.lit("body["), (F.col("doc_id") % 5).cast("string"), F.lit("]")))
    return documents.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("record_id"),
        F.concat(F.lit("Record "), F.col("source")).alias("record_title"),
        F.col("lang").alias("record_status"),
        F.array("source", "lang").alias("record_tags"),
        path.alias("value_path"),
        F.sha2("text", 256).alias("fingerprint"),
        F.col("doc_id").alias("ordinal"),
        "text",
    )


def active_chunks(chunk: DataFrame, snapshot: DataFrame, tag: DataFrame, chunk_source: DataFrame) -> DataFrame:
    """Chunks with their record's title, status, sorted tags and sorted provenance."""
    tags = tag.groupBy("record_id").agg(F.array_sort(F.collect_set("tag")).alias("record_tags"))
    sources = chunk_source.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("path", "section"))).alias("provenance"))
    rows = chunk.join(snapshot.select("record_id", F.col("title").alias("record_title"), F.col("status").alias("record_status")), "record_id")
    rows = rows.join(tags, "record_id", "left").join(sources, "chunk_id", "left")
    return rows.withColumn("record_tags", F.coalesce("record_tags", F.array().cast("array<string>"))).withColumn("provenance", F.coalesce("provenance", F.array().cast("array<struct<path:string,section:string>>")))

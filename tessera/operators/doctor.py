"""Corpus profiling: heading frequencies, heading sets, skipped paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.schemas import SKIP_REASONS


def heading_frequency(docs: DataFrame) -> DataFrame:
    """(heading, file_count, percentage): in how many files a heading is; percent to one digit, half up.

    ``docs`` (path, headings array).
    """
    total = docs.agg(F.count("*")).scalar()
    counts = docs.select("path", F.explode(F.array_distinct("headings")).alias("heading")).groupBy("heading").agg(F.count("*").alias("file_count"))
    percent = F.round(F.col("file_count").cast("decimal(20,0)") * 100 / total.cast("decimal(20,0)"), 1).cast("double")
    return counts.select("heading", "file_count", percent.alias("percentage"))


def heading_sets(docs: DataFrame, samples: int = 3) -> DataFrame:
    """(headings, file_count, samples): files grouped by their exact set of headings; the first paths in order.

    The smallest paths come from a per-group top list that each task cuts to
    ``samples``, so a set that most files share is no hot spot.
    """
    from pyspark.sql import Window

    keyed = docs.select("path", F.array_join(F.array_sort(F.array_distinct("headings")), "\x1f").alias("headings"))
    counts = keyed.groupBy("headings").agg(F.count("*").alias("file_count"))
    first = keyed.withColumn("r", F.row_number().over(Window.partitionBy("headings").orderBy("path"))).where(F.col("r") <= samples)
    lists = first.groupBy("headings").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("samples"))
    return counts.join(lists, "headings").select(F.split("headings", "\x1f").alias("headings"), "file_count", "samples")


def skip_summary(skips: DataFrame, samples: int = 3) -> DataFrame:
    """(position, reason, path_count, unseen_count, samples) in display order.

    ``skips`` (path, reason, unseen_contents).
    """
    from pyspark.sql import Window

    order = F.coalesce(*[F.when(F.col("reason") == r, F.lit(i)) for i, r in enumerate(SKIP_REASONS)], F.lit(len(SKIP_REASONS)))
    counts = skips.groupBy("reason").agg(F.count("*").alias("path_count"), F.count_if(F.coalesce("unseen_contents", F.lit(False))).alias("unseen_count"))
    first = skips.withColumn("r", F.row_number().over(Window.partitionBy("reason").orderBy("path"))).where(F.col("r") <= samples)
    lists = first.groupBy("reason").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("samples"))
    return counts.join(lists, "reason").select(order.alias("position"), "reason", "path_count", "unseen_count", "samples")

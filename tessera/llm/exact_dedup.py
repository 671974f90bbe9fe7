"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries of every partition name the digests that may be
frequent. The true totals and winners of those few are computed exactly and
broadcast, so rows of frequent texts are settled map-side; every other digest
takes an ordinary shuffle with map-side partial aggregation. Only digest rows
move, never texts.

Equal texts are those with equal digests of the text without white space. Of
equal texts the row with the most code points in the original text stays, then
the one with the smallest id (a null id counts as the largest). Null text
counts as empty. Identical rows (same id, text) are told apart by a copy
number, and exactly one of them stays. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bare, cut, heavy_keys

#: Characters that do not count when texts are compared: [\x20\x09-\x0D].
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n): sha256 of the text without white space and its code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            sums = [hashlib.sha256(t.as_py().translate(None, BLANK)).hexdigest() for t in texts.cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.string()), pc.utf8_length(texts).cast(pa.int64())], ["id", "digest", "n"])

    slim = bare(docs, id_col, text_col).toDF("id", "text")
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, digest string, n bigint")


def resolve_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 1024) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    return settle(cut(digest_rows(docs, id_col, text_col)), k).withColumnRenamed("id", id_col)


def settle(digests: DataFrame, k: int = 1024) -> DataFrame:
    """The decision for rows (id, digest, n): id, keep_id, group_size, kept, text_sha256."""
    heavy = heavy_keys(digests.select("digest"), k)
    frequent = F.col("digest").isin(heavy) if heavy else F.lit(False)
    best = F.min_by(F.struct("id", "n"), F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("z"), F.col("id").alias("i")))

    def winners(rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(best.alias("best"), F.sum("c").alias("group_size"))

    # identical rows fold into one with a count, so that one of them can be told from the rest
    rows = digests.groupBy("digest", "id", "n").agg(F.count("*").alias("c"))
    few, rest = rows.where(frequent), rows.where(~frequent)
    done = few.join(F.broadcast(winners(few)), "digest")  # winners(few): k rows at most
    done = done.unionByName(rest.join(winners(rest), "digest"))
    is_best = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("n") == F.col("best.n"))
    return _unfolded(done).select(
        "id",
        F.col("best.id").alias("keep_id"),
        F.col("group_size").cast("bigint").alias("group_size"),
        (is_best & (F.col("copy") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


#: Copies of one row that a task writes out at once.
COPIES = 100_000


def _unfolded(rows: DataFrame) -> DataFrame:
    """Each row ``c`` times, with ``copy`` from 1; those of very many copies are dealt to many tasks."""
    some = lambda lo, hi: F.explode(F.sequence(lo, hi))
    few = rows.where(F.col("c") <= COPIES).select("*", some(F.lit(1).cast("bigint"), F.col("c")).alias("copy"))
    many = rows.where(F.col("c") > COPIES).select("*", some(F.lit(0).cast("bigint"), F.expr(f"(c - 1) div {COPIES}")).alias("part"))
    start = F.col("part") * COPIES
    dealt = many.repartition("digest", "part").select("*", some(start + 1, F.least(F.col("c"), start + COPIES)).alias("copy")).drop("part")
    return few.unionByName(dealt)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 1024) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The decision is joined back on (id, digest, length), so texts cross the
    network once. Identical rows collapse to one.
    """
    slim = cut(digest_rows(docs, id_col, text_col))
    keep = settle(slim, k).where("kept").select(F.col("id").alias("__id"), F.col("text_sha256").alias("__digest"))
    stripped = F.regexp_replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), r"[\x20\x09-\x0D]", "")
    tagged = docs.withColumn("__d", F.sha2(stripped, 256))
    n = F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    joined = tagged.join(keep, tagged[f"`{id_col}`"].eqNullSafe(keep["__id"]) & (F.col("__d") == F.col("__digest")))
    # rows that share id and digest may still differ in white space or repeat: the longest stays, once
    dup = slim.groupBy("id", "digest").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias("__i2"), F.col("digest").alias("__d2"))
    multi = joined.join(dup, joined["__id"].eqNullSafe(dup["__i2"]) & (joined["__d"] == dup["__d2"]), "left")
    single = multi.where(F.col("__d2").isNull()).select(*docs.columns)
    several = multi.where(F.col("__d2").isNotNull())
    whole = [F.col(f"`{c}`") for c in docs.columns]  # among equal lengths the choice hangs on the row alone
    one = several.groupBy("__id", "__d").agg(F.max_by(F.struct(*whole), F.struct(n, F.xxhash64(*whole))).alias("r")).select("r.*")
    return single.unionByName(one)

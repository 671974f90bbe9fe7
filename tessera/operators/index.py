"""Index maintenance: plans, drift, parity, supersession, citations, ledgers.

Tables are compared by outer and anti joins on their keys; nothing collects.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.digest import canonical_json
from tessera.functions.text import json_text, nfc
from tessera.store.shared import cut


def ingest_plan(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """(record_id, action): manifest (record_id, fingerprint) against ledger (record_id, state, active_fingerprint).

    unchanged if current with the same active fingerprint; updated if there is
    an active fingerprint; else added; removed if gone from the manifest and
    not yet removed.
    """
    rows = manifest.select("record_id", "fingerprint", F.lit(True).alias("wanted")).join(ledger.select("record_id", "state", "active_fingerprint", F.lit(True).alias("known")), "record_id", "full_outer")
    same = (F.col("state") == "current") & (F.col("active_fingerprint") == F.col("fingerprint"))
    action = (
        F.when(F.col("wanted").isNull(), F.when(F.col("state") != "removed", "removed"))
        .when(F.coalesce(same, F.lit(False)), "unchanged")
        .when(F.col("active_fingerprint").isNotNull(), "updated")
        .otherwise("added")
    )
    return rows.withColumn("action", action).where("action is not null").select("record_id", "action")


def adapt_plan(specs: DataFrame, previous: DataFrame, existing: DataFrame) -> DataFrame:
    """(record_id, action): written, rewritten or unchanged, by the previous manifest and the files there are."""
    rows = specs.select("record_id", "fingerprint").join(previous.select("record_id", F.col("fingerprint").alias("before")), "record_id", "left").join(existing.select("record_id", F.lit(True).alias("there")), "record_id", "left")
    action = F.when(F.col("before").isNull(), "written").when((F.col("before") == F.col("fingerprint")) & F.col("there").isNotNull(), "unchanged").otherwise("rewritten")
    return rows.select("record_id", action.alias("action"))


def drift_reasons(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """(reason): why the manifest (record_id, entry_digest) and ledger (record_id, entry_digest, state) differ."""
    live = ledger.where("state <> 'removed'").select("record_id", F.col("entry_digest").alias("stored"), F.lit(True).alias("known"))
    rows = manifest.select("record_id", "entry_digest", F.lit(True).alias("wanted")).join(live, "record_id", "full_outer")
    reason = F.when(F.col("known").isNull(), "record_added").when(F.col("wanted").isNull(), "record_removed").when(~F.col("entry_digest").eqNullSafe(F.col("stored")), "record_changed")
    failed = ledger.where("state = 'failed'").select(F.lit("failed_ingest").alias("reason"))
    return rows.select(reason.alias("reason")).where("reason is not null").unionByName(failed).distinct()


def orphans(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id) of vectors without a chunk."""
    return vectors.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def parity_problems(chunks: DataFrame, vectors: DataFrame, locator: list[str]) -> DataFrame:
    """(chunk_id, problem): missing_vector, orphan_vector or locator_mismatch."""
    one = chunks.select("chunk_id", F.struct(*locator).alias("a"))
    two = vectors.select("chunk_id", F.struct(*locator).alias("b"))
    rows = one.join(two, "chunk_id", "full_outer")
    problem = F.when(F.col("b").isNull(), "missing_vector").when(F.col("a").isNull(), "orphan_vector").when(~F.col("a").eqNullSafe(F.col("b")), "locator_mismatch")
    return rows.select("chunk_id", problem.alias("problem")).where("problem is not null")


def active_set_digest(chunks: DataFrame) -> DataFrame:
    """(n, digest): the count and the SHA-256 of the canonical JSON list of the sorted chunk ids; empty for none.

    The ids are sorted by all tasks, in numbered ranges, and each task joins
    its own to pieces of text. The digest itself is sequential by definition:
    one task streams the pieces through it, by range and place, and holds one.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, b in enumerate(b for b in batches if b.num_rows):
            listed = canonical_json(b.column(1).to_pylist())[1:-1]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), pa.array([place], pa.int64()), pa.array([b.num_rows], pa.int64()), pa.array([listed])], ["stretch", "place", "ids", "listed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, whole = 0, hashlib.sha256(b"[")
        for b in batches:
            for ids, listed in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                whole.update(f"{',' if n else ''}{listed.as_py()}".encode())
                n += ids
        whole.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([whole.hexdigest() if n else ""])], ["n", "digest"])

    ids = chunks.select(F.col("chunk_id").cast("string").alias("c")).repartitionByRange("c").sortWithinPartitions("c")
    pieces = ids.select(F.spark_partition_id().alias("stretch"), "c").mapInArrow(joined, "stretch int, place bigint, ids bigint, listed string")
    one = pieces.repartition(1).sortWithinPartitions("stretch", "place").mapInArrow(run, "n bigint, digest string")
    return one.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("digest"), F.lit("")).alias("digest"))


def latest_state(ledger: DataFrame, order: list[str]) -> DataFrame:
    """The last row of each record (upsert by key); ties go to the largest remaining columns."""
    rest = [c for c in ledger.columns if c not in ("record_id", *order)]
    best = F.max(F.struct(*order, *rest)).alias("r")
    return ledger.groupBy("record_id").agg(best).select("record_id", "r.*")


def replace_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` without the rows whose key is in ``new``, and ``new``."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def stale_records(ledger: DataFrame) -> DataFrame:
    """(record_id) whose wanted fingerprint is not the active one."""
    return ledger.where("not (desired_fingerprint <=> active_fingerprint)").select("record_id")


def supersession_edges(records: DataFrame) -> DataFrame:
    """(successor_id, predecessor_id, evidence_id) of records that name a predecessor."""
    named = records.where("supersedes is not null and trim(supersedes) <> ''")
    evidence = F.concat(F.lit("mev_"), F.sha2(F.concat(F.lit('["supersession-v1",'), json_text(nfc(F.col("supersedes"))), F.lit(","), json_text(nfc(F.col("id"))), F.lit("]")), 256))
    return named.select(F.col("id").alias("successor_id"), F.col("supersedes").alias("predecessor_id"), evidence.alias("evidence_id"))


def supersession_notices(accepted: DataFrame, edges: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, predecessor_id, successor_id, successor_title, evidence_id, disclosure_no, sentence): immediate successors of accepted records."""
    seen = accepted.select("query_id", F.col("record_id").alias("predecessor_id")).distinct()
    rows = seen.join(edges, "predecessor_id").join(records.select(F.col("id").alias("successor_id"), F.col("title").alias("successor_title")), "successor_id")
    order = Window.partitionBy("query_id").orderBy("successor_id", "predecessor_id")
    text = F.concat(F.lit("This decision was later changed by "), "successor_title", F.lit(" ("), "successor_id", F.lit(")."))
    return rows.dropDuplicates(["query_id", "predecessor_id", "successor_id"]).select("query_id", "predecessor_id", "successor_id", "successor_title", "evidence_id", F.row_number().over(order).alias("disclosure_no"), text.alias("sentence"))


def disclosure_citations(notices: DataFrame, sources: DataFrame | None, stale: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, disclosure_no, citation_no, evidence_id, record_id, path, section, resolution, freshness): what each notice cites.

    ``sources`` (record_id, path, section): where a manifest says that a record
    names its predecessor, the first for each; ``after`` (query_id, last): the
    numbers that are taken. A successor without a source keeps an empty path.
    """
    rows = notices.withColumnRenamed("successor_id", "record_id").join(after, "query_id", "left").join(stale.select("record_id", F.lit(True).alias("stale")), "record_id", "left")
    none = F.lit(None).cast("string")
    rows = rows.withColumn("path", none).withColumn("section", none) if sources is None else rows.join(sources.select("record_id", "path", "section").dropDuplicates(["record_id"]), "record_id", "left")
    return rows.select(
        "query_id", "disclosure_no", (F.coalesce("last", F.lit(0)) + F.col("disclosure_no")).alias("citation_no"), "evidence_id", "record_id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("section", F.lit("")).alias("section"),
        F.when(F.col("path").isNull(), "hint_unavailable").otherwise("named").alias("resolution"), F.when(F.col("stale"), "stale_version").otherwise("current").alias("freshness"),
    )


def cyclic_records(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(record_id) of records on a supersession cycle (each names at most one predecessor).

    Pointer doubling: after k rounds a record points 2**k places down its
    chain, and chains that end have dropped out. Once a round changes neither
    the pointing records nor the ones pointed at, the latter are the cycles.
    """
    now = cut(edges.select(F.col("successor_id").alias("node"), F.col("predecessor_id").alias("to")).where("node is not null and to is not null").distinct())
    seen = None
    for _ in range(rounds):
        size = now.agg(F.count("*").alias("n"), F.count_distinct("to").alias("d")).first()
        if tuple(size) == seen:
            break
        seen = tuple(size)
        now = cut(now.join(now.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))
    return now.select(F.col("to").alias("record_id")).distinct()


def number_citations(uses: DataFrame) -> DataFrame:
    """(query_id, chunk_id, path, section, citation_no, sentences): C numbers by first use.

    ``uses`` (query_id, sentence_pos, chunk_pos, source_pos, chunk_id, path, section).
    """
    first = uses.groupBy("query_id", "chunk_id", "path", "section").agg(F.min(F.struct("sentence_pos", "chunk_pos", "source_pos")).alias("first"), F.array_sort(F.collect_set("sentence_pos")).alias("sentences"))
    order = Window.partitionBy("query_id").orderBy("first", "chunk_id", "path", "section")
    return first.select("query_id", "chunk_id", "path", "section", F.row_number().over(order).alias("citation_no"), "sentences")


def store_diff(one: DataFrame, two: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two stores as multisets: (key..., in_one, in_two) where the counts differ."""
    a = one.groupBy(*key).agg(F.count("*").alias("in_one"))
    b = two.groupBy(*key).agg(F.count("*").alias("in_two"))
    both = a.join(b, key, "full_outer").na.fill(0, ["in_one", "in_two"])
    return both.where("in_one <> in_two")


def live_ledger(ledger: DataFrame, column: str) -> DataFrame:
    """(record_id, column) of records that are not removed: fingerprints or entry digests."""
    return ledger.where("state <> 'removed'").select("record_id", column)


def has_failed(ledger: DataFrame) -> bool:
    return not ledger.where("state = 'failed'").isEmpty()


def eligible_versions(chunks: DataFrame, generation: str) -> DataFrame:
    """The distinct (generation, record_id, fingerprint) that have chunks."""
    return chunks.select(F.lit(generation).alias("generation"), "record_id", "fingerprint").distinct()


def source_states(refs: DataFrame, listing: DataFrame | None) -> DataFrame:
    """``refs`` (path, ...) with ``resolution``: resolved, missing, hint_unavailable or invalid_relative_path.

    ``listing`` (path) holds the files under the root, case and all; None if there is no root.
    """
    parts = F.split("path", "/")
    valid = (F.col("path") != "") & ~F.array_contains(parts, "") & ~F.array_contains(parts, "..")
    if listing is None:
        return refs.withColumn("resolution", F.when(F.coalesce(valid, F.lit(False)), "hint_unavailable").otherwise("invalid_relative_path"))
    rows = refs.join(listing.select("path").distinct().withColumn("__there", F.lit(True)), "path", "left")
    state = F.when(~F.coalesce(valid, F.lit(False)), "invalid_relative_path").when(F.col("__there"), "resolved").otherwise("missing")
    return rows.withColumn("resolution", state).drop("__there")

"""Building and updating an index generation from records."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.digest import pipeline_signature, record_digest
from tessera.operators import chunking, index, packing
from tessera.providers.ports import Providers
from tessera.schemas import LEDGER, S
from tessera.sources.frontmatter import _dict
from tessera.store.generation import LOCATOR, TABLES, Store, StoreError, bucket_of, buckets_for
from tessera.store.shared import cut, discard, stored

#: Fixed value: why a record is removed.
REMOVED = "absent_from_manifest"


def with_digest(records: DataFrame) -> DataFrame:
    """``records`` (a struct column ``record``) with ``record_digest``, computed next to the rows."""

    @F.pandas_udf(S)
    def digest(record: pd.DataFrame) -> pd.Series:
        return pd.Series([record_digest(_dict(r)) for r in record.to_dict("records")])

    return records.withColumn("record_digest", digest("record"))


def embedded(chunks: DataFrame, providers: Providers) -> DataFrame:
    """(chunk_id, vector) of (chunk_id, embedding_input), in provider batches of bounded size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), chunking.BATCH_CHUNKS):
                part = f.iloc[at : at + chunking.BATCH_CHUNKS]
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "vector": providers.checked_embedding(part["embedding_input"].tolist())})

    return chunks.select("chunk_id", "embedding_input").mapInPandas(run, "chunk_id string, vector array<double>")


def ingest(
    spark: SparkSession, store: Store, entries: DataFrame, providers: Providers | None = None, *, now: str = "", rebuild: bool = False, dry_run: bool = False, fresh_if_other: bool = False,
    manifest_digest: str | None = None, removed: DataFrame | None = None, whole: bool = True, batch: tuple[str, int] | None = None, buckets: int | None = None,
) -> DataFrame:
    """Bring the store to ``entries`` and return (record_id, action, failure_code).

    ``entries``: record (struct), fingerprint, entry_digest, record_digest,
    field_sources. Unchanged records keep their rows; changed ones are replaced
    as a whole; a record that fails keeps its former rows and a failed ledger
    row. Unchanged records are read again too: one that cannot be read, whose
    digest differs or that lacks a source fails. Entries may name a
    ``record_id`` of their own, for records that cannot be read. The generation
    is published only if every chunk has its vector. A store of another
    pipeline is refused, or with ``fresh_if_other`` a fresh generation is built.

    Only buckets with a changed record are written; the new generation shares
    the others' files with the one before. ``whole=False``: ``entries`` are
    changes, other records stay as they are, and ``removed`` (record_id) names
    those that go. ``batch`` (stream, number): changes nothing if the store has
    seen that number of that stream, so a batch may be run again.
    """
    with nullcontext(store) if dry_run else store.as_writer():
        return _ingest(spark, store, entries, providers or Providers(), now, rebuild, dry_run, fresh_if_other, manifest_digest, removed, whole, batch, buckets)


REPORT = "record_id string, action string, failure_code string"


def _ingest(spark, store, entries, providers, now, rebuild, dry_run, fresh_if_other, manifest_digest, removed, whole, batch, buckets) -> DataFrame:
    signature = pipeline_signature(providers.model, providers.dimensions, providers.encoding)
    base = store.active()
    meta = store.meta(base) if base else {}
    if batch and meta.get("batches", {}).get(batch[0], -1) >= batch[1]:
        return spark.createDataFrame([], REPORT)
    active = None if rebuild else base
    if active and meta["signature"] != signature:
        if not fresh_if_other:
            raise StoreError("the store was built by another pipeline; rebuild it")
        active = None
    ledger = store.table("ledger", active) if active else spark.createDataFrame([], LEDGER)
    rows = with_digest(entries.withColumnRenamed("record_digest", "stated_digest")).withColumn("record_id", F.coalesce(F.col("record.id"), F.col("record_id") if "record_id" in entries.columns else F.lit(None)))
    code = F.when(F.col("record").isNull(), "record.unreadable").when(F.coalesce(F.col("stated_digest") != F.col("record_digest"), F.lit(False)), "digest.record_mismatch")
    rows = stored(rows.withColumn("failure_code", code))  # every record is read and digested once
    known = ledger
    if not whole:
        named = rows.select("record_id")
        known = ledger.join(named.unionByName(removed.select("record_id")) if removed is not None else named, "record_id", "left_semi")
    plan = cut(index.ingest_plan(rows.select("record_id", "fingerprint"), known))
    work = rows.join(plan, "record_id")
    readable = work.where("failure_code is null")
    sources = readable.select(F.col("record_id").alias("id"), F.explode("field_sources").alias("value_path", "refs"))
    given = sources.select("id", F.regexp_replace("value_path", r"^(decision\.alternatives\[\d+\])\..*$", "$1").alias("value_path"), "refs")
    unsourced = chunking.missing_provenance(chunking.units(readable.select("record.*", "fingerprint")), given).select(F.col("id").alias("record_id")).distinct().withColumn("lost", F.lit(True))
    flat = readable.where("action in ('added', 'updated')").select("record.*", "fingerprint")
    planned = packing.plan(chunking.units(flat), "g", packing.bpe_counter, *providers.vocabulary) if providers.vocabulary else chunking.plan(chunking.units(flat), "g")
    chunks = stored(planned)
    oversize = chunks.where("oversize").select(F.col("id").alias("record_id")).distinct().withColumn("big", F.lit(True))
    judged = work.select("record_id", "action", "failure_code").join(unsourced, "record_id", "left").join(oversize, "record_id", "left")
    failed = F.coalesce("failure_code", F.when(F.col("lost"), "provenance.missing"), F.when(F.col("big"), "chunking.oversize"))
    fates = judged.select("record_id", "action", failed.alias("failure_code"))
    gone = plan.where("action = 'removed'").select("record_id", "action", F.lit(None).cast("string").alias("failure_code"))
    report = cut(fates.unionByName(gone).withColumn("action", F.when(F.col("failure_code").isNotNull(), "failed").otherwise(F.col("action"))))
    if not dry_run:
        if buckets is None:
            buckets = meta["buckets"] if active else buckets_for(report.count())
        files = _written(store, active, buckets, rows, flat, given, chunks, ledger, report, providers, now)
        batches = meta.get("batches", {}) | ({batch[0]: batch[1]} if batch else {})
        store.publish(files, {"signature": signature, "model": providers.model, "manifest_digest": manifest_digest, "written_at": now, "buckets": buckets, "batches": batches}, base)
    discard(rows, chunks)
    return report


def _written(store: Store, active: str | None, buckets: int, rows: DataFrame, flat: DataFrame, given: DataFrame, chunks: DataFrame, ledger: DataFrame, report: DataFrame, providers: Providers, now: str) -> dict[str, dict[str, str]]:
    """The files of the next generation: touched buckets written anew, the others as they were."""
    before = store.meta(active)["files"] if active else {}
    fresh = report.where("action in ('added', 'updated')").select("record_id")
    stale = report.where("action in ('added', 'updated', 'removed')").select("record_id")
    touched = {r["b"] for r in stale.select(bucket_of(F.col("record_id"), buckets).alias("b")).distinct().collect()}  # a number for each bucket at most
    files = {name: dict(before.get(name, {})) for name in TABLES}

    def replaced(name: str, new: DataFrame, key: str, gone: DataFrame, where: set[int]) -> DataFrame:
        if not active:
            return new
        old = store.table(name, active, where)
        return old.join(gone.withColumnRenamed("record_id", key), key, "left_anti").unionByName(new.select(*old.columns))

    def put(name: str, table: DataFrame, where: set[int]) -> None:
        kept = {b: path for b, path in files[name].items() if int(b) not in where}
        files[name] = kept | store.write(name, table, buckets)

    if touched:
        ready = chunks.withColumnRenamed("id", "record_id").join(fresh, "record_id", "left_semi")
        records = flat.withColumnRenamed("id", "record_id").join(fresh, "record_id", "left_semi")
        sources = ready.select("chunk_id", F.col("record_id").alias("id"), "value_path").join(given, ["id", "value_path"])
        snapshot = replaced("snapshot", records.select("record_id", "title", "status", "supersedes", "fingerprint"), "record_id", stale, touched)
        one = lambda name, new: (name, replaced(name, new, "record_id", stale, touched), touched)
        tables = [
            one("chunk", ready.select("chunk_id", *LOCATOR, "text", "evidence_tokens", "input_tokens")),
            one("vector", embedded(ready, providers).join(ready.select("chunk_id", *LOCATOR), "chunk_id").select("chunk_id", *LOCATOR, "vector")),
            one("tag", records.select("record_id", F.explode("tags").alias("tag")).distinct()),
            one("chunk_source", sources.select("chunk_id", F.col("id").alias("record_id"), F.explode("refs").alias("r")).select("chunk_id", "record_id", "r.path", "r.section").distinct()),
            ("snapshot", snapshot, touched),
            ("link", index.supersession_edges(snapshot.withColumnRenamed("record_id", "id")), touched),
        ]
        with ThreadPoolExecutor(len(tables)) as pool:  # the tables don't depend on one another: small writes share the cores
            list(pool.map(lambda t: put(*t), tables))
        here = [[f"{store.root}/{files[name][b]}" for b in sorted(files[name]) if int(b) in touched] for name in ("chunk", "vector")]
        if not index.parity_problems(store.read("chunk", here[0]), store.read("vector", here[1]), LOCATOR).isEmpty():
            raise StoreError("chunks and vectors do not match; nothing was published")

    wanted = rows.select("record_id", F.col("fingerprint").alias("desired"), "entry_digest", "record_digest")
    state = F.when(F.col("action") == "removed", "removed").when(F.col("action") == "failed", "failed").otherwise("current")
    prior = ledger.select("record_id", F.col("active_fingerprint").alias("prior"), F.struct(*[c for c in ledger.columns if c not in ("record_id", "changed_at")]).alias("was"))
    book = report.join(wanted, "record_id", "left").join(prior, "record_id", "left")
    held = F.when(state == "current", F.col("desired")).when(state == "failed", F.col("prior"))
    now_is = [state.alias("state"), F.col("desired").alias("desired_fingerprint"), held.alias("active_fingerprint"), "entry_digest", "record_digest", "failure_code", F.when(F.col("action") == "removed", REMOVED).alias("removal_reason")]
    changed = cut(book.select("record_id", *now_is, "was").where(~F.struct("state", "desired_fingerprint", "active_fingerprint", "entry_digest", "record_digest", "failure_code", "removal_reason").eqNullSafe(F.col("was"))).drop("was").withColumn("changed_at", F.lit(now)))
    pages = {r["b"] for r in changed.select(bucket_of(F.col("record_id"), buckets).alias("b")).distinct().collect()}
    if pages:
        put("ledger", replaced("ledger", changed, "record_id", changed.select("record_id"), pages), pages)
    return files

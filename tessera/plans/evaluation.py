"""Evaluation of a battery against one store: adapt, ingest, ask, judge."""

from __future__ import annotations

import shutil
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluate
from tessera.plans.engine import Engine
from tessera.plans.ingest import ingest
from tessera.providers.ports import Providers
from tessera.sources.adapters import Adapter
from tessera.store.generation import Store
from tessera.store.shared import cut


def entries(spark: SparkSession, adapter: Adapter, root: str) -> DataFrame:
    """(record, fingerprint, field_sources, entry_digest, record_digest) of the folders in use."""
    used = adapter.adapt(spark, root).where("record is not null and used")
    return used.select("record", "fingerprint", F.sha2(F.concat_ws("|", "fingerprint", "record.id"), 256).alias("entry_digest"), F.lit(None).cast("string").alias("record_digest"), "field_sources")


def answered(engine: Engine, questions: DataFrame, runs: int, *, allow_stale: bool = False) -> DataFrame:
    """(query_id, run, state, cause, n_sentences, cited_records, cited_paths, result): every question asked ``runs`` times.

    ``result`` is the whole traced result as JSON, for those who look into a deviation.
    """
    paths = engine.tables["chunk"].select("chunk_id", "value_path")

    def once(run: int) -> DataFrame:
        rows = cut(engine.ask(questions, allow_stale=allow_stale).withColumn("run", F.lit(run)))
        cites = rows.select("query_id", F.explode("citations").alias("c")).select("query_id", "c.chunk_id", "c.record_id").join(paths, "chunk_id")
        cited = cites.groupBy("query_id").agg(F.collect_set("record_id").alias("cited_records"), F.collect_set(F.struct("record_id", "value_path")).alias("cited_paths"))
        none = F.array()
        out = rows.join(cited, "query_id", "left")
        return out.select(
            "query_id", "run", "state", "cause", F.coalesce(F.size("sentences"), F.lit(0)).alias("n_sentences"),
            F.coalesce("cited_records", none.cast("array<string>")).alias("cited_records"),
            F.coalesce("cited_paths", none.cast("array<struct<record_id string, value_path string>>")).alias("cited_paths"),
            F.to_json(F.struct("state", "stage", "cause", "sentences", "citations", "notices", "failure", "trace")).alias("result"),
        )

    return reduce(DataFrame.unionByName, [once(run) for run in range(1, runs + 1)])


def battery_report(spark: SparkSession, store: Store, battery: DataFrame, runs: int = 1, providers: Providers | None = None, traces: str | None = None, allow_stale: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pass rates, impossible expectations) of a battery over the active generation; failing runs go to ``traces``.

    No manifest is at hand here: a store that recorded one is judged only if stale answers are allowed.
    """
    with store.reading():
        engine = Engine(spark, store, providers)
        lost = cut(evaluate.unsatisfiable(battery, engine.tables["snapshot"], engine.tables["chunk"]))
        results = cut(answered(engine, battery.select("query_id", "question"), runs, allow_stale=allow_stale))
        checks = cut(evaluate.check(results, battery))
        if traces and not checks.where(~F.col("passed")).isEmpty():
            evaluate.write_deviations(results.select("query_id", "run", "result"), checks, traces)
        return evaluate.pass_rates(checks), lost


def reingested(spark: SparkSession, store: Store, adapter: Adapter, root: str, record_id: str, path: str, work: str, providers: Providers | None = None) -> bool:
    """Whether a record's chunks change when the file ``path`` of its corpus does; the corpus itself is left alone."""
    before = cut(store.table("chunk").where(F.col("record_id") == record_id).select("record_id", "chunk_id"))
    copy = Path(work) / "corpus"
    shutil.copytree(root, copy)
    changed = copy / path
    changed.write_text(changed.read_text() + "\nOne more sentence for the second ingest.\n")
    with store.writing():
        ingest(spark, store, entries(spark, adapter, str(copy)), providers)
    after = store.table("chunk").where(F.col("record_id") == record_id).select("record_id", "chunk_id")
    verdict = evaluate.reingest_check(before, after).first()
    return bool(verdict and verdict["passed"])

"""Generations by bucket, fences and locks, and ingest as a stream."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_engine import ENTRY, actions, entries, entry

from tessera.operators import index
from tessera.plans.ingest import ingest
from tessera.providers.ports import Providers
from tessera.schemas import S, struct
from tessera.store.generation import COLUMNS, LOCATOR, TABLES, Store, StoreError, bucket_of
from tessera.streaming import cdc


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """A store of five records, an ingest that changes one, and both lists of files."""
    store = Store(spark, str(tmp_path_factory.mktemp("built") / "store"))
    base = [entry(n, text, supersedes="R1" if n == 2 else None) for n, text in enumerate(["parquet files", "sqlite tables", "plain text", "wild birds", "red boats"], 1)]
    ingest(spark, store, entries(spark, *base), buckets=64, now="first")
    first = store.meta()["files"]
    report = ingest(spark, store, entries(spark, *base[:4], entry(5, "blue boats", "2")), now="second")
    assert actions(report) == {"R1": "unchanged", "R2": "unchanged", "R3": "unchanged", "R4": "unchanged", "R5": "updated"}
    return store, first


def test_one_changed_record_rewrites_one_bucket(spark, built):
    store, first = built
    second = store.meta()["files"]
    numbers = {r["record_id"]: str(r["b"]) for r in store.table("ledger").select("record_id", bucket_of(F.col("record_id"), 64).alias("b")).collect()}
    assert set(first) == set(second) == set(TABLES)
    for name in ("chunk", "vector", "tag", "chunk_source", "snapshot", "ledger"):
        assert {b for b in second[name] if second[name][b] != first[name].get(b)} == {numbers["R5"]}
    assert second["link"] == first["link"] and len(first["link"]) == 1
    texts = {r["record_id"]: r["text"] for r in store.table("chunk").where("value_path = 'decision.chosen'").collect()}
    assert texts["R5"] == "We chose blue boats." and len(texts) == 5
    assert index.parity_problems(store.table("chunk"), store.table("vector"), LOCATOR).isEmpty()
    assert {r["changed_at"] for r in store.table("ledger").where("record_id <> 'R5'").collect()} == {"first"}
    assert store.table("ledger").where("record_id = 'R5'").first()["changed_at"] == "second"


def test_same_rows_as_a_rebuild(spark, built, tmp_path):
    store, _ = built
    other = Store(spark, str(tmp_path / "other"))
    ingest(spark, other, entries(spark, *[entry(n, text, supersedes="R1" if n == 2 else None) for n, text in enumerate(["parquet files", "sqlite tables", "plain text", "wild birds"], 1)], entry(5, "blue boats", "2")), buckets=3)
    for name in TABLES:
        columns = [c for c in store.table(name).columns if c != "changed_at"]
        one, two = store.table(name).select(*columns), other.table(name).select(*columns)
        assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty(), name


def test_upkeep_drops_what_no_list_names(spark, built):
    store, first = built
    with store.reading(), pytest.raises(StoreError):
        store.drop_inactive()
    assert store.readers() == 0 and len(store.drop_inactive()) == 1
    named = {path for listed in store.meta()["files"].values() for path in listed.values()}
    assert all(store._exists(path) for path in named)
    assert not any(store._exists(path) for listed in first.values() for path in listed.values() if path not in named)
    assert store.problems() == [] and store.table("chunk").count() == store.table("vector").count() > 0
    path = next(iter(store.meta()["files"]["tag"].values()))
    store._delete(path, True)
    assert any(p.startswith("tag: ") for p in store.problems())


def test_a_stalled_writer_cannot_undo_its_successor(spark, tmp_path):
    slow, fast = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    with slow.writing(lease=-1.0):  # its lease has run out
        with pytest.raises(StoreError, match="took over"):
            with fast.writing():
                assert fast.fence == slow.fence + 1
                slow.publish({}, {"by": "slow"}, None)
        with fast.writing():
            kept = fast.publish({}, {"by": "fast"}, None)
        # even a pointer that the stalled writer had on its way stays below its successor's
        slow._write(f"ACTIVE/{slow.fence:012d}-{9:06d}", "late")
        assert slow.active() == fast.active() == kept and fast.meta()["by"] == "fast"
        with pytest.raises(StoreError, match="meanwhile"):
            fast.publish({}, {"by": "other"}, None)
    with fast.writing(), pytest.raises(StoreError, match="another writer"):
        with slow.writing():
            pass


def test_a_lease_left_behind_ends(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store._create("FENCES/000000000007", "0.0") and not store._create("FENCES/000000000007", "1")
    with store.writing():
        assert store.fence == 8
    assert store._create("FENCES/000000000009", str(10**12))
    with pytest.raises(StoreError), store.writing():
        pass
    assert store._create("READERS/crashed", "5.0") and store.readers() == 0


def test_another_pipeline_builds_afresh(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    ingest(spark, store, entries(spark, entry(1, "a"), entry(2, "b")))
    report = ingest(spark, store, entries(spark, entry(1, "a")), Providers(model="other"), fresh_if_other=True)
    assert actions(report) == {"R1": "added"} and store.meta()["model"] == "other"
    assert [r["record_id"] for r in store.table("ledger").collect()] == ["R1"]


def test_batches_of_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    ingest(spark, store, entries(spark, entry(1, "a"), entry(2, "b"), entry(3, "c")))
    gone = spark.createDataFrame([("R2",)], "record_id string")
    change = lambda n: ingest(spark, store, entries(spark, entry(3, "d", "2"), entry(4, "e")), removed=gone, whole=False, batch=("feed", n))
    assert actions(change(0)) == {"R2": "removed", "R3": "updated", "R4": "added"}
    after = store.active()
    assert actions(change(0)) == {} and store.active() == after  # run again
    assert actions(change(1)) == {"R3": "unchanged", "R4": "unchanged"}
    assert {r["record_id"]: r["state"] for r in store.table("ledger").collect()} == {"R1": "current", "R2": "removed", "R3": "current", "R4": "current"}
    assert {r["record_id"] for r in store.table("chunk").select("record_id").distinct().collect()} == {"R1", "R3", "R4"}


def test_ingest_as_a_stream_equals_one_batch(spark, tmp_path):
    schema = struct(record_id=S, ts=S, deleted=S, entry=ENTRY)
    source = tmp_path / "in"
    source.mkdir()

    def put(name, *changes):
        rows = [{"record_id": f"R{n}", "ts": f"2024-01-01T00:{minute:02d}:00", "deleted": str(text is None).lower(), "entry": dict(zip(ENTRY.fieldNames(), entry(n, text, str(minute)), strict=True)) if text else None} for n, minute, text in changes]
        (source / name).write_text("\n".join(json.dumps(r) for r in rows))

    def stream():
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        rows = rows.withColumn("ts", F.to_timestamp("ts")).withColumn("deleted", F.col("deleted") == "true")
        return rows.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["record_id", "ts"])

    store = Store(spark, str(tmp_path / "store"))
    go = lambda: cdc.ingest_stream(spark, stream(), store, str(tmp_path / "cp"), name="specs").awaitTermination(120)
    put("1.json", (1, 1, "old"), (1, 2, "parquet"), (2, 1, "sqlite"))
    go()
    put("2.json", (2, 5, None), (3, 6, "birds"), (1, 2, "parquet"))  # the last one is a replay
    go()
    assert store.meta()["batches"]["specs"] >= 1
    once = Store(spark, str(tmp_path / "once"))
    ingest(spark, once, entries(spark, entry(1, "parquet", "2"), entry(3, "birds", "6")))
    for name in ("chunk", "vector", "snapshot", "tag"):
        assert sorted(map(str, store.table(name).collect())) == sorted(map(str, once.table(name).collect())), name
    assert {r["record_id"]: r["state"] for r in store.table("ledger").collect()} == {"R1": "current", "R2": "removed", "R3": "current"}


def test_upserts_keep_the_last_row_whatever_the_order(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"state": "record_id bigint, ts timestamp, value string"})
    rows = lambda *r: spark.createDataFrame([(k, datetime(2024, 1, 1, 0, m), v) for k, m, v in r], "record_id bigint, ts timestamp, value string")
    assert store.upsert("state", rows((1, 5, "b"), (2, 1, "x")), ["ts"], ("in", 0))
    files = store.meta()["files"]["state"]
    assert not store.upsert("state", rows((1, 9, "zzz")), ["ts"], ("in", 0))
    assert store.upsert("state", rows((1, 3, "a"), (1, 4, "c")), ["ts"], ("in", 1))
    assert {r["record_id"]: r["value"] for r in store.table("state").collect()} == {1: "b", 2: "x"}
    changed = [b for b, path in store.meta()["files"]["state"].items() if files.get(b) != path]
    assert len(changed) == 1 and set(COLUMNS) == set(TABLES)

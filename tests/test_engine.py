import pytest
from pyspark.sql import functions as F

from tessera.operators.retrieval import Filters
from tessera.plans.engine import Engine
from tessera.plans.ingest import ingest
from tessera.providers.ports import Invalid, Providers, Retryable, with_retries
from tessera.schemas import FIELD_SOURCES, RECORD, S, struct
from tessera.store.generation import Store, StoreError

ENTRY = struct(record=RECORD, fingerprint=S, entry_digest=S, record_digest=S, field_sources=FIELD_SOURCES)
SOURCES = {p: [{"path": "docs/x.md", "section": "s"}] for p in ("context.problem", "decision.chosen", "decision.alternatives[0].title", "why[0]", "rationale_summary", "body[0]", "consequences.positive[0]")}


def entry(n, text, version="1", supersedes=None, sources=SOURCES, status="accepted", digest=None):
    record = {
        "id": f"R{n}", "title": f"Title {n}", "status": status, "date": "2024-01-01", "body": None, "context": {"problem": f"Problem of {text}.", "triggering_change": None},
        "decision": {"chosen": f"We chose {text}.", "alternatives": [{"title": "nothing", "rejection_reason": "no"}]}, "why": [f"Because {text} works."], "rationale_summary": None,
        "consequences": None, "evidence": [], "tags": [f"t{n % 2}"], "supersedes": supersedes,
    }
    return (record, f"f{n}-{version}", f"e{n}-{version}", digest, sources)


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY)


def actions(df):
    return {r["record_id"]: r["failure_code"] or r["action"] for r in df.collect()}


def test_ingest_and_answer(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    base = [entry(1, "parquet files"), entry(2, "sqlite tables"), entry(3, "plain text", supersedes="R2"), entry(4, "wild birds")]
    assert actions(ingest(spark, store, entries(spark, *base), dry_run=True)) == dict.fromkeys(["R1", "R2", "R3", "R4"], "added")
    assert store.active() is None
    assert set(actions(ingest(spark, store, entries(spark, *base))).values()) == {"added"}
    first = store.active()
    again = [base[0], entry(2, "duckdb tables", "2"), base[2], entry(5, "red boats", sources={}), entry(6, "x", digest="wrong")]
    assert actions(ingest(spark, store, entries(spark, *again))) == {"R1": "unchanged", "R2": "updated", "R3": "unchanged", "R4": "removed", "R5": "provenance.missing", "R6": "digest.record_mismatch"}
    assert store.active() != first
    texts = {r["record_id"]: r["text"] for r in store.table("chunk").where("value_path = 'decision.chosen'").collect()}
    assert texts == {"R1": "We chose parquet files.", "R2": "We chose duckdb tables.", "R3": "We chose plain text."}
    states = {r["record_id"]: r["state"] for r in store.table("ledger").collect()}
    assert states == {"R1": "current", "R2": "current", "R3": "current", "R4": "removed", "R5": "failed", "R6": "failed"}
    assert store.table("chunk").count() == store.table("vector").count()
    assert store.drop_inactive() == [first]

    engine = Engine(spark, store)
    asked = spark.createDataFrame([(1, "Which duckdb tables were chosen?"), (2, "zzz qqq")], "query_id int, question string")
    got = {r["query_id"]: r for r in engine.ask(asked).collect()}
    assert got[1]["state"] == "answered"
    assert any("duckdb" in s for s in got[1]["sentences"])
    assert [c["citation_no"] for c in got[1]["citations"]] == list(range(1, len(got[1]["citations"]) + 1))
    assert any("Title 3 (R3)" in n for n in got[1]["notices"])
    assert got[2]["state"] == "abstained"
    only = engine.retrieve(asked, Filters.build(record_ids=["R1"])).select("record_id").distinct().collect()
    assert [r[0] for r in only] == ["R1"]


def test_store_guards(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(StoreError):
        Engine(spark, store)
    with store.writing(), pytest.raises(StoreError), store.writing():
        pass
    with store.writing():
        pass
    ingest(spark, store, entries(spark, entry(1, "a")))
    other = Providers(model="other")
    with pytest.raises(StoreError):
        ingest(spark, store, entries(spark, entry(1, "a")), other)
    with pytest.raises(StoreError):
        Engine(spark, store, other)
    store._write("FORMAT", "9")
    with pytest.raises(StoreError):
        store.active()


def test_retries_and_checks():
    calls, log = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise Retryable
        return x

    assert with_retries(flaky, sleep=lambda s: None, log=log, concern="embed")(5) == 5
    assert [a["outcome"] for a in log] == ["retryable_failure", "retryable_failure", "success"]

    def always(x):
        raise Retryable

    with pytest.raises(Retryable):
        with_retries(always, sleep=lambda s: None, log=log)(1)
    assert log[-1]["outcome"] == "final_failure" and log[-1]["attempt_number"] == 4
    p = Providers()
    assert p.checked_embedding(["a b"]) == p.checked_embedding(["a b"])
    for bad in (Providers(facets=lambda q: []), Providers(facets=lambda q: ["a", "a"])):
        with pytest.raises(Invalid):
            bad.checked_facets("q")
    with pytest.raises(Invalid):
        Providers(answer=lambda q, e: [("x", ["unknown"])]).checked_answer("q", [("c", "t")])
    with pytest.raises(Invalid):
        Providers(dimensions=3).checked_embedding(["a"])


def test_stream_of_changes(spark, tmp_path):
    import json

    from tessera.streaming import cdc

    source = tmp_path / "in"
    source.mkdir()
    line = lambda k, minute, v: json.dumps({"record_id": k, "ts": f"2024-01-01T00:{minute:02d}:00", "value": v})
    (source / "1.json").write_text("\n".join([line("a", 1, "old"), line("a", 2, "new"), line("b", 1, "x"), line("b", 1, "x")]))
    from pyspark.sql.types import StringType, StructType, TimestampType

    schema = StructType().add("record_id", StringType()).add("ts", TimestampType()).add("value", StringType())
    seen = {}

    def apply(changes, number):
        seen.update({r["record_id"]: r["value"] for r in changes.collect()})

    stream = cdc.change_stream(spark, str(source), schema)
    cdc.run(stream, apply, str(tmp_path / "cp")).awaitTermination(60)
    assert seen == {"a": "new", "b": "x"}
    (source / "2.json").write_text("\n".join([line("b", 1, "x"), line("b", 5, "y")]))
    seen.clear()
    cdc.run(cdc.change_stream(spark, str(source), schema), apply, str(tmp_path / "cp")).awaitTermination(60)
    assert seen == {"b": "y"}
    counts = cdc.windowed_counts(spark.createDataFrame([("2024-01-01 00:01:00",), ("2024-01-01 00:02:00",)], "ts string").withColumn("ts", F.to_timestamp("ts")))
    assert [r["changes"] for r in counts.collect()] == [2]

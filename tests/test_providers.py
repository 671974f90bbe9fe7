"""Structured model calls in the engine, freshness, disclosures, and batteries, over one store."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F
from test_engine import SOURCES, entries, entry

from tessera.operators import index
from tessera.operators.claims import folded_all
from tessera.plans.engine import Engine, Manifest
from tessera.plans.evaluation import battery_report
from tessera.plans.ingest import ingest
from tessera.providers import ports
from tessera.providers.ports import Invalid, Retryable, in_order, model_providers, structured
from tessera.store.generation import Store


def scripted(broken=()):
    """A model that answers from the evidence; the first answer of each concern in ``broken`` is broken. Made here so that workers get it by value."""
    broken = dict(broken)

    def ask(concern, about, schema, problem):
        assert schema["additionalProperties"] is False
        if concern in broken and problem is None:
            return broken[concern]
        if "boom" in about.get("question", ""):
            raise Retryable("the model is busy")
        if concern == "facets":
            out = {"facets": [{"id": "a", "text": about["question"]}]}
        elif concern == "draft":
            best = next((e for e in about["evidence"] if "chose" in e["text"]), about["evidence"][0])
            out = {"sentences": [{"id": "s", "text": best["text"], "chunk_ids": [best["chunk_id"]]}]}
        elif concern == "decompose":
            out = {"sub_claims": [{"text": about["sentence"]}]}
        elif concern == "entail":
            out = {"supported": True, "reason": "r"}
        else:
            out = {"rows": [{"facet_id": f["id"], "covered": True, "reason": "r", "sentence_ids": [about["sentences"][0]["id"]]} for f in about["facets"]]}
        return json.dumps(out)

    return ask


def test_a_broken_answer_is_asked_for_once_more():
    seen = []

    def ask(concern, about, schema, problem):
        seen.append((concern, problem))
        return '{"facets": []}' if len(seen) == 1 else '{"facets": [{"id": "1", "text": "why"}]}'

    assert model_providers(ask, pauses=()).checked_facets("why?") == ["why"]
    assert [c for c, _ in seen] == ["facets", "facets"] and seen[0][1] is None and "1 to 8" in seen[1][1]
    evidence = [("c1", "text")]
    for wrong, said in [("no JSON", "not JSON"), ('{"sentences": [{"id": "1", "text": "x"}]}', "exactly"), ('{"sentences": [{"id": "1", "text": "x", "chunk_ids": ["c9"]}]}', "known chunks"), ('{"sentences": [{"id": "1", "text": "x", "chunk_ids": "c1"}]}', "list")]:
        problems = []

        def always(concern, about, schema, problem, wrong=wrong, problems=problems):
            problems.append(problem)
            return wrong

        with pytest.raises(Invalid):
            model_providers(always, pauses=()).checked_answer("q", evidence)
        assert problems[0] is None and said in problems[1] and len(problems) == 2
    p = model_providers(scripted(), pauses=())
    assert p.checked_answer("q", evidence) == [("text", ["c1"])] and p.checked_decomposition("a b") == ["a b"] and p.checked_entailment("a", ["b"]) is True
    assert p.checked_coverage("q", [("F1", "q")], [("S1", "text")])[0]["sentence_ids"] == ["S1"]
    log = []
    assert structured(lambda schema, problem: '{"supported": true, "reason": "x"}', "entail", log=log)["supported"] and log[0]["concern"] == "entail"


def test_calls_at_once_are_bounded_and_keep_their_order():
    lock, now, most = threading.Lock(), [0], [0]

    def call(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02 * (i % 3))
        with lock:
            now[0] -= 1
        return i

    assert list(in_order(call, ((i,) for i in range(20)), 3)) == list(range(20)) and 1 < most[0] <= 3
    assert list(in_order(call, ((i,) for i in range(3)), 1)) == [0, 1, 2]
    with pytest.raises(ZeroDivisionError):
        list(in_order(lambda x: 1 // x, [(1,), (0,)], 4))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("p") / "store"))
    base = [entry(1, "parquet files"), entry(2, "sqlite tables"), entry(3, "duckdb tables", supersedes="R2")]
    ingest(spark, store, entries(spark, *base), manifest_digest="m")
    return store


def manifest(spark, digest="m", other="e1-1"):
    rows = [(f"R{n}", other if n == 1 else f"e{n}-1", {"supersedes": [{"path": "docs/3.md", "section": "preamble"}]} if n == 3 else SOURCES) for n in (1, 2, 3)]
    return Manifest(spark.createDataFrame(rows, "record_id string, entry_digest string, field_sources map<string, array<struct<path string, section string>>>"), lambda: digest)


def test_a_model_answers_and_is_repaired(spark, store):
    broken = {c: "not JSON" for c in ("facets", "draft", "coverage")}
    engine = Engine(spark, store, model_providers(scripted(broken), pauses=()))
    asked = spark.createDataFrame([(1, "Which sqlite tables were chosen?"), (2, "boom sqlite"), (3, "  ")], "query_id int, question string")
    got = {r["query_id"]: r for r in engine.ask(asked, manifest=manifest(spark)).collect()}
    assert got[1]["state"] == "answered" and "chose" in got[1]["sentences"][0]
    assert got[2]["failure"]["code"] == "provider.draft" and "busy" in got[2]["failure"]["message"]
    assert got[3]["failure"]["code"] == "usage.empty_question"
    # what a successor's notice cites comes from the manifest
    told = [d for d in got[1]["disclosures"] if d["record_id"] == "R3"]
    assert told and told[0]["path"] == "docs/3.md" and told[0]["resolution"] == "named" and told[0]["citation_no"] > len(got[1]["citations"]) - 1
    assert got[1]["trace"]["freshness"]["state"] == "current"


def test_stale_stores_are_refused_unless_allowed(spark, store):
    engine = Engine(spark, store)
    asked = spark.createDataFrame([(1, "Which sqlite tables were chosen?")], "query_id int, question string")
    assert engine.freshness(None) == ("unknown", ["manifest_unavailable"])
    changed = manifest(spark, other="e1-2")
    assert engine.freshness(changed) == ("drift", ["record_changed"])
    assert [r["failure"]["code"] for r in engine.ask(asked, manifest=changed).collect()] == ["stale.refused"]
    digests = iter(["one", "two"])
    moving = Manifest(manifest(spark).entries, lambda: next(digests))
    (row,) = engine.ask(asked, manifest=moving).collect()
    assert row["failure"]["message"] == "the manifest changed during the query"


def test_a_battery_over_the_store(spark, store, tmp_path):
    shape = "query_id string, question string, expected_state string, required_records array<string>, value_paths array<string>, cause string"
    battery = spark.createDataFrame(
        [("good", "Which sqlite tables were chosen?", "answered", ["R2"], ["decision"], None), ("none", "zzz", "abstained", [], [], None), ("bad", "zzz qqq", "answered", ["R1"], [], None), ("odd", "zzz yyy", "abstained", ["R9"], ["nowhere"], None)], shape
    )
    traces = str(tmp_path / "traces")
    rates, lost = battery_report(spark, store, battery, 2, traces=traces, allow_stale=True)
    got = {r["query_id"]: (r["runs"], r["passed"], r["first_failure"]) for r in rates.collect()}
    assert got["good"] == (2, 2, None) and got["none"] == (2, 2, None) and got["bad"] == (2, 0, "state abstained, expected answered")
    assert {(r["query_id"], r["problem"]) for r in lost.collect()} == {("odd", "no record R9"), ("odd", "no path nowhere")}
    kept = spark.read.json(traces)
    assert {(r["query_id"], r["run"]) for r in kept.collect()} == {("bad", 1), ("bad", 2)} and json.loads(kept.first()["result"])["trace"]["settings"]
    # a store that recorded a manifest gives no answers without one, unless that is allowed
    assert {r["passed"] for r in battery_report(spark, store, battery.limit(1))[0].collect()} == {0}


def test_digest_does_not_depend_on_partitions(spark):
    import hashlib

    ids = [f"ch_{i * 7919 % 1000:04d}" for i in range(1000)]
    rows = spark.createDataFrame([(i,) for i in ids], "chunk_id string")
    want = (1000, hashlib.sha256(json.dumps(sorted(ids), separators=(",", ":")).encode()).hexdigest())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for parts, size in ((1, 10_000), (13, 10_000), (40, 7)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert tuple(index.active_set_digest(rows.repartition(parts)).first()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert tuple(index.active_set_digest(rows.limit(0)).first()) == (0, "")


def test_texts_that_hold_the_parting_mark(spark):
    rows = spark.createDataFrame([(["One﷐Two", "Three"],), ([None, "X"],), ([],)], "c array<string>")
    assert [r[0] for r in rows.select(folded_all(F.col("c"))).collect()] == [["onetwo", "three"], ["", "x"], []]
    assert ports.MAX_FACETS == 8

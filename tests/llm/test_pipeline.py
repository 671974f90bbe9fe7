from collections import Counter

import pytest
from test_exact_dedup import brute as exact_brute
from test_near_dedup import brute as near_brute

import corpus_pipeline as cp
from tessera.llm import mixing
from tessera.llm.common import stored, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    out = [table(spark, SF, "documents")]
    for _, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], SF)))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_the_schema(steps):
    for df in steps[:-1]:
        assert df.dtypes == steps[0].dtypes


def test_language_stage_keeps_every_document_with_letters(steps):
    assert ids(steps[1]) == sorted(r["doc_id"] for r in steps[0].collect() if any(c.isalpha() for c in r["text"] or ""))


def test_exact_stage_matches_brute_force(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[1].collect()]
    assert ids(steps[2]) == sorted({r[1] for r in exact_brute(rows)})


def test_near_stage_matches_brute_force(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[2].collect()]
    assert ids(steps[3]) == [r[0] for r in near_brute(rows, 5) if r[3]]


def test_mixing_stage_follows_the_rates_and_loses_no_clean_document(spark, steps):
    labels = {r["doc_id"]: r["domain"] for r in mixing.domains_of(table(spark, SF, "labels")).collect()}
    before, after = ids(steps[3]), Counter(ids(steps[4]))
    mixed = mixing.mix(steps[3], mixing.domains_of(table(spark, SF, "labels")), cp.WEIGHTS, floor=mixing.at_least_once(list(cp.WEIGHTS), ["good", "low"]))
    copies = {r["doc_id"]: r for r in mixed.collect()}
    assert after == Counter({d: copies[d]["copies"] for d in before if copies[d]["copies"]})
    clean = [d for d in before if max(range(3), key=lambda i: copies[d]["posterior"][i]) != sorted(cp.WEIGHTS).index("toxic")]
    assert all(after[d] >= 1 for d in clean)
    assert sum(after[d] for d in before if labels.get(d) == "toxic") < sum(labels.get(d) == "toxic" for d in before)


def test_packing_stage_holds_every_token(steps):
    docs = Counter(ids(steps[4]))
    pieces = steps[5].collect()
    assert set(docs) == {p["doc_id"] for p in pieces}
    per = Counter()
    for p in pieces:
        per[p["doc_id"]] += p["length"]
    assert all(per[p["doc_id"]] == docs[p["doc_id"]] * p["doc_tokens"] for p in pieces)


def test_run_equals_the_stages(spark, steps):
    assert cp.run(spark, SF).count() == steps[5].count()


def test_nulls_and_an_empty_table(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, "the of and there", None, None, None), (5, None, "en", None, 0), (6, "", "en", "s", 0), (6, "", "en", "s", 0), (7, "the of " * 20_000, "en", "s", 1)], docs.schema)
    for start in (docs.limit(40).unionByName(odd), docs.limit(0)):
        now = start
        for _, stage in cp.STAGES:
            now = stored(stage(spark, now, SF))
        assert now.count() >= (1 if start.count() else 0)

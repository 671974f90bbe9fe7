import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, queries
from tessera.llm.common import table

WEIGHTS = {"good": 0.6, "low": 0.3, "toxic": 0.1}


def brute(tokens, p, goal, floor=0.0, rounds=40, budget=None):
    """The same descent in numpy, on all documents at once."""
    x, total = np.ones(len(tokens)), tokens.sum()
    have = tokens @ p
    want = goal * (total if budget is None else budget)
    share = np.maximum(have / total, 1e-12)
    for _ in range(rounds):
        miss = ((tokens * x) @ p - want) / total
        if np.abs(miss).max() <= 1e-6:
            break
        x = np.maximum(floor, x - p @ (miss / share))
    return x


def test_rates_match_numpy_and_totals_match_targets(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), mixing.domains_of(table(spark, sf, "labels"))
    rows = mixing.mix(docs.select("doc_id", "text"), labels, WEIGHTS).collect()
    tokens, p = np.array([r["tokens"] for r in rows], float), np.array([r["posterior"] for r in rows])
    assert np.allclose(p.sum(axis=1), 1)
    goal = np.array([WEIGHTS[k] for k in sorted(WEIGHTS)])
    mass = mass_of(spark, tokens, p)
    steps, _ = mixing.fit_rates(mass, list(goal))
    # the first 40 moves are plain descent; the rates end where the totals match
    assert np.allclose(brute(tokens, p, goal), [r[0] for r in mass.select(mixing.rate_of(steps[:40])).collect()], atol=1e-6)
    rates = np.array([r["rate"] for r in rows])
    assert np.allclose(rates, [r[0] for r in mass.select(mixing.rate_of(steps)).collect()], atol=1e-6)
    got = (tokens * rates) @ p / tokens.sum()
    assert np.abs(got - goal).max() < 2e-6 and rates.min() >= 0
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)
    assert {r["tokens"] for r in rows if r["doc_id"] == 1} == {len(docs.where("doc_id = 1").first()["text"].split())}


def test_classifier_tells_domains_apart(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), mixing.domains_of(table(spark, sf, "labels"))
    priors, model = mixing.learn(docs, labels, sorted(WEIGHTS), labelled_rows=900)
    said = mixing.posteriors(docs.select("doc_id", "text"), sorted(WEIGHTS), priors, model).join(labels, "doc_id")
    means = {r["domain"]: r for r in said.groupBy("domain").agg(*[F.avg(F.col("posterior")[i]).alias(d) for i, d in enumerate(sorted(WEIGHTS))]).collect()}
    assert all(means[d][d] > max(means[e][d] for e in means if e != d) + 0.2 for d in means)


def test_floor_keeps_every_document(spark):
    rows = [(float(10 + i), [0.9, 0.1] if i % 3 else [0.2, 0.8]) for i in range(200)]
    mass = spark.createDataFrame(rows, "tokens double, posterior array<double>")
    steps, report = mixing.fit_rates(mass, [0.5, 0.5], floor=1.0, rounds=200)
    rates = np.array([r[0] for r in mass.select(mixing.rate_of(steps, 1.0)).collect()])
    assert rates.min() >= 1.0
    assert np.allclose(report["got"], report["want"], rtol=1e-3)
    assert np.allclose((np.array([r[0] for r in rows]) * rates) @ np.array([r[1] for r in rows]), report["got"])


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "good word " * 30_000, "x"), (None, "bad word", "x"), (4, "bad word", "x"), (4, "bad word", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rate string")
    labels = spark.createDataFrame([(3, "a"), (4, "b"), (9, "b"), (1, None), (None, "a"), (2, "other")], "doc_id bigint, domain string")
    got = mixing.mix(docs, labels, {"a": 1.0, "b": 1.0}).collect()
    assert len(got) == 6 and all(r["rate"] >= 0 for r in got)
    assert [r["tokens"] for r in got if r["doc_id"] in (1, 2)] == [0, 0]
    assert mixing.mix(docs.limit(0), labels, {"a": 1.0, "b": 1.0}).count() == 0
    even = mixing.mix(docs, labels.limit(0), {"a": 1.0, "b": 1.0}).collect()
    assert all(r["posterior"] == [0.5, 0.5] for r in even)
    with pytest.raises(ValueError):
        mixing.mix(docs, labels, {"a": 0.0})
    assert mixing.realise(mixing.mix(docs, labels, {"a": 1.0, "b": 1.0}), docs.columns).columns == docs.columns


def test_labels_to_domains(spark):
    rows = [(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, 0), (5, 1, None), (6, None, 1)]
    got = {r["doc_id"]: r["domain"] for r in mixing.domains_of(spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")).collect()}
    assert got == {1: "good", 2: "low", 3: "toxic", 6: "toxic"}


def soft(natural, sharp, n=3000):
    """(tokens, posterior) of documents whose domains overlap the more the smaller ``sharp`` is."""
    rng = np.random.default_rng(4)
    z = rng.normal(size=(n, len(natural)))
    z[np.arange(n), rng.choice(len(natural), n, p=natural)] += sharp
    p = np.exp(z)
    return rng.integers(20, 2000, n).astype(float), p / p.sum(axis=1, keepdims=True)


def mass_of(spark, tokens, p):
    return spark.createDataFrame([(t, r) for t, r in zip(tokens.tolist(), p.tolist(), strict=True)], "tokens double, posterior array<double>")


@pytest.mark.parametrize("sharp", [8, 2])
def test_production_floor_meets_far_targets(spark, sharp):
    tokens, p = soft([0.5, 0.45, 0.05], sharp)
    mass, goal = mass_of(spark, tokens, p), np.array([0.88, 0.07, 0.05])
    floor = mixing.at_least_once(list(WEIGHTS), ["good", "low"])
    steps, report = mixing.fit_rates(mass, list(goal), floor=floor)
    x = np.array([r[0] for r in mass.select(mixing.rate_of(steps, floor)).collect()])
    got = (tokens * x) @ p
    assert np.abs(got / got.sum() - goal).max() < 1e-5 and report["miss"] <= 1e-6
    assert np.allclose(got, report["got"])
    assert (x[p.argmax(axis=1) < 2] >= 1).all() and x.min() >= 0


def test_unreachable_targets_get_the_nearest_rates_and_a_miss(spark):
    tokens, p = soft([0.5, 0.45, 0.05], 1, 300)
    p = 0.5 * p + 0.5 / 3  # no document is more than two thirds good
    mass, goal, floor = mass_of(spark, tokens, p), np.array([0.88, 0.07, 0.05]), (p.argmax(axis=1) < 2) * 1.0
    steps, report = mixing.fit_rates(mass, list(goal), floor=mixing.at_least_once(list(WEIGHTS), ["good", "low"]))
    x = np.array([r[0] for r in mass.select(mixing.rate_of(steps, mixing.at_least_once(list(WEIGHTS), ["good", "low"]))).collect()])
    share = tokens @ p / tokens.sum()
    gap = (np.eye(3) - goal[:, None]) @ ((tokens * x) @ p) / tokens.sum()
    pull = p @ ((np.eye(3) - goal[:, None]).T @ (gap / share))  # each document's gradient
    assert report["miss"] > 0.01
    assert (pull > -1e-6).all() and np.abs(pull[x > floor + 1e-9]).max(initial=0) < 1e-6
    with pytest.raises(RuntimeError):
        mixing.fit_rates(mass, list(goal), floor=1.0, passes=2)


def test_overlapping_domains_meet_the_production_weights(spark):
    tokens, p = soft([0.3, 0.68, 0.02], 1)
    mass, goal = mass_of(spark, tokens, p), np.array([0.8, 0.15, 0.05])
    steps, report = mixing.fit_rates(mass, list(goal))
    x = np.array([r[0] for r in mass.select(mixing.rate_of(steps)).collect()])
    assert np.abs((tokens * x) @ p / tokens.sum() - goal).max() < 2e-6 and report["miss"] <= 1e-6 and x.min() >= 0


def test_rows_say_how_far_the_weights_are_missed(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_mix(spark, sf).collect()
    assert {r["miss"] for r in rows} == {rows[0]["miss"]} and rows[0]["miss"] <= 1e-6
    x = np.array([r["tokens"] * r["rate"] for r in rows])
    got = np.array([x @ np.array([r[f"p_{d}"] for r in rows]) for d in sorted(queries.WEIGHTS)]) / sum(r["tokens"] for r in rows)
    assert np.abs(got - [queries.WEIGHTS[d] for d in sorted(queries.WEIGHTS)]).max() < 2e-6
    few = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id bigint, domain string")
    assert all(r["miss"] > 0.05 for r in mixing.mix(few, labels, {"a": 1.0, "b": 1.0}).collect())

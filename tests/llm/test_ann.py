import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann
from tessera.llm.common import table


def brute(rows, k=5, every=50):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids, m = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, v in good:
        if i % every == 0:
            s = ann.cosine(np.broadcast_to(v, m.shape), m)
            at = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in at]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_against_brute_force(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    good = rows.where(ann.usable(F.col("embedding"))).select(F.col("embedding").cast("array<double>").alias("vector"), F.xxhash64("embedding").alias("print"))
    router = ann.fit_router(good, good.count(), k=5, sample_rows=6000, wanted=0.97)
    assert router.parts >= 8 and router.visits < router.parts
    got = answers(ann.search(rows, F.col("id") % 50 == 0))
    want = brute([(r["vec_id"], r["embedding"]) for r in rows.collect()])
    assert recall(got, want) >= 0.95
    assert set(got) == set(want)
    exact = {q: dict(brute_row) for q, brute_row in want.items()}
    assert all(abs(exact[q][i] - s) < 1e-15 for q, a in got.items() for i, s in a if i in exact[q])


def test_recall_over_many_clusters_and_partitions(spark):
    rng = np.random.default_rng(9)
    points = np.repeat(rng.normal(size=(60, 16)), 150, axis=0) + 0.5 * rng.normal(size=(9000, 16))
    rows = [(i, v) for i, v in enumerate(points.tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(8)
    got, want = answers(ann.search(df, F.col("id") % 50 == 0, sample_rows=1500)), brute(rows)
    assert ann.per_level(9000) == 4 and recall(got, want) >= 0.9
    assert {len(a) for a in got.values()} == {5}


def test_huge_and_tiny_components(spark):
    rows = [(i, [x * (1.0 + i % 7), x]) for i, x in enumerate([1e300, -1e300, 1e-300, 5e-200, 1.0, 3.0] * 10)]
    got = answers(ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") % 50 == 0))
    assert got == brute(rows) and all(-1.0000001 <= s <= 1.0000001 for a in got.values() for _, s in a)


def test_exact_on_one_partition_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(40)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(50, 120)]
    rows += [(200, None), (250, []), (300, [0.0] * 4), (350, [1.0, None, 1.0, 1.0]), (400, [float("nan")] * 4), (450, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (500, [1.0, 2.0])]
    rows += rows[:3]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, part int")
    got = answers(ann.search(df, F.col("id") % 50 == 0))
    assert got == brute(dict(r for r in rows if r[0] != 500 and r[0] is not None).items())
    assert [i for i, _ in got[100]] == [50, 51, 52, 53, 54]


def test_sparse_partitions_are_widened(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, (np.eye(3)[0 if i < 3 else 1] + 0.1 * rng.normal(size=3)).tolist()) for i in range(60)]
    # three parts: the first holds three rows, the last none; one is visited
    level, one = ann.Level(np.array([[1.0, 0, 0], [0, 1.0, 0], [0, 0, 0]]), np.array([0, 0, -9.0])), ann.Level(np.zeros((3, 1)), np.zeros(1))
    monkeypatch.setattr(ann, "fit_router", lambda *_, **__: ann.Router(level, (one,) * 3, 1))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = answers(ann.search(df, F.col("id") % 50 == 0))
    assert got == brute(rows) and {len(a) for a in got.values()} == {5}


def test_small_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema), F.col("id") % 50 == 0).count() == 0
    assert ann.search(spark.createDataFrame([(50, [1.0])], schema), F.col("id") % 50 == 0).count() == 0
    got = answers(ann.search(spark.createDataFrame([(50, [1.0, 0.0]), (1, [1.0, 1.0])], schema), F.col("id") % 50 == 0))
    assert [i for i, _ in got[50]] == [1]


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    points = ann.unit(np.repeat(centres, 100, axis=0) + 0.2 * rng.normal(size=(800, 16)))
    graph = ann.neighbour_graph(points, 10)
    label = ann.balanced_parts(points, graph, 8)
    assert np.bincount(label, minlength=8).max() <= 110
    assert (label[graph] == label[:, None]).mean() > 0.8


@pytest.mark.parametrize("parts", [1, 6])
def test_router_visits_enough(parts):
    rng = np.random.default_rng(2)
    points = ann.unit(rng.normal(size=(1500, 8)))
    upper = ann.fit_level(points[:1200], parts)
    router = ann.Router(upper, tuple(ann.fit_level(points[:1200], 2) for _ in range(parts)))
    assert len(upper.bias) == parts and router.parts == 2 * parts
    assert 1 <= ann.visits_for(router, points[:1200], points[1200:], k=5, wanted=0.97) <= router.parts
    assert ann.visits_for(router, points[:1200], points[:0], k=5, wanted=0.97) == router.parts

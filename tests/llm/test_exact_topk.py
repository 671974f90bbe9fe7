import math

import numpy as np
import pytest

from tessera.llm import exact_topk
from tessera.llm.vector_blocks import best

SCHEMA = "vec_id bigint, embedding array<double>"


def whole(rows):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    return sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in good})


def brute(rows, k=5, every=50):
    own, out = whole(rows), []
    for q, a in own:
        if q % every == 0:
            near = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in own if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


def answers(spark, rows, schema=SCHEMA, **options):
    return sorted(map(tuple, exact_topk.search(spark.createDataFrame(rows, schema), lambda i: i % 50 == 0, **options).collect()))


def random_rows(n, width, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, v) for i, v in enumerate((scale * rng.normal(size=(n, width))).tolist())]


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e6])
def test_like_brute_force(spark, scale):
    rows = random_rows(700, 12, scale=scale)
    assert answers(spark, rows) == brute(rows)


def test_sparse_rows_and_many_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=40) * (rng.random(40) < 0.1)).tolist()) for i in range(900)]
    assert answers(spark, rows, block_rows=50) == brute(rows)


def test_one_very_common_vector(spark):
    rows = random_rows(300, 8) + [(1000 + i, [0.5] * 8) for i in range(400)]
    assert answers(spark, rows, block_rows=64) == brute(rows)


def test_rows_that_take_no_part_and_ragged_ones(spark):
    rows = [*random_rows(120, 4), (None, [1.0] * 4), (150, None), (200, [1.0, None]), (250, [float("nan"), 1.0]), (300, [float("inf")]), (350, [1e308]), (400, []), (401, [2.0]), (402, [0.0] * 9), (450, [-0.1, 3.0])]
    assert answers(spark, rows) == brute(rows)


def test_repeated_rows_count_once_and_an_id_with_two_vectors_is_two_rows(spark):
    rows = random_rows(60, 3)
    assert answers(spark, rows + rows[:9]) == brute(rows)
    rows += [(50, [9.0, 9.0, 9.0])]
    assert answers(spark, rows) == brute(rows)


def test_few_rows_empty_tables_and_clashing_columns(spark):
    rows = random_rows(3, 3)
    assert answers(spark, rows) == brute(rows) and len(brute(rows)) == 2
    assert answers(spark, rows[:1]) == answers(spark, []) == []
    more = [(*r, 1, 2, 3, "x") for r in rows]
    assert answers(spark, more, SCHEMA + ", block int, copy bigint, score long, asked string") == brute(rows)


def test_scores_beyond_64_bits_end_there(spark):
    rows = [(0, [1e200]), (1, [1e200]), (2, [-1e200]), (3, [0.0])]
    assert [(v, s) for _, _, v, s in sorted(answers(spark, rows), key=lambda r: r[1])] == [(1, 2**63 - 1), (3, 0), (2, 1 - 2**63)]


def test_best_of_rows_with_ties():
    scores = np.array([[3, 5, 5, 1], [2, 2, 2, 2]], np.int64)
    r, c = best(scores, np.array([4, 9, 2, 1]), 2)
    assert list(zip(r.tolist(), c.tolist(), strict=True)) == [(0, 2), (0, 1), (1, 3), (1, 2)]

import math

import numpy as np
import pytest

from tessera.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, positives=5, negatives=3):
    good = [r for r in rows if None not in r and all(x is not None and math.isfinite(256 * x) for x in r[1])]
    own = sorted({(i, tuple(math.floor(256 * x) for x in v), label) for i, v, label in good})
    out = []
    for q, a, label in own:
        if q % 50:
            continue
        near = sorted((-sum(x * y for x, y in zip(a, b)), i, other) for i, b, other in own if i != q)
        for s, p, _ in [n for n in near if n[2] == label][:positives]:
            fit = [n for n in near if n[2] != label and 50 * -s <= 100 * -n[0] <= 95 * -s][:negatives]
            out += [(q, p, r, n, -s, -t) for r, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA, **options):
    return sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, schema), lambda i: i % 50 == 0, **options).collect()))


def random_rows(n, width, labels=4, seed=2, spread=1.0):
    rng = np.random.default_rng(seed)
    norms = np.exp(spread * rng.normal(size=(n, 1)))
    return [(i, v, int(x)) for i, (v, x) in enumerate(zip((norms * rng.normal(size=(n, width))).tolist(), rng.integers(0, labels, n), strict=True))]


@pytest.mark.parametrize(("spread", "block_rows"), [(1.0, 100), (0.0, 16_384), (0.2, 40)])
def test_like_brute_force(spark, spread, block_rows):
    rows = random_rows(900, 6, spread=spread)
    assert mined(spark, rows, block_rows=block_rows) == brute(rows)


def test_large_scores(spark):
    rows = [(i, [1e6 * x for x in v], c) for i, v, c in random_rows(400, 5)]
    assert mined(spark, rows) == brute(rows)


def test_a_common_vector_ties_and_equal_norms(spark):
    rows = random_rows(200, 5, seed=5) + [(1000 + i, [1.0, 2.0, 0.0, 0.0, 1.0], i % 3) for i in range(500)]
    rows += [(2000 + i, np.roll([1.5, 0.0, 0.0, 0.5, 0.0], i).tolist(), i % 2) for i in range(100)]
    assert mined(spark, rows, block_rows=128) == brute(rows)


def test_rows_that_take_no_part(spark):
    rows = [*random_rows(150, 4), (None, [1.0] * 4, 1), (200, None, 1), (250, [1.0], None), (300, [None, 1.0], 1), (350, [float("nan")], 1), (400, [float("-inf")], 1), (450, [], 1), (500, [2.0], 1), (550, [0.0] * 7, 2)]
    assert mined(spark, rows) == brute(rows)


def test_repeated_rows_few_rows_and_empty_tables(spark):
    rows = random_rows(120, 3)
    assert mined(spark, rows + rows[:30]) == brute(rows)
    assert mined(spark, rows[:2]) == brute(rows[:2])
    assert mined(spark, []) == mined(spark, [(50, None, None)]) == []
    one = [(i, v, 1) for i, v, _ in rows]  # one label alone: no negatives
    assert mined(spark, one) == []
    assert mined(spark, [(*r, 1, 2, "x") for r in rows], SCHEMA + ", copy int, bucket int, low string") == brute(rows)


def test_slices_that_cannot_reach_a_window_are_passed_over():
    ids = np.arange(3 * hard_negatives.SLICE)
    tops = np.linspace(100.0, 1.0, ids.size)
    held = np.stack([tops, np.zeros(ids.size)], axis=1)
    seen = []

    def allowed(live, here):
        seen.append(here.start)
        return np.ones((live.size, held[here].shape[0]), bool)

    found = hard_negatives.walk(np.array([[2.0, 0.0]]), np.array([2.0]), held, tops, ids, allowed, np.array([[-np.inf]]), np.array([[np.inf]]), 3)
    assert seen == [0] and found[0][2].tolist() == [0, 1, 2]
    seen.clear()
    hard_negatives.walk(np.array([[2.0, 0.0]]), np.array([2.0]), held, tops, ids, allowed, np.array([[150.0]]), np.array([[160.0]]), 3)
    assert seen == [0, hard_negatives.SLICE] or seen == [0]

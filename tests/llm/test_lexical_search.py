import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lexical_search

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for place, (doc, c) in enumerate(counts):
            own = sum(c.values())
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * (75 + 25 * own * n // total))) for w, q in Counter(terms(text)).items() if c[w])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, place))
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc, _) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    return sorted(map(tuple, lexical_search.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), **options).collect()), key=str)


def corpus(n=300, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["Été", "é", "日本", "x-y", "don't", "A1b"]
    return [(i, " ".join(words[int(len(words) * rng.random() ** 2)] for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_like_brute_force(spark):
    docs = corpus()
    items = [(i, t) for i, t in corpus(25, 9)] + [(100, "W1 w1 w2 zzz"), (101, "nothing known"), (102, ""), (103, None)]
    assert found(spark, docs, items) == brute(docs, items)


def test_blocks_of_questions_and_small_groups_of_documents(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ENTRIES", 50)
    docs, items = corpus(120), corpus(12, 7)
    assert found(spark, docs, items, block_terms=60, k=3) == brute(docs, items, 3)


def test_copies_ties_nulls_and_repeated_ids(spark):
    docs = corpus(60) + [(500 + i, "w1 common passage w2") for i in range(90)] + [(None, "w1 common passage w2"), (None, None), (7, "w1 w1"), (7, "w1 w1"), (-3, "w1 common passage w2"), (901, None), (902, " ... ")]
    items = [(1, "common passage"), (1, "common passage"), (2, "w1"), (1, "w2")]
    assert found(spark, docs, items) == brute(docs, items)


def test_a_very_long_text(spark):
    docs = [*corpus(20), (99, "w1 " * 300_000 + "rare")]
    assert found(spark, docs, [(0, "rare w1"), (1, "w3 " * 5000)]) == brute(docs, [(0, "rare w1"), (1, "w3 " * 5000)])


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == found(spark, [(1, None)], [(1, "a")]) == []
    docs, items = corpus(30), corpus(4, 2)
    more = lexical_search.search(spark.createDataFrame([(*d, 1, 2) for d in docs], DOCS + ", n int, score int"), spark.createDataFrame([(*i, 1) for i in items], ITEMS + ", question int"))
    assert sorted(map(tuple, more.collect()), key=str) == brute(docs, items)


@pytest.mark.parametrize("high", [2**10, 2**40, 2**63])
def test_sums_of_packed_keys(high):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, high, 5000, dtype=np.uint64) // np.uint64(max(1, high >> 9)) * np.uint64(max(1, high >> 9))
    values = rng.integers(-9, 9, 5000)
    own, sums = lexical_search.added_up(keys, values)
    want = Counter()
    for k, v in zip(keys.tolist(), values.tolist(), strict=True):
        want[k] += v
    assert own.tolist() == sorted(want) and sums.tolist() == [want[k] for k in sorted(want)]

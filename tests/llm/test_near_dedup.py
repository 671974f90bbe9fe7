import random
import re
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import components, hyperminhash, near_dedup
from tessera.llm.common import shingle_hashes, table, word_hashes


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, percent=80):
    sets = {d: shingles(t, width) for d, t in rows}
    head = {d: d for d, _ in rows}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in combinations(sets, 2):
        s, t = sets[a], sets[b]
        if s and t and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
            common = len(s & t)
            if 100 * common >= percent * (len(s) + len(t) - common):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in sets)


@pytest.mark.parametrize("width", [2, 5])
def test_documents_match_brute_force(spark, width):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = sorted(tuple(r) for r in near_dedup.near_groups(docs, width=width).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], width)


def test_chain_of_near_copies_and_template_with_many_variants(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(5000)]
    rows, base = [], rng.choices(vocab, k=80)
    for i in range(60):  # each is like its neighbour, the ends are unlike
        base = list(base)
        for _ in range(3):
            base[rng.randrange(80)] = rng.choice(vocab)
        rows.append((i, " ".join(base)))
    template = rng.choices(vocab, k=60)
    for i in range(100, 160):  # share most of a template, below or about the threshold
        rows.append((i, " ".join(template + rng.choices(vocab, k=rng.randrange(4, 14)))))
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2).collect())
    assert got == brute(rows, 2)


def test_edge_cases(spark):
    long = "lorem ipsum dolor " * 30_000
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, "a b"), (7, "A\x0bB"), (8, long), (9, long + "x"), (10, "ÄB c"), (11, "äb c")]
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id bigint, text string, n int, sig string")
    assert sorted(tuple(r) for r in near_dedup.near_groups(df, width=2).collect()) == brute(rows, 2)
    assert near_dedup.near_groups(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id bigint, text string")
    assert sorted(str(tuple(r)) for r in near_dedup.near_groups(odd).collect()) == sorted(["(None, 1, None, True)", "(1, 1, 1, True)", "(1, 1, 1, True)", "(2, 1, 1, False)"])
    assert sorted(str(r["doc_id"]) for r in near_dedup.drop_near(odd).collect()) == ["1", "1", "None"]


def test_rows_that_share_an_id_are_grouped_each_by_its_text(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, other = say(60), say(60)
    near = a + " more"
    rows = [(3, a), (5, near), (5, other), (7, other + " end"), (8, say(30)), (9, a + " x"), (9, a + " y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(df).collect())
    assert got == sorted([(3, 56, 3, True), (5, 57, 3, False), (5, 56, 5, True), (7, 57, 5, False), (8, 26, 8, True), (9, 57, 3, False), (9, 57, 3, False)])
    assert sorted(r["text"] for r in near_dedup.drop_near(df).collect()) == sorted([a, other, rows[4][1]])


def test_word_and_shingle_hashes_tell_words_apart():
    text = "The the  cat\tsat\non\x0bthe MAT é É x" + " y" * 5000
    h = word_hashes(text)
    w = words(text)
    assert len(h) == len(w) and len(set(h.tolist())) == len(set(w))
    assert all((h[i] == h[j]) == (w[i] == w[j]) for i in range(12) for j in range(12))
    assert len(shingle_hashes(h, 2)) == len(shingles(text, 2))


def test_estimate_is_close_and_registers_do_not_depend_on_batching():
    rng = np.random.default_rng(1)
    k = 400
    for common in (0, 300, 900):
        a = rng.integers(0, 2**63, 1000).astype(np.uint64)
        b = np.concatenate([a[:common], rng.integers(0, 2**63, 1000 - common).astype(np.uint64)])
        regs = hyperminhash.registers(np.concatenate([a, b]), np.array([0, 1000]), k)
        assert (hyperminhash.registers(b, np.array([0]), k)[0] == regs[1]).all()
        sim = hyperminhash.estimate(np.array([(regs[0] == regs[1]).sum()]), k, np.array([1000]), np.array([1000]))[0]
        assert abs(sim - common / (2000 - common)) < 0.09
    big = rng.integers(0, 2**63, 30_000).astype(np.uint64)
    regs = hyperminhash.registers(np.concatenate([big, big[:5]]), np.array([0, 30_000]), 8)
    assert (regs[1] == hyperminhash.registers(big[:5], np.array([0]), 8)[0]).all()


def test_components_match_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 5001 + i) for i in range(300)]
    head = {}

    def find(x):
        head.setdefault(x, x)
        while head[x] != x:
            x = head[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        head[y] = x
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in head if any(n in p and p[0] != p[1] for p in links)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0

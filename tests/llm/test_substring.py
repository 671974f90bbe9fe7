import random
import re
import time
from itertools import combinations

import numpy as np
import pytest
from test_near_dedup import shingles, words

from tessera.llm import substring
from tessera.llm.common import in_parts, located_together, table


def brute_lines(rows, min_words, percent=80):
    """(doc, kind, start, length, words, cluster_doc, cluster_start, removed) of every repeated line."""
    paras = []
    for doc, text in rows:
        at = 0
        for line in (text or "").split("\n"):
            if len(words(line)) >= max(min_words, 5):
                paras.append((doc, at, len(line), len(words(line)), shingles(line, 5)))
            at += len(line) + 1
    head = list(range(len(paras)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, j in combinations(range(len(paras)), 2):
        a, b = paras[i][4], paras[j][4]
        if 100 * len(a & b) >= percent * len(a | b):
            head[find(j)] = find(i)
    groups = {}
    for i, p in enumerate(paras):
        groups.setdefault(find(i), []).append(p)
    out = []
    for g in groups.values():
        first = min(g)[:2]
        if len({p[0] for p in g}) > 1:
            out += [(p[0], "line", p[1], p[2], p[3], *first, p[:2] != first) for p in g]
    return out


def brute_runs(rows, n):
    """The same of every maximal span of shared runs of n words."""
    seen = {}
    at = {d: [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for d, t in rows}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), []).append((d, i))
    spans = {}
    for places in seen.values():
        if len({d for d, _ in places}) > 1:
            first = min(places)
            for d, i in places:
                spans.setdefault((d, first[0], first[1] - i), set()).add(i)
    out = []
    for (d, head, ahead), found in spans.items():
        for i in found:
            if i - 1 not in found:
                j = i
                while j + 1 in found:
                    j += 1
                start, stop = at[d][i][0], at[d][j + n - 1][1]
                out.append((d, "run", start, stop - start, j - i + n, head, at[head][i + ahead][0], (d, 0) != (head, ahead)))
    return out


def brute(rows, min_words=50, line_words=15):
    return sorted(brute_lines(rows, line_words) + brute_runs(rows, min_words))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("min_words", [50, 15])
def test_documents_match_brute_force(spark, sf_dir, min_words):
    docs = table(spark, sf_dir, "documents")
    got = rows_of(substring.repeats(docs, min_words=min_words))
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], min_words)
    assert {r[1] for r in got} == {"line", "run"}


def test_planted_passages_and_edge_cases(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("aä") + str(rng.randrange(10**6)) for _ in range(n))
    passage, own = say(60), say(60)
    words = passage.split()
    words[30] = "changed"
    rows = [
        (1, f"{say(30)}\n{passage}\n{say(40)}"),
        (2, f"{passage.replace(chr(97), chr(65))}\n"),
        (3, f"x\n\n{' '.join(words)}"),  # edited
        (4, f"{own}\n{own}"),  # repeats in one document only
        (5, None),
        (6, ""),
        (7, say(14)),
        (8, say(14)),
        (9, say(40_000)),
        (10, f"🙂\n{passage}"),
        (None, passage),
    ]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, start int, sig string")
    for min_words in (50, 15):  # runs; lines count from 15 words on
        got = rows_of(substring.repeats(df, min_words=min_words))
        assert got == brute([r for r in rows if r[0] is not None], min_words)
        assert {r[0] for r in got} == {1, 2, 3, 10}
        cleaned = {r["doc_id"]: r["text"] for r in substring.remove_repeats(df, min_words=min_words).collect()}
        assert cleaned[1] == rows[0][1] and cleaned[10] == "🙂\n" and cleaned[2] == "" and cleaned[4] == rows[3][1] and cleaned[None] == passage and cleaned[5] is None
        assert cleaned[3] == "x\n\n"
    assert substring.repeats(df.limit(0)).count() == 0


def test_overlapping_spans_are_cut_once():
    assert substring.without("ab\ncd\nef", [(3, 5)]) == "ab\nef"
    assert substring.without("ab\ncd\nef", [(0, 2), (1, 4)]) == "d\nef"
    assert substring.without("ab cd ef", [(0, 5), (1, 3), (6, 8)]) == " "
    assert substring.without("ab", [(0, 2)]) == ""


def test_bands_reach_the_recall_asked_for():
    for percent in (70, 80, 90):
        bands, rows = substring.tune(percent)
        assert 1 - (1 - (percent / 100) ** rows) ** bands >= 0.9998


def test_passages_within_across_and_in_short_lines(spark):
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice("aäß🙂") + str(rng.randrange(10**6)) for _ in range(n))
    passage, edge, short = say(51), say(50), say(49)
    wrapped = "\n".join(" ".join(passage.split()[i : i + 8]) for i in range(0, 51, 8))
    rows = [
        (1, f"{say(30)} {passage} {say(90)}"),  # inside a longer line
        (2, f"{say(5)}\n{say(70)} {passage.replace('a', 'A')} {say(3)}\n{say(4)}"),
        (3, f"{say(9)} " + "\n".join([" ".join(passage.split()[:20]), " ".join(passage.split()[20:])]) + f" {say(9)}"),  # across a line end
        (4, f"{say(20)}\n{wrapped}\n{say(20)}"),  # in lines of under 15 words
        (5, f"{short} {say(40)}"),
        (6, f"{say(40)} {short}"),
        (7, edge),
        (8, f"{say(1)} {edge} {edge}"),
        (9, None),
        (10, ""),
        (11, "ab " * 200),
        (12, "ab " * 120),
        (13, f"{passage} {edge}"),
        (14, ("x y z " + say(20) + " ") * 6),  # repeats within itself, and in another document
        (15, "and"),
    ]
    rows[14] = (15, f"{say(7)} {rows[13][1]}")
    df = spark.createDataFrame([*rows, (None, passage), rows[1]], "doc_id bigint, text string")
    got = rows_of(substring.repeats(df).distinct())
    assert got == brute(rows)
    assert {r[0] for r in got} == {1, 2, 3, 4, 7, 8, 11, 12, 13, 14, 15}


def test_a_passage_that_a_third_of_all_documents_hold(spark):
    rng = random.Random(4)
    say = lambda n: " ".join("w" + str(rng.randrange(10**6)) for _ in range(n))
    passage = say(70)
    rows = [(i, f"{say(20)} {passage} {say(20)}" if i % 3 == 0 else say(90)) for i in range(300)]
    got = rows_of(substring.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == brute(rows) and len(got) == 100


def test_texts_taken_together_give_what_each_gives_alone():
    rng = random.Random(5)
    texts = ["", "a", "\n", None, " ä\n"] + ["".join(rng.choice(["ä", "🙂b", "c ", " d", "e\n", "\tX "]) for _ in range(rng.choice([3, 60, 900]))) for _ in range(40)]
    located, begin = located_together(texts)
    text, *found, members = substring.split_lines(located, begin, 6)
    blocks = substring._blocks(located, begin, 12)
    assert len(text) and blocks[0].size
    upto = 0
    for i, t in enumerate(texts):
        own, at = located_together([t])
        _, *lines, sets = substring.split_lines(own, at, 6)
        assert [x[text == i].tolist() for x in found] == [x.tolist() for x in lines]
        assert members[upto : upto + sets.size].tolist() == sets.tolist()
        upto += sets.size
        # at which of two equally small runs a block is anchored does not depend on the other texts
        assert [x[blocks[0] == i].tolist() for x in blocks[1:]] == [x.tolist() for x in substring._blocks(own, at, 12)[1:]]


def test_many_short_lines_take_few_array_operations():
    lines = [" ".join(f"w{i * j % 9973}" for j in range(20)) for i in range(20_000)]
    began = time.process_time()
    for low, high in in_parts(np.array([len(x) for x in lines])):
        (words, starts, *_), begin = located_together(lines[low:high])
        at = np.append(np.searchsorted(starts, begin), starts.size)
        assert substring.distinct_runs(words, at[:-1], at[1:])[1].size == high - low
    assert time.process_time() - began < 2  # line by line: 5 s

import hashlib
import re
from collections import defaultdict

from tessera.llm import exact_dedup
from tessera.llm.common import heavy_keys, table

SCHEMA = "doc_id bigint, text string, digest string, id string"


def brute(rows):
    """(doc_id, keep, size, kept) of each row, in input order."""
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, i))
    out = [None] * len(rows)
    for key, members in groups.items():
        best = min(members)
        for m in members:
            out[m[3]] = (rows[m[3]][0], rows[best[3]][0], len(members), m == best, hashlib.sha256(key.encode()).hexdigest())
    return out


def test_matches_brute_force_with_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (None, " "), (6, "x y"), (7, "xy"), (7, "xy"), (8, "\x0ba\x0cb\r\n"), (9, "é" * 50_000)] + [(100 + i, "hot") for i in range(60)]
    df = spark.createDataFrame([(d, t, "z", "z") for d, t in rows], SCHEMA)
    got = sorted(map(str, (tuple(r) for r in exact_dedup.resolve_copies(df, k=4).collect())))
    assert got == sorted(map(str, brute(rows)))


def test_empty_table(spark):
    assert exact_dedup.resolve_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_heavy_digests_hold_every_frequent_one(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(900)]
    slim = exact_dedup.digest_rows(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert hashlib.sha256(b"hot").hexdigest() in heavy_keys(slim.select("digest"), k=8)
    assert len(heavy_keys(slim.select("digest"), k=8)) <= 8


def test_drop_copies_keeps_one_row_of_each_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = exact_dedup.drop_copies(docs)
    want = {r[1] for r in brute([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_drop_copies_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a", "p"), (1, "a", "p"), (1, "a ", "q"), (None, "b", "r"), (None, "b", "r"), (2, None, "s")]
    kept = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([(1, "a ", "q"), (None, "b", "r"), (2, None, "s")], "doc_id bigint, text string, lang string").collect()))


def test_very_many_equal_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COPIES", 7)
    rows = [(1, "a b")] * 50 + [(2, "ab")] * 7 + [(3, "x")] * 8 + [(4, "y")]
    df = spark.createDataFrame([(d, t, "z", "z") for d, t in rows], SCHEMA)
    assert sorted(map(str, (tuple(r) for r in exact_dedup.resolve_copies(df).collect()))) == sorted(map(str, brute(rows)))


def test_equal_lengths_are_settled_by_the_rows_alone(spark):
    rows = [(1, "a b", "p"), (1, "ab ", "q"), (1, " ab", "r")]
    kept = {tuple(exact_dedup.drop_copies(spark.createDataFrame(order, "doc_id bigint, text string, lang string")).first()) for order in (rows, rows[::-1], rows[1:] + rows[:1])}
    assert len(kept) == 1

"""Operators against plain Python and fixed vectors."""

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import claims as fc
from tessera.functions import text as ft
from tessera.functions.paths import evidence_block, is_value_path, label_of, path_selected
from tessera.operators import chunking, claims, evaluate, index, retrieval, validate


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def on(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_tokenizer_vectors(spark):
    texts = ["Server-side", "don't retry", "DM-0019", "O’Reilly", "_why_not_", "no not nor", "Café", None, "", "'a' b' 'c", "the of"]
    got = on(spark, texts, lambda t: ft.lexical_tokens(t))
    assert got == [["server", "side"], ["retry"], ["dm", "0019"], ["o’reilly"], ["not"], ["no", "not", "nor"], ["café"], None, [], ["b", "c"], []]


def test_sentences_and_paragraphs(spark):
    text = 'One. Two! "Three?" (Four.) five'
    assert on(spark, [text, "", None], ft.sentences) == [["One.", "Two!", '"Three?"', "(Four.)", "five"], [], None]
    assert on(spark, ["First. Second."], lambda t: ft.sentences(t, compat=True)) == [["First", ". Second", "."]]
    assert on(spark, ["a\r\nb\r\n \t\r\n\r\nc\n\n"], ft.paragraphs) == [["a\nb", "c"]]
    assert on(spark, ["One.", "One. Two.", "none"], ft.is_one_sentence) == [True, False, False]
    mark = "ch_" + "a" * 64
    assert on(spark, [f"Said [{mark}, {mark}]. And {mark} again ."], ft.without_markers) == ["Said. And again."]
    texts = [f"A (see [{mark}] ) b", f"A [{mark.upper()},{mark}]!", f"a {{ x {mark}\n }}", "[see " + mark + "]", None, ""]
    assert on(spark, texts, ft.without_markers) == ["A (see) b", "A!", "a {x}", "[see]", None, ""]


def test_texts_in_other_forms_than_nfc(spark):
    decomposed = ["Cafe\u0301 cre\u0300me", "\u212bngstro\u0308m", "\u1112\u1161\u11ab", "\u2126 \uf900"]
    assert on(spark, decomposed, ft.lexical_tokens) == [["café", "crème"], ["ångström"], ["한"], ["ω", "豈"]]
    import sys
    import unicodedata

    lost = [c for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.normalize("NFC", c) != c or unicodedata.combining(c)]
    assert on(spark, ["".join(lost)], lambda t: ft.nfc(t)) == [unicodedata.normalize("NFC", "".join(lost))]
    singles = [c for c in lost if not unicodedata.combining(c)]
    assert on(spark, singles, lambda t: ft.nfc(t)) == [unicodedata.normalize("NFC", c) for c in singles]


def test_claims_are_folded_like_their_parent(spark):
    rows = [
        ("a", "Die Straße bleibt gesperrt.", ["Die Straße bleibt gesperrt."]),
        ("b", "Die STRASSE bleibt gesperrt.", ["Die Straße bleibt gesperrt."]),
        ("c", "The ﬁle is ＯＰＥＮ.", ["The file is open."]),
        ("d", "The file is open.", ["The ﬁle\u2003is open.", "the FILE is open."]),
        ("e", "The file is open.", ["The file is red."]),
        ("f", "The file is open.", []),
    ]
    got = claims.decomposition_verdicts(spark.createDataFrame(rows, "sentence_id string, parent string, sub_claims array<string>")).orderBy("sentence_id").collect()
    assert [(r["disposition"], r["failure_token"]) for r in got] == [("valid", ""), ("valid", ""), ("valid", ""), ("duplicate", ""), ("not_additive", "red"), ("incomplete", "file")]


def test_chunks_that_hold_claims(spark):
    chunks = spark.createDataFrame([(1, "one two three four five six seven"), (2, "xone two three four five sixy"), (3, "two three four"), (4, "")], "c int, chunk string")
    said = spark.createDataFrame([("a", "one two three four five six"), ("b", "ne two three four five si"), ("c", "three four"), ("d", "e"), ("e", ""), ("f", "two three four five six nine")], "k string, claim string")
    want = sorted((k, c) for k, t in [tuple(r) for r in said.collect()] for c, x in [tuple(r) for r in chunks.collect()] if t and t in x)
    assert sorted(tuple(r) for r in claims.holders(said, chunks, "k", "c").collect()) == want


def test_digest_of_the_active_set(spark):
    import hashlib
    import json

    ids = [f"ch_{i}ü" for i in range(500)]
    row = index.active_set_digest(spark.createDataFrame([(i,) for i in reversed(ids)], "chunk_id string").repartition(7)).first()
    assert tuple(row) == (500, hashlib.sha256(json.dumps(sorted(ids), ensure_ascii=False, separators=(",", ":")).encode()).hexdigest())
    assert tuple(index.active_set_digest(spark.createDataFrame([], "chunk_id string")).first()) == (0, "")


def test_value_paths(spark):
    assert on(spark, ["a.b[0].c", "a[x]", "1a", "body[12]"], is_value_path) == [True, False, False, True]
    assert on(spark, ["body[0]", "body[00]", "body", "body[1].x", "bodyx[1]"], lambda p: path_selected(p, "body[*]")) == [True, False, False, False, False]
    assert on(spark, ["why[3]", "title"], label_of) == ["a reason this record gives for its decision", ""]
    assert on(spark, ["title"], lambda p: evidence_block(F.lit(1), F.lit("c"), p, F.lit("text"))) == ["CHUNK 1 (c)\ntext"]


def base(token):
    out = {token}
    for suffix in ("s", "es", "ed", "ing"):
        if token.endswith(suffix):
            cut = token[: -len(suffix)]
            found = {cut}
            if suffix in ("ed", "ing"):
                found.add(cut + "e")
                if len(cut) > 1 and cut[-1] == cut[-2]:
                    found.add(cut[:-1])
            if suffix in ("es", "ed") and cut.endswith("i"):
                found.add(cut[:-1] + "y")
            out |= {b for b in found if len(b) >= 3}
    return out


def match(a, b):
    return a == b or (a not in fc.FUNCTION_WORDS and b not in fc.FUNCTION_WORDS and bool(base(a) & base(b)))


def test_base_sets(spark):
    words = "record records box boxes accept accepted accepting use used using ship shipped shipping rely relies relied falls falling is ed s bring".split()
    assert [set(x) for x in on(spark, words, fc.base_set)] == [base(w) for w in words]
    for a, b in (("record", "records"), ("box", "boxes"), ("use", "using"), ("ship", "shipped"), ("rely", "relied"), ("falls", "falling")):
        assert match(a, b)


def test_validity_tests_match_plain_python(spark):
    rng = random.Random(4)
    vocab = "the of and not is cache caches cached store stored storing run running quick a while however data datum".split()
    cases = [([rng.choice(vocab) for _ in range(rng.randrange(0, 7))], [rng.choice(vocab) for _ in range(rng.randrange(0, 9))]) for _ in range(300)]

    def additive(claim, parent):
        used, added = set(), 0
        for t in claim:
            seat = next((i for i, p in enumerate(parent) if i not in used and match(t, p)), None)
            if seat is not None:
                used.add(seat)
            elif t not in fc.FUNCTION_WORDS:
                return ("content_token", t)
            else:
                added += 1
                if added > fc.MAX_ADDED:
                    return ("function_word_overrun", t)
        return None

    exempt = set(fc.FUNCTION_WORDS + fc.CLAUSE_CONNECTIVES)
    df = spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate(cases)], "i int, c array<string>, p array<string>")
    df = df.withColumn("c", fc.prepared(F.col("c"))).withColumn("p", fc.prepared(F.col("p")))
    rows = df.select("i", fc.additive_failure(F.col("c"), F.col("p")).alias("a"), fc.first_uncovered(F.col("p"), F.col("c")).alias("m")).collect()
    for r in rows:
        claim, parent = cases[r["i"]]
        assert (tuple(r["a"]) if r["a"] else None) == additive(claim, parent)
        assert r["m"] == next((p for p in parent if p not in exempt and not any(match(p, t) for t in claim)), None)


def test_decomposition_verdicts(spark):
    parent = "The cache stores results and the server reads them."
    rows = [
        ("valid", parent, ["The cache stores results.", "The server reads them."]),
        ("cap", parent, [f"x{i}" for i in range(9)]),
        ("twice", parent, ["The cache stores results.", "the  cache stores results."]),
        ("adds", parent, ["The cache stores secrets.", "The server reads them."]),
        ("lacks", parent, ["The cache stores results."]),
        ("words", parent, ["There is not a cache stores results", "The server reads them"]),
    ]
    got = {r["sentence_id"]: (r["disposition"], r["additive_failure"], r["failure_token"], r["failure_side"]) for r in claims.decomposition_verdicts(spark.createDataFrame(rows, "sentence_id string, parent string, sub_claims array<string>")).collect()}
    assert got == {
        "valid": ("valid", "", "", ""),
        "cap": ("over_cap", "", "", ""),
        "twice": ("duplicate", "", "", ""),
        "adds": ("not_additive", "content_token", "secrets", "sub_claim"),
        "lacks": ("incomplete", "", "server", "parent"),
        "words": ("not_additive", "function_word_overrun", "not", "sub_claim"),
    }


def test_sentence_fates(spark):
    chunks = spark.createDataFrame([("c1", "Alpha runs fast. Beta runs slow."), ("c2", "Gamma walks.")], "chunk_id string, text string")
    drafts = spark.createDataFrame([("s1", "alpha RUNS fast.", ["c1"]), ("s2", "Alpha runs.", ["gone"]), ("s3", "Alpha runs and gamma walks.", ["c1", "c2"]), ("s4", "Delta runs.", ["c1"]), ("s5", "Alpha and beta runs.", ["c1"])], "sentence_id string, text string, chunk_ids array<string>")
    split = spark.createDataFrame([("s3", 1, ["Alpha jumps."]), ("s3", 2, ["Alpha runs", "gamma walks."]), ("s4", 1, ["Delta runs."]), ("s5", 1, ["Alpha and beta runs.", "alpha and beta runs."]), ("s5", 2, ["Alpha runs", "beta runs"])], "sentence_id string, attempt int, sub_claims array<string>")
    verdicts = spark.createDataFrame([("s4", "Delta runs.", False)], "sentence_id string, sub_claim string, supported boolean")
    got = {r["sentence_id"]: (r["fate"], r["reason"]) for r in claims.sentence_fates(drafts, chunks, split, verdicts).collect()}
    assert got == {"s1": ("emitted", None), "s2": ("dropped", "no_available_citations"), "s3": ("emitted", None), "s4": ("dropped", "unsupported_sub_claim"), "s5": ("dropped", "decomposition_invalid")}


def count(text):
    return len(re.findall(r"\w+|[^\w\s]", text))


def greedy(pieces, joiner, target):
    out, cur = [], None
    for p in pieces:
        both = p if cur is None else cur + joiner + p
        if cur is None or count(both) <= target:
            cur = both
        else:
            out.append(cur)
            cur = p
    return out + ([cur] if cur is not None else [])


def plain_chunks(text, target):
    split = lambda t: [s.strip() for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()]
    out, run = [], []
    for p in re.split(r"\n\s*\n", text.strip()):
        if count(p) > target:
            out += greedy(run, "\n\n", target)
            run = []
            out += greedy(split(p), " ", target)
        else:
            run.append(p)
    return out + greedy(run, "\n\n", target)


def test_packing_matches_plain_python(spark):
    rng = random.Random(6)
    texts = ["\n\n".join(" ".join(" ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))) + "." for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    got = on(spark, texts, lambda t: chunking.packed(t, target=20))
    assert got == [plain_chunks(t, 20) for t in texts]
    assert on(spark, ["", None, " \n\n "], lambda t: chunking.packed(t)) == [[], None, []]


def test_overlap(spark):
    chunk = " ".join(["word"] * 30) + ". Tail one. End."
    assert on(spark, [chunk], chunking.overlap) == ["Tail one. End."]
    assert on(spark, ["x" * 3], chunking.overlap) == ["xxx"]
    assert on(spark, ["one two three four five."], chunking.overlap) == [""]
    df = spark.createDataFrame([([chunk, "next", "last"],)], "c array<string>")
    assert df.select(chunking.with_overlap(F.col("c"))).first()[0] == [chunk, "Tail one. End.\n\nnext", "next\n\nlast"]


def test_batches(spark):
    rng = random.Random(1)
    counts = [rng.randrange(1, 2000) for _ in range(300)]
    got = spark.createDataFrame([(counts,)], "t array<bigint>").select(chunking.batches(F.col("t"))).first()[0]
    want, n, total, batch = [], 0, 0, 0
    for c in counts:
        if n and (n >= 64 or total + c > 50_000):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + c
        want.append(batch)
    assert got == want


def snapshot(spark, rows):
    return spark.createDataFrame([(c, r, "en", ["t"], "body[0]", f"f{c}", 0, t) for c, r, t in rows], "chunk_id string, record_id string, record_status string, record_tags array<string>, value_path string, fingerprint string, ordinal int, text string")


def test_lexical_dispositions(spark):
    snap = snapshot(spark, [("c1", "r1", "alpha beta"), ("c2", "r2", "alpha gamma delta"), ("c3", "r3", "omega"), ("c4", "r4", "the of"), ("c5", "r5", "kappa alpha")])
    asked = spark.createDataFrame([(1, "alpha beta?"), (2, "the")], "query_id int, question string")
    scores = retrieval.bm25(retrieval.lexical_index(snap), asked)
    rows = {(r["query_id"], r["chunk_id"]): r for r in retrieval.lexical_stage(snap, scores, asked).collect()}
    assert len(rows) == 10
    assert rows[1, "c1"]["rank"] == 1 and rows[1, "c3"]["disposition"] == "no_term_match"
    assert all(rows[2, c]["disposition"] == "no_term_match" for c in ("c1", "c2", "c3", "c4", "c5"))
    shuffled = snapshot(spark, [("c5", "r5", "kappa alpha"), ("c4", "r4", "the of"), ("c3", "r3", "omega"), ("c2", "r2", "alpha gamma delta"), ("c1", "r1", "alpha beta")]).repartition(3)
    again = retrieval.bm25(retrieval.lexical_index(shuffled), asked)
    assert sorted((r[0], r[1], round(r[2], 9)) for r in scores.collect()) == sorted((r[0], r[1], round(r[2], 9)) for r in again.collect())


def test_nonpositive_score(spark):
    snap = snapshot(spark, [("c1", "r1", "alpha"), ("c2", "r2", "beta")])
    asked = spark.createDataFrame([(1, "alpha")], "query_id int, question string")
    scores = retrieval.bm25(retrieval.lexical_index(snap), asked)
    assert {r["chunk_id"]: r["disposition"] for r in retrieval.lexical_stage(snap, scores, asked).collect()} == {"c1": "nonpositive_score", "c2": "no_term_match"}


def test_fusion_order(spark):
    snap = snapshot(spark, [("c1", "r1", ""), ("c2", "r2", ""), ("c3", "r3", "")])
    lex = spark.createDataFrame([(1, "c1", 1), (1, "c2", 3)], "query_id int, chunk_id string, lexical_rank int")
    sem = spark.createDataFrame([(1, "c2", 2), (1, "c3", 1)], "query_id int, chunk_id string, semantic_rank int")
    rows = retrieval.fuse(lex, sem, snap).orderBy("fused_rank").collect()
    assert [r["chunk_id"] for r in rows] == ["c2", "c1", "c3"]
    assert rows[0]["fused_score"] == pytest.approx(1 / 63 + 1 / 62)


def test_diversity_matches_two_passes(spark):
    rng = random.Random(9)
    rows = [(q, i, f"r{rng.randrange(1, 2 + q % 6)}") for q in range(40) for i in range(1, rng.randrange(1, 30))]
    got = {}
    for r in retrieval.diversify(spark.createDataFrame(rows, "query_id int, fused_rank int, record_id string")).collect():
        if r["final_rank"]:
            got.setdefault(r["query_id"], {})[r["final_rank"]] = (r["fused_rank"], r["selection_pass"])
    for q in range(40):
        own, kept, later, per = [x for x in rows if x[0] == q], [], [], {}
        for _, rank, rec in own:
            if len(kept) < 8 and per.get(rec, 0) < 2:
                per[rec] = per.get(rec, 0) + 1
                kept.append((rank, "breadth"))
            elif len(kept) < 8:
                later.append((rank, "fill"))
        kept += later[: 8 - len(kept)]
        assert got.get(q, {}) == dict(enumerate(kept, 1))


def test_renaming_chunks_changes_no_rank(spark):
    rows = [(f"c{i}", f"r{i % 4}", f"alpha {'beta ' * (i % 3)}word{i % 5}") for i in range(40)]
    asked = spark.createDataFrame([(1, "alpha beta word1")], "query_id int, question string")
    vectors = spark.createDataFrame([(c, [float(i % 7), 1.0]) for i, (c, _, _) in enumerate(rows)], "chunk_id string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, vector array<double>")
    # the stable key does not hold the chunk id
    renamed = {c: f"z{len(rows) - i}" for i, (c, _, _) in enumerate(rows)}
    back = {v: k for k, v in renamed.items()}
    one_ = retrieval.hybrid(snapshot(spark, rows), vectors, asked, q).collect()
    snap = snapshot(spark, rows).replace(renamed, subset=["chunk_id"])
    two = retrieval.hybrid(snap, vectors.replace(renamed, subset=["chunk_id"]), asked, q).collect()
    assert {(r["chunk_id"], r["final_rank"], r["breadth"]) for r in one_} == {(back[r["chunk_id"]], r["final_rank"], r["breadth"]) for r in two}


def test_composing_letters_are_all_in_one_range():
    """So texts without a letter of ``FAR_LETTERS`` need not be held against the wide class."""
    assert ft.FAR_LETTERS == r"[\u0300-\x{10FFFF}]"
    assert all(unicodedata.normalize("NFC", chr(c)) == chr(c) and not unicodedata.category(chr(c)).startswith("M") for c in range(0x300))


def test_filters():
    assert retrieval.Filters.build(statuses=[" Accepted ", "accepted"], tags=["b", "a"]) == retrieval.Filters(statuses=("accepted",), tags=("a", "b"))
    for bad in ({"statuses": ["odd"]}, {"tags": [" "]}):
        with pytest.raises(ValueError):
            retrieval.Filters.build(**bad)
    for path in ("body[*].x", "title[*]", "a..b", "body[x]"):
        with pytest.raises(ValueError):
            retrieval.Filters.build(value_paths=[path])
    assert retrieval.Filters.build(value_paths=[" body[*] ", "why[0]"]).value_paths == ("body[*]", "why[0]")


def test_filter_trace_reports_all_reasons_in_order(spark):
    snap = snapshot(spark, [("c1", "r1", "x")]).withColumn("record_status", F.lit(None).cast("string"))
    row = retrieval.filter_trace(snap, retrieval.Filters(("r2",), ("en",), ("u",), ("why[*]",))).first()
    assert row["exclusion_reasons"] == ["record_id", "status", "tag", "value_path"] and row["state"] == "excluded"
    assert retrieval.filter_trace(snap, retrieval.Filters()).first()["state"] == "accepted"


def test_supersession_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("x", "y"), ("y", "z"), ("s", "s")] + [(f"t{i}", f"t{i + 1}") for i in range(100)] + [("t100", "a")]
    got = index.cyclic_records(spark.createDataFrame(edges, "successor_id string, predecessor_id string"))
    assert {r[0] for r in got.collect()} == {"a", "b", "c", "s"}
    assert index.cyclic_records(spark.createDataFrame([], "successor_id string, predecessor_id string")).count() == 0


def test_validation_rules(spark):
    from tessera.schemas import RECORD

    good = {"id": "A-1", "title": "t", "status": "accepted", "date": "2024-02-29", "decision": {"chosen": "c", "alternatives": []}, "why": ["w"], "evidence": [{"kind": "file", "target": "./a//b.py", "note": None}]}
    bad = {"id": "-x", "title": " ", "date": "2023-02-29", "supersedes": "-x", "why": [" "], "decision": {"chosen": None, "alternatives": [{"title": "", "rejection_reason": None}]}, "evidence": [{"kind": None, "target": "x"}, {"kind": "file", "target": "/abs"}, {"kind": "spec", "target": "src/a"}, {"kind": "commit", "target": "ab"}, {"kind": "commit", "target": "zz"}, {"kind": "file", "target": "no"}]}
    records = spark.createDataFrame([good, bad, {"id": None}], RECORD)
    paths = spark.createDataFrame([("a/b.py",)], "path string")
    commits = spark.createDataFrame([("abc1",), ("abd2",)], "commit string")
    rows = validate.validate(records, paths, commits).collect()
    by = lambda i: sorted((r["field"], r["rule"]) for r in rows if r["id"] == i)
    assert by("A-1") == []
    assert by("-x") == sorted(
        [
            ("title", "required.missing"), ("status", "required.missing"), ("decision.chosen", "required.missing"), ("evidence[0].kind", "required.missing"), ("decision.alternatives[0].title", "required.missing"),
            ("decision.alternatives[0].rejection_reason", "alternative.missing_rejection_reason"), ("id", "id.malformed"), ("date", "date.malformed"), ("", "rationale.missing"), ("supersedes", "supersedes.self_reference"),
            ("evidence[1].target", "evidence.target_not_normalized"), ("evidence[2].target", "evidence.spec_outside_specs_dir"), ("evidence[3].target", "evidence.commit_ambiguous"), ("evidence[4].target", "evidence.commit_unresolved"), ("evidence[5].target", "evidence.path_unresolved"),
        ]
    )
    assert ("evidence", "required.missing") in by(None)
    without = validate.evidence_violations(records, paths, None).collect()
    assert [r["rule"] for r in without if r["field"] == ""] == ["context.git_unavailable"]


def test_pass_rates(spark):
    checks = spark.createDataFrame([("q", 1, True, None), ("q", 2, False, "late"), ("q", 3, False, "later"), ("p", 1, True, None)], "query_id string, run int, passed boolean, detail string")
    assert {r["query_id"]: (r["runs"], r["passed"], r["first_failure"]) for r in evaluate.pass_rates(checks).collect()} == {"q": (3, 1, "late"), "p": (1, 1, None)}


def test_stem_relation_is_directional(spark):
    pairs = [("falls", "falling"), ("fall", "falling"), ("rely", "relied"), ("a", "as"), ("x", "x"), ("ship", "shipped")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(fc.stem_match(F.col("a"), F.col("b"))).collect()] == [False, True, True, False, True, True]


def test_deviations_are_written_whole(spark, tmp_path):
    checks = spark.createDataFrame([("q", 1, True, None), ("q", 2, False, "late")], "query_id string, run int, passed boolean, detail string")
    results = spark.createDataFrame([("q", 1, "answered"), ("q", 2, "abstained")], "query_id string, run int, state string")
    evaluate.write_deviations(results, checks, str(tmp_path / "t"))
    assert [(r["run"], r["state"], r["detail"]) for r in spark.read.json(str(tmp_path / "t")).collect()] == [(2, "abstained", "late")]


def test_sources_without_a_root(spark):
    refs = spark.createDataFrame([("a/b",), ("/a",), ("",), (None,)], "path string")
    assert [r["resolution"] for r in index.source_states(refs, None).collect()] == ["hint_unavailable"] + ["invalid_relative_path"] * 3


def test_leading_rows_hold_every_winner_and_few_others(spark):
    rng = random.Random(5)
    rows = [(q, f"c{i}", float(rng.randrange(500))) for i in range(6000) for q in (1, 2)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, score double").coalesce(1)
    for sign in (True, False):
        kept = {(r[0], r[1]) for r in retrieval.leading(df, 24, "score", sign).collect()}
        assert len(kept) < 3000
        for q in (1, 2):
            own = sorted((-s if sign else s) for x, _, s in rows if x == q)
            assert {(x, c) for x, c, s in rows if x == q and (-s if sign else s) <= own[23]} <= kept
    assert retrieval.leading(df, retrieval.EVERY).count() == len(rows)


def test_scores_take_no_shuffle_and_equal_texts_score_equally(spark):
    words = [f"w{i}" for i in range(60)]
    rng = random.Random(6)
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(50)]
    rows = [(f"c{i}", "r", " ".join(rng.sample(t.split(), 40))) for i, t in enumerate(texts * 3)]
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=30))) for q in range(5)], "query_id int, question string")
    index = retrieval.lexical_index(snapshot(spark, rows))
    scores = retrieval.bm25(index, asked)
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()
    of = {(r["query_id"], r["chunk_id"]): r["score"] for r in scores.collect()}
    assert all(of[q, f"c{i}"] == of[q, f"c{i + 50}"] == of[q, f"c{i + 100}"] for q in range(5) for i in range(50))
    few = {(r["query_id"], r["chunk_id"]) for r in retrieval.bm25(index, asked, best=3).collect()}
    for q in range(5):
        third = sorted((s for (x, _), s in of.items() if x == q), reverse=True)[2]
        assert {k for k, s in of.items() if k[0] == q and s >= third} <= few
    assert len(few) < len(of)


def test_a_small_file_of_parts_is_dealt_to_all_cores(spark, sf_dir):
    from tessera.plans import text_queries

    assert text_queries.records(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_the_mean_idf_does_not_depend_on_the_order_of_the_words(spark):
    n, dfs = 400_000, [1 + i * i % 997 for i in range(200_000)] + [300_000]
    rows = spark.createDataFrame(list(enumerate(dfs)), "word int, df bigint")
    raw = rows.select((F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("x"))
    mean = math.fsum(r["x"] for r in raw.collect()) / len(dfs)
    for frequency in (rows.coalesce(1), rows.repartition(7, "word"), rows.orderBy(F.desc("df")).coalesce(1)):
        floor = retrieval.idf(frequency, n).where("word = 200000").first()["idf"]
        assert abs(floor - 0.25 * mean) <= 2 * math.ulp(floor)


def test_stems_are_made_where_the_texts_are(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("aeiysgnd\u00e9\U0001d54f", k=rng.randint(1, 9))) for _ in range(3000)] + ["ssss", "iiii", "eeee", "ess", "singing", "horses", "busied"]
    rows = [(f"c{i}", "r", " ".join(rng.choices(words, k=20))) for i in range(300)] + [("empty", "r", ""), ("none", "r", None), ("stop", "r", "the of")]
    counts = retrieval.stem_counts(snapshot(spark, rows))
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    got = {r["chunk_id"]: (r["dl"], [tuple(t) for t in r["terms"]]) for r in counts.collect()}
    stems = snapshot(spark, rows).select("chunk_id", F.coalesce(ft.stemmed_tokens(F.col("text")), F.array()).alias("stems")).collect()
    assert got == {r["chunk_id"]: (len(r["stems"]), sorted(Counter(r["stems"]).items())) for r in stems}


def test_field_aware_moves_a_pair_once(spark):
    rng = random.Random(9)
    words = [f"w{i}ing" for i in range(30)]
    rows = [(f"c{i}", f"r{i % 4}", " ".join(rng.choices(words, k=12))) for i in range(60)] + [("c60", "r0", "other"), ("c61", "r0", None)]
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=8))) for q in range(3)] + [(3, "the of")], "query_id int, question string")
    vectors = spark.createDataFrame([(f"c{i}", [float(i % 7), 1.0]) for i in range(0, 62, 2)] + [("c1", [0.0, 0.0]), ("c3", None), ("gone", [1.0, 1.0])], "chunk_id string, vector array<float>")
    near = spark.createDataFrame([(0, [1.0, 2.0]), (3, [2.0, 1.0])], "query_id int, vector array<double>")
    snap = snapshot(spark, rows)
    ranked = retrieval.field_aware(snap, vectors, asked, near, {"no.field": "label"})
    plan = ranked._jdf.queryExecution().sparkPlan().toString() + ranked._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "fingerprint" not in plan and plan.count("Exchange hashpartitioning(query_id") == 1
    key = {r["chunk_id"]: (r["record_id"], r["fingerprint"], r["value_path"], r["ordinal"]) for r in snap.collect()}
    scores = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieval.bm25(retrieval.stem_counts(snap), asked, tokens=ft.stemmed_tokens).collect()}
    want = {}
    for q, v in ((0, (1.0, 2.0)), (1, None), (2, None), (3, (2.0, 1.0))):
        lexical = sorted((c for (x, c), s in scores.items() if x == q and round(s, 9) > 0), key=lambda c: (-round(scores[q, c], 9), key[c]))
        have = {c: (float(int(c[1:]) % 7), 1.0) for c in key if int(c[1:]) % 2 == 0} if v else {}
        far = {c: 1 - (x[0] * v[0] + x[1] * v[1]) / math.hypot(*x) / math.hypot(*v) for c, x in have.items()} | ({"c1": 2.0} if v else {})
        semantic = sorted(far, key=lambda c: (round(far[c], 9), key[c]))
        lexical, semantic = ({c: n for n, c in enumerate(x, 1)} for x in (lexical, semantic))
        fused = {c: round(sum(1 / (60 + x[c]) for x in (lexical, semantic) if c in x), 9) for c in lexical | semantic}
        for n, c in enumerate(sorted(fused, key=lambda c: (-fused[c], key[c])), 1):
            want[q, c] = (lexical.get(c), semantic.get(c), fused[c], n)
    assert {(r["query_id"], r["chunk_id"]): (r["lexical_rank"], r["semantic_rank"], r["fused_score"], r["fused_rank"]) for r in ranked.collect()} == want
    for some, seen, lexical in ((vectors.limit(0), near, asked), (vectors, near.limit(0), asked), (vectors, near, asked.limit(0))):
        rows = retrieval.field_aware(snap, some, lexical, seen, {"no.field": "label"}).collect()
        assert {(r["query_id"], r["chunk_id"]): r["lexical_rank"] for r in rows if r["lexical_rank"]} == {k: w[0] for k, w in want.items() if w[0] and lexical is asked}
        assert {(r["query_id"], r["chunk_id"]): r["semantic_rank"] for r in rows if r["semantic_rank"]} == {k: w[1] for k, w in want.items() if w[1] and lexical is not asked}


def test_equal_vectors_are_equally_far_wherever_they_lie():
    rng = np.random.default_rng(3)
    far = retrieval._far(np.repeat(rng.normal(size=(1, 64)), 333, 0), rng.normal(size=(200, 64)))
    assert (far == far[0]).all()

"""Canonical stems, byte-pair packing, containment by automaton."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.functions.claims import base_set
from tessera.functions.paths import RANKED_LABELS
from tessera.functions.text import canonical_stem, token_count
from tessera.operators import chunking, claims, packing
from tessera.operators.retrieval import lexical_document
from tessera.plans.base import table
from tessera.plans.text_queries import _spaced, bpe_chunks

BPE = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
# Tokens and their canonical stems.
STEMS = {
    "decide": "decid", "decides": "decid", "decided": "decid", "deciding": "decid", "decision": "decision", "use": "us", "using": "us", "ship": "ship", "shipped": "ship", "rely": "rely", "relies": "rely", "records": "record",
    "chose": "cho", "chosen": "chosen", "retrieve": "retriev", "retrieval": "retrieval", "process": "proc", "setting": "set", "settings": "set", "need": "ne", "needs": "ne", "falls": "fal", "falling": "fal", "sing": "sing", "singing": "sing",
    "is": "is", "a": "a", "": "", "taxi": "taxy",
}


def test_canonical_stems(spark):
    rows = spark.createDataFrame([(t,) for t in STEMS], "t string").select("t", canonical_stem(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in rows} == STEMS


def test_a_match_of_base_sets_implies_equal_stems(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in "setting settings set sets need needs needed falls fall falling relies rely relied using use used ships shipped ship files file filled fill".split()], "w string")
    rows = words.select("w", base_set(F.col("w")).alias("bases"), canonical_stem(F.col("w")).alias("stem")).collect()
    pairs = [(a, b) for a in rows for b in rows if a["w"] < b["w"] and set(a["bases"]) & set(b["bases"])]
    assert len(pairs) > 10 and all(a["stem"] == b["stem"] for a, b in pairs)


def test_lexical_documents(spark):
    rows = spark.createDataFrame([("decision.chosen",), ("body[3]",), ("other",)], "p string")
    got = [r[0] for r in rows.select(lexical_document(F.col("p"), F.lit("text"), RANKED_LABELS)).collect()]
    assert got == ["what this record decided\n\ntext", "other prose from this record\n\ntext", "text"]


def loop(text, count, target=400):
    """Packing as one reads it: join what fits, counting the whole text each time."""
    out, current = [], []
    for p in packing.paragraphs(text):
        pieces, joiner = ([p], "\n\n") if count(p) <= target else (packing.sentences(p), " ")
        if joiner == " " and current:
            out.append("\n\n".join(current))
            current = []
        for piece in pieces:
            if current and count(joiner.join([*current, piece])) > target:
                out.append(joiner.join(current))
                current = []
            current.append(piece)
        if joiner == " " and current:
            out.append(" ".join(current))
            current = []
    return out + (["\n\n".join(current)] if current else [])


def test_byte_pair_packing_like_a_plain_loop(spark, sf_dir):
    count = packing.bpe_counter(*BPE)
    texts = {r["doc_id"]: r["text"] for r in _spaced(spark, sf_dir).collect()}
    got = {}
    for r in bpe_chunks(spark, sf_dir).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["evidence_tokens"]))
    for doc, text in texts.items():
        packs = loop(text or "", count)
        want = []
        for i, c in enumerate(packs):
            tails = [""]
            for s in reversed(packing.sentences(packs[i - 1]) if i else []):
                tails.append(f"{s} {tails[-1]}".strip())
            fit = [t for n, t in enumerate(tails) if all(count(u) <= max(1, int(count(packs[i - 1]) * 0.15)) for u in tails[1 : n + 1])] if i else [""]
            want.append("\n\n".join(filter(None, (fit[-1], c))))
        assert [t for t, _ in got.get(doc, [])] == want, doc
        assert all(n == count(t) for t, n in got.get(doc, []))
        assert all(count(p) <= 400 or len(packing.sentences(p)) == 1 for p in packs)


def test_additive_counts_give_the_chunks_of_the_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", chunking.with_overlap(chunking.packed(F.col("text"))).alias("chunks"), token_count(F.col("text")).alias("n")).collect()
    assert all(packing.chunks(r["text"], packing.word_count) == r["chunks"] and packing.word_count(r["text"]) == r["n"] for r in rows)
    edges = ["", " \n \n", "One. Two! ", "áb \x0bc d.\r\n\r\nNext (end.)  ", "x" * 2000 + ".\n\n" + "Word. " * 900, 'He said "no." Then left.\n \n\n Last', "\x1e a. b"]
    got = spark.createDataFrame([(t,) for t in edges], "t string").select("t", chunking.with_overlap(chunking.packed(F.col("t"))).alias("c")).collect()
    assert [packing.chunks(r["t"], packing.word_count) for r in got] == [r["c"] for r in got]


def test_counts_and_table_function(spark):
    rows = spark.createDataFrame([("hello world",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(packing.token_counts(F.col("t"), *BPE)).collect()] == [2, None, 0]
    spark.udtf.register("text_chunks", packing.TextChunks)
    got = spark.sql(f"SELECT c.* FROM VALUES ('one two. three'), (NULL) AS v(t), LATERAL text_chunks(t, '{BPE[0]}', \"{BPE[1]}\") c".replace("\\", "\\\\")).collect()
    assert [tuple(r) for r in got] == [(0, "one two. three", 4)]


@pytest.mark.parametrize("block", [10**6, 12])
def test_containment_by_automaton(spark, block):
    chunks = spark.createDataFrame([(1, "abc abd"), (2, "xabcx"), (3, ""), (4, None), (5, "b" * 5000 + "abc")], "c int, chunk string")
    said = spark.createDataFrame([("p", "abc"), ("q", "abc"), ("r", "bc ab"), ("s", "b"), ("t", ""), ("u", None), ("p", "abc")], "k string, claim string")
    want = sorted({(k, c) for k, t in [tuple(r) for r in said.collect()] for c, x in [tuple(r) for r in chunks.collect()] if t and x and t in x})
    assert sorted(map(tuple, claims.holders(said, chunks, "k", "c", block).collect())) == want
    assert claims.holders(said.limit(0), chunks, "k", "c").collect() == [] == claims.holders(said, chunks.limit(0), "k", "c").collect()


def test_inputs_are_counted_only_where_asked_for(spark):
    units = spark.createDataFrame([("a", "t", "f", 0, 0, "body[0]", "One. Two.")], "id string, title string, fingerprint string, schema_order int, i int, value_path string, text string")
    rows = packing.plan(units, "g", packing.word_count)
    assert rows.select("id", "text", "evidence_tokens")._jdf.queryExecution().optimizedPlan().toString().count("counted") == 0
    assert [tuple(r) for r in rows.select("text", "evidence_tokens", "input_tokens", "oversize").collect()] == [("One. Two.", 4, packing.word_count(rows.first()["embedding_input"]), False)]
    assert str(rows.select("id", "text")._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1

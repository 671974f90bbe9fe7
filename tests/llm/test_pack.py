import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import pack
from tessera.llm.common import table

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encode():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(docs, pieces, encode, size=1024):
    """Exact round trip: every id in exactly one piece, sequences gapless and full or a power of two."""
    want = defaultdict(list)
    for doc, text in docs:
        want[doc].append(encode(text))
    seqs, got = defaultdict(list), defaultdict(list)
    for p in pieces:
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
        got[p["doc_id"]].append((p["start"], p["length"], np.frombuffer(p["ids"], "<u4").tolist(), p["doc_tokens"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size and at & (at - 1) == 0
    assert set(got) == set(want)
    for doc, parts in got.items():
        if len(want[doc]) == 1:
            ids = [i for p in sorted(parts) for i in p[2]]
            assert ids == want[doc][0]
            assert {p[3] for p in parts} == {len(ids)}
        else:
            assert sorted(i for p in parts for i in p[2]) == sorted(i for w in want[doc] for i in w)


def test_round_trip_on_documents(spark, sf_dir, encode):
    docs = table(spark, sf_dir, "documents")
    check([(r["doc_id"], r["text"]) for r in docs.collect()], pack.pack(docs).collect(), encode)


def test_edge_cases(spark, encode):
    rows = [(1, None), (2, ""), (3, "a" * 20_000), (4, "x<|endoftext|>y"), (5, "🙂 é"), (5, "🙂 é"), (6, " \n\t "), (None, "no id")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id bigint, text string, key int, ids int")
    check(rows, pack.pack(df).collect(), encode)
    assert pack.pack(df.limit(0)).count() == 0


def test_texts_under_one_id_keep_apart(spark, encode):
    one, other = "a b " * 3000, "b a " * 3000
    df = spark.createDataFrame([(1, one), (1, other), (1, one)], "doc_id bigint, text string").repartition(1)
    whole = [encode(one), encode(other)]
    assert len(whole[0]) == len(whole[1]) > 4096
    pieces = pack.pack(df).collect()
    assert sum(p["length"] for p in pieces) == 2 * len(whole[0]) + len(whole[1])
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert any(ids == w[p["start"] : p["start"] + p["length"]] for w in whole)
    check([(1, one), (1, other), (1, one)], pieces, encode)


def test_digest_is_crc32_of_the_ids(spark):
    pieces = pack.pack(spark.createDataFrame([(1, "some words")], "doc_id bigint, text string"))
    ids = pieces.first()["ids"]
    assert pack.digest(pieces).first()["ids_crc32"] == zlib.crc32(ids)


@pytest.mark.parametrize("dims", [2, 3, 4])
def test_hilbert_neighbours_are_one_step_apart(dims):
    bits = 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = pack.hilbert_key(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()

from collections import Counter

import pytest

from tessera.llm import shard
from tessera.llm.common import table


def brute_table(names, slots):
    """The textbook form: whole permutations, one claim a turn."""
    perms = [[(shard._draw(n, "offset") + j * (shard._draw(n, "stride") % (slots - 1) + 1)) % slots for j in range(slots)] for n in names]
    out, nxt = {}, [0] * len(names)
    while True:
        for i in range(len(names)):
            while perms[i][nxt[i]] in out:
                nxt[i] += 1
            out[perms[i][nxt[i]]] = i
            if len(out) == slots:
                return [out[s] for s in range(slots)]


def test_table_matches_brute_force_and_is_even():
    names = [f"n{i}" for i in range(7)]
    got = shard.lookup_table(names, 251)
    assert got == brute_table(names, 251)
    assert max(Counter(got).values()) - min(Counter(got).values()) <= 1


def test_removing_a_shard_moves_little():
    names = [f"n{i}" for i in range(20)]
    a, b = shard.lookup_table(names), shard.lookup_table(names[:-1])
    moved = sum(x != y and x != 19 for x, y in zip(a, b, strict=True)) / len(a)
    assert moved < 0.06


def test_weights_and_bad_arguments():
    got = Counter(shard.lookup_table(["a", "b"], 1009, [3, 1]))
    assert 2.8 < got[0] / got[1] < 3.2
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            shard.lookup_table(bad)
    with pytest.raises(ValueError):
        shard.lookup_table(["a"], 100)


def test_placement(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    placed = shard.place(docs, "doc_id", 4)
    filled = shard.lookup_table([f"shard-{i:05d}" for i in range(4)])
    rows = placed.collect()
    assert len(rows) == docs.count()
    import hashlib

    for r in rows:
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % shard.SLOTS
        assert (r["slot"], r["shard"]) == (slot, filled[slot])
    assert "Exchange hash" not in placed._jdf.queryExecution().toString()


def test_edge_cases(spark):
    rows = [(None, "a", 9), (None, "b", 9), (None, None, 9), (1, "c", 9), (1, "c", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    got = shard.place(df, "doc_id", 8, fallback=("text",)).collect()
    assert len(got) == 5 and all(r["shard"] is not None and 0 <= r["shard"] < 8 for r in got)
    assert len({r["slot"] for r in got if r["doc_id"] == 1}) == 1
    assert len({r["slot"] for r in got if r["doc_id"] is None}) == 3
    assert shard.place(df.limit(0), "doc_id", 8).count() == 0
    hot = shard.place(spark.range(1000).selectExpr("id", "'one' AS source"), "source", 8, salt="id", salts=64)
    assert hot.select("shard").distinct().count() == 8


def test_write_shards(spark, tmp_path):
    shard.write_shards(spark.range(50).withColumnRenamed("id", "doc_id"), str(tmp_path / "out"), shards=3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50

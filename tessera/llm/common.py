"""Shared plumbing: table access, frequent keys and joins on them, word hashing.

Every helper here works row by row or on a bounded batch; nothing collects.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.store.shared import cut, discard, shared_dir, stored  # noqa: F401  (used through this module)

#: Odd 64-bit multipliers (fixed values of the word and mixing hashes).
POLY = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heavy_keys(keys: DataFrame, k: int = 1024) -> list:
    """At most ``k`` values of the one column of ``keys``, among them all that more than 1/k of the rows have.

    Each task keeps a Misra-Gries summary of ``k`` counters; summaries are
    added up and cut to ``k`` once more. What reaches the driver is ``k`` rows,
    whatever the input. Nulls don't count.
    """
    kind = keys.schema[0].dataType

    def counted(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("key").aggregate([("c", "sum")]).rename_columns(["key", "c"]).select(["key", "c"])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for b in batches:
            own = b.column(0).drop_null()
            parts.append(pa.table({"key": own, "c": np.ones(len(own), np.int64)}))
            rows += len(own)
            if rows > 200_000:
                parts, rows = [_fewer(counted(parts), k)], 0
        if parts:
            yield from _fewer(counted(parts), k).to_batches()

    merged = keys.mapInArrow(summarise, f"key {kind.simpleString()}, c bigint").groupBy("key").agg(F.sum("c").alias("c"))
    return [r["key"] for r in merged.where("c > 1").orderBy(F.desc("c"), "key").limit(k).collect()]


def _fewer(counts: pa.Table, k: int) -> pa.Table:
    """A Misra-Gries summary cut to ``k`` counters: all give up the count of the first that must go."""
    if counts.num_rows <= k:
        return counts
    c = counts["c"].to_numpy()
    left = c - np.partition(c, -k - 1)[-k - 1]
    return pa.table({"key": counts["key"], "c": left}).filter(pa.array(left > 0))


def joined(rows: DataFrame, facts: DataFrame, on: list[str], size: str = "size") -> DataFrame:
    """``rows`` with the facts of their key, where a key may hold a large part of all rows.

    ``facts`` has one row a key, cut from its lineage, with ``size``, the number
    of rows of that key. Keys of more than a 1,024th of the rows number under
    1,024: these keys are broadcast, and their rows are dealt to ``SALTS``
    copies of their facts. Null keys match nothing.
    """
    total = facts.agg(F.sum(size).alias("s")).first()["s"] or 0
    hot = F.col(size) * 1024 > total
    many = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    named = facts.where(hot).select(*on, F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = rows.join(F.broadcast(named), on, "left").withColumn("__salt", salt).drop("__hot")  # 1,023 keys at most
    return dealt.join(facts.withColumn("__salt", F.explode(many)), [*on, "__salt"]).drop("__salt")


#: Tasks among which the rows of one hot key are dealt.
SALTS = 64


def stored_apart(df: DataFrame, column: str, values: list) -> list[DataFrame]:
    """``df`` stored in one pass as a table for each of the values that ``column`` has; they are discarded one by one."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession).rstrip('/')}/tessera-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").partitionBy(column).parquet(path)
    kind = df.drop(column).schema
    out = []
    for value in values:
        at = f"{path}/{column}={value}"
        there = spark._jvm.org.apache.hadoop.fs.Path(at)
        part = spark.read.schema(kind).parquet(at) if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there) else spark.createDataFrame([], kind)
        part._stored_at = at
        out.append(part)
    return out


def bare(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns, whatever they are called, cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * MIX_A
        x = x ^ (x >> np.uint64(27))
        x = x * MIX_B
        return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd base, modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or have.size < n:
        have = np.full(1 << max(10, int(n).bit_length()), base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def inverse(base: int) -> int:
    """What an odd base must be multiplied with to give 1 modulo 2**64."""
    return pow(base, -1, 1 << 64)


Located = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def located_words(text: str | None) -> Located:
    """Hashes of the words of a text, where they begin and end in bytes, and the bytes.

    Words are maximal runs outside ``[\\x20\\x09-\\x0D]``; A-Z count as a-z. The
    hash is a polynomial in the word's bytes, so the whole text takes a few
    array operations and no Python loop over words.
    """
    return _located((text or "").encode("utf-8", "surrogatepass"))


def located_together(texts: list[str | None]) -> tuple[Located, np.ndarray]:
    """The words of some texts as of one, a line end between two, and where each text begins in bytes."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return _located(b"\n".join(parts)), np.cumsum([0, *[len(p) + 1 for p in parts[:-1]]])


def in_parts(sizes: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of ``most`` bytes at most together, or of one."""
    before, low = np.concatenate(([0], np.cumsum(sizes))), 0
    while low < sizes.size:
        high = max(low + 1, int(np.searchsorted(before, before[low] + most, "right")) - 1)
        yield low, high
        low = high


def _located(text: bytes) -> Located:
    raw = np.frombuffer(text, np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not starts.size:
        return np.empty(0, np.uint64), starts, ends, raw
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    with np.errstate(over="ignore"):
        value = (low.astype(np.uint64) + np.uint64(1)) * powers(int(POLY), raw.size)
        value[gap] = 0
        total = np.add.reduceat(value, starts)
        return mix64(total * powers(inverse(int(POLY)), raw.size)[starts] + (ends - starts).astype(np.uint64)), starts, ends, raw


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order (see ``located_words``)."""
    return located_words(text)[0]


def run_hashes(words: np.ndarray, width: int, base: int = int(POLY)) -> np.ndarray:
    """A hash of each run of ``width`` words, by differences of one cumulated polynomial."""
    n = words.size - width + 1
    with np.errstate(over="ignore"):
        sums = np.cumsum(words * powers(base, words.size), dtype=np.uint64)
        sums[width:] -= sums[: n - 1].copy()
        return mix64(sums[width - 1 :] * powers(inverse(base), n))


def shingles_in_order(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words, in order."""
    out = np.full(max(0, words.size - width + 1), width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mix64(out * POLY + words[i : i + out.size])
    return out


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; fewer words make one run."""
    if 0 < words.size < width:
        out = np.full(1, words.size, np.uint64)
        with np.errstate(over="ignore"):
            for w in words:
                out = mix64(out * POLY + w)
        return out
    return np.unique(shingles_in_order(words, width))

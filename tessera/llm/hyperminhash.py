"""HyperMinHash: compressed MinHash registers, banding, and collision-corrected Jaccard.

A register keeps, of the smallest of a set's 32-bit hashes, the number of
leading zeros (6 bits) and the ten bits after the leading one. Equal registers
of two sets mean equal minima up to a known rate of accidental collisions,
which the estimate takes off. Published as HyperMinHash (Yu and Weber).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, joined, mix64

#: Bits after the leading one that a register keeps.
MANTISSA = 10


def families(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``k`` hash functions on 32 bits."""
    draw = mix64(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).astype(np.uint32)
    return draw[:k] | np.uint32(1), draw[k:]


def registers(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Registers (len(starts), k) of the consecutive, non-empty sets in ``hashes``."""
    out = np.empty((starts.size, k), np.uint16)
    a, b = families(k)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    ends = np.append(starts[1:], hashes.size)
    at = 0
    while at < starts.size:  # whole sets, about 8,192 hashes at a time
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + 8192, "right")))
        low = np.full((k, upto - at), np.uint32(0xFFFFFFFF))
        for lo in range(int(starts[at]), int(ends[upto - 1]), 8192):  # a long set alone, in parts
            part = x[lo : min(lo + 8192, int(ends[upto - 1]))]
            v = part[None, :] * a[:, None]
            v += b[:, None]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            inner = starts[at:upto] - lo if upto - at > 1 else np.zeros(1, np.int64)
            low = np.minimum(low, np.minimum.reduceat(v, inner, axis=1))
        out[at:upto] = compress(low.T)
        at = upto
    return out


def compress(minima: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of 32-bit minima as 16-bit registers."""
    bits = np.maximum(minima.astype(np.float64), 0.5).view(np.uint64)
    exponent = (bits >> np.uint64(52)).astype(np.int64) - 1023
    mantissa = (bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return (((31 - exponent) << MANTISSA) | mantissa.astype(np.int64)).astype(np.uint16)


def estimate(equal: np.ndarray, k: int, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less accidental collisions.

    0.169919487... * 2**-MANTISSA * 4ab/(a+b)^2 is the published collision rate
    of a register of two disjoint sets of sizes a and b.
    """
    phi = 4.0 * n_a * n_b / np.maximum(1, n_a + n_b) ** 2
    rate = 0.169919487159739093975315012348 * phi / (1 << MANTISSA)
    return np.clip((equal / k - rate) / (1.0 - rate), 0.0, 1.0)


def banded(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, node): a row for each band of each class (node, sig)."""
    width = 2 * rows
    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")
    cutout = F.substring("sig", F.col("band") * width + 1, F.lit(width))
    return classes.select("node", "sig", band).select(F.xxhash64("band", cutout).alias("key"), "node")


def flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that the values of a binary column hold, one value after the other, and where each begins; without nulls."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return whole.view(kind), (ends - ends[0]) // np.dtype(kind).itemsize


def likely(pairs: DataFrame, classes: DataFrame, least: float, percent: int) -> DataFrame:
    """The pairs (a, b), cut from their lineage, estimated at ``least`` or more whose sizes allow ``percent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (flat(b.column(i), np.uint16)[0].reshape(b.num_rows, -1) for i in (2, 4))
            equal = (x == y).sum(axis=1)
            n, m = b.column(3).to_numpy(), b.column(5).to_numpy()
            sure = estimate(equal, x.shape[1], n, m) >= least
            mask = pa.array(sure & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    one = classes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    two = classes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    both = joined(pairs.join(two, "b"), _sized(pairs, one), ["a"]).select("a", "b", "sig_a", "n_a", "sig_b", "n_b")
    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def _sized(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``facts`` of the nodes ``a`` with the number of their pairs: one node may be in very many."""
    return cut(pairs.groupBy("a").agg(F.count("*").alias("size")).join(facts, "a"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs, cut from their lineage, with 100 * |A & B| >= percent * |A | B| on full sets (node, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            (x, at), (y, by) = flat(b.column(2), np.uint64), flat(b.column(3), np.uint64)
            common = np.empty(b.num_rows, np.int64)
            for i, (p, q, r, t) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), by[:-1].tolist(), by[1:].tolist(), strict=True)):
                both = np.concatenate((x[p:q], y[r:t]))
                both.sort()
                common[i] = np.count_nonzero(both[1:] == both[:-1])
            mask = pa.array(100 * common >= percent * (np.diff(at) + np.diff(by) - common))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    one = sets.select(F.col("node").alias("a"), F.col("members").alias("in_a"))
    two = sets.select(F.col("node").alias("b"), F.col("members").alias("in_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "in_a", "in_b").mapInArrow(run, "a bigint, b bigint").distinct()

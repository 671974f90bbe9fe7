"""Vectors of whole numbers in blocks, for the searches that score exactly.

A vector of fewer components than another counts as ending in zeros. Scores are exact; those beyond 64 bits end there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bare


def whole_rows(rows: DataFrame, id_col: str, vector_col: str, *keep: str, scale: float = 256.0) -> DataFrame:
    """(id, *keep, vector, copy): the rows that take part, each component ``x`` as ``floor(scale * x)``.

    Rows with a null among id and ``keep``, a null vector or a component that is null or, times ``scale``, not finite take
    no part. Rows equal in all of these count once. ``copy`` tells rows apart that share an id.
    """
    slim = bare(rows, id_col, vector_col, *keep).toDF("id", "vector", *keep)
    wide = slim.withColumn("id", F.col("id").cast("bigint")).withColumn("vector", F.transform(F.col("vector").cast("array<double>"), lambda x: x * scale))
    finite = F.forall("vector", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    good = wide.dropna(subset=["id", "vector", *keep]).where(finite)
    floor = F.transform("vector", lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y))
    return good.select("id", *keep, floor.alias("vector")).dropDuplicates().withColumn("copy", F.xxhash64(*keep, "vector"))


def block_count(rows: DataFrame, n: int, block_rows: int) -> int:
    """Blocks of at most about ``block_rows`` of ``n`` rows; enough of them to keep all cores busy."""
    return max(1, -(-n // block_rows), min(-(-n // 256), 2 * rows.sparkSession.sparkContext.defaultParallelism))


def by_block(held: DataFrame, asks: DataFrame, blocks: int, order: list) -> DataFrame:
    """Rows of both frames (``block`` and the same further columns) dealt to a task a block: those held, in ``order``, then those asked."""
    both = held.withColumn("asked", F.lit(False)).unionByName(asks.withColumn("asked", F.lit(True)))
    return both.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asked", *order)


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.RecordBatch]]:
    """The rows a block holds (the same object for the whole block) with each slice of rows that ask; needs ``by_block``."""
    here, parts, held = None, [], None
    for b in batches:
        if not b.num_rows:
            continue
        block, asked = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("block", "asked"))
        edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(asked) != 0)) + 1
        for lo, hi in zip([0, *edges], [*edges, b.num_rows], strict=True):
            if block[lo] != here:
                here, parts, held = block[lo], [], None
            if not asked[lo]:
                parts.append(b.slice(lo, hi - lo))
            elif parts:
                held = held or pa.Table.from_batches(parts).combine_chunks()
                yield held, b.slice(lo, hi - lo)


def numbers(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy() if isinstance(rows, pa.Table) else rows.column(name).to_numpy(zero_copy_only=False)


def matrix(rows: pa.Table | pa.RecordBatch, name: str, fill: float = 0.0) -> np.ndarray:
    """A list column as rows of a matrix, short ones filled up."""
    column = rows.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.full((len(sizes), int(sizes.max(initial=0))), fill, values.dtype)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values
    return out


def as_exact(asks: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices, cut to their common components, in the narrowest numbers in which all inner products are exact."""
    width = min(asks.shape[1], held.shape[1])
    asks, held = asks[:, :width], held[:, :width]
    most = int(np.abs(asks).max(initial=0.0)) * sum(int(x) for x in np.abs(held).max(axis=0, initial=0.0))
    if most >= 2**63:  # whole numbers of Python, slow, for blocks with such components only
        return tuple(np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (asks, held))
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return asks.astype(kind), held.astype(kind)


def kind_of(scores: np.dtype) -> np.dtype:
    """The numbers in which scores of such vectors are kept."""
    return np.dtype(np.int64) if scores == object else scores


def kept(scores: np.ndarray) -> np.ndarray:
    """Scores that end at the range of 64 bits, the least of which stands for no score."""
    return np.clip(scores, 1 - 2**63, 2**63 - 1).astype(np.int64) if scores.dtype == object else scores


def lowest(kind: np.dtype) -> float:
    """What stands for no score."""
    return np.iinfo(kind).min if np.issubdtype(kind, np.integer) else -np.inf


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` best scores of each row, ties to smaller ids; a partition selects before anything is sorted."""
    keep = scores > lowest(scores.dtype)
    if k < scores.shape[1]:
        keep &= scores >= np.partition(scores, -k, axis=1)[:, -k][:, None]
    r, c = np.nonzero(keep)
    order = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    first = np.arange(r.size) - np.searchsorted(r, r) < k
    return r[first], c[first]

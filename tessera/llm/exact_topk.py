"""Exact top-k search by exhaustive term-at-a-time accumulation.

Terms are the components of the vectors. A task holds a block of candidates as postings, for each term the rows where it
is not zero and their weights. A strip of sparse query rows goes through its terms one after the other; each term adds
its weight times the postings into a dense array of scores. Then a partition selects the strip's best rows of the block,
and the best over all blocks are the answer. Every candidate is scored for every query: queries are copied once for each
block of ``block_rows`` candidates, candidates are shuffled once, and a task's memory does not grow with the table.

See ``whole_rows`` for the rows that take part and ``vector_blocks`` for ragged vectors and very large components. Rows
that share an id with the query are never its candidates; rows that share an id but not the vector are searched for, and
found, each on its own. Zero vectors score 0. Fewer than ``k`` candidates give fewer rows. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.vector_blocks import as_exact, best, block_count, by_block, kept, lowest, matrix, numbers, streamed, whole_rows

#: Candidates and queries of one dense array of scores.
TILE, STRIP = 4096, 64
FOUND = pa.schema([("query_id", pa.int64()), ("copy", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def accumulate(asks: np.ndarray, postings: list[tuple[np.ndarray | slice, np.ndarray]], rows: int) -> np.ndarray:
    """Dense scores of each query row against ``rows`` candidates, one term after the other."""
    scores = np.zeros((len(asks), rows), asks.dtype)
    for term, (at, weights) in enumerate(postings):
        own = np.flatnonzero(asks[:, term])
        if not own.size or not weights.size:
            continue
        add = np.multiply.outer(asks[own, term], weights)
        if isinstance(at, slice):
            scores[own if own.size < len(asks) else slice(None)] += add
        else:
            scores[np.ix_(own, at)] += add
    return kept(scores)


def postings_of(held: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For each term the candidates that have it (all of them as a slice) and their weights."""
    out = []
    for column in held.T:
        at = np.flatnonzero(column)
        out.append((slice(None), np.ascontiguousarray(column)) if at.size == len(held) else (at, column[at]))
    return out


def _scan(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for held, asks in streamed(batches):
            if held is not last:
                last, ids, vectors = held, numbers(held, "id"), matrix(held, "vector")
            own, copies = numbers(asks, "id"), numbers(asks, "copy")
            points, exact = as_exact(matrix(asks, "vector"), vectors)
            found: list[tuple[np.ndarray, ...]] = []
            for low in range(0, len(ids), TILE):
                tile = postings_of(exact[low : low + TILE])
                names = ids[low : low + TILE]
                for at in range(0, len(own), STRIP):
                    scores = accumulate(points[at : at + STRIP], tile, len(names))
                    scores[own[at : at + STRIP, None] == names[None, :]] = lowest(scores.dtype)
                    r, c = best(scores, names, k)
                    found.append((r + at, names[c], scores[r, c].astype(np.int64)))
            r, name, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((name, -score, r))  # the tiles' best are merged to the block's best
            order = order[np.arange(r.size) - np.searchsorted(r[order], r[order]) < k]
            yield pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (own[r], copies[r], name, score)], schema=FOUND)

    return run


def search(rows: DataFrame, queries: Callable[[Column], Column], id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5, scale: float = 256.0, block_rows: int = 16_384) -> DataFrame:
    """The ``k`` other rows of largest inner product for each row whose id ``queries`` picks.

    query_id, rank (from 1), vec_id, score (whole, of vectors of ``floor(scale * x)``); ties go to the smaller id.
    """
    own = cut(whole_rows(rows, id_col, vector_col, scale=scale))
    blocks = block_count(own, own.count(), block_rows)
    held = own.select(F.pmod(F.xxhash64("id", "copy"), F.lit(blocks)).cast("int").alias("block"), "id", "copy", "vector")
    asks = own.where(queries(F.col("id"))).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "copy", "vector")
    found = by_block(held, asks, blocks, ["id", "copy"]).mapInArrow(_scan(k), "query_id bigint, copy bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Hard negatives by norm-bucketed search.

Candidates are ordered by norm and cut into buckets of equal counts (their edges are quantiles, 1,023 numbers at most);
a bucket of more than ``block_rows`` rows is dealt to several blocks. A task holds a block and walks it from the largest
norm down in slices. By Cauchy-Schwarz no row of a slice scores more than the anchor's norm times the slice's largest
norm: a slice is passed over for all anchors that need more than that, and the walk ends where all do. What an anchor
needs is its running k-th score or, for a negative, the lower limit of its window if that is more. Across tasks the same
test works in two waves: the bucket of the largest norms is searched first, and its k-th scores keep anchors away from
buckets that cannot better them before anything is shuffled.

Rows with a null id, label or vector, or a component that is null or, times ``scale``, not finite take no part; rows
equal in id, label and vector count once (``whole_rows``). Rows that share an anchor's id are neither its positives nor
its negatives; rows that share an id but differ otherwise are rows of their own. Ties go to smaller ids. A positive of a
negative score has no window, one of score 0 the window of score 0. Fewer rows than asked for give fewer results. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.vector_blocks import as_exact, best, block_count, by_block, kept, kind_of, lowest, matrix, numbers, streamed, whole_rows

#: Rows of one slice of a block, anchors scored against it at once, and norm buckets.
SLICE, STRIP, BUCKETS = 1024, 256, 1024
FOUND = pa.schema([("id", pa.int64()), ("copy", pa.int64()), ("window", pa.int32()), ("found", pa.int64()), ("score", pa.int64())])


def reach(norm: np.ndarray | Column, most: float | Column) -> np.ndarray | Column:
    """More than any score of vectors of these norms, roundings included."""
    return norm * most * (1 + 1e-9) + 1e-3


def kth_best(running: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k best of the running best and a slice's scores, row by row, the least of them first."""
    few = scores if scores.shape[1] <= k else np.partition(scores, -k, axis=1)[:, -k:]
    return np.sort(np.concatenate([running, few], axis=1), axis=1)[:, -k:]


def walk(points: np.ndarray, norms: np.ndarray, held: np.ndarray, tops: np.ndarray, ids: np.ndarray, allowed: Callable[[np.ndarray, slice], np.ndarray], low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """(anchor, window, candidate, score) of the k best candidates in each window, walked from the largest norm down.

    ``low`` and ``high`` limit the windows (anchors x windows); ``tops`` are the candidates' norms, falling.
    """
    kind = kind_of(points.dtype)
    none, low, high = lowest(kind), low.astype(kind), high.astype(kind)
    running = np.full((*low.shape, k), none, kind)
    out = []
    for at in range(0, len(ids), SLICE):
        here = slice(at, at + SLICE)
        needs = np.maximum(low, running[:, :, 0])
        live = np.flatnonzero(reach(norms, tops[at]) >= np.where(low > high, np.inf, needs).min(axis=1))
        if not live.size:
            break  # norms fall and needs only grow
        scores = kept(points[live] @ held[here].T)
        fair = allowed(live, here)
        for w in range(low.shape[1]):
            fit = np.where(fair & (scores >= needs[live, w, None]) & (scores <= high[live, w, None]), scores, none)
            r, c = best(fit, ids[here], k)
            if r.size:
                out.append((live[r], np.full(r.size, w), c + at, fit[r, c]))
                running[live, w] = kth_best(running[live, w], fit, k)
    return out


def _scan(k: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Best rows of a block for each window of each anchor: of the anchor's own label, or of any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for held, asks in streamed(batches):
            if held is not last:
                last, vectors, (ids, labels, tops) = held, matrix(held, "vector"), (numbers(held, c) for c in ("id", "label", "norm"))
            own, copies, wanted, norms = (numbers(asks, c) for c in ("id", "copy", "label", "norm"))
            points, exact = as_exact(matrix(asks, "vector"), vectors)
            low, high = (np.ascontiguousarray(matrix(asks, c, fill)) for c, fill in (("low", 1), ("high", 0)))
            for at in range(0, len(own), STRIP):
                strip = np.arange(at, min(at + STRIP, len(own)))
                # rows of one label are walked by themselves, so that positives meet their own label only
                turns = [(strip[wanted[strip] == x], np.flatnonzero(labels == x)) for x in np.unique(wanted[strip])] if same else [(strip, np.arange(len(ids)))]
                for who, rows in turns:
                    def allowed(live: np.ndarray, here: slice, who=who, rows=rows) -> np.ndarray:
                        other = own[who[live], None] != ids[rows[here]][None, :]
                        return other if same else other & (wanted[who[live], None] != labels[rows[here]][None, :])

                    found = walk(points[who], norms[who], exact[rows], tops[rows], ids[rows], allowed, low[who], high[who], k)
                    if found:
                        a, w, c, s = (np.concatenate(x) for x in zip(*found, strict=True))
                        names = ids[rows][c]
                        order = np.lexsort((names, -s, w, a))
                        group = (a * low.shape[1] + w)[order]
                        order = order[np.arange(len(group)) - np.searchsorted(group, group) < k]
                        yield pa.RecordBatch.from_arrays([pa.array(own[who][a[order]]), pa.array(copies[who][a[order]]), pa.array(w[order].astype(np.int32)), pa.array(names[order]), pa.array(s[order].astype(np.int64))], schema=FOUND)

    return run


class NormBuckets:
    """Rows (id, copy, label, vector, norm) in buckets of falling norm, each dealt to one block or more."""

    def __init__(self, rows: DataFrame, block_rows: int):
        n = rows.count()
        self.count = min(BUCKETS, block_count(rows, n, block_rows))
        edges = np.unique(rows.approxQuantile("norm", [i / self.count for i in range(1, self.count)], 0.2 / self.count))[::-1] if n and self.count > 1 else np.empty(0)

        @F.pandas_udf("int")
        def bucket(norm: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(-edges, -norm.to_numpy(), side="left").astype(np.int32))

        self.rows = rows.withColumn("bucket", bucket("norm"))
        sizes = {r["bucket"]: (r["n"], r["top"]) for r in self.rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}
        self.used = sorted(sizes)  # BUCKETS rows at most
        self.tops = [sizes[b][1] for b in self.used]
        self.blocks = [-(-sizes[b][0] // block_rows) for b in self.used]

    def scan(self, asks: DataFrame, first: int, last: int, k: int, same: bool) -> DataFrame:
        """(id, copy, window, found, score): the k best of the buckets ``first`` to ``last`` for each window, and a few more.

        ``asks``: id, copy, label, vector, norm, low and high (whole limits of each window). Anchors go to buckets only that reach one of their windows.
        """
        used, blocks = self.used[first:last], self.blocks[first:last]
        starts = np.concatenate([[0], np.cumsum(blocks)]).astype(int).tolist()
        place = {b: i for i, b in enumerate(used)}
        at = F.get(F.lit([place.get(b, -1) for b in range(max(self.used) + 1)]), F.col("bucket"))
        held = self.rows.withColumn("at", at).where("at >= 0")
        held = held.withColumn("block", (F.get(F.lit(starts[:-1]), F.col("at")) + F.pmod(F.xxhash64("id", "copy"), F.get(F.lit(blocks), F.col("at")))).cast("int"))
        none = F.array().cast("array<bigint>")
        held = held.select("block", "id", "copy", "label", "vector", "norm", none.alias("low"), none.alias("high"))
        need = F.array_min(F.transform(F.arrays_zip("low", "high"), lambda w: F.when(w["low"] <= w["high"], w["low"])))
        met = F.filter(F.sequence(F.lit(0), F.lit(len(used) - 1)), lambda i: reach(F.col("norm"), F.get(F.lit(self.tops[first:last]), i)) >= need)
        every = F.flatten(F.transform(met, lambda i: F.sequence(F.get(F.lit(starts), i), F.get(F.lit(starts), i + 1) - 1)))
        asked = asks.select(F.explode(every).alias("block"), "id", "copy", "label", "vector", "norm", "low", "high")
        dealt = by_block(held, asked, starts[-1], [F.desc("norm"), F.col("id")])
        return dealt.mapInArrow(_scan(k, same), "id bigint, copy bigint, window int, found bigint, score bigint")

    def search(self, asks: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best rows of each window, as (id, copy, window, rank, found, score)."""
        windows = ["id", "copy", "window"]
        order = Window.partitionBy(*windows).orderBy(F.desc("score"), "found")
        ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*windows, "rank", "found", "score")
        found = self.scan(asks, 0, 1, k, same)
        if len(self.used) > 1:
            found = cut(ranked(found))
            held = found.where(F.col("rank") == k).groupBy("id", "copy").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("held"))
            kept = asks.join(held, ["id", "copy"], "left")
            kept = kept.withColumn("low", F.transform("low", lambda x, w: F.greatest(x, F.element_at("held", w)))).drop("held")
            found = found.drop("rank").unionByName(self.scan(kept, 1, len(self.used), k, same))
        return ranked(found)


def mine(rows: DataFrame, anchors: Callable[[Column], Column], id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, block_rows: int = 16_384) -> DataFrame:
    """Hard negatives of each row whose id ``anchors`` picks, for each of its best ``positives`` rows of its own label.

    A negative has another label and a score of ``low`` to ``high`` percent of the positive's. anchor_id, positive_id,
    rank (from 1), negative_id, positive_score, negative_score; scores are inner products of ``floor(scale * x)``.
    """
    if not 0 <= low <= high:
        raise ValueError("a window goes from its lower to its higher share")
    own = whole_rows(rows, id_col, vector_col, label_col, scale=scale).withColumnRenamed(label_col, "label").withColumn("label", F.col("label").cast("bigint"))
    own = cut(own.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))))
    buckets = NormBuckets(own, block_rows)
    if not buckets.used:
        return own.select(F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), F.lit(1).alias("rank"), F.col("id").alias("negative_id"), F.col("id").alias("positive_score"), F.col("id").alias("negative_score"))
    asks = own.where(anchors(F.col("id")))
    whole = [F.array(F.lit(x)).alias(name) for name, x in (("low", -(2**63)), ("high", 2**63 - 1))]
    best = cut(buckets.search(asks.select("*", *whole), positives, True))

    part, rest = F.expr("score div 100"), F.expr("score % 100")
    limits = best.where("score >= 0").select("id", "copy", "rank", (part * low + F.ceil(rest * low / 100)).alias("lo"), (part * high + F.floor(rest * high / 100)).alias("hi"))
    by_rank = lambda c, fill: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.element_at(c, i), F.lit(fill)))
    windows = limits.groupBy("id", "copy").agg(*[F.map_from_entries(F.collect_list(F.struct("rank", c))).alias(c) for c in ("lo", "hi")])
    windows = windows.select("id", "copy", by_rank("lo", 1).cast("array<bigint>").alias("low"), by_rank("hi", 0).cast("array<bigint>").alias("high"))
    found = buckets.search(asks.join(windows, ["id", "copy"]), negatives, False)
    pairs = best.select("id", "copy", (F.col("rank") - 1).alias("window"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pairs, ["id", "copy", "window"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

"""Approximate nearest neighbours with learned partitions.

Fit, on bounded samples, at two levels (the lower has one part more): a
nearest-neighbour graph of the sample is cut into balanced partitions
(recursive halving, then moves of nodes to the partition where most of their
neighbours are, within a size limit), and a small softmax classifier learns in
which partitions a vector's neighbours lie. The upper level is fitted on a sample of all
vectors, the lower ones each on a sample of one upper partition, by the
executors. Partitions grow in number with the square root of the rows (``per_level``),
so work grows with rows to the power of one and a half. The number of
partitions a query visits is the smallest for which held-out sample queries
surely find the wanted share of their true neighbours.

Index: every row goes to its most probable partition, and partitions are cut
into blocks of bounded size. Search: a query visits its most probable
partitions (all of them if these hold fewer than ``k`` other rows); a task holds
one block and streams queries past it, keeps each query's best rows, and the
best over all blocks are the answer. Scores are
cosines in double precision on the original vectors, computed pair by pair, so
equal vectors score exactly alike. Vectors are first scaled by a power of two,
which changes no score but those whose squares would leave the range of
doubles.

Rows with equal vectors can only differ in id, so of each vector only the
``k`` + 1 rows with the smallest ids can be among a query's ``k`` nearest; the
others are left out of the blocks without changing any answer.

Vectors that are null, empty, zero, or hold null or non-finite components take
no part, neither do rows with a null id or with another number of dimensions
than most. Rows that repeat id and vector count once. Fewer than ``k``
candidates give fewer rows. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bare, cut


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component lies between a half and one."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def cosine(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Cosines of paired rows; each depends on its own two vectors alone."""
    one, many = scaled(one), scaled(many)
    dot = (one * many).sum(axis=1)
    return dot / (np.sqrt((one * one).sum(axis=1)) * np.sqrt((many * many).sum(axis=1)))


def neighbour_graph(points: np.ndarray, degree: int) -> np.ndarray:
    """(n, degree) nearest other points by cosine, computed in strips."""
    n = len(points)
    degree = min(degree, n - 1)
    out = np.empty((n, degree), np.int64)
    for at in range(0, n, 512):
        near = points[at : at + 512] @ points.T
        near[np.arange(near.shape[0]), np.arange(at, at + near.shape[0])] = -np.inf
        out[at : at + 512] = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(points: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 20, slack: float = 1.1) -> np.ndarray:
    """A partition number for each point; no partition over ``slack`` times its even share."""
    label = np.zeros(len(points), np.int64)
    todo = [(np.arange(len(points)), 0, parts)]
    while todo:  # halve along the main direction, in proportion to the parts wanted
        members, first, wanted = todo.pop()
        if wanted == 1:
            label[members] = first
            continue
        own = points[members] - points[members].mean(axis=0)
        _, _, axes = np.linalg.svd(own.T @ own) if len(own) else (0, 0, np.zeros((1, points.shape[1])))
        order = members[np.argsort(own @ axes[0], kind="stable")]
        left = wanted // 2
        at = len(order) * left // wanted
        todo += [(order[:at], first, left), (order[at:], first + left, wanted - left)]
    limit = int(np.ceil(slack * len(points) / parts))
    load = np.bincount(label, minlength=parts)
    for _ in range(sweeps):
        votes = np.zeros((len(points), parts))
        np.add.at(votes, (np.repeat(np.arange(len(points)), graph.shape[1]), label[graph].ravel()), 1.0)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1.0)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(points)), best] - votes[np.arange(len(points)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if load[best[i]] < limit:
                load[label[i]] -= 1
                load[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def neighbour_shares(graph: np.ndarray, label: np.ndarray, parts: int) -> np.ndarray:
    """The share of each point's neighbours that lie in each partition."""
    out = np.zeros((len(graph), parts))
    np.add.at(out, (np.repeat(np.arange(len(graph)), graph.shape[1]), label[graph].ravel()), 1.0 / graph.shape[1])
    return out


def fit_softmax(points: np.ndarray, shares: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a softmax classifier that foretells ``shares``, by Adam on mini-batches."""
    rng = np.random.default_rng(seed)
    parts = shares.shape[1]
    w, b = np.zeros((points.shape[1], parts)), np.zeros(parts)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        pick = rng.integers(0, len(points), min(1024, len(points)))
        x = points[pick]
        p = _softmax(8.0 * (x @ w + b)) - shares[pick]
        for i, (value, grad) in enumerate(((w, x.T @ p / len(x) + decay * w), (b, p.mean(axis=0)))):
            m, v = state[2 * i], state[2 * i + 1]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w, b


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Level:
    """Names a unit vector's partition at one level."""

    weights: np.ndarray
    bias: np.ndarray

    def chances(self, points: np.ndarray) -> np.ndarray:
        """Logarithms of the probabilities of the partitions."""
        z = 8.0 * (points @ self.weights + self.bias)
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Router:
    """Names a vector's partitions, the most probable first."""

    upper: Level
    lower: tuple[Level, ...]
    visits: int = 1

    @property
    def parts(self) -> int:
        return sum(len(x.bias) for x in self.lower)

    def order(self, points: np.ndarray, first: int) -> np.ndarray:
        out = []
        for at in range(0, len(points), 1024):
            own = unit(points[at : at + 1024])
            above = self.upper.chances(own)
            score = np.concatenate([above[:, i : i + 1] + x.chances(own) for i, x in enumerate(self.lower)], axis=1)
            out.append(np.argsort(-score, axis=1, kind="stable")[:, :first])
        return np.concatenate(out) if out else np.empty((0, first), np.int64)


def per_level(n: int) -> int:
    """Parts of the upper level for ``n`` rows: their square is about a fifth of the root of n."""
    return max(2, round(n**0.25 / 2.2))


def fit_level(points: np.ndarray, parts: int, degree: int = 12) -> Level:
    """Balanced parts of the graph of unit vectors, and the classifier that names them."""
    parts = max(1, min(parts, len(points) // 8))
    if parts == 1:
        return Level(np.zeros((points.shape[1], 1)), np.zeros(1))
    graph = neighbour_graph(points, degree)
    return Level(*fit_softmax(points, neighbour_shares(graph, balanced_parts(points, graph, parts), parts)))


def visits_for(router: Router, teach: np.ndarray, held: np.ndarray, *, k: int, wanted: float) -> int:
    """The fewest partitions in which held-out queries find the wanted share of their nearest sample vectors."""
    if not len(held) or len(teach) <= k:
        return router.parts
    order = router.order(held, router.parts)
    rank = np.argsort(order, axis=1)  # where each partition stands in a query's order
    home = router.order(teach, 1)[:, 0]
    near = np.concatenate([np.argpartition(-(unit(held[at : at + 512]) @ unit(teach).T), k - 1, axis=1)[:, :k] for at in range(0, len(held), 512)])
    at = rank[np.arange(len(near))[:, None], home[near]]
    # found with 95 % confidence (Wilson's lower bound): few queries prove little
    z, n = 1.96**2, at.size
    share = np.array([(at < m).mean() for m in range(1, router.parts + 1)])
    sure = (share + z / (2 * n) - np.sqrt(z * (share * (1 - share) / n + z / (4 * n * n)))) / (1 + z / n)
    return 1 + int(np.argmax(sure >= wanted)) if (sure >= wanted).any() else router.parts


def usable(vector: Column) -> Column:
    """A vector that takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def fit_router(rows: DataFrame, n: int, *, k: int, sample_rows: int, wanted: float) -> Router:
    """A router for ``n`` rows (vector, print).

    What reaches the driver is ``sample_rows`` vectors and a lower level of each
    upper partition; an executor holds ``sample_rows`` vectors of one partition.
    """
    parts = per_level(n)
    draw = F.pmod("print", F.lit(1 << 30)) / float(1 << 30)
    held = F.pmod(F.xxhash64("print"), F.lit(5)) == 0  # these teach nothing and set the number of visits
    own = rows.dropDuplicates(["print"]).withColumn("held", held)
    picked = own.where(draw <= min(1.0, 1.2 * sample_rows / n)).orderBy("print").limit(sample_rows).select("vector", "held").collect()
    sample, aside = np.array([r["vector"] for r in picked]), np.array([r["held"] for r in picked], bool)
    teach = sample[~aside] if (~aside).any() else sample
    upper = fit_level(unit(teach), parts)
    seen = _routed(own.where(~held & (draw <= min(1.0, 1.5 * parts * sample_rows / n))).select(F.col("print").alias("id"), "vector"), Router(upper, (Level(np.zeros((sample.shape[1], 1)), np.zeros(1)),) * len(upper.bias)), 1)
    few = seen.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("id"))).where(F.col("r") <= sample_rows).select("part", "vector")

    def below(group: pa.Table) -> pa.Table:
        level = fit_level(unit(_matrix(group.column(1).combine_chunks())), parts + 1)
        return pa.table({"part": [group.column(0)[0].as_py()], "weights": [level.weights.ravel().tolist()], "bias": [level.bias.tolist()]}, schema=pa.schema([("part", pa.int32()), ("weights", pa.list_(pa.float64())), ("bias", pa.list_(pa.float64()))]))

    fitted = {r["part"]: Level(np.array(r["weights"]).reshape(sample.shape[1], -1), np.array(r["bias"])) for r in few.groupBy("part").applyInArrow(below, "part int, weights array<double>, bias array<double>").collect()}
    one = Level(np.zeros((sample.shape[1], 1)), np.zeros(1))
    router = Router(upper, tuple(fitted.get(i, one) for i in range(len(upper.bias))))
    return replace(router, visits=visits_for(router, teach, sample[aside], k=k, wanted=wanted))


def search(rows: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5, sample_rows: int = 6000, block_rows: int = 8192, wanted: float = 0.97) -> DataFrame:
    """The ``k`` nearest other rows of each row for which ``queries`` holds.

    query_id, rank (from 1), vec_id, score; ties go to the smaller id.
    ``queries`` is a condition on the id column.
    """
    slim = bare(rows, id_col, vector_col).toDF("id", "vector").withColumn("id", F.col("id").cast("bigint"))
    good = slim.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("vector", F.col("vector").cast("array<double>"))
    widths = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = good.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    if not widths:
        return empty
    good = good.where(F.size("vector") == widths[0]["d"]).withColumn("print", F.xxhash64("vector"))
    same = Window.partitionBy("print", "vector").orderBy("id")
    kept = cut(good.dropDuplicates(["id", "vector"]).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).select("id", "vector", "print"))
    router = fit_router(kept, kept.count(), k=k, sample_rows=sample_rows, wanted=wanted)

    index = cut(_routed(kept, router, 1))
    sizes = cut(index.groupBy("part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")))
    sizes = F.broadcast(sizes)  # a row for each partition: about per_level(n) squared
    held = index.join(sizes, "part").select("part", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(0).alias("role"), "id", "vector")
    # queries may have been left out of the index as repeated vectors: they are taken from all rows
    asked = good.where(queries(F.col("id")) if callable(queries) else queries).dropDuplicates(["id", "vector"]).select("id", "vector")

    def scanned(asked: DataFrame, visits: int) -> DataFrame:
        asks = _routed(asked, router, visits).join(sizes, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "id", "vector")
        dealt = held.unionByName(asks).repartition("part", "block").sortWithinPartitions("part", "block", "role", "id")
        return dealt.mapInArrow(_scan(k), "query_id bigint, vec_id bigint, score double")

    found, parts = scanned(asked, router.visits), router.parts
    if router.visits < parts:
        # queries whose partitions hold too few rows search them all
        found = cut(found)
        served = found.groupBy(F.col("query_id").alias("id")).agg(F.countDistinct("vec_id").alias("c")).where(F.col("c") >= k)
        short = cut(asked.join(served, "id", "left_anti"))
        if not short.isEmpty():
            found = found.unionByName(scanned(short, parts))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _routed(rows: DataFrame, router: Router, visits: int) -> DataFrame:
    """(part, id, vector): a row for each of the ``visits`` most probable partitions."""
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            points = _matrix(b.column(1))
            order = shared.value.order(points, visits)
            times = pa.array(np.repeat(np.arange(b.num_rows), order.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype(np.int32)), b.column(0).take(times), b.column(1).take(times)], ["part", "id", "vector"])

    return rows.select("id", "vector").mapInArrow(run, "part int, id bigint, vector array<double>")


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scan(k: int):
    """Streams (part, block, role, id, vector), held rows of a block first, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, vectors, ready = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            part, block, role, own = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            points = _matrix(b.column(4))
            edge = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0)) + 1
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, hi in zip([0, *edge], [*edge, b.num_rows], strict=True):
                if (part[lo], block[lo]) != here:
                    here, ids, vectors, ready = (part[lo], block[lo]), [], [], None
                if role[lo] == 0:
                    ids.append(own[lo:hi])
                    vectors.append(points[lo:hi])
                elif ids:
                    if ready is None:
                        ready = np.concatenate(ids), np.concatenate(vectors)
                        flat = unit(ready[1])
                    for at in range(lo, hi, 256):
                        out += _best(own[at : min(at + 256, hi)], points[at : min(at + 256, hi)], *ready, flat, k)
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    return run


def _best(asked: np.ndarray, asks: np.ndarray, ids: np.ndarray, vectors: np.ndarray, flat: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each query's k best of a block, picked by exact score among those near enough to matter."""
    rough = unit(asks) @ flat.T
    rough[asked[:, None] == ids[None, :]] = -np.inf
    out = []
    for i, row in enumerate(rough):
        least = np.partition(row, -k)[-k] if row.size > k else -2.0
        at = np.flatnonzero(row >= max(least - 1e-9, -2.0))
        score = cosine(np.broadcast_to(asks[i], (at.size, asks.shape[1])), vectors[at])
        top = np.lexsort((ids[at], -score))[:k]
        out.append((np.full(top.size, asked[i]), ids[at][top], score[top]))
    return out

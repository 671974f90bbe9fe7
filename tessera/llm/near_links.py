"""From registers to components: candidates by banding, estimation, exact verification.

Sets that share a bucket are candidates. All pairs of a bucket are never
emitted. First every member meets the bucket's smallest node: those estimated
near enough are verified, and the links give components. Then only buckets
that still mix components are revisited: the full sets of the members outside
the bucket's main component are held in bounded blocks, and all members stream
past them. After that every pair that shares a bucket is in one component or
has been compared on full sets, so components lose nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard, joined, stored
from tessera.llm.components import components
from tessera.llm.hyperminhash import banded, likely, linked


def near_components(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], *, percent: int, bands: int, rows: int, slack: float) -> DataFrame:
    """(node, component) of the linked classes.

    ``classes`` has (node bigint, n bigint, sig binary), already cut from its
    lineage; ``sets_of`` gives (node, members binary) for a DataFrame of nodes.
    Pairs estimated below percent/100 - slack are not verified.
    """
    least = percent / 100 - slack
    # a set of fewer than percent/(100-percent) members is as similar as that only to its equal
    able = classes.where(F.col("n") * (100 - percent) >= percent - (100 - percent) + 1) if percent < 100 else classes.limit(0)
    keys = banded(able, bands, rows)
    shared = cut(keys.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("size")).where("size > 1"))
    members = stored(joined(keys, shared, ["key"]))

    met = stored(members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    # texts are read again once, for the sets of all that share a bucket with another
    sets = stored(sets_of(members.select("node").distinct()))
    stars = cut(likely(met, able, least, percent))
    discard(met)
    links = cut(linked(stars, sets, percent))
    so_far = components(links)

    rest = members.where("size > 2 and node <> first").join(so_far, "node", "left")
    placed = stored(rest.select("key", "node", F.coalesce("component", "node").alias("component")))
    discard(members)
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key")
    mixed = cut(parts.agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("total")).where("most < total"))
    tagged = stored(joined(placed, mixed, ["key"], "total"))
    discard(placed)
    blocks, parts = F.ceil((F.col("total") - F.col("most")) / 256).cast("int"), F.ceil(F.col("total") / 1024).cast("int")
    dealt = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = tagged.where("component <> main").select("key", dealt(1, blocks).alias("block"), every(parts).alias("part"), F.lit(0).alias("role"), "node", "component")
    passing = tagged.select("key", every(blocks).alias("block"), dealt(2, parts).alias("part"), F.lit(1).alias("role"), "node", "component")
    more = cut(_met_in_blocks(held.unionByName(passing).join(sets, "node"), percent))
    discard(sets, tagged)
    if more.isEmpty():
        return so_far
    return components(links.unionByName(more))


def _met_in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the held (role 0) and the passing sets (role 1) of each (key, block, part).

    A task holds the sets of one block; the others stream by in any number, and
    their overlaps with all held sets are counted at once. Of the links found,
    a group returns those that join components it hasn't joined yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, block = None, None
        for b in batches:
            links: list[tuple[int, int]] = []
            cols = [b.column(i).to_pylist() for i in range(6)]
            for key, no, part, role, node, component, members in zip(*cols, b.column(6), strict=True):
                if (key, no, part) != here:
                    here, block = (key, no, part), _Block(percent)
                own = np.frombuffer(members.as_buffer(), np.uint64)
                if role == 0:
                    block.hold(node, component, own)
                else:
                    links += block.meet(node, component, own)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    dealt = rows.repartition("key", "block", "part").sortWithinPartitions("key", "block", "part", "role", "node")
    return dealt.select("key", "block", "part", "role", "node", "component", "members").mapInArrow(run, "a bigint, b bigint").distinct()


class _Block:
    """Some sets, indexed by member, and the components known to be joined."""

    def __init__(self, percent: int):
        self.percent, self.nodes, self.parts, self.sets, self.index, self.joined = percent, [], [], [], None, {}

    def hold(self, node: int, component: int, members: np.ndarray) -> None:
        self.nodes.append(node)
        self.parts.append(component)
        self.sets.append(members)
        self.index = None

    def root(self, component: int) -> int:
        while component in self.joined:
            component = self.joined[component]
        return component

    def meet(self, node: int, component: int, members: np.ndarray) -> list[tuple[int, int]]:
        if not self.nodes:
            return []
        if self.index is None:
            sizes = np.array([s.size for s in self.sets])
            every = np.concatenate(self.sets)
            order = np.argsort(every, kind="stable")
            self.index = every[order], np.repeat(np.arange(sizes.size), sizes)[order], sizes
        values, owner, sizes = self.index
        lo, hi = np.searchsorted(values, members, "left"), np.searchsorted(values, members, "right")
        times = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
        common = np.bincount(owner[at], minlength=sizes.size)
        out = []
        for i in np.flatnonzero(100 * common >= self.percent * (sizes + members.size - common)):
            x, y = self.root(self.parts[i]), self.root(component)
            if x != y:
                self.joined[max(x, y)] = min(x, y)
                out.append((min(node, self.nodes[i]), max(node, self.nodes[i])))
        return out

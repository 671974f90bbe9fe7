"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table (a
permutation given by an offset and a stride drawn from its name). Shards take
turns claiming their next free slot until the table is full. The table has a
fixed size, is broadcast, and places any key in constant time; adding or
removing a shard moves few keys besides those it gains or loses.

Rows whose key is null are placed by the fallback columns instead, so that
they spread; rows where these are null too share one slot. Repeated rows share
a shard. Extra columns pass through unless they clash with ``slot``/``shard``,
which are then replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots in the table (prime, over 100 times the largest number of shards meant here).
SLOTS = 65_537


def _draw(name: str, what: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{what}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """The shard number of each slot. A shard of weight w claims w slots a turn."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be distinct, one at least")
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    turns = weights or [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("each shard needs a weight of 1 or more")
    place = [_draw(s, "offset") % slots for s in shards]
    stride = [_draw(s, "stride") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for i, times in enumerate(turns):
            for _ in range(min(times, free)):
                while table[place[i]] >= 0:
                    place[i] = (place[i] + stride[i]) % slots
                table[place[i]] = i
                free -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: its MD5's first 60 bits, modulo the table's size."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: list[str] | int = 64, *, fallback: tuple[str, ...] = (), slots: int = SLOTS, weights: list[int] | None = None, salt: str | None = None, salts: int = 1) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; no shuffle.

    With ``salt`` (a column) and ``salts`` > 1, rows of one key spread over that
    many slots: the way to shard by a key that may hold a third of all rows.
    """
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    spark = df.sparkSession
    filled = spark.createDataFrame(list(enumerate(lookup_table(names, slots, weights))), "__slot int, __shard int")
    texts = [F.col(f"`{key}`").cast("string"), *[F.concat(F.lit("\0"), F.sha2(F.col(f"`{c}`").cast("string"), 256)) for c in fallback]]
    whole = F.coalesce(*texts, F.lit("\0"))
    if salt and salts > 1:
        whole = F.concat(whole, F.lit("#"), F.coalesce(F.pmod(F.xxhash64(F.col(f"`{salt}`")), F.lit(salts)), F.lit(0)).cast("string"))
    keep = [c for c in df.columns if c not in ("slot", "shard")]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], slot_of(whole, slots).alias("slot"))
    # the table has a fixed number of slots: a proven bound on what is broadcast
    return rows.join(F.broadcast(filled), F.col("slot") == F.col("__slot"), "left").select(*keep, "slot", F.col("__shard").alias("shard"))


def write_shards(df: DataFrame, path: str, **kwargs) -> None:
    """Write a folder per shard: each task writes its part of every shard, nothing is gathered."""
    place(df, **kwargs).write.partitionBy("shard").parquet(path)

"""Index generations: Parquet tables in buckets, lists of their files, and a pointer to the active list.

``FORMAT``, ``ACTIVE/<fence>-<n>``, ``generations/<id>/meta.json`` and ``data/<table>/<write>/bucket=<b>``. A generation
is a list: for each table and bucket of record ids the folder that holds its rows. Nothing that a list names is ever
changed, so a new generation shares the folders of all buckets that its ingest didn't touch.

A reader pins the generation that is active, so it needs no lock to read; one that must not lose it to
``drop_inactive`` holds a shared lock, a file under ``READERS``. A writer holds a lease, a file under ``FENCES`` whose
number is the writer's fence. Numbers only grow, and of two contenders for one only the first gets it. Pointers are named
by fence, and the highest is the active one: a writer that was stalled beyond its lease and wakes up after a successor
published can't undo that, whatever it still does. Leases and shared locks name when they end, so that one left behind
by a crashed process counts no more after that.
Files are reached through Hadoop's file systems, so a store may lie anywhere Spark can write.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.index import parity_problems

FORMAT = "4"
LOCATOR = ["record_id", "fingerprint", "value_path", "ordinal"]
_AT = "chunk_id string, record_id string, fingerprint string, value_path string, ordinal int"
#: Each table's columns; all but ``link``, whose key is ``successor_id``, are dealt to buckets by ``record_id``.
COLUMNS = {
    "chunk": f"{_AT}, text string, evidence_tokens int, input_tokens int",
    "vector": f"{_AT}, vector array<double>",
    "tag": "record_id string, tag string",
    "chunk_source": "chunk_id string, record_id string, path string, section string",
    "snapshot": "record_id string, title string, status string, supersedes string, fingerprint string",
    "ledger": "record_id string, state string, desired_fingerprint string, active_fingerprint string, entry_digest string, record_digest string, failure_code string, removal_reason string, changed_at string",
    "link": "successor_id string, predecessor_id string, evidence_id string",
}
TABLES = tuple(COLUMNS)
#: Records that one bucket is made for, and the most buckets.
BUCKET_RECORDS, MOST_BUCKETS = 20_000, 4096
#: Seconds for which a lease whose text can't be read yet counts as held.
GRACE = 60.0


class StoreError(Exception):
    """The store cannot be used as asked."""


def buckets_for(records: int) -> int:
    return min(MOST_BUCKETS, max(8, -(-records // BUCKET_RECORDS)))


def bucket_of(record_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(record_id), F.lit(buckets)).cast("int")


class Store:
    """Generations of the index's tables, or with ``columns`` (name: columns as DDL) and ``keys`` (name: its key) of others."""

    def __init__(self, spark: SparkSession, root: str, columns: dict[str, str] | None = None, keys: dict[str, str] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.columns, self.keys = columns or COLUMNS, keys or {"link": "successor_id"}
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fence: int | None = None

    # --- small files ---

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def _names(self, name: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(name))) if self._exists(name) else []

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Replace a small file in one step: written aside, then renamed over."""
        aside = self._path(f".{name.replace('/', '-')}-{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        self._fs.mkdirs(self._path(name).getParent())
        context.rename(aside, self._path(name), options)

    def _create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet; of several that try, one succeeds."""
        path = self._path(name)
        if self._fs.getScheme() == "file":  # Hadoop's local file system tests and creates in two steps
            self._fs.mkdirs(path.getParent())
            if not self.spark._jvm.java.io.File(path.toUri().getPath()).createNewFile():
                return False
        try:
            out = self._fs.create(path, self._fs.getScheme() == "file")
        except Exception:
            return False
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _delete(self, name: str, whole: bool = False) -> None:
        self._fs.delete(self._path(name), whole)

    # --- generations ---

    def _pointer(self) -> str | None:
        """The name of the highest pointer."""
        names = [n for n in self._names("ACTIVE") if n[:1].isdigit()]
        return names[-1] if names else None

    def active(self) -> str | None:
        for _ in range(5):
            if (pointer := self._pointer()) is None:
                return None
            if (found := self._read("FORMAT").strip()) != FORMAT:
                raise StoreError(f"store format {found}, this engine reads {FORMAT}")
            try:
                return self._read(f"ACTIVE/{pointer}").strip()
            except Exception:  # a newer pointer came and this one went
                if self._pointer() == pointer:
                    raise
        raise StoreError("the active generation keeps changing")

    def meta(self, generation: str | None = None) -> dict:
        generation = generation or self.active()
        return json.loads(self._read(f"generations/{generation}/meta.json")) if generation else {}

    def files(self, name: str, generation: str, buckets: Iterable[int] | None = None) -> list[str]:
        """The folders of a table, of all buckets or of some."""
        listed = self.meta(generation)["files"].get(name, {})
        return [f"{self.root}/{path}" for b, path in sorted(listed.items()) if buckets is None or int(b) in buckets]

    def table(self, name: str, generation: str | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        generation = generation or self.active()
        if generation is None:
            raise StoreError("the store has no active generation")
        return self.read(name, self.files(name, generation, buckets))

    def read(self, name: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.columns[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.columns[name])

    def write(self, name: str, rows: DataFrame, buckets: int) -> dict[str, str]:
        """Write rows of a table; the folder of each bucket that has any. No generation names them yet."""
        key = self.keys.get(name, "record_id")
        folder = f"data/{name}/{uuid.uuid4().hex}"
        dealt = rows.selectExpr(*[f"cast({f.name} as {f.dataType.simpleString()}) as {f.name}" for f in self.read(name, []).schema])
        dealt.withColumn("bucket", bucket_of(F.col(key), buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        return {n.partition("=")[2]: f"{folder}/{n}" for n in self._names(folder) if n.startswith("bucket=")}

    def publish(self, files: dict[str, dict[str, str]], meta: dict, base: str | None) -> str:
        """Make a generation of these folders the active one, if ``base`` still is and no other writer took over."""
        with self.as_writer():
            if self.active() != base:
                raise StoreError("another generation was published meanwhile")
            generation = uuid.uuid4().hex
            self._write(f"generations/{generation}/meta.json", json.dumps(meta | {"files": files, "fence": self.fence}, sort_keys=True))
            if self._highest() != self.fence:
                raise StoreError("the lease ran out and another writer took over; nothing was published")
            if not self._exists("FORMAT"):
                self._write("FORMAT", FORMAT)
            mine = [int(n.partition("-")[2]) for n in self._names("ACTIVE") if n.startswith(f"{self.fence:012d}-")]
            pointer = f"{self.fence:012d}-{max(mine, default=0) + 1:06d}"
            self._write(f"ACTIVE/{pointer}", generation)
            if self._pointer() != pointer:
                raise StoreError("another writer took over; nothing was published")
            for n in self._names("ACTIVE"):
                if n[:1].isdigit() and n < pointer:
                    self._delete(f"ACTIVE/{n}")
            return generation

    def upsert(self, name: str, rows: DataFrame, order: list[str], batch: tuple[str, int], buckets: int = 64) -> bool:
        """Keep of each key the row that is last by ``order``, old or new; False if the store has seen this batch.

        Only buckets of the keys in ``rows`` are written. As the last row doesn't depend on when rows come, late and repeated ones do no harm.
        """
        key = self.keys.get(name, "record_id")
        with self.as_writer():
            base = self.active()
            meta = self.meta(base) if base else {"buckets": buckets, "batches": {}, "files": {}}
            if meta["batches"].get(batch[0], -1) >= batch[1]:
                return False
            buckets, listed = meta["buckets"], meta["files"].get(name, {})
            touched = {r["b"] for r in rows.select(bucket_of(F.col(key), buckets).alias("b")).distinct().collect()}  # a number for each bucket at most
            old = self.read(name, [f"{self.root}/{path}" for b, path in listed.items() if int(b) in touched])
            rest = [c for c in old.columns if c not in (key, *order)]
            last = old.unionByName(rows.select(*old.columns)).groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(key, "r.*")
            files = {b: path for b, path in listed.items() if int(b) not in touched} | (self.write(name, last, buckets) if touched else {})
            self.publish(meta["files"] | {name: files}, {k: v for k, v in meta.items() if k not in ("files", "fence")} | {"batches": meta["batches"] | {batch[0]: batch[1]}}, base)
            return True

    # --- locks ---

    def _ends(self, name: str) -> float:
        """When a lease or shared lock ends; 0 if it is given back or gone."""
        try:
            return float(self._read(name))
        except Exception:  # being written, or gone
            return self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000 + GRACE if self._exists(name) else 0.0

    def _highest(self) -> int:
        return max((int(n) for n in self._names("FENCES") if n.isdigit()), default=0)

    @contextmanager
    def writing(self, lease: float = 86_400.0) -> Iterator[Store]:
        """Hold the writer's lease for ``lease`` seconds at most; a second writer fails at once."""
        last = self._highest()
        if last and self._ends(f"FENCES/{last:012d}") > time.time():
            raise StoreError("another writer holds the store")
        own = last + 1
        if not self._create(f"FENCES/{own:012d}", str(time.time() + lease)):
            raise StoreError("another writer holds the store")
        for n in self._names("FENCES"):
            if n.isdigit() and int(n) < own:
                self._delete(f"FENCES/{n}")
        self.fence = own
        try:
            yield self
        finally:
            self.fence = None
            if self._highest() == own:  # a successor's lease is left alone; the number stays taken
                self._write(f"FENCES/{own:012d}", "0")

    def as_writer(self) -> AbstractContextManager:
        """The lease this store holds, or one for the occasion."""
        return nullcontext(self) if self.fence else self.writing()

    @contextmanager
    def reading(self, lease: float = 86_400.0) -> Iterator[Store]:
        """Hold a shared lock: any number at once, and no generation goes meanwhile."""
        name = f"READERS/{uuid.uuid4().hex}"
        self._create(name, str(time.time() + lease))
        try:
            yield self
        finally:
            self._delete(name)

    def readers(self) -> int:
        return sum(self._ends(f"READERS/{n}") > time.time() for n in self._names("READERS") if not n.startswith("."))

    # --- upkeep ---

    def problems(self) -> list[str]:
        """What is wrong with the active generation: missing or unreadable tables, other columns, chunks without vectors."""
        active = self.active()
        if active is None:
            return ["no active generation"]
        found, listed = [], self.meta(active)["files"]
        for name in self.columns:
            wanted = set(self.read(name, []).columns)
            if name not in listed:
                found.append(f"{name}: not listed")
                continue
            try:
                paths = self.files(name, active)
                columns = set(self.spark.read.parquet(*paths).columns) if paths else wanted
            except Exception as e:
                found.append(f"{name}: {type(e).__name__}")
                continue
            if lost := wanted - columns:
                found.append(f"{name}: no column {', '.join(sorted(lost))}")
        if not found and "vector" in self.columns and not parity_problems(self.table("chunk", active), self.table("vector", active), LOCATOR).isEmpty():
            found.append("chunks and vectors do not match")
        return found

    def drop_inactive(self) -> list[str]:
        """Delete generations other than the active one, and folders that it doesn't name; refused while readers hold the store."""
        with self.as_writer():
            active = self.active()
            if active is None:
                return []
            if self.readers():
                raise StoreError("readers hold the store")
            gone = [n for n in self._names("generations") if n != active]
            for n in gone:
                self._delete(f"generations/{n}", True)
            named = {path for listed in self.meta(active)["files"].values() for path in listed.values()}
            for table in self._names("data"):
                for write in self._names(f"data/{table}"):
                    folder = f"data/{table}/{write}"
                    kept = {f"{folder}/{n}" for n in self._names(folder)} & named
                    for n in self._names(folder) if kept else []:
                        if n.startswith("bucket=") and f"{folder}/{n}" not in kept:
                            self._delete(f"{folder}/{n}", True)
                    if not kept:
                        self._delete(folder, True)
            return gone

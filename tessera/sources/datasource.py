"""Spec folders as a data source of Spark's own: ``spark.read.format("spec-folders").load(root)``.

Planning lists the folders under ``docs/specs``; a partition is a slice of them, and executors read, parse and resolve
their own slice, so that nothing is shuffled: of folders that claim one id, a slice also looks into those before its own
to tell which is used. Filters on ``folder`` and ``record_id`` are pushed into the listing, so that other folders are
never opened. As a stream, the source gives a folder's row again whenever one of its files changed.
Rows are those of ``markdown.adapt``. Files are reached through Arrow's file systems; ``root`` is a path or URI.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import IntegerType, StructType

from tessera.schemas import B, struct
from tessera.sources.markdown import FOLDER, adapt_folder

SPECS = "docs/specs"
ROW = StructType([f for f in FOLDER if f.name != "mentions"] + list(struct(used=B, unresolved_mentions=IntegerType())))
#: The files of a folder that its row is made of.
PARTS = ("index.md", "rationale.md")


@dataclass
class Slice(InputPartition):
    """Folders with those of the same id that come before them."""

    folders: list[tuple[str, list[str]]]


class Corpus:
    """A root folder on one of Arrow's file systems."""

    def __init__(self, root: str):
        self.fs, self.root = arrow_fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
        self._known: dict[str, bool] = {}

    def folders(self) -> list[str]:
        base = f"{self.root}/{SPECS}"
        if self.fs.get_file_info(base).type != arrow_fs.FileType.Directory:
            raise FileNotFoundError(f"{self.root} has no {SPECS}")
        return sorted(f"{SPECS}/{x.base_name}" for x in self.fs.get_file_info(arrow_fs.FileSelector(base)) if x.type == arrow_fs.FileType.Directory)

    def changed(self, folder: str) -> int:
        """When one of a folder's files changed last, in nanoseconds; 0 without files."""
        return max((x.mtime_ns for x in self.fs.get_file_info([f"{self.root}/{folder}/{p}" for p in PARTS]) if x.type == arrow_fs.FileType.File), default=0)

    def content(self, path: str) -> bytes | None:
        if not self.there(path):
            return None
        with self.fs.open_input_stream(f"{self.root}/{path}") as f:
            return f.read()

    def there(self, path: str) -> bool:
        """Whether a relative path names a file; like Spark's listings, hidden names don't count."""
        if path not in self._known:
            plain = all(part and part[0] not in "._" for part in path.split("/"))
            self._known[path] = plain and self.fs.get_file_info(f"{self.root}/{path}").type == arrow_fs.FileType.File
        return self._known[path]

    def row(self, folder: str) -> dict:
        return adapt_folder(folder, *(self.content(f"{folder}/{p}") for p in PARTS))

    def finished(self, folder: str, rivals: list[str]) -> tuple:
        """A folder's row with its evidence, unresolved mentions, and whether it is the first of its id."""
        out = self.row(folder)
        mentions = out.pop("mentions") or []
        lost = sum(m["shaped"] and not self.there(m["path"]) for m in mentions)
        if out["record"] is not None:
            cited = dict.fromkeys(m["path"] for m in mentions if self.there(m["path"]))
            out["record"]["evidence"] = [{"kind": kind, "target": path, "note": None} for kind, paths in (("spec", out["files"]), ("file", cited)) for path in paths]
        used = None if out["record_id"] is None else all(self.row(r)["record_id"] is None for r in rivals)
        return tuple((out | {"used": used, "unresolved_mentions": lost})[name] for name in ROW.fieldNames())


def claimed(folder: str) -> str | None:
    """The id that a folder's name claims."""
    digits = re.match(r"\d+", folder.rsplit("/", 1)[-1])
    return f"DM-{digits[0]}" if digits else None


def sliced(folders: list[str], wanted: Iterable[str], size: int) -> list[Slice]:
    by_id: dict[str, list[str]] = {}
    rivals = {}
    for folder in folders:
        if (name := claimed(folder)) is not None:
            rivals[folder] = list(by_id.setdefault(name, []))
            by_id[name].append(folder)
    rows = [(f, rivals.get(f, [])) for f in wanted]
    return [Slice(rows[at : at + size]) for at in range(0, len(rows), size)]


class FolderReader(DataSourceReader):
    def __init__(self, root: str, size: int):
        self.root, self.size = root, size
        self.filters: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes conditions on a folder's name; one on the id narrows the listing and is checked again by Spark."""
        for f in filters:
            column = f.attribute if isinstance(f, EqualTo | In | StringStartsWith) else None
            if column == ("folder",):
                self.filters.append(("folder", type(f).__name__, tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                if column == ("record_id",) and not isinstance(f, StringStartsWith):
                    self.filters.append(("record_id", type(f).__name__, tuple(f.value) if isinstance(f, In) else (f.value,)))
                yield f

    def _fits(self, folder: str) -> bool:
        has = {"folder": folder, "record_id": claimed(folder)}
        return all(any(has[c].startswith(v) if kind == "StringStartsWith" else has[c] == v for v in values) for c, kind, values in self.filters)

    def partitions(self) -> list[Slice]:
        folders = Corpus(self.root).folders()
        return sliced(folders, filter(self._fits, folders), self.size)

    def read(self, partition: Slice) -> Iterator[tuple]:
        corpus = Corpus(self.root)
        for folder, rivals in partition.folders:
            yield corpus.finished(folder, rivals)


class FolderStream(DataSourceStreamReader):
    """Offsets are times of change; a file that changes within the nanosecond of an offset already taken is seen at its next change."""

    def __init__(self, root: str, size: int):
        self.root, self.size = root, size

    def initialOffset(self) -> dict:
        return {"changed": 0}

    def latestOffset(self, *_: object) -> dict:
        corpus = Corpus(self.root)
        return {"changed": max(map(corpus.changed, corpus.folders()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        corpus = Corpus(self.root)
        folders = corpus.folders()
        return sliced(folders, [f for f in folders if start["changed"] < corpus.changed(f) <= end["changed"]], self.size)

    def read(self, partition: Slice) -> Iterator[tuple]:
        return FolderReader(self.root, self.size).read(partition)


class SpecFolderSource(DataSource):
    """Options: ``path``, the corpus root, and ``folders``, how many a partition has (64)."""

    @classmethod
    def name(cls) -> str:
        return "spec-folders"

    def schema(self) -> StructType:
        return ROW

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options["path"], int(self.options.get("folders", 64)))

    def streamReader(self, schema: StructType) -> FolderStream:
        return FolderStream(self.options["path"], int(self.options.get("folders", 64)))


def register(spark: SparkSession) -> SparkSession:
    """Make the source known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SpecFolderSource)
    return spark

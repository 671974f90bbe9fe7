"""Adapters as plug-ins, and what every adapter must satisfy."""

from __future__ import annotations

import importlib
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import markdown


class Adapter(Protocol):
    """Turns a corpus into rows (folder, record_id, skip_reason, fingerprint, files, record, field_sources, ...).

    One that also has ``rows(root)``, the same rows of a local folder as dicts
    and without Spark, can be tested on executors.
    """

    adapter_id: str
    adapter_version: str

    def adapt(self, spark: SparkSession, root: str) -> DataFrame: ...


class SpecFolders:
    adapter_id = "spec-folders"
    adapter_version = markdown.VERSION

    def adapt(self, spark: SparkSession, root: str) -> DataFrame:
        return markdown.adapt(spark, root)

    def rows(self, root: str) -> list[dict]:
        from tessera.sources.datasource import ROW, FolderReader

        reader = FolderReader(root, 1 << 20)
        return [dict(zip(ROW.fieldNames(), row, strict=True)) for part in reader.partitions() for row in reader.read(part)]


class FlatRecords:
    """One record file each under ``decisions``, front matter and body."""

    adapter_id = "flat-records"
    adapter_version = "1"

    def adapt(self, spark: SparkSession, root: str) -> DataFrame:
        from tessera.sources.frontmatter import read_records

        rows = read_records(spark, f"{root}/decisions")
        name = F.concat(F.lit("decisions/"), F.regexp_extract("path", r"/decisions/(.+)$", 1))
        reason = F.when(F.col("record").isNull(), F.get("violations", F.lit(0))["rule"])
        print_ = F.sha2(F.to_json("record"), 256)
        refs = F.array(F.struct(name.alias("path"), F.lit("frontmatter").alias("section")))
        sources = F.map_from_arrays(F.array(*[F.lit(p) for p in ("title", "decision.chosen", "rationale_summary")]), F.array(refs, refs, refs))
        return rows.select(name.alias("folder"), F.col("record.id").alias("record_id"), reason.alias("skip_reason"), print_.alias("fingerprint"), F.array(name).alias("files"), "record", sources.alias("field_sources"), F.lit(True).alias("used"))


BUILT_IN = {a.adapter_id: a for a in (SpecFolders, FlatRecords)}


def load(name: str) -> Adapter:
    """A built-in adapter by id, or ``module:attribute``."""
    if name in BUILT_IN:
        return BUILT_IN[name]()
    module, colon, attribute = name.partition(":")
    if not colon:
        raise ValueError(f"no adapter {name!r}: one of {', '.join(BUILT_IN)}, or module:attribute")
    found = getattr(importlib.import_module(module), attribute)
    made = found() if isinstance(found, type) else found
    for need in ("adapter_id", "adapter_version", "adapt"):
        if not hasattr(made, need):
            raise TypeError(f"{name} has no {need}")
    return made


def conformance(spark: SparkSession, adapter: Adapter, corpus: str, probe: str) -> list[tuple[str, bool]]:
    """(rule, holds): contract, determinism, an emptied file, invalid UTF-8, and a fingerprint that follows the file ``probe``."""

    def rows(change: Callable[[Path], None] | None = None) -> dict[str, tuple]:
        with tempfile.TemporaryDirectory() as d:
            own = Path(d) / "corpus"
            shutil.copytree(corpus, own)
            if change:
                change(own / probe)
            out = adapter.adapt(spark, str(own)).select("folder", "record_id", "skip_reason", "fingerprint", F.to_json("record").alias("record")).collect()
            return {r["folder"]: tuple(r) for r in out}

    base, again = rows(), rows()
    home = max((f for f in base if probe.startswith(f)), key=len)
    emptied = rows(lambda p: p.write_bytes(b""))
    broken = rows(lambda p: p.write_bytes(b"\xff\xfe\xfa"))
    longer = rows(lambda p: p.write_bytes(p.read_bytes() + b"\nprobe\n"))
    others = lambda r: {k: v for k, v in r.items() if k != home}
    return [
        ("contract", all((r[1] is None) == (r[2] is not None) for r in base.values())),
        ("deterministic", base == again),
        ("emptied file is skipped", home not in emptied or emptied[home][2] is not None),
        ("invalid text is skipped", broken[home][2] is not None),
        ("others unaffected", others(emptied) == others(broken) == others(base)),
        ("fingerprint follows the file", longer[home][3] != base[home][3]),
    ]

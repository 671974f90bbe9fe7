"""A corpus walk: every path under a folder once, classified, and the headings of its Markdown files.

The tree is listed level by level: executors list the folders of a level, a
batch of them each, and the folders they find are the next level's rows. No
level is collected, so a wide tree costs the driver nothing. Links are noted
and not followed; names are as the file system spells them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import S, array, struct
from tessera.sources.frontmatter import decode
from tessera.sources.markdown import h2_headings
from tessera.store.shared import cut

DISAPPEARED, LINK, HIDDEN, CLOSED, UNREADABLE, OTHER = "disappeared", "descendant symbolic link", "hidden directory", "unreadable directory", "unreadable Markdown file", "unsupported entry"
ENTRY = "path string, kind string, reason string"


def entries(root: str, folder: str) -> list[tuple[str, str, str | None]]:
    """(path, kind, reason) of what a folder holds: ``folder``, ``file``, or ``skipped`` for a reason."""
    try:
        found = sorted(os.scandir(Path(root) / folder), key=lambda e: e.name)
    except FileNotFoundError:
        return [(folder, "skipped", DISAPPEARED)]
    except OSError:
        return [(folder, "skipped", CLOSED)]
    out = []
    for e in found:
        path = f"{folder}/{e.name}" if folder else e.name
        if e.is_symlink():
            out.append((path, "skipped", LINK))
        elif e.is_dir():
            out.append((path, "skipped", HIDDEN) if e.name.startswith(".") else (path, "folder", None))
        else:
            out.append((path, "file", None) if e.is_file() else (path, "skipped", OTHER))
    return out


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, reason) of everything under ``root`` that can be seen, a folder that all executors share."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([e for folder in f["path"] for e in entries(root, folder)], columns=["path", "kind", "reason"])

    level, out = spark.createDataFrame([("",)], "path string"), []
    while True:
        seen = cut(level.mapInPandas(scan, ENTRY))
        out.append(seen)
        level = seen.where("kind = 'folder'").select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, out)
        level = level.repartition(F.col("path"))


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all plain files that are reached without links, hidden folders left out."""
    return tree(spark, root).where("kind = 'file'").select("path")


def survey(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(docs (path, headings), skips (path, reason, unseen_contents)) of a folder."""
    seen = tree(spark, root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path in f["path"]:
                try:
                    text = decode((Path(root) / path).read_bytes())
                except OSError:
                    text = None
                out.append((path, None if text is None else sorted(h2_headings(text))))
            yield pd.DataFrame(out, columns=["path", "headings"])

    read = cut(seen.where((F.col("kind") == "file") & F.lower("path").endswith(".md")).select("path").mapInPandas(run, struct(path=S, headings=array(S))))
    bad = read.where("headings is null").selectExpr("path", f"'{UNREADABLE}' AS reason", "false AS unseen_contents")
    listed = seen.where("kind = 'skipped'").select("path", "reason", (F.col("reason") != OTHER).alias("unseen_contents"))
    return read.where("headings is not null"), listed.unionByName(bad)

"""Manifests, batteries, settings, research tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.digest import tidy_sources
from tessera.schemas import MANIFEST
from tessera.sources.frontmatter import load_yaml

CONFIG = ".tessera.yml"
SETTINGS = ("adapter", "corpus_root", "output")
MANIFEST_VERSION = 2


class InputError(Exception):
    """A file that does not have its stated form."""


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a manifest, a row each; another version is refused."""
    whole = spark.read.schema(MANIFEST).json(path, multiLine=True)
    if [r[0] for r in whole.select("schema_version").distinct().collect()] != [MANIFEST_VERSION]:
        raise InputError(f"{path}: not a manifest of version {MANIFEST_VERSION}")
    return whole.select("adapter_version", "source_root_hint", F.explode("entries").alias("e")).select("adapter_version", "source_root_hint", "e.*")


def previous_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, fingerprint) of a manifest; none if it cannot be used."""
    try:
        return read_manifest(spark, path).select(F.col("id").alias("record_id"), "fingerprint")
    except InputError:
        return spark.createDataFrame([], "record_id string, fingerprint string")


def manifest_text(manifest: dict) -> str:
    """The manifest file: two blanks a level, entries by id, sources tidied."""
    entries = [e | {"field_sources": tidy_sources(e["field_sources"])} for e in sorted(manifest["entries"], key=lambda e: e["id"])]
    return json.dumps({"schema_version": MANIFEST_VERSION} | manifest | {"entries": entries}, indent=2) + "\n"


def find_config(start: str) -> tuple[Path, dict] | None:
    """The nearest settings file from a folder up to the root of its git tree; unknown keys are refused."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        path = folder / CONFIG
        if path.is_file():
            data = load_yaml(path.read_text()) or {}
            if not isinstance(data, dict) or set(data) - set(SETTINGS) or any(not isinstance(v, str | None) for v in data.values()):
                raise InputError(f"{path}: settings are {', '.join(SETTINGS)}")
            return path, {k: (str((folder / v).resolve()) if k != "adapter" else v) for k, v in data.items() if v is not None}
        if (folder / ".git").exists():
            break
    return None


def setting(name: str, given: str | None, config: dict, default: str | None = None) -> str | None:
    """Command line before settings file before default."""
    return given if given is not None else config.get(name, default)


def read_battery(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, question, expected_state, required_records, value_paths, cause) of a JSON battery."""
    keys = {"id", "text", "expected_record", "expected_state", "expected_value_paths", "expected_abstention"}
    rows = []
    for i, q in enumerate(json.loads(Path(path).read_text())["queries"]):
        if set(q) != keys:
            raise InputError(f"query {i}: keys are {', '.join(sorted(keys))}")
        if q["expected_state"] not in ("answered", "abstained") or q["expected_state"] == "answered" and q["expected_abstention"]:
            raise InputError(f"query {i}: state and abstention do not agree")
        rows.append((q["id"], q["text"], q["expected_state"], [q["expected_record"]] if q["expected_record"] else [], q["expected_value_paths"] or [], q["expected_abstention"] or None))
    return spark.createDataFrame(rows, "query_id string, question string, expected_state string, required_records array<string>, value_paths array<string>, cause string")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(records, repo, directory) of a tab-separated table with ``#`` comments."""
    return spark.read.csv(path, sep="\t", comment="#", header=True, schema="records int, repo string, directory string")


RUN = """run_id string, query_id string, state string, sentences_emitted bigint, sentences_reaching_coverage bigint, facet_covered boolean, abstention_cause string,
co_location_satisfied boolean, reader_verdicts array<string>, dropped array<struct<sentence_id: string, reason: string>>,
rejected array<struct<sentence_id: string, disposition: string, additive_failure: string>>, entailment array<struct<sub_claim_id: string, entailment: string>>, wall_seconds double, usd_cost double"""


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation runs, one JSON object a line."""
    return spark.read.schema(RUN).json(path)

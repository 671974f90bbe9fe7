"""Conformance of adapters: a manifest of cases, comparison, and the run over copies of their corpora.

A manifest (YAML, version 1) names cases of five categories, each with a corpus
folder and what an adapter must find there: sources, skips, collisions. A run
adapts a copy of each corpus, compares, and then changes one file at a time: an
emptied or garbled required file must not go unnoticed, every contributing file
must move the fingerprint, and nothing else may change. Adapters must not write.
"""

from __future__ import annotations

import hashlib
import json
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import GRAMMAR
from tessera.sources.adapters import Adapter
from tessera.sources.files import InputError
from tessera.sources.frontmatter import decode, load_yaml, parse

# The categories of cases, and the changes made to files.
CATEGORIES = ("valid", "skip", "wrong_heading", "missing_required_field", "collision")
CHANGES: dict[str, Callable[[bytes], bytes]] = {"empty": lambda b: b"", "invalid_utf8": lambda b: b"\xff\xfe\xfa", "probe": lambda b: b + b"\nprobe\n"}
SOURCE_KEYS = {"id", "root", "contributing_files", "required_files", "result"}
RESULT_KEYS = {"record", "attempted_fields", "unresolved_mention_count", "violations", "field_sources"}


@dataclass(frozen=True)
class Case:
    id: str
    category: str
    corpus: Path
    sources: list[dict]
    skips: list[str]
    collisions: list[dict]
    subject: str | None = None
    targets: list[str] = field(default_factory=list)


def _exact(value: object, keys: set[str], where: str, optional: frozenset[str] = frozenset()) -> dict:
    if not isinstance(value, dict) or set(value) - keys - optional or keys - set(value):
        raise InputError(f"{where}: keys are {', '.join(sorted(keys))}")
    return value


def _relative(path: object, where: str) -> str:
    """A corpus path: relative, without empty, ``.`` or ``..`` segments."""
    if not isinstance(path, str) or not path or path.startswith("/") or any(s in ("", ".", "..") for s in path.split("/")):
        raise InputError(f"{where}: {path!r} is no relative path")
    return path


def _inside(base: Path, name: object, where: str) -> Path:
    """A file or folder under ``base``, reached without symbolic links."""
    at = base
    for part in PurePosixPath(_relative(name, where)).parts:
        at = at / part
        if at.is_symlink():
            raise InputError(f"{where}: {name} leads through a symbolic link")
    if not at.exists():
        raise InputError(f"{where}: {name} does not exist")
    return at


def _unique(values: list, where: str) -> None:
    if len(set(values)) < len(values):
        raise InputError(f"{where} repeats")


def read_cases(path: str) -> list[Case]:
    """The cases of a manifest; every rule of the form is checked."""
    base = Path(path).resolve().parent
    whole = _exact(load_yaml(Path(path).read_text()), {"schema_version", "cases"}, path)
    if whole["schema_version"] != 1 or not whole["cases"]:
        raise InputError(f"{path}: not a conformance manifest of version 1 with cases")
    cases = [_case(c, base, f"case {i}") for i, c in enumerate(whole["cases"])]
    _unique([c.id for c in cases], "case id")
    if missing := set(CATEGORIES) - {c.category for c in cases}:
        raise InputError(f"{path}: no case of category {', '.join(sorted(missing))}")
    return cases


def _case(value: object, base: Path, where: str) -> Case:
    raw = _exact(value, {"id", "category", "corpus", "expect"}, where, frozenset(("subject_path", "target_fields")))
    where, category = f"case {raw['id']}", raw["category"]
    if category not in CATEGORIES:
        raise InputError(f"{where}: category is one of {', '.join(CATEGORIES)}")
    corpus = _inside(base, raw["corpus"], where)
    if not corpus.is_dir() or any(p.is_symlink() for p in corpus.rglob("*")):
        raise InputError(f"{where}: the corpus is no folder free of symbolic links")
    expect = _exact(raw["expect"], {"sources", "skips", "collisions"}, where)
    sources = [_source(s, base, corpus, f"{where}, source {i}") for i, s in enumerate(expect["sources"])]
    skips = [_relative(_exact(s, {"path"}, f"{where}, skip {i}")["path"], where) for i, s in enumerate(expect["skips"])]
    collisions = [_exact(c, {"id", "paths", "used"}, f"{where}, collision {i}") for i, c in enumerate(expect["collisions"])]
    for c in collisions:
        if len(c["paths"]) < 2 or c["used"] not in c["paths"]:
            raise InputError(f"{where}: a collision has two paths or more, one of them used")
    _unique([s["id"] for s in sources], f"{where}: source id")
    _unique(skips, f"{where}: skip")
    subject, targets = raw.get("subject_path"), raw.get("target_fields") or []
    if subject is not None:
        _inside(corpus, subject, where)
    for t in targets:
        if not re.fullmatch(GRAMMAR, t):
            raise InputError(f"{where}: {t!r} is no field path")
    named = {"skip": subject is not None and not targets, "wrong_heading": subject is not None and bool(targets), "missing_required_field": subject is not None and bool(targets)}.get(category, subject is None and not targets)
    shaped = {"valid": bool(sources), "skip": subject in skips, "wrong_heading": subject in skips or any(subject in s["contributing_files"] for s in sources), "missing_required_field": any(subject in s["contributing_files"] for s in sources), "collision": bool(collisions)}[category]
    if not named or not shaped:
        raise InputError(f"{where}: subject, fields and expectations do not fit its category")
    return Case(raw["id"], category, corpus, sources, skips, collisions, subject, list(targets))


def _source(value: object, base: Path, corpus: Path, where: str) -> dict:
    raw = _exact(value, SOURCE_KEYS, where)
    files = raw["contributing_files"]
    if not files or set(raw["required_files"]) - set(files):
        raise InputError(f"{where}: required files are among the contributing files")
    for f in (raw["root"], *files):
        _inside(corpus, f, where)
    _unique(files, f"{where}: contributing file")
    result = _exact(raw["result"], RESULT_KEYS, where)
    for name, refs in (result["field_sources"] or {}).items():
        if not re.fullmatch(GRAMMAR, name) or not refs or any(_exact(r, {"path", "section"}, where)["path"] not in files for r in refs):
            raise InputError(f"{where}: sources of {name} are sections of contributing files")
    if not all(re.fullmatch(GRAMMAR, f) for f in result["attempted_fields"]):
        raise InputError(f"{where}: an attempted field is no field path")
    made = parse(decode(_inside(base, result["record"], where).read_bytes()))
    if made["record"] is None:
        raise InputError(f"{where}: the expected record cannot be read")
    return raw | {"record": made["record"]}


# --- comparison --------------------------------------------------------------


def row_differences(got: DataFrame, want: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other: their columns and ``side`` (unexpected or missing)."""
    more = got.exceptAll(want).withColumn("side", F.lit("unexpected"))
    return more.unionByName(want.select(*got.columns).exceptAll(got).withColumn("side", F.lit("missing")))


def first_difference(got: object, want: object, at: str = "") -> str | None:
    """Where two values first differ, in order; None if they are equal. Null and absent count the same."""
    if isinstance(got, dict) and isinstance(want, dict):
        return next((d for k in sorted({*got, *want}) if (d := first_difference(got.get(k), want.get(k), f"{at}.{k}" if at else k))), None)
    if isinstance(got, list | tuple) and isinstance(want, list | tuple):
        if d := next((d for i, (g, w) in enumerate(zip(got, want, strict=False)) if (d := first_difference(g, w, f"{at}[{i}]"))), None):
            return d
        return None if len(got) == len(want) else f"{at}: {len(got)} entries, expected {len(want)}"
    return None if got == want or not got and not want and (got is None or want is None) else f"{at}: {got!r}, expected {want!r}"


# --- the run -----------------------------------------------------------------


def _state(root: Path) -> dict[str, str]:
    return {p.relative_to(root).as_posix(): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob("*")) if p.is_file()}


def contract(adapter: object) -> Iterator[tuple[str, str]]:
    """(rule, problem): the adapter's name and version are texts, and ``adapt`` takes a session and a root."""
    for name in ("adapter_id", "adapter_version"):
        value = getattr(adapter, name, None)
        yield "contract.metadata", "" if isinstance(value, str) and value else f"{name} must be a text"
    import inspect

    try:
        inspect.signature(adapter.adapt).bind(None, "root")
        yield "contract.signature", ""
    except (AttributeError, TypeError, ValueError) as e:
        yield "contract.signature", f"adapt must take a session and a root: {e}"


REPORT = "rule string, passed boolean, detail string, case_id string, source_id string, path string, variant string"


def _seen(rows: list[dict]) -> dict:
    """Sources in use by id, skipped folders and collisions among an adapter's rows."""
    rows = sorted(rows, key=lambda r: r["folder"])
    good = [r for r in rows if r["record_id"] is not None and r["skip_reason"] is None]
    by_id: dict[str, list[dict]] = {}
    for r in good:
        by_id.setdefault(r["record_id"], []).append(r)
    collisions = [{"id": i, "paths": [r["folder"] for r in rs], "used": next((r["folder"] for r in rs if r["used"]), None)} for i, rs in sorted(by_id.items()) if len(rs) > 1]
    return {"sources": {r["record_id"]: r for r in good if r["used"]}, "skips": [r["folder"] for r in rows if r["skip_reason"] is not None], "collisions": collisions}


def variants(case: Case) -> list[tuple[str, str | None]]:
    """(variant, changed file) of all runs of a case: as it is, twice, then one file changed at a time."""
    probes = [("probe", path) for s in case.sources for path in s["contributing_files"]]
    broken = [(change, path) for s in case.sources for path in s["required_files"] for change in ("empty", "invalid_utf8")]
    return [("original", None), ("again", None), *dict.fromkeys(probes + broken)]


def observe(adapt: Callable[[str], list[dict]], files: dict[str, bytes], variant: str, path: str | None, keep: str | None = None) -> dict:
    """What an adapter makes of a copy of a corpus: what ``_seen`` tells, or ``error``; and whether it ``touched`` the copy."""
    with tempfile.TemporaryDirectory() as folder:
        root = Path(folder) / "corpus"
        for name, content in files.items():
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_bytes(CHANGES[variant](content) if name == path else content)
        before, out = _state(root), {}
        try:
            out = _seen(adapt(str(root)))
        except Exception as e:
            out = {"error": f"{type(e).__name__}: {e}"[:500]}
        out["touched"] = _state(root) != before
        if keep and ("error" in out or out["touched"]):
            shutil.copytree(root, Path(keep) / f"{variant}-{hashlib.sha256(repr((path, sorted(files))).encode()).hexdigest()[:12]}", dirs_exist_ok=True)
        return out


def run_cases(spark: SparkSession, adapter: Adapter, cases: list[Case], keep: str | None = None) -> DataFrame:
    """(rule, passed, detail, case_id, source_id, path, variant): a row for every check.

    One job: its rows are the cases' variants, each adapted by an executor in a
    folder of its own, and executors judge each case. An adapter without
    ``rows`` needs a session and is run by the driver. Copies of failing
    corpora are kept in the folder ``keep``, if one is named.
    """
    rows = [(rule, not bad, bad, None, None, None, None) for rule, bad in contract(adapter)]
    checks = spark.createDataFrame(rows, REPORT)
    if not all(r[1] for r in rows) or not cases:
        return checks
    files = {case.id: {p.relative_to(case.corpus).as_posix(): p.read_bytes() for p in sorted(case.corpus.rglob("*")) if p.is_file()} for case in cases}
    if not hasattr(adapter, "rows"):
        local = lambda root: [r.asDict(recursive=True) for r in adapter.adapt(spark, root).collect()]  # noqa: E731  a case's corpus is small
        told = [row for case in cases for row in judge(case, {v: observe(local, files[case.id], *v, keep) for v in variants(case)})]
        return checks.unionByName(spark.createDataFrame(told, REPORT))

    asked = spark.createDataFrame([(case.id, *v) for case in cases for v in variants(case)], "case_id string, variant string, path string")
    held = spark.createDataFrame([(case_id, name, bytearray(content)) for case_id, own in files.items() for name, content in own.items()], "case_id string, name string, content binary")
    listed = held.groupBy("case_id").agg(F.collect_list(F.struct("name", "content")).alias("files"))  # a case's corpus is small

    def seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = [json.dumps(observe(adapter.rows, {x["name"]: bytes(x["content"]) for x in own}, variant, path, keep)) for own, variant, path in zip(f["files"], f["variant"], f["path"], strict=True)]
            yield pd.DataFrame({"case_id": f["case_id"], "variant": f["variant"], "path": f["path"], "seen": said})

    by_id = {case.id: case for case in cases}

    def judged(f: pd.DataFrame) -> pd.DataFrame:
        looks = {(variant, path): json.loads(said) for variant, path, said in zip(f["variant"], f["path"], f["seen"], strict=True)}
        return pd.DataFrame(judge(by_id[f["case_id"].iloc[0]], looks), columns=[c.split()[0] for c in REPORT.split(", ")])

    dealt = asked.join(listed, "case_id").repartition("case_id", "variant", "path")
    told = dealt.mapInPandas(seen, "case_id string, variant string, path string, seen string").groupBy("case_id").applyInPandas(judged, REPORT)
    return checks.unionByName(told)


def judge(case: Case, looks: dict[tuple[str, str | None], dict]) -> list[tuple]:
    """All checks of a case, given what was seen of each of its variants."""
    rows: list[tuple] = []

    def check(rule: str, bad: str | None, source: str | None = None, path: str | None = None, variant: str = "original") -> None:
        rows.append((rule, not bad, bad or "", case.id, source, path, variant))

    def shown(variant: str, path: str | None = None) -> dict | None:
        seen = looks[variant, path]
        check("adapter.exception", seen.get("error"), None, path, variant)
        check("fixture.unchanged", "the adapter changed the corpus" if seen["touched"] else None, None, path, variant)
        return None if "error" in seen else seen

    seen, again = shown("original"), shown("again")
    if seen is None or again is None:
        return rows
    sources = seen["sources"]
    check("discovery.deterministic", first_difference({k: v for k, v in again.items() if k != "touched"}, {k: v for k, v in seen.items() if k != "touched"}))
    check("discovery.sources", first_difference(sorted(sources), sorted(s["id"] for s in case.sources), "sources"))
    check("discovery.skips", first_difference(seen["skips"], sorted(case.skips), "skips"))
    check("discovery.collisions", first_difference(seen["collisions"], sorted(case.collisions, key=lambda c: c["id"]), "collisions"))
    for want in case.sources:
        name = want["id"]
        got = sources.get(name)
        if got is None:
            continue
        result = want["result"]
        check("discovery.root", first_difference(got["folder"], want["root"], "root"), name)
        check("discovery.files", first_difference(got["files"], want["contributing_files"], "files"), name)
        check("parse.record", first_difference(got["record"], want["record"], "record"), name)
        check("parse.field_sources", first_difference(got["field_sources"] or {}, result["field_sources"] or {}, "field_sources"), name)
        if "attempted_fields" in got:
            check("parse.attempted_fields", first_difference(got["attempted_fields"], sorted(result["attempted_fields"]), "attempted_fields"), name)
            check("parse.unresolved_mentions", first_difference(got["unresolved_mentions"], result["unresolved_mention_count"], "unresolved_mentions"), name)
        for path in want["contributing_files"]:
            probed = shown("probe", path)
            now = probed and probed["sources"].get(name)
            check("fingerprint.follows_file", None if now and now["fingerprint"] != got["fingerprint"] else "the fingerprint stays as it was", name, path, "probe")
        for path in want["required_files"]:
            for change in ("empty", "invalid_utf8"):
                broken = shown(change, path)
                if broken is None:
                    continue
                now = broken["sources"].get(name)
                check("corruption.noticed", "the record is as before" if now and first_difference(now["record"], got["record"]) is None else None, name, path, change)
                check("corruption.others_unaffected", first_difference({k: v for k, v in broken["sources"].items() if k != name}, {k: v for k, v in sources.items() if k != name}), name, path, change)
    if case.category == "missing_required_field":
        holders = [s for s in sources.values() if case.subject in s["files"]]
        filled = [t for t in case.targets for s in holders if _value(s["record"], t)]
        check("category.missing_required_field", f"{', '.join(filled)} has a value" if filled else None, path=case.subject)
    return rows


def _value(record: object, path: str) -> object:
    for part in path.split("."):
        record = record.get(part) if isinstance(record, dict) else None
    return record

"""Record files: YAML front matter between ``---`` fences, then a Markdown body.

Reading never raises for bad input: it gives violations. Writing is the exact
inverse and leaves out nulls and empty lists.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import EVIDENCE_KINDS, PARSED, RECORD, STATUSES, S, struct

try:
    import yaml
except ImportError:  # the small reader below takes what the writer writes
    yaml = None

FENCE = "---"
#: What may stand in a record; the leaves are kinds of value.
SHAPE = {
    "id": "text", "title": "text", "status": STATUSES, "date": "text", "context": {"problem": "text", "triggering_change": "text"},
    "decision": {"chosen": "text", "alternatives": [{"title": "text", "rejection_reason": "text"}]}, "why": ["text"], "rationale_summary": "text",
    "consequences": {"positive": ["text"], "negative": ["text"]}, "evidence": [{"kind": EVIDENCE_KINDS, "target": "text", "note": "text"}], "tags": ["text"], "supersedes": "text",
}


def violation(rule: str, reason: str, field: str = "", severity: str = "error") -> dict:
    return {"field": field, "severity": severity, "rule": rule, "reason": reason}


def decode(content: bytes | None) -> str | None:
    """UTF-8 text without a byte order mark, lines ended by LF; null if it isn't UTF-8."""
    try:
        return None if content is None else content.decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError:
        return None


def load_yaml(text: str) -> object:
    return yaml.safe_load(text) if yaml else SmallYaml(text).read()


class SmallYaml:
    """Block mappings and lists, JSON or plain scalars: the subset that ``dump`` writes. Anything else raises ValueError."""

    def __init__(self, text: str):
        self.lines = [(len(line) - len(line.lstrip()), line.strip()) for line in text.split("\n") if line.strip() and not line.lstrip().startswith("#")]
        self.at = 0

    def read(self) -> object:
        out = self.block(0) if self.lines else None
        if self.at < len(self.lines):
            raise ValueError(f"cannot read {self.lines[self.at][1]!r}")
        return out

    def block(self, indent: int) -> object:
        if self.lines[self.at][1].startswith("- ") or self.lines[self.at][1] == "-":
            return self.sequence(indent)
        out = {}
        while self.at < len(self.lines) and self.lines[self.at][0] == indent:
            key, colon, rest = self.lines[self.at][1].partition(":")
            if not colon or (rest and not rest.startswith(" ")):
                if not out and self.at + 1 == len(self.lines) and indent == 0:
                    self.at += 1
                    return self.scalar(key + colon + rest)
                raise ValueError(f"no key in {self.lines[self.at][1]!r}")
            self.at += 1
            out[self.scalar(key)] = self.scalar(rest.strip()) if rest.strip() else self.nested(indent)
        return out

    def nested(self, indent: int) -> object:
        if self.at < len(self.lines):
            depth, text = self.lines[self.at]
            if depth > indent or depth == indent and text.startswith("- "):
                return self.block(depth)
        return None

    def sequence(self, indent: int) -> list:
        out = []
        while self.at < len(self.lines) and self.lines[self.at][0] == indent and self.lines[self.at][1].startswith("-"):
            rest = self.lines[self.at][1][1:].strip()
            if re.match(r"[A-Za-z_]\w*:( |$)", rest):
                self.lines[self.at] = (indent + 2, rest)
                out.append(self.block(indent + 2))
            else:
                self.at += 1
                out.append(self.scalar(rest) if rest else self.nested(indent))
        return out

    @staticmethod
    def scalar(text: str) -> object:
        if text[:1] in '"[{':
            return json.loads(text)
        if text[:1] == "'":
            if len(text) < 2 or text[-1] != "'":
                raise ValueError(f"open quote in {text!r}")
            return text[1:-1].replace("''", "'")
        if text[:1] in "|>&*!%@`":
            raise ValueError(f"cannot read {text!r}")
        return {"null": None, "~": None, "true": True, "false": False, "": None}.get(text, int(text) if re.fullmatch(r"-?\d+", text) else text)


def _fit(value: object, shape: object, path: str, wrong: list[dict], extra: list[str]) -> object:
    """``value`` as ``shape`` says; what does not fit and keys that are not known are reported."""
    if value is None:
        return [] if isinstance(shape, list) and path != "evidence" else None
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            wrong.append(violation("field.wrong_type", f"{path} must be a mapping", path))
            return None
        dot = f"{path}." if path else ""
        extra += [f"{dot}{k}" for k in value if k not in shape]
        return {k: _fit(value.get(k), s, f"{dot}{k}", wrong, extra) for k, s in shape.items()}
    if isinstance(shape, list):
        if not isinstance(value, list):
            wrong.append(violation("field.wrong_type", f"{path} must be a list", path))
            return []
        return [_fit(v, shape[0], f"{path}[{i}]", wrong, extra) for i, v in enumerate(value)]
    if path == "date" and isinstance(value, datetime.date):
        return value.isoformat()
    if not isinstance(value, str):
        wrong.append(violation("field.wrong_type", f"{path} must be text", path))
        return None
    if isinstance(shape, tuple) and value not in shape:
        wrong.append(violation("field.unknown_value", f"{path} must be one of {', '.join(shape)}", path))
        return None
    return value


def parse(text: str | None, path: str = "") -> dict:
    """struct(record, violations, unknown_fields) of a record file."""
    fail = lambda rule, reason: {"record": None, "violations": [violation(rule, reason)], "unknown_fields": []}
    if text is None:
        return fail("file.unreadable", f"cannot read {path} as UTF-8 text")
    head, *rest = text.split("\n")
    if head != FENCE or FENCE not in rest:
        return fail("file.no_frontmatter", "record file must open and close with a --- frontmatter fence")
    end = rest.index(FENCE)
    body = rest[end + 1 :]
    try:
        data = load_yaml("\n".join(rest[:end]))
    except Exception as e:
        if isinstance(e, ValueError) or yaml and isinstance(e, yaml.YAMLError):
            return fail("file.frontmatter_unparseable", "frontmatter is not valid YAML")
        raise
    if not isinstance(data, dict):
        return fail("file.frontmatter_not_mapping", "frontmatter must parse to a YAML mapping")
    wrong: list[dict] = []
    extra: list[str] = []
    record = _fit(data, SHAPE, "", wrong, extra)
    if wrong:
        return {"record": None, "violations": wrong, "unknown_fields": []}
    return {"record": record | {"body": "\n".join(body[1:] if body[:1] == [""] else body)}, "violations": [], "unknown_fields": sorted(extra)}


def dump(record: dict) -> str:
    """The record file of a record."""

    def lines(value: object, indent: int) -> Iterator[str]:
        pad = " " * indent
        for k, v in value.items():
            if isinstance(v, dict):
                if inner := list(lines(v, indent + 2)):
                    yield f"{pad}{k}:"
                    yield from inner
            elif isinstance(v, list) and v:
                yield f"{pad}{k}:"
                for x in v:
                    own = list(lines(x, indent + 4)) if isinstance(x, dict) else [json.dumps(x, ensure_ascii=False)]
                    yield f"{pad}  - {own[0].strip()}" if own else f"{pad}  - {{}}"
                    yield from own[1:]
            elif v is not None and v != []:
                yield f"{pad}{k}: {json.dumps(v, ensure_ascii=False)}"

    front = "\n".join(lines({k: record.get(k) for k in SHAPE}, 0))
    return f"{FENCE}\n{front}\n{FENCE}\n\n{record.get('body') or ''}"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, violations, unknown_fields) of the ``.md`` files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([{"path": name} | parse(decode(content), name) for name, content in zip(p["path"], p["content"], strict=True)], columns=["path", "record", "violations", "unknown_fields"])

    return files.mapInPandas(run, struct(path=S, **{f.name: f.dataType for f in PARSED}))


def record_files(records: DataFrame) -> DataFrame:
    """(record_path, text) of records: what ``write_records`` writes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            own = [_dict(r) for r in p["record"]]
            yield pd.DataFrame({"record_path": [f"{r['id']}.md" for r in own], "text": [dump(r) for r in own]})

    return records.select(F.struct(*RECORD.fieldNames()).alias("record")).mapInPandas(run, "record_path string, text string")


def _dict(value: object) -> object:
    """Rows and arrays of pandas as plain dicts and lists."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: _dict(v) for k, v in value.items()}
    if hasattr(value, "tolist"):
        value = value.tolist()
    return [_dict(v) for v in value] if isinstance(value, list) else value

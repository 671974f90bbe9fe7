"""Canonical JSON and the digests built on it."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from operator import itemgetter

#: The inputs of the default pipeline signature besides the token counter.
SIGNATURE = {
    "signature_schema": 1,
    "chunker_version": "chunker-v1",
    "prefix_version": "embedding-prefix-v1",
    "target": 400,
    "overlap": "0.15",
    "paragraph_rule_version": "paragraph-v1",
    "sentence_rule_version": "sentence-v1",
    "atomic_paths": ["decision.alternatives[i]"],
}


def tidy(text: str) -> str:
    """NFC form, line ends as LF."""
    return unicodedata.normalize("NFC", "\n".join(re.split("\r\n|\r", text)))


def canonical_json(value: object) -> str:
    """JSON with tidy texts, sorted keys, no blanks, no ASCII escapes, nulls kept; written in one go."""
    if isinstance(value, str):
        return json.dumps(tidy(value), ensure_ascii=False)
    if isinstance(value, dict):
        fields = sorted(((str(k), v) for k, v in value.items()), key=itemgetter(0))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(v)}" for k, v in fields) + "}"
    if isinstance(value, list | tuple):
        return f"[{','.join(map(canonical_json, value))}]"
    return json.dumps(value)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def tidy_sources(sources: dict[str, list[dict]] | None) -> dict[str, list[dict]]:
    """Each path's sources without repeats, in order of path and section."""
    out = {}
    for path, refs in (sources or {}).items():
        pairs = sorted({(r["path"], r["section"]) for r in refs})
        out[path] = [{"path": p, "section": s} for p, s in pairs]
    return out


def record_digest(record: dict) -> str:
    """SHA-256 of the whole record, absent fields as nulls, absent lists empty."""
    whole = {k: record.get(k) for k in ("id", "title", "status", "date", "body", "context", "decision", "rationale_summary", "consequences", "evidence", "supersedes")}
    whole |= {k: list(record.get(k) or []) for k in ("why", "tags")}
    return sha(canonical_json(whole))


def entry_digest(entry: dict) -> str:
    """SHA-256 of what retrieval depends on in a manifest entry."""
    keys = ("id", "fingerprint", "contributing_files", "record_path", "record_digest")
    return sha(canonical_json({k: entry[k] for k in keys} | {"field_sources": tidy_sources(entry["field_sources"])}))


def manifest_digest(manifest: dict) -> str:
    """SHA-256 of a manifest without its time, skips and collisions."""
    keys = ("id", "fingerprint", "contributing_files", "record_path", "record_digest", "entry_digest")
    entries = [{k: e[k] for k in keys} | {"field_sources": tidy_sources(e["field_sources"])} for e in sorted(manifest["entries"], key=lambda e: e["id"])]
    return sha(canonical_json({k: manifest[k] for k in ("schema_version", "adapter_version", "source_root_hint")} | {"entries": entries}))


def fingerprint(version: str, files: list[tuple[str, bytes]]) -> str:
    """SHA-256 over a version and the names and bytes of files."""
    h = hashlib.sha256(version.encode())
    for name, content in files:
        h.update(name.encode() + b"\0" + content + b"\0")
    return h.hexdigest()


def pipeline_signature(model: str, dimensions: int, encoding: str) -> str:
    """What an index was built with; indexes of different signatures never mix."""
    return sha(canonical_json(SIGNATURE | {"model": model, "dimensions": dimensions, "encoding": encoding}))

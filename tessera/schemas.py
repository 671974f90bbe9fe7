"""Types of the data model, its closed vocabularies and its constants."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def array(of: T.DataType) -> T.ArrayType:
    return T.ArrayType(of)


ALTERNATIVE = struct(title=S, rejection_reason=S)
EVIDENCE = struct(kind=S, target=S, note=S)
SOURCE = struct(path=S, section=S)
VIOLATION = struct(field=S, severity=S, rule=S, reason=S)
RECORD = struct(
    id=S,
    title=S,
    status=S,
    date=S,
    body=S,
    context=struct(problem=S, triggering_change=S),
    decision=struct(chosen=S, alternatives=array(ALTERNATIVE)),
    why=array(S),
    rationale_summary=S,
    consequences=struct(positive=array(S), negative=array(S)),
    evidence=array(EVIDENCE),
    tags=array(S),
    supersedes=S,
)
FIELD_SOURCES = T.MapType(S, array(SOURCE))
MANIFEST_ENTRY = struct(id=S, fingerprint=S, contributing_files=array(S), record_path=S, record_digest=S, entry_digest=S, field_sources=FIELD_SOURCES)
MANIFEST = struct(
    schema_version=I,
    adapter_version=S,
    generated_at=S,
    source_root_hint=S,
    entries=array(MANIFEST_ENTRY),
    skipped=array(struct(path=S, reason=S)),
    collisions=array(struct(id=S, paths=array(S), used=S)),
)
CHUNK = struct(chunk_id=S, record_id=S, record_title=S, record_status=S, record_tags=array(S), value_path=S, fingerprint=S, ordinal=L, text=S)
PARSED = struct(record=RECORD, violations=array(VIOLATION), unknown_fields=array(S))
LEDGER = struct(record_id=S, state=S, desired_fingerprint=S, active_fingerprint=S, entry_digest=S, record_digest=S, failure_code=S, removal_reason=S, changed_at=S)

# The closed vocabularies.
STATUSES = ("proposed", "accepted", "superseded", "rejected")
EVIDENCE_KINDS = ("spec", "file", "commit")
SEVERITIES = ("error", "warning")
EXCLUSION_REASONS = ("record_id", "status", "tag", "value_path")
LEXICAL_DISPOSITIONS = ("ranked", "outside_top_24", "no_term_match", "nonpositive_score")
SEMANTIC_DISPOSITIONS = ("ranked", "outside_top_24")
BREADTH_DISPOSITIONS = ("accepted", "record_cap", "accepted_limit_reached")
SKIP_REASONS = ("disappeared", "descendant symbolic link", "hidden directory", "unreadable directory", "unreadable Markdown file", "unsupported entry")
FINAL_DISPOSITIONS = ("accepted", "outside_top_8")
RECORD_ACTIONS = ("added", "updated", "unchanged", "removed", "failed")
STALE_REASONS = ("record_added", "record_changed", "record_removed", "manifest_unavailable", "manifest_changed_during_query", "failed_ingest")
FAILURE_CODES = ("record.unreadable", "digest.record_mismatch", "digest.entry_mismatch", "provenance.missing", "chunking.oversize", "provider.embedding")

# Retrieval constants.
CANDIDATES = 24
ACCEPTED = 8
RRF_K = 60
RECORD_CAP = 2
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

#: The order of every ranking after its score: stable across rebuilds.
STABLE_KEY = ("record_id", "fingerprint", "value_path", "ordinal")

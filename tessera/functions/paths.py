"""Value paths and file paths as predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of value paths, and the selectors with a star.
GRAMMAR = r"^[A-Za-z_][A-Za-z0-9_]*((\.[A-Za-z_][A-Za-z0-9_]*)|(\[[0-9]+\]))*$"

STARRED = ("decision.alternatives[*]", "why[*]", "consequences.positive[*]", "consequences.negative[*]", "body[*]")

# The chunkable paths in schema order, and their labels.
CHUNKABLE = ("context.problem", "context.triggering_change", "decision.chosen", "decision.alternatives", "why", "rationale_summary", "consequences.positive", "consequences.negative", "body")
LABELS = {
    "context.problem": "the problem this record faced",
    "context.triggering_change": "the change that triggered this record",
    "decision.chosen": "the decision this record chose",
    "decision.alternatives": "an alternative this record considered and did not choose",
    "why": "a reason this record gives for its decision",
    "rationale_summary": "this record's summary of its own reasoning",
    "consequences.positive": "a positive consequence this record expects",
    "consequences.negative": "a negative consequence this record accepts",
    "body": "other prose from this record",
}
#: The labels that rankings by field see.
RANKED_LABELS = LABELS | {"decision.chosen": "what this record decided"}
SPECS = "docs/specs/"


def is_value_path(path: Column) -> Column:
    return path.rlike(GRAMMAR)


def path_selected(path: Column, selector: str) -> Column:
    """Exact, or for ``prefix[*]`` exactly one index without leading zeros."""
    if selector.endswith("[*]"):
        return path.rlike(f"^{re.escape(selector[:-3])}\\[(0|[1-9][0-9]*)\\]$")
    return path == selector


def label_of(path: Column) -> Column:
    """The plain label of a value path, by its text before the first index; empty for other paths."""
    stem = F.substring_index(path, "[", 1)
    return F.coalesce(*[F.when(stem == k, F.lit(v)) for k, v in LABELS.items()], F.lit(""))


def evidence_block(number: Column, chunk_id: Column, path: Column, text: Column) -> Column:
    """A chunk as it is shown to an answer provider."""
    label = label_of(path)
    head = F.concat(F.lit("CHUNK "), number.cast("string"), F.lit(" ("), chunk_id, F.lit(")"))
    return F.concat(head, F.when(label != "", F.concat(F.lit("\nField: "), label)).otherwise(""), F.lit("\n"), text)


def normal_target(target: Column) -> Column:
    """A path without a leading ``./`` and without empty segments."""
    bare = F.regexp_replace(F.trim(target), r"^\./", "")
    return F.array_join(F.filter(F.split(bare, "/"), lambda s: s != ""), "/")


def not_normal(target: Column) -> Column:
    """Absolute, with a ``..`` segment, or ending in a slash."""
    t = F.trim(target)
    return t.startswith("/") | F.array_contains(F.split(t, "/"), "..") | t.endswith("/")


def under_specs(target: Column) -> Column:
    return normal_target(target).startswith(SPECS)

"""Record validation: every rule as a condition, violations as rows.

Rule ids are stable strings. Facts about the outside (existing paths, commits)
are tables that evidence is joined with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import normal_target, not_normal, under_specs

ID, DATE = r"^[A-Za-z0-9][A-Za-z0-9._-]*$", r"^\d{4}-\d{2}-\d{2}$"


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(F.regexp_replace(text, r"\s+", " ")) == "")


def violation(condition: Column, field: Column | str, severity: str, rule: str, reason: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(as_column(field).alias("field"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), as_column(reason).alias("reason")))


def each(values: Column, make) -> Column:
    """Violations of a list's elements: ``make(element, index as text)``."""
    return F.transform(F.coalesce(values, F.array()), lambda v, i: make(v, i.cast("string")))


def record_violations(records: DataFrame) -> DataFrame:
    """(id, field, severity, rule, reason) of the rules that need the record alone.

    ``records`` has the record's columns and may have ``attempted_fields``,
    ``unknown_fields`` (arrays) and ``unresolved_mentions`` (int).
    """
    c, has = F.col, set(records.columns)
    required = lambda cond, field, what: violation(cond, field, "error", "required.missing", f"{what} is required")
    at = lambda name, i, leaf: F.concat(F.lit(f"{name}["), i, F.lit(f"].{leaf}"))
    shape = ~blank(c("date")) & c("date").rlike(DATE)
    day = F.date_format(F.try_to_timestamp(F.when(shape, c("date")), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")
    single = F.array(
        required(blank(c("id")), "id", "id"),
        required(blank(c("title")), "title", "title"),
        required(blank(c("status")), "status", "status"),
        required(blank(c("decision.chosen")), "decision.chosen", "decision.chosen"),
        required(c("evidence").isNull() | (F.size("evidence") == 0), "evidence", "evidence"),
        violation(~blank(c("id")) & ~c("id").rlike(ID), "id", "error", "id.malformed", F.concat(F.lit("id '"), c("id"), F.lit("' does not match the required format"))),
        violation(~blank(c("date")) & ~c("date").rlike(DATE), "date", "error", "date.malformed", F.concat(F.lit("date '"), c("date"), F.lit("' is not a valid YYYY-MM-DD date"))),
        violation(shape & ~F.coalesce(day == c("date"), F.lit(False)), "date", "error", "date.malformed", F.concat(F.lit("date '"), c("date"), F.lit("' is not a real calendar date"))),
        violation(blank(c("rationale_summary")) & ~F.exists(F.coalesce("why", F.array().cast("array<string>")), lambda w: ~blank(w)), "", "error", "rationale.missing", "at least one of why or rationale_summary must be populated"),
        violation(c("supersedes") == c("id"), "supersedes", "error", "supersedes.self_reference", "supersedes must not equal this record's own id"),
    )
    lists = [
        each(c("evidence"), lambda e, i: violation(e["kind"].isNull(), at("evidence", i, "kind"), "error", "required.missing", "evidence kind is required")),
        each(c("evidence"), lambda e, i: violation(blank(e["target"]), at("evidence", i, "target"), "error", "evidence.empty_target", "evidence target is empty")),
        each(c("decision.alternatives"), lambda a, i: violation(blank(a["title"]), at("decision.alternatives", i, "title"), "error", "required.missing", "alternative title is required")),
        each(c("decision.alternatives"), lambda a, i: violation(blank(a["rejection_reason"]), at("decision.alternatives", i, "rejection_reason"), "warning", "alternative.missing_rejection_reason", "alternative has no rejection reason")),
    ]
    if "attempted_fields" in has:
        lists.append(each(c("attempted_fields"), lambda f, i: violation(f.isNotNull(), f, "warning", "field.attempted_unfilled", F.concat(F.lit("field "), f, F.lit(" was attempted but not populated")))))
    if "unknown_fields" in has:
        lists.append(each(c("unknown_fields"), lambda f, i: violation(f.isNotNull(), f, "warning", "field.unknown", F.concat(F.lit("unknown field "), f))))
    if "unresolved_mentions" in has:
        n = c("unresolved_mentions")
        lists.append(F.array(violation(n > 0, "evidence", "warning", "evidence.mentions_unresolved", F.concat(n.cast("string"), F.lit(" code path mentions did not resolve")))))
    return records.select("id", F.inline(F.array_compact(F.concat(single, *lists))))


def evidence_rows(records: DataFrame) -> DataFrame:
    """(id, i, kind, target) of evidence with a kind and a target."""
    rows = records.select("id", F.posexplode("evidence").alias("i", "e")).select("id", "i", "e.kind", F.trim("e.target").alias("target"))
    return rows.where("kind is not null and target is not null and target <> ''")


def commit_matches(targets: DataFrame, commits: DataFrame, least: int = 4) -> DataFrame:
    """(target, n): how many commits begin with each target.

    An equi-join on the first ``least`` characters, then the prefix test;
    shorter targets are joined by themselves on as many characters as they have.
    """
    asked = targets.select("target").where("target is not null and target <> ''").distinct()
    out = None
    for size in range(1, least + 1):
        own = asked.where(F.length("target") == size) if size < least else asked.where(F.length("target") >= least)
        part = own.withColumn("head", F.substring("target", 1, size)).join(commits.select("commit", F.substring("commit", 1, size).alias("head")), "head", "left")
        part = part.groupBy("target").agg(F.count_if(F.coalesce(F.col("commit").startswith(F.col("target")), F.lit(False))).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def evidence_violations(records: DataFrame, paths: DataFrame, commits: DataFrame | None) -> DataFrame:
    """(id, field, severity, rule, reason) of evidence that does not resolve.

    ``paths`` (path) exist; ``commits`` (commit) or None if history is unavailable.
    """
    rows = evidence_rows(records).withColumn("normal", normal_target(F.col("target")))
    field = F.concat(F.lit("evidence["), F.col("i").cast("string"), F.lit("].target"))
    there = rows.join(paths.select(F.col("path").alias("normal"), F.lit(True).alias("there")).distinct(), "normal", "left")
    files = there.where("kind in ('spec', 'file')")
    made = F.coalesce(
        violation(not_normal(F.col("target")), field, "error", "evidence.target_not_normalized", "evidence target must be a relative normalized path"),
        violation((F.col("kind") == "spec") & ~under_specs(F.col("target")), field, "error", "evidence.spec_outside_specs_dir", "spec evidence must resolve under docs/specs/"),
        violation(F.col("there").isNull(), field, "error", "evidence.path_unresolved", F.concat(F.lit("evidence target '"), F.col("normal"), F.lit("' is not an existing path"))),
    )
    out = files.select("id", made.alias("v")).where("v is not null").select("id", "v.*")
    cited = rows.where("kind = 'commit'")
    if commits is None:
        warned = cited.select("id").distinct()
        return out.unionByName(warned.select("id", F.lit("").alias("field"), F.lit("warning").alias("severity"), F.lit("context.git_unavailable").alias("rule"), F.lit("git history is unavailable, commit evidence resolution was skipped").alias("reason")))
    found = cited.join(commit_matches(cited, commits), "target")
    about = lambda text: F.concat(F.lit("commit prefix '"), F.col("target"), F.lit(f"' {text}"))
    made = F.coalesce(
        violation(F.col("n") == 0, field, "error", "evidence.commit_unresolved", about("matches no known commit")),
        violation(F.col("n") > 1, field, "error", "evidence.commit_ambiguous", about("matches more than one known commit")),
    )
    return out.unionByName(found.select("id", made.alias("v")).where("v is not null").select("id", "v.*"))


def validate(records: DataFrame, paths: DataFrame, commits: DataFrame | None) -> DataFrame:
    """All violations of all records."""
    return record_violations(records).unionByName(evidence_violations(records, paths, commits))

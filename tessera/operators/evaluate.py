"""Evaluation of a battery's results against its oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(results: DataFrame, oracles: DataFrame) -> DataFrame:
    """(query_id, run, passed, detail): whether each result satisfies its oracle.

    ``results`` (query_id, run, state, cited_records array, cited_paths
    array<struct<record_id, value_path>>, n_sentences, cause); ``oracles``
    (query_id, expected_state, required_records, value_paths array, cause).
    """
    rows = results.join(oracles.withColumnRenamed("cause", "expected_cause"), "query_id")
    missing = F.array_sort(F.array_except("required_records", "cited_records"))
    uncovered = F.filter("value_paths", lambda p: ~F.exists("cited_paths", lambda c: F.col("required_records").isNull() | ((F.size("required_records") == 0) | F.array_contains(F.col("required_records"), c["record_id"])) & c["value_path"].startswith(p)))
    abstained, answered = F.col("expected_state") == "abstained", F.col("expected_state") == "answered"
    detail = (
        F.when(F.col("state") != F.col("expected_state"), F.concat(F.lit("state "), F.col("state"), F.lit(", expected "), F.col("expected_state")))
        .when(abstained & ((F.col("n_sentences") > 0) | (F.size("cited_records") > 0)), "abstained with sentences or citations")
        .when(abstained & F.col("expected_cause").isNotNull() & ~F.col("cause").eqNullSafe(F.col("expected_cause")), F.concat(F.lit("cause "), F.coalesce("cause", F.lit("unknown"))))
        .when(answered & (F.size(missing) > 0), F.concat(F.lit("missing records "), F.array_join(missing, ",")))
        .when(answered & (F.size(uncovered) > 0), F.concat(F.lit("missing paths "), F.array_join(uncovered, ",")))
    )
    return rows.select("query_id", "run", detail.isNull().alias("passed"), detail.alias("detail"))


def pass_rates(checks: DataFrame) -> DataFrame:
    """(query_id, runs, passed, rate, first_failure): the first failing detail by run."""
    first = F.min_by("detail", F.when(~F.col("passed"), F.col("run")))
    return checks.groupBy("query_id").agg(F.count("*").alias("runs"), F.count_if("passed").alias("passed"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("rate"), F.when(F.count_if(~F.col("passed")) > 0, first).alias("first_failure"))


def unsatisfiable(oracles: DataFrame, records: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, problem): required records that don't exist, value paths that no required record carries."""
    need = oracles.select("query_id", F.explode("required_records").alias("record_id"))
    gone = need.join(records.select("record_id").distinct(), "record_id", "left_anti").select("query_id", F.concat(F.lit("no record "), "record_id").alias("problem"))
    paths = oracles.select("query_id", "required_records", F.explode("value_paths").alias("prefix"))
    carried = chunks.select("record_id", "value_path").distinct()
    wanted = paths.select("query_id", "prefix", F.explode("required_records").alias("record_id"))
    hit = wanted.join(carried, "record_id").where(F.col("value_path").startswith(F.col("prefix"))).select("query_id", "prefix").distinct()
    lost = paths.join(hit, ["query_id", "prefix"], "left_anti").select("query_id", F.concat(F.lit("no path "), "prefix").alias("problem"))
    return gone.unionByName(lost)


def reingest_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """(record_id, passed): chunk ids of a record before and after are both there and differ."""
    a = before.groupBy("record_id").agg(F.count("*").alias("n_before"), F.sum(F.xxhash64("chunk_id").cast("decimal(38,0)")).alias("h_before"))
    b = after.groupBy("record_id").agg(F.count("*").alias("n_after"), F.sum(F.xxhash64("chunk_id").cast("decimal(38,0)")).alias("h_after"))
    both = a.join(b, "record_id", "full_outer")
    same = (F.col("n_before") == F.col("n_after")) & (F.col("h_before") == F.col("h_after"))
    return both.select("record_id", (F.col("n_before").isNotNull() & F.col("n_after").isNotNull() & ~F.coalesce(same, F.lit(False))).alias("passed"))


def facet_failure(facets: DataFrame, coverage: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, stage): where a question that asks for a decision and its reason went wrong; null if nowhere.

    ``facets`` (query_id, facet_id, pos, text), ``coverage`` (query_id,
    facet_id, covered), ``results`` (query_id, state).
    """
    low = F.lower("text")
    asked = facets.withColumn("reason", F.contains(low, F.lit("why")) | F.contains(low, F.lit("reason")))
    kinds = asked.groupBy("query_id").agg(F.bool_or("reason").alias("has_reason"), F.bool_or(~F.col("reason")).alias("has_decision"), F.min_by("facet_id", F.when(~F.col("reason"), F.col("pos"))).alias("facet_id"))
    rows = results.join(kinds, "query_id", "left").join(coverage.select("query_id", "facet_id", "covered"), ["query_id", "facet_id"], "left")
    both = F.coalesce(F.col("has_reason") & F.col("has_decision"), F.lit(False))
    stage = F.when(F.col("state") == "failed", None).when(~both, "facet_extraction").when(F.coalesce("covered", F.lit(False)), "coverage_directness").when(F.col("state") == "answered", "query_state")
    return rows.select("query_id", stage.alias("stage"))


def attempts(rows: DataFrame) -> DataFrame:
    """Provider attempts by concern and outcome: counts, retries, time and tokens.

    ``rows`` (concern, attempt_number, elapsed_ms, outcome, tokens).
    """
    return rows.groupBy("concern", "outcome").agg(F.count("*").alias("attempts"), F.count_if(F.col("attempt_number") > 1).alias("retries"), F.round(F.sum("elapsed_ms"), 3).alias("elapsed_ms"), F.sum("tokens").alias("tokens"))


def write_deviations(results: DataFrame, checks: DataFrame, path: str) -> None:
    """The whole results of failing runs as JSON, in a folder for each question."""
    failed = checks.where(~F.col("passed")).select("query_id", "run", "detail")
    results.join(failed, ["query_id", "run"]).write.partitionBy("query_id").json(path)

"""Records to units, units to chunks.

Units are records unpivoted along the chunkable value paths. A unit's
paragraphs are packed greedily by a fold over an ordered array: nothing is
shuffled. Each chunk after a unit's first begins with the longest run of whole
sentences that ends the chunk before it and fits in 15 % of its tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import json_text, paragraphs, sentences, token_count, unix_lines

TARGET, OVERLAP, MODEL_LIMIT = 400, 0.15, 8191
BATCH_CHUNKS, BATCH_TOKENS = 64, 50_000
Counter = Callable[[Column], Column]


def units(records: DataFrame) -> DataFrame:
    """(id, title, fingerprint, schema_order, value_path, text): a row for each non-blank value of a record."""
    nothing = F.array().cast("array<string>")

    def listed(order: int, name: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, nothing), lambda v, i: F.struct(F.lit(order).alias("schema_order"), i.alias("i"), F.concat(F.lit(name + "["), i.cast("string"), F.lit("]")).alias("value_path"), v.alias("text")))

    def single(order: int, name: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(order).alias("schema_order"), F.lit(0).alias("i"), F.lit(name).alias("value_path"), value.alias("text")))

    lost = F.transform(F.col("decision.alternatives"), alternative_text)
    parts = F.concat(
        single(0, "context.problem", F.col("context.problem")),
        single(1, "context.triggering_change", F.col("context.triggering_change")),
        single(2, "decision.chosen", F.col("decision.chosen")),
        listed(3, "decision.alternatives", lost),
        listed(4, "why", F.col("why")),
        single(5, "rationale_summary", F.col("rationale_summary")),
        listed(6, "consequences.positive", F.col("consequences.positive")),
        listed(7, "consequences.negative", F.col("consequences.negative")),
        listed(8, "body", body_units(F.col("body"))),
    )
    shown = F.filter(parts, lambda p: F.coalesce(F.trim(F.regexp_replace(p["text"], r"\s+", " ")) != "", F.lit(False)))
    # ``inline_outer``, so that no filter on the array's size is inferred and evaluated along with all that makes the array
    rows = records.select("id", "title", "fingerprint", F.inline_outer(shown)).where("value_path is not null")
    return rows.select("id", "title", "fingerprint", "schema_order", "i", "value_path", "text")


def alternative_text(a: Column) -> Column:
    """``Alternative: title`` and, if there is one, ``Rejected because: reason``."""
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return F.array_join(F.array_compact(F.array(F.when(has(a["title"]), F.concat(F.lit("Alternative: "), a["title"])), F.when(has(a["rejection_reason"]), F.concat(F.lit("Rejected because: "), a["rejection_reason"])))), "\n")


def body_units(body: Column) -> Column:
    """The text before the first ``## `` heading, then each section with its heading."""
    marked = F.regexp_replace(unix_lines(body), r"(?m)^##[ \t]+", "\x1e")
    parts = F.transform(
        F.split(marked, "\x1e"),
        lambda p, i: F.when(i == 0, F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))).otherwise(
            F.concat(F.lit("## "), F.trim(F.substring_index(p, "\n", 1)), F.lit("\n\n"), F.regexp_replace(F.when(F.instr(p, "\n") > 0, F.substring(p, F.instr(p, "\n") + 1, F.length(p))).otherwise(F.lit("")), r"^\s+|\s+$", ""))
        ),
    )
    return F.filter(parts, lambda p: F.trim(p) != "")


def pack(pieces: Column, joiner: str, target: int = TARGET, count: Counter = token_count) -> Column:
    """Greedy packing of an array of texts: each pack has ``target`` tokens at most, or is one piece.

    ``count`` is additive over blanks, as the offline counter is: each piece is counted once.
    """
    sized = F.transform(pieces, lambda p: F.struct(p.alias("text"), count(p).alias("n")))
    return F.aggregate(sized, _nothing(), lambda acc, p: _added(acc, p, joiner, target), lambda acc: _closed(acc, joiner))


def _nothing() -> Column:
    none = F.array().cast("array<string>")
    return F.struct(none.alias("done"), none.alias("cur"), F.lit(0).alias("n"))


def _added(acc: Column, p: Column, joiner: str, target: int) -> Column:
    """A fold step: the open pack is a list of texts, joined when it closes."""
    fits = (F.size(acc["cur"]) == 0) | (acc["n"] + p["n"] <= target)
    more = F.struct(acc["done"].alias("done"), F.array_append(acc["cur"], p["text"]).alias("cur"), (acc["n"] + p["n"]).alias("n"))
    return F.when(fits, more).otherwise(F.struct(F.array_append(acc["done"], F.array_join(acc["cur"], joiner)).alias("done"), F.array(p["text"]).alias("cur"), p["n"].alias("n")))


def _closed(acc: Column, joiner: str) -> Column:
    return F.when(F.size(acc["cur"]) > 0, F.array_append(acc["done"], F.array_join(acc["cur"], joiner))).otherwise(acc["done"])


def packed(text: Column, target: int = TARGET, count: Counter = token_count, compat: bool = False) -> Column:
    """The chunks of a text: packed paragraphs; a longer paragraph is packed by sentences, on its own."""
    sized = F.transform(paragraphs(text), lambda p: F.struct(p.alias("text"), count(p).alias("n")))

    def step(acc: Column, p: Column) -> Column:
        alone = F.concat(_closed(acc, "\n\n"), pack(sentences(p["text"], compat), " ", target, count))
        return F.when(p["n"] > target, F.struct(alone.alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))).otherwise(_added(acc, p, "\n\n", target))

    return F.aggregate(sized, _nothing(), step, lambda acc: _closed(acc, "\n\n"))


def overlap(chunk: Column, count: Counter = token_count, compat: bool = False) -> Column:
    """The longest run of whole sentences at a chunk's end within 15 % of its tokens; empty if none fits."""
    sized = F.transform(F.reverse(sentences(chunk, compat)), lambda s: F.struct(s.alias("text"), count(s).alias("n")))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("tail"), F.lit(0).alias("n"), F.lit(False).alias("full"), F.greatest(F.lit(1), F.floor(count(chunk) * OVERLAP).cast("int")).alias("limit"))

    def step(acc: Column, s: Column) -> Column:
        full = acc["full"] | (acc["n"] + s["n"] > acc["limit"])
        return F.struct(F.when(full, acc["tail"]).otherwise(F.array_append(acc["tail"], s["text"])).alias("tail"), F.when(full, acc["n"]).otherwise(acc["n"] + s["n"]).alias("n"), full.alias("full"), acc["limit"].alias("limit"))

    return F.aggregate(sized, start, step, lambda acc: F.array_join(F.reverse(acc["tail"]), " "))


def with_overlap(chunks: Column, count: Counter = token_count, compat: bool = False) -> Column:
    """Each chunk but the first with the end of its predecessor before it."""

    def one(c: Column, i: Column) -> Column:
        return F.array_join(F.filter(F.array(overlap(F.get(chunks, i - 1), count, compat), c), lambda x: x != ""), "\n\n")

    return F.transform(chunks, lambda c, i: F.when(i > 0, one(c, i)).otherwise(c))


def embedding_input(title: Column, value_path: Column, text: Column) -> Column:
    flat = F.trim(F.regexp_replace(title, r"\s+", " "))
    return F.concat(F.lit("Record title: "), flat, F.lit("\nValue path: "), value_path, F.lit("\n\n"), text)


def chunk_id(generation: str, record_id: Column, fingerprint: Column, value_path: Column, ordinal: Column) -> Column:
    """``ch_`` and the SHA-256 of the compact JSON array of the locator."""
    parts = [F.lit('"chunk-v1"'), *[json_text(c) for c in (F.lit(generation), record_id, fingerprint, value_path)], ordinal.cast("string")]
    text = F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    return F.concat(F.lit("ch_"), F.sha2(text, 256))


def plan(unit_rows: DataFrame, generation: str, count: Counter = token_count, compat: bool = False) -> DataFrame:
    """Chunks of units with ids, counts and the oversize flag of embedding inputs.

    Ordinals number a value path's chunks. ``oversize`` rows fail their record.
    """
    rows = unit_rows.withColumn("parts", packed(F.col("text"), TARGET, count, compat)).withColumn("parts", with_overlap(F.col("parts"), count, compat))
    rows = rows.select("id", "title", "fingerprint", "schema_order", "i", "value_path", F.posexplode_outer("parts").alias("ordinal", "text")).where("ordinal is not null")
    given = embedding_input(F.col("title"), F.col("value_path"), F.col("text"))
    rows = rows.withColumn("chunk_id", chunk_id(generation, F.col("id"), F.col("fingerprint"), F.col("value_path"), F.col("ordinal")))
    rows = rows.withColumn("embedding_input", given).withColumn("evidence_tokens", count(F.col("text"))).withColumn("input_tokens", count(given))
    return rows.withColumn("oversize", F.col("input_tokens") > MODEL_LIMIT)


def missing_provenance(unit_rows: DataFrame, field_sources: DataFrame) -> DataFrame:
    """(id, value_path) of units that no source is given for."""
    return unit_rows.select("id", "value_path").distinct().join(field_sources.select("id", "value_path"), ["id", "value_path"], "left_anti")


def batches(tokens: Column, chunks: int = BATCH_CHUNKS, limit: int = BATCH_TOKENS) -> Column:
    """The batch number (from 0) of each element of an array of token counts, in order."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("sum"))

    def step(acc: Column, t: Column) -> Column:
        new = (acc["n"] > 0) & ((acc["n"] >= chunks) | (acc["sum"] + t > limit))
        batch = F.when(new, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(F.array_append(acc["out"], batch).alias("out"), batch.alias("batch"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), F.when(new, t.cast("bigint")).otherwise(acc["sum"] + t).alias("sum"))

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])

"""Claim verification over drafts, decompositions and verdicts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.claims import MAX_CLAIMS, additive_failure, first_uncovered, prepared, sentence_tokens
from tessera.functions.text import containment_form

#: Characters of claims that one automaton is made of; a character costs it some 30 bytes.
BLOCK_CHARS = 4_000_000


def contained(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """(claim_id, contained): the folded claim is a substring of a cited chunk.

    ``claims`` (claim_id, text), ``cited`` (claim_id, text of one cited chunk).
    """
    own = claims.select("claim_id", containment_form(F.col("text")).alias("claim"))
    chunks = cited.select("claim_id", containment_form(F.col("text")).alias("chunk"))
    hit = F.coalesce((F.col("claim") != "") & F.contains(F.col("chunk"), F.col("claim")), F.lit(False))
    return own.join(chunks, "claim_id", "left").groupBy("claim_id").agg(F.bool_or(hit).alias("contained"))


def holders(claims: DataFrame, chunks: DataFrame, claim_id: str, chunk_id: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(claim_id, chunk_id): which chunks hold which claims, both folded (columns ``claim`` and ``chunk``).

    The claims make one Aho-Corasick automaton, so that a chunk is read once
    whatever their number. They reach the tasks in blocks of ``block_chars``
    characters (or one claim), each a pass over the chunks; a task holds one
    automaton. Blank claims are in no chunk.
    """
    out = [_found(chunks, claims, block, claim_id, chunk_id) for block in _claim_blocks(claims.where("claim <> ''").select(claim_id, "claim").distinct(), block_chars)]
    return reduce(DataFrame.unionByName, out) if out else claims.select(claim_id).limit(0).join(chunks.select(chunk_id).limit(0))


def _claim_blocks(claims: DataFrame, limit: int) -> Iterator[list[tuple]]:
    block, chars = [], 0
    for row in claims.toLocalIterator():
        if block and chars + len(row[1]) + 8 > limit:
            yield block
            block, chars = [], 0
        block.append(tuple(row))
        chars += len(row[1]) + 8
    if block:
        yield block


#: The last block that a Python worker has seen, and its automaton.
_last: list = [None, None]


def _found(chunks: DataFrame, claims: DataFrame, block: list[tuple], claim_id: str, chunk_id: str) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(block)
    ctype, ktype = claims.schema[claim_id].dataType, chunks.schema[chunk_id].dataType
    kind = to_arrow_type(ctype)

    def automaton() -> ahocorasick.Automaton:
        if _last[0] is not shared.value:
            made = ahocorasick.Automaton()
            for i, (_, text) in enumerate(shared.value):
                made.add_word(text, [*made.get(text, []), i])
            made.make_automaton()
            _last[:] = shared.value, made
        return _last[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton()
        ids = pa.array([r[0] for r in shared.value], kind)
        for b in batches:
            rows, hits = [], []
            for row, text in enumerate(b.column(1)):
                own = {i for _, same in find.iter(text.as_py() or "") for i in same}
                rows += [row] * len(own)
                hits += own
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(hits, pa.int64())), b.column(0).take(pa.array(rows, pa.int64()))], [claim_id, chunk_id])

    return chunks.select(chunk_id, "chunk").mapInArrow(run, f"`{claim_id}` {ctype.simpleString()}, `{chunk_id}` {ktype.simpleString()}")


def decomposition_verdicts(rows: DataFrame) -> DataFrame:
    """``rows`` (sentence_id, parent, sub_claims) with disposition, additive_failure, failure_token, failure_side.

    In this order: over_cap, duplicate, not_additive (the first failing claim
    and token), incomplete (the first parent word not covered), valid.
    """
    rows = rows.withColumn("__claims", folded_all(F.col("sub_claims"))).withColumn("__parent", prepared(sentence_tokens(containment_form(F.col("parent")))))
    rows = rows.withColumn("__tokens", F.transform("__claims", lambda c: prepared(sentence_tokens(c))))
    rows = rows.withColumn("__failures", F.transform("__tokens", lambda t: additive_failure(t, F.col("__parent"))))
    rows = rows.withColumn("__failed", F.try_element_at(F.filter("__failures", lambda f: f.isNotNull()), F.lit(1)))
    rows = rows.withColumn("__response", F.flatten("__tokens")).withColumn("__missed", first_uncovered(F.col("__parent"), F.col("__response")))
    n = F.size("sub_claims")
    said = (
        F.when(n > MAX_CLAIMS, "over_cap")
        .when(F.size(F.array_distinct("__claims")) < n, "duplicate")
        .when(F.col("__failed").isNotNull(), "not_additive")
        .when(F.col("__missed").isNotNull(), "incomplete")
        .otherwise("valid")
    )
    rows = rows.withColumn("disposition", said)
    additive, incomplete = F.col("disposition") == "not_additive", F.col("disposition") == "incomplete"
    rows = rows.withColumn("additive_failure", F.when(additive, F.col("__failed.category")).otherwise(""))
    rows = rows.withColumn("failure_token", F.when(additive, F.col("__failed.token")).when(incomplete, F.col("__missed")).otherwise(""))
    rows = rows.withColumn("failure_side", F.when(additive, "sub_claim").when(incomplete, "parent").otherwise(""))
    return rows.drop("__claims", "__parent", "__tokens", "__failures", "__failed", "__response", "__missed")


def folded_all(claims: Column) -> Column:
    """``containment_form`` of each text of an array.

    No Python can run inside an array function, so the texts are folded as one
    and parted again at ``PART``, which survives folding and which texts lose
    before; null claims count as empty.
    """
    plain = F.transform(claims, lambda c: F.translate(F.coalesce(c, F.lit("")), PART, ""))
    parts = F.transform(F.split(containment_form(F.array_join(plain, PART)), PART), lambda c: F.trim(c))
    return F.when(F.size(claims) > 0, parts).otherwise(F.array().cast("array<string>"))


#: A code point that is set aside as no character.
PART = "\ufdd0"


def sentence_fates(drafts: DataFrame, chunks: DataFrame, decompositions: DataFrame, entailments: DataFrame) -> DataFrame:
    """(sentence_id, fate, reason, citations) of draft sentences.

    ``drafts`` (sentence_id, text, chunk_ids), ``chunks`` (chunk_id, text),
    ``decompositions`` (sentence_id, attempt, sub_claims), ``entailments``
    (sub_claim, sentence_id, supported). A contained sentence is emitted;
    without an available citation it is dropped; otherwise the last attempt (a
    second is used only if the first is not_additive or incomplete) must be
    valid and every sub-claim contained or entailed. All or nothing.
    """
    cited = drafts.select("sentence_id", F.explode_outer(F.array_distinct("chunk_ids")).alias("chunk_id")).join(chunks.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id")
    whole = contained(drafts.select(F.col("sentence_id").alias("claim_id"), "text"), cited.select(F.col("sentence_id").alias("claim_id"), F.col("chunk_text").alias("text")))
    available = cited.groupBy("sentence_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("citations"))
    tried = decomposition_verdicts(decompositions.join(drafts.select("sentence_id", F.col("text").alias("parent")), "sentence_id"))
    first = tried.where("attempt = 1").select("sentence_id", F.col("disposition").alias("first_said"))
    used = tried.join(first, "sentence_id", "left").where("attempt = 1 or (attempt = 2 and first_said in ('not_additive', 'incomplete'))")
    last = used.withColumn("__r", F.row_number().over(Window.partitionBy("sentence_id").orderBy(F.desc("attempt")))).where("__r = 1")
    parts = last.select("sentence_id", F.posexplode("sub_claims").alias("pos", "sub_claim"))
    in_chunks = contained(
        parts.select(F.struct("sentence_id", "pos").alias("claim_id"), F.col("sub_claim").alias("text")),
        parts.join(cited, "sentence_id").select(F.struct("sentence_id", "pos").alias("claim_id"), F.col("chunk_text").alias("text")),
    ).select(F.col("claim_id.sentence_id").alias("sentence_id"), F.col("claim_id.pos").alias("pos"), "contained")
    judged = parts.join(in_chunks, ["sentence_id", "pos"]).join(entailments.select("sentence_id", "sub_claim", "supported"), ["sentence_id", "sub_claim"], "left")
    backed = judged.groupBy("sentence_id").agg(F.bool_and(F.col("contained") | F.coalesce("supported", F.lit(False))).alias("backed"))
    rows = drafts.select("sentence_id").join(whole.select(F.col("claim_id").alias("sentence_id"), "contained"), "sentence_id").join(available, "sentence_id", "left")
    rows = rows.join(last.select("sentence_id", "disposition", F.size("sub_claims").alias("n")), "sentence_id", "left").join(backed, "sentence_id", "left")
    reason = (
        F.when(F.col("contained"), None)
        .when(F.col("citations").isNull(), "no_available_citations")
        .when(F.coalesce(F.col("n"), F.lit(0)) == 0, "decomposition_invalid")
        .when(F.col("disposition") != "valid", "decomposition_invalid")
        .when(~F.coalesce("backed", F.lit(False)), "unsupported_sub_claim")
    )
    return rows.withColumn("reason", reason).select("sentence_id", F.when(F.col("reason").isNull(), "emitted").otherwise("dropped").alias("fate"), "reason", "citations")


def coverage(facets: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, abstains, cause): a question abstains unless every facet is covered.

    ``facets`` (query_id, facet_id), ``rows`` (query_id, facet_id, covered, reason).
    No row for any facet means that no sentence was emitted.
    """
    all_rows = facets.join(rows, ["query_id", "facet_id"], "left")
    nothing = F.coalesce("reason", F.lit("no_emitted_sentence")) == "no_emitted_sentence"
    out = all_rows.groupBy("query_id").agg(F.bool_or(~F.coalesce("covered", F.lit(False))).alias("abstains"), F.bool_and(nothing).alias("silent"))
    return out.select("query_id", "abstains", F.when(F.col("abstains"), F.when(F.col("silent"), "no_emitted_sentences").otherwise("uncovered_facet")).alias("cause"))

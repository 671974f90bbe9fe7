"""Chunking, claim verification and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import claims as fc
from tessera.functions.paths import LABELS, evidence_block
from tessera.functions.text import containment_form, is_one_sentence, paragraphs, sentences, token_count, without_markers
from tessera.operators import chunking, doctor, packing
from tessera.operators import claims as oc
from tessera.plans.base import quoted, spread, table, texts
from tessera.plans.text_sql import ADDITIVE_VERDICT, DECOMPOSITION_VERDICT, END, FOLD_SQL, MARK, OVERLAP_CHUNKS, PACK_CHUNKS, SENTENCE_FATE, batches_sql
from tessera.plans.text_sql import base_sql as _base_sql
from tessera.plans.text_sql import tokens_sql as _tokens_sql


def _spaced(spark, d):
    """Documents whose lines are paragraphs."""
    return texts(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n \n")).alias("text"))


def paragraph_split(spark, d):
    return _spaced(spark, d).select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("pos", "paragraph")).withColumn("pos", F.col("pos").cast("bigint"))


def sentence_split(spark, d):
    rows = texts(spark, d).select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


def sentence_split_compat(spark, d):
    rows = texts(spark, d).select("doc_id", F.posexplode(sentences(F.col("text"), compat=True)).alias("pos", "sentence"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


def records(spark, d):
    """Parts seen as decision records."""
    p, key = spread(table(spark, d, "part")), F.col("p_partkey")
    name = lambda k: F.concat(F.lit("P-"), k.cast("string"))
    return p.select(
        name(key).alias("id"),
        F.col("p_name").alias("title"),
        F.when(key % 9 == 0, None).otherwise(F.lit("accepted")).alias("status"),
        F.when(key % 10 == 3, "2024-02-31").when(key % 10 == 4, "soon").otherwise("2024-02-28").alias("date"),
        F.concat(F.lit("Intro of "), "p_name", F.lit("\n## Notes\n"), "p_type", F.lit("\n## Size\n"), F.col("p_size").cast("string")).alias("body"),
        F.struct(F.col("p_brand").alias("problem"), F.when(key % 4 == 0, F.col("p_type")).alias("triggering_change")).alias("context"),
        F.struct(F.when(key % 8 == 0, " ").otherwise(F.col("p_type")).alias("chosen"), F.array(F.struct(F.col("p_brand").alias("title"), F.when(key % 3 == 0, "too small").alias("rejection_reason"))).alias("alternatives")).alias("decision"),
        F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name", "p_brand")).alias("why"),
        F.when(key % 2 == 0, F.col("p_type")).alias("rationale_summary"),
        F.struct(F.array(F.col("p_type")).alias("positive"), F.array().cast("array<string>").alias("negative")).alias("consequences"),
        F.array(
            F.struct(F.when(key % 6 == 0, "spec").when(key % 6 == 1, "file").when(key % 6 < 5, "commit").alias("kind"), F.when(key % 6 == 0, F.concat(F.lit("docs/specs/"), "p_brand")).when(key % 6 == 1, F.concat(F.lit("./src//"), "p_brand")).when(key % 7 == 0, "").otherwise(F.substring(F.md5("p_name"), 1, 3)).alias("target"), F.lit(None).cast("string").alias("note"))
        ).alias("evidence"),
        F.array("p_brand").alias("tags"),
        F.when(key % 3 == 0, name(key - 1)).when(key % 17 == 0, name(key)).alias("supersedes"),
        F.sha2("p_name", 256).alias("fingerprint"),
    )


RECORDS_SQL = """rec AS (
    SELECT 'P-' || p_partkey AS id, p_name AS title, p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'accepted' END AS status,
           CASE p_partkey % 10 WHEN 3 THEN '2024-02-31' WHEN 4 THEN 'soon' ELSE '2024-02-28' END AS date, p_name, p_brand, p_type, p_size, sha256(p_name) AS fingerprint,
           CASE WHEN p_partkey % 8 = 0 THEN ' ' ELSE p_type END AS chosen,
           CASE WHEN p_partkey % 6 = 0 THEN 'spec' WHEN p_partkey % 6 = 1 THEN 'file' WHEN p_partkey % 6 < 5 THEN 'commit' END AS kind,
           CASE WHEN p_partkey % 6 = 0 THEN 'docs/specs/' || p_brand WHEN p_partkey % 6 = 1 THEN './src//' || p_brand WHEN p_partkey % 7 = 0 THEN '' ELSE substr(md5(p_name), 1, 3) END AS target,
           CASE WHEN p_partkey % 3 = 0 THEN 'P-' || (p_partkey - 1) WHEN p_partkey % 17 = 0 THEN 'P-' || p_partkey END AS supersedes FROM part)"""
UNITS_SQL = """units AS (
    SELECT id, title, fingerprint, 0 AS schema_order, 'context.problem' AS value_path, p_brand AS text FROM rec
    UNION ALL SELECT id, title, fingerprint, 1, 'context.triggering_change', p_type FROM rec WHERE k % 4 = 0
    UNION ALL SELECT id, title, fingerprint, 2, 'decision.chosen', chosen FROM rec WHERE trim(chosen) <> ''
    UNION ALL SELECT id, title, fingerprint, 3, 'decision.alternatives[0]', 'Alternative: ' || p_brand || CASE WHEN k % 3 = 0 THEN chr(10) || 'Rejected because: too small' ELSE '' END FROM rec
    UNION ALL SELECT id, title, fingerprint, 4, 'why[0]', p_name FROM rec WHERE k % 5 <> 0
    UNION ALL SELECT id, title, fingerprint, 4, 'why[1]', p_brand FROM rec WHERE k % 5 <> 0
    UNION ALL SELECT id, title, fingerprint, 5, 'rationale_summary', p_type FROM rec WHERE k % 2 = 0
    UNION ALL SELECT id, title, fingerprint, 6, 'consequences.positive[0]', p_type FROM rec
    UNION ALL SELECT id, title, fingerprint, 8, 'body[0]', 'Intro of ' || p_name FROM rec
    UNION ALL SELECT id, title, fingerprint, 8, 'body[1]', '## Notes' || chr(10) || chr(10) || p_type FROM rec
    UNION ALL SELECT id, title, fingerprint, 8, 'body[2]', '## Size' || chr(10) || chr(10) || p_size FROM rec)"""


def unpivot_units(spark, d):
    return chunking.units(records(spark, d)).select("id", "schema_order", "value_path", "text")


def embedding_input(spark, d):
    rows = chunking.units(records(spark, d))
    return rows.select("id", "value_path", chunking.embedding_input(F.col("title"), F.col("value_path"), F.col("text")).alias("input"))


def chunk_ids(spark, d):
    rows = chunking.plan(chunking.units(records(spark, d)), "g1")
    return rows.select("id", "value_path", F.col("ordinal").cast("bigint").alias("ordinal"), "chunk_id", "text", "oversize")


def evidence_blocks(spark, d):
    rows = chunking.units(records(spark, d))
    return rows.select("id", "value_path", evidence_block(F.col("schema_order") + 1, F.col("id"), F.col("value_path"), F.col("text")).alias("block"))


def missing_provenance(spark, d):
    rows = chunking.units(records(spark, d))
    given = rows.where("schema_order in (0, 2, 4, 8)").select("id", "value_path")
    return chunking.missing_provenance(rows, given)


def pack_chunks(spark, d):
    rows = _spaced(spark, d).select("doc_id", F.posexplode(chunking.packed(F.col("text"))).alias("ordinal", "text"))
    return rows.withColumn("ordinal", F.col("ordinal").cast("bigint"))


def overlap_chunks(spark, d):
    rows = _spaced(spark, d).select("doc_id", chunking.packed(F.col("text")).alias("chunks"))
    return rows.select("doc_id", F.posexplode(chunking.with_overlap(F.col("chunks"))).alias("ordinal", "text"))


def lateral_chunks(spark, d):
    """The chunks of ``overlap_chunks`` by the table function, in Spark's SQL."""
    spark.udtf.register("text_chunks", packing.TextChunks)
    _spaced(spark, d).createOrReplaceTempView("spaced_documents")
    return spark.sql("SELECT doc_id, c.ordinal, c.chunk AS text FROM spaced_documents, LATERAL text_chunks(text) c")


def bpe_chunks(spark, d):
    """Chunks of at most 400 byte-pair tokens before overlap, with their counts."""
    import public_tokenizers

    units = _spaced(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("f").alias("fingerprint"), F.lit(0).alias("schema_order"), F.lit(0).alias("i"), F.lit("body[0]").alias("value_path"), "text")
    rows = packing.plan(units, "g", packing.bpe_counter, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select(F.col("id").cast("bigint").alias("doc_id"), "ordinal", "text", "evidence_tokens")


#: Chunks and tokens a batch of a document holds at most.
BATCH = (3, 900)


def batch_assignment(spark, d):
    """The chunks of each document, dealt to batches of bounded size."""
    rows = _spaced(spark, d).select("doc_id", chunking.packed(F.col("text")).alias("chunks"))
    rows = rows.withColumn("batches", chunking.batches(F.transform("chunks", token_count), *BATCH))
    return rows.select("doc_id", F.posexplode("batches").alias("ordinal", "batch")).withColumn("ordinal", F.col("ordinal").cast("bigint"))


def marker_strip(spark, d):
    docs = texts(spark, d)
    one, two = F.sha2("text", 256), F.upper(F.sha2("source", 256))
    marked = F.concat(F.lit("[ch_"), one, F.lit(", CH_"), two, F.lit("] "), F.col("text"), F.lit(" (see [ch_"), one, F.lit("] )  and [ more\tch_"), two, F.lit(" ] ."))
    return docs.select("doc_id", without_markers(marked).alias("text"))


def one_sentence(spark, d):
    return texts(spark, d).select("doc_id", is_one_sentence(F.col("text")).alias("one"))


def claim_containment(spark, d):
    """Which documents hold which benchmark passage: a set of claims against all rows."""
    claims = table(spark, d, "benchmark").select("item_id", containment_form(F.col("text")).alias("claim"))
    docs = texts(spark, d).select("doc_id", containment_form(F.col("text")).alias("chunk"))
    return oc.holders(claims, docs, "item_id", "doc_id")


def sentence_tokens(spark, d):
    tokens = fc.sentence_tokens(containment_form(F.col("text")))
    return texts(spark, d).select("doc_id", F.posexplode(tokens).alias("pos", "token")).withColumn("pos", F.col("pos").cast("bigint"))


def _vocabulary(spark, d):
    return texts(spark, d).select(F.explode(fc.sentence_tokens(containment_form(F.col("text")))).alias("token")).distinct()


def base_sets(spark, d):
    return _vocabulary(spark, d).select("token", F.array_join(F.array_sort(fc.base_set(F.col("token"))), ",").alias("bases"))


def token_match_pairs(spark, d):
    """Pairs of different content words with a base in common, by an equi-join on the bases."""
    words = _vocabulary(spark, d).where(~F.col("token").isin(fc.FUNCTION_WORDS))
    bases = words.select("token", F.explode(fc.base_set(F.col("token"))).alias("base"))
    other = bases.select(F.col("token").alias("other"), "base")
    return bases.join(other, "base").where("token < other").select("token", "other").distinct()


def _decompositions(spark, d):
    """Each passage split into its sentences, and into those of the next passage."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("parent"), sentences(F.col("text")).alias("own"))
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("own").alias("next"))
    both = items.join(after, "item_id", "left")
    own = both.select(F.concat(F.lit("own-"), F.col("item_id").cast("string")).alias("sentence_id"), "parent", F.col("own").alias("sub_claims"))
    part = both.select(F.concat(F.lit("part-"), F.col("item_id").cast("string")).alias("sentence_id"), "parent", F.slice("own", 1, 1).alias("sub_claims"))
    twice = both.select(F.concat(F.lit("twice-"), F.col("item_id").cast("string")).alias("sentence_id"), "parent", F.concat(F.slice("own", 1, 2), F.slice("own", 1, 1)).alias("sub_claims"))
    other = both.where("next is not null").select(F.concat(F.lit("other-"), F.col("item_id").cast("string")).alias("sentence_id"), "parent", "next")
    return own.union(part).union(twice).union(other).withColumn("parent", F.upper("parent"))


def decomposition_verdict(spark, d):
    return oc.decomposition_verdicts(_decompositions(spark, d)).select("sentence_id", "disposition", "additive_failure", "failure_token", "failure_side")


def additive_verdict(spark, d):
    rows = _decompositions(spark, d).select("sentence_id", "parent", F.posexplode("sub_claims").alias("pos", "claim"))
    tokens = lambda c: fc.prepared(fc.sentence_tokens(containment_form(F.col(c))))
    rows = rows.withColumn("c", tokens("claim")).withColumn("p", tokens("parent"))
    rows = rows.select("sentence_id", F.col("pos").cast("bigint").alias("pos"), fc.additive_failure(F.col("c"), F.col("p")).alias("v"))
    return rows.select("sentence_id", "pos", "v.category", "v.token")


def completeness_verdict(spark, d):
    """The first word of a passage that its first sentence lacks."""
    fold = lambda c: fc.prepared(fc.sentence_tokens(containment_form(c)))
    items = table(spark, d, "benchmark").select("item_id", fold(F.col("text")).alias("p"), fold(F.get(sentences(F.col("text")), F.lit(0))).alias("r"))
    return items.select("item_id", fc.first_uncovered(F.col("p"), F.col("r")).alias("missed"))


def sentence_fate(spark, d):
    """Passages as drafts that cite the documents with their own number and the next."""
    items = table(spark, d, "benchmark")
    cited = F.array(F.col("item_id").cast("string"), (F.col("item_id") + 1).cast("string"))
    drafts = items.select(F.col("item_id").alias("sentence_id"), "text", cited.alias("chunk_ids"))
    chunks = texts(spark, d).select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    split = items.select(F.col("item_id").alias("sentence_id"), F.lit(1).alias("attempt"), sentences(F.col("text")).alias("sub_claims"))
    judged = split.select("sentence_id", F.explode("sub_claims").alias("sub_claim")).withColumn("supported", F.col("sentence_id") % 2 == 0).distinct()
    return oc.sentence_fates(drafts, chunks, split, judged).select("sentence_id", "fate", "reason", F.array_join("citations", ",").alias("citations"))


def coverage_abstention(spark, d):
    turns = table(spark, d, "conversations")
    facets = turns.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("facet_id"))
    rows = turns.where("role <> 'system'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("facet_id"), (F.length("text") % 5 > 0).alias("covered"), F.when(F.col("turn") % 2 == 0, "no_emitted_sentence").otherwise("other").alias("reason"))
    return oc.coverage(facets, rows)


def _surveyed(spark, d):
    heads = F.array_distinct(F.transform(F.split("text", "\n"), lambda line: F.substring_index(line, " ", 1)))
    return texts(spark, d).select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.filter(heads, lambda h: h != "").alias("headings"))


def doctor_heading_frequency(spark, d):
    return doctor.heading_frequency(_surveyed(spark, d))


def doctor_heading_sets(spark, d):
    rows = doctor.heading_sets(_surveyed(spark, d))
    return rows.select(F.array_join("headings", "|").alias("headings"), "file_count", F.array_join("samples", ",").alias("samples"))


def doctor_skip_summary(spark, d):
    reasons = F.array(*[F.lit(r) for r in doctor.SKIP_REASONS])
    skips = table(spark, d, "events").select(F.concat(F.lit("e/"), F.col("event_id").cast("string")).alias("path"), F.get(reasons, (F.col("user_id") % 6).cast("int")).alias("reason"), (F.col("value") > 50).alias("unseen_contents"))
    rows = doctor.skip_summary(skips)
    return rows.select("position", "reason", "path_count", "unseen_count", F.array_join("samples", ",").alias("samples"))


LABEL_SQL = "CASE split_part(value_path, '[', 1) " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in LABELS.items()) + " ELSE '' END"
TOKENS_SQL = _tokens_sql("text")
VOCAB_SQL = f"vocab AS (SELECT DISTINCT unnest({TOKENS_SQL}) AS token FROM documents)"
NUMBERED = "SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, xs[i] AS {name} FROM (SELECT doc_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM ({inner}))"
SENTENCES_SQL = "list_filter(list_transform(string_split(regexp_replace(text, '({end})', '{put}', 'g'), chr(30)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
SURVEY_SQL = "survey AS (SELECT 'docs/' || doc_id || '.md' AS path, list_filter(list_distinct(list_transform(string_split(text, chr(10)), lambda l: split_part(l, ' ', 1))), lambda h: h <> '') AS headings FROM documents)"

QUERIES = {
    "paragraph_split": (paragraph_split, NUMBERED.format(name="paragraph", inner="SELECT doc_id, list_filter(string_split(regexp_replace(text, '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g'), chr(10)), lambda p: length(trim(p, ' ' || chr(9) || chr(10))) > 0) AS xs FROM documents")),
    "sentence_split": (sentence_split, NUMBERED.format(name="sentence", inner=f"SELECT doc_id, {SENTENCES_SQL.format(end=END, put=chr(92) + '1' + MARK)} AS xs FROM documents")),
    "sentence_split_compat": (sentence_split_compat, NUMBERED.format(name="sentence", inner=f"SELECT doc_id, {SENTENCES_SQL.format(end=END, put=MARK + chr(92) + '1')} AS xs FROM documents")),
    "unpivot_units": (unpivot_units, f"WITH {RECORDS_SQL}, {UNITS_SQL} SELECT id, schema_order, value_path, text FROM units"),
    "embedding_input": (embedding_input, f"WITH {RECORDS_SQL}, {UNITS_SQL} SELECT id, value_path, 'Record title: ' || trim(regexp_replace(title, '\\s+', ' ', 'g')) || chr(10) || 'Value path: ' || value_path || chr(10) || chr(10) || text AS input FROM units"),
    "chunk_ids": (
        chunk_ids,
        f"""WITH {RECORDS_SQL}, {UNITS_SQL} SELECT id, value_path, CAST(0 AS BIGINT) AS ordinal,
        'ch_' || sha256('["chunk-v1","g1","' || id || '","' || fingerprint || '","' || value_path || '",0]') AS chunk_id, text, false AS oversize FROM units""",
    ),
    "evidence_blocks": (evidence_blocks, f"WITH {RECORDS_SQL}, {UNITS_SQL} SELECT id, value_path, 'CHUNK ' || (schema_order + 1) || ' (' || id || ')' || chr(10) || 'Field: ' || {LABEL_SQL} || chr(10) || text AS block FROM units"),
    "missing_provenance": (missing_provenance, f"WITH {RECORDS_SQL}, {UNITS_SQL} SELECT DISTINCT id, value_path FROM units WHERE schema_order NOT IN (0, 2, 4, 8)"),
    "pack_chunks": (pack_chunks, PACK_CHUNKS),
    "overlap_chunks": (overlap_chunks, OVERLAP_CHUNKS),
    "lateral_chunks": (lateral_chunks, OVERLAP_CHUNKS),
    "bpe_chunks": (bpe_chunks, None),
    "batch_assignment": (batch_assignment, batches_sql(*BATCH)),
    "marker_strip": (
        marker_strip,
        r"""WITH m AS (SELECT doc_id, '[ch_' || sha256(text) || ', CH_' || upper(sha256(source)) || '] ' || text || ' (see [ch_' || sha256(text) || '] )  and [ more' || chr(9) || 'ch_' || upper(sha256(source)) || ' ] .' AS t FROM documents),
        g AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\[\s*ch_[0-9a-f]{64}(?:\s*,\s*ch_[0-9a-f]{64})*\s*\]', '', 'gi'), '\bch_[0-9a-f]{64}\b', '', 'gi') AS t FROM m)
        SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), ' ([.,;:!?)\]}])', '\1', 'g'), '([(\[{]) ', '\1', 'g')) AS text FROM g""",
    ),
    "one_sentence": (one_sentence, f"SELECT doc_id, len(regexp_extract_all(text, '{END}')) = 1 AS one FROM documents"),
    "claim_containment": (claim_containment, f"SELECT item_id, doc_id FROM (SELECT item_id, {FOLD_SQL.format('text')} AS claim FROM benchmark) b, (SELECT doc_id, {FOLD_SQL.format('text')} AS chunk FROM documents) d WHERE contains(chunk, claim)"),
    "sentence_tokens": (sentence_tokens, NUMBERED.format(name="token", inner="SELECT doc_id, " + "__T__" + " AS xs FROM documents").replace("__T__", TOKENS_SQL)),
    "base_sets": (base_sets, f"WITH {VOCAB_SQL} SELECT token, array_to_string(list_sort({_base_sql('token')}), ',') AS bases FROM vocab"),
    "token_match_pairs": (
        token_match_pairs,
        f"""WITH {VOCAB_SQL}, b AS (SELECT token, unnest({_base_sql("token")}) AS base FROM vocab WHERE token NOT IN ({quoted(fc.FUNCTION_WORDS)}))
        SELECT DISTINCT a.token, b.token AS other FROM b a JOIN b USING (base) WHERE a.token < b.token""",
    ),
    "additive_verdict": (additive_verdict, ADDITIVE_VERDICT),
    "completeness_verdict": (
        completeness_verdict,
        f"""WITH t AS (SELECT item_id, {TOKENS_SQL} AS ts, {SENTENCES_SQL.format(end=END, put=chr(92) + "1" + MARK)}[1] AS s FROM benchmark),
        r AS (SELECT item_id, {_tokens_sql("s")} AS rs FROM t),
        p AS (SELECT item_id, i, ts[i] AS token FROM (SELECT item_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM t)),
        rb AS (SELECT item_id, token, unnest({_base_sql("token")}) AS base FROM (SELECT item_id, unnest(rs) AS token FROM r) WHERE token NOT IN ({quoted(fc.FUNCTION_WORDS)})),
        pb AS (SELECT item_id, i, unnest({_base_sql("token")}) AS base FROM p WHERE token NOT IN ({quoted(fc.FUNCTION_WORDS)})),
        ok AS (SELECT DISTINCT item_id, i FROM pb JOIN rb USING (item_id, base)),
        miss AS (SELECT p.item_id, min(p.i) AS i FROM p ANTI JOIN ok ON p.item_id = ok.item_id AND p.i = ok.i
                 WHERE p.token NOT IN ({quoted(fc.FUNCTION_WORDS + fc.CLAUSE_CONNECTIVES)}) GROUP BY p.item_id)
        SELECT t.item_id, p.token AS missed FROM t LEFT JOIN miss USING (item_id) LEFT JOIN p ON p.item_id = miss.item_id AND p.i = miss.i""",
    ),
    "decomposition_verdict": (decomposition_verdict, DECOMPOSITION_VERDICT),
    "sentence_fate": (sentence_fate, SENTENCE_FATE),
    "coverage_abstention": (
        coverage_abstention,
        """WITH r AS (SELECT conv_id AS query_id, CASE WHEN role <> 'system' THEN length(text) % 5 > 0 END AS covered, CASE WHEN role = 'system' OR turn % 2 = 0 THEN true ELSE false END AS nothing FROM conversations)
        SELECT query_id, bool_or(NOT coalesce(covered, false)) AS abstains, CASE WHEN bool_or(NOT coalesce(covered, false)) THEN CASE WHEN bool_and(nothing) THEN 'no_emitted_sentences' ELSE 'uncovered_facet' END END AS cause FROM r GROUP BY query_id""",
    ),
    "doctor_heading_frequency": (
        doctor_heading_frequency,
        f"WITH {SURVEY_SQL} SELECT heading, count(*) AS file_count, CAST(round(CAST(count(*) AS DECIMAL(18, 0)) * 100.0000 / CAST((SELECT count(*) FROM survey) AS DECIMAL(18, 0)), 1) AS DOUBLE) AS percentage FROM (SELECT unnest(headings) AS heading FROM survey) GROUP BY heading",
    ),
    "doctor_heading_sets": (
        doctor_heading_sets,
        f"""WITH {SURVEY_SQL} SELECT headings, count(*) AS file_count, array_to_string(list_slice(list(path ORDER BY path), 1, 3), ',') AS samples
        FROM (SELECT path, array_to_string(list_sort(headings), '|') AS headings FROM survey) GROUP BY headings""",
    ),
    "doctor_skip_summary": (
        doctor_skip_summary,
        f"""WITH s AS (SELECT 'e/' || event_id AS path, CAST(user_id % 6 AS INTEGER) AS position, value > 50 AS unseen FROM events)
        SELECT position, ([{quoted(list(doctor.SKIP_REASONS))}])[position + 1] AS reason, count(*) AS path_count, count(*) FILTER (unseen) AS unseen_count,
        array_to_string(list_slice(list(path ORDER BY path), 1, 3), ',') AS samples FROM s GROUP BY position""",
    ),
}

"""Tokenizer, filter, BM25, vector, fusion, diversity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.paths import RANKED_LABELS, path_selected
from tessera.functions.text import STEM_SUFFIXES, canonical_stem, lexical_tokens
from tessera.operators import retrieval as r
from tessera.plans.base import BM25_SQL, DIVERSE_SQL, FAR_SQL, FUSED_SQL, KEY, LEX_SQL, SEM_SQL, SNAPSHOT_SQL, question_vectors, questions, snapshot, texts, tokens_sql, vectors

FILTERS = r.Filters(record_ids=("src1", "src2", "src3"), statuses=("en", "fr"), tags=("en", "src2"), value_paths=("decision.chosen", "body[*]"))


def tokenize_documents(spark, d):
    rows = texts(spark, d).select("doc_id", F.posexplode(lexical_tokens(F.col("text"))).alias("pos", "token"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


def token_document_frequency(spark, d):
    return r.postings(r.term_counts(snapshot(spark, d))).groupBy("word").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def corpus_length_stats(spark, d):
    return r.corpus_stats(r.term_counts(snapshot(spark, d))).select("n", F.round("avgdl", 6).alias("avgdl"))


def _scores(spark, d, best=None):
    return r.bm25(r.lexical_index(snapshot(spark, d)), questions(spark, d), best=best)


def bm25_scores(spark, d):
    return _scores(spark, d).select("query_id", "chunk_id", (F.round("score", 6) + 0.0).alias("score"))


def lexical_stage(spark, d):
    rows = r.lexical_stage(snapshot(spark, d), _scores(spark, d), questions(spark, d))
    return rows.withColumn("score", F.round("score", 6) + 0.0).withColumn("rank", F.col("rank").cast("bigint"))


def _far(spark, d):
    return r.distances(vectors(spark, d), question_vectors(spark, d))


def semantic_distances(spark, d):
    return _far(spark, d).select("query_id", "chunk_id", (F.round("distance", 6) + 0.0).alias("distance"))


def semantic_stage(spark, d):
    rows = r.semantic_stage(snapshot(spark, d), _far(spark, d))
    return rows.select("query_id", "chunk_id", (F.round("distance", 6) + 0.0).alias("distance"), (F.round("similarity", 6) + 0.0).alias("similarity"), F.col("rank").cast("bigint").alias("rank"), "disposition")


def _fused(spark, d):
    snap = snapshot(spark, d)
    return r.fuse(r.lexical_top(snap, _scores(spark, d, r.CANDIDATES)), r.semantic_top(snap, vectors(spark, d), question_vectors(spark, d)), snap)


def rrf_fusion(spark, d):
    return _fused(spark, d).select("query_id", "chunk_id", F.col("lexical_rank").cast("bigint").alias("lexical_rank"), F.col("semantic_rank").cast("bigint").alias("semantic_rank"), F.round("fused_score", 9).alias("fused_score"), F.col("fused_rank").cast("bigint").alias("fused_rank"))


def diversity_selection(spark, d):
    rows = r.diversify(_fused(spark, d))
    return rows.select("query_id", "chunk_id", "record_id", F.col("fused_rank").cast("bigint").alias("fused_rank"), "breadth", "selection_pass", "final_rank", "final_disposition")


def hybrid_retrieve(spark, d):
    rows = r.hybrid(snapshot(spark, d), vectors(spark, d), questions(spark, d), question_vectors(spark, d))
    return rows.where("final_rank is not null").select("query_id", "final_rank", "chunk_id", "record_id", "value_path", F.round("fused_score", 9).alias("fused_score"), "selection_pass")


def hybrid_retrieve_filtered(spark, d):
    filters = r.Filters(statuses=("en", "fr"), value_paths=("body[*]",))
    rows = r.hybrid(snapshot(spark, d), vectors(spark, d), questions(spark, d), question_vectors(spark, d), filters)
    return rows.where("final_rank is not null").select("query_id", "final_rank", "chunk_id", F.round("fused_score", 9).alias("fused_score"))


def canonical_stems(spark, d):
    """Every token of the documents with its canonical stem."""
    words = texts(spark, d).select(F.explode_outer(lexical_tokens(F.col("text"))).alias("token")).where("token is not null").distinct()
    return words.select("token", canonical_stem(F.col("token")).alias("stem"))


def field_aware_ranks(spark, d):
    rows = r.field_aware(snapshot(spark, d), vectors(spark, d), questions(spark, d), question_vectors(spark, d))
    return rows.select("query_id", "chunk_id", *[F.col(c).cast("bigint").alias(c) for c in ("lexical_rank", "semantic_rank", "fused_rank")], "fused_score")


def filter_trace(spark, d):
    rows = r.filter_trace(snapshot(spark, d), FILTERS)
    return rows.select("chunk_id", "state", F.array_join("exclusion_reasons", ",").alias("reasons"))


def filter_accepted(spark, d):
    return r.accepted(snapshot(spark, d), FILTERS).select("chunk_id", "record_id", "record_status", "value_path")


def value_path_selector(spark, d):
    snap = snapshot(spark, d)
    picks = ["body[*]", "body[3]", "decision.chosen", "decision[*]"]
    return snap.select("chunk_id", "value_path", *[path_selected(F.col("value_path"), s).alias(f"s{i}") for i, s in enumerate(picks)])


def tag_value_paths(spark, d):
    """Per record: its value paths, and how many of its chunks are of each status."""
    snap = snapshot(spark, d)
    return snap.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("value_path")), ",").alias("value_paths"), F.count_if(F.col("record_status") == "en").alias("n_en"), F.count_if(F.col("record_status").isNull()).alias("n_unparsed"))


def _less(t: str, n: int) -> str:
    return f"CASE WHEN length({t}) >= {n + 2} THEN left({t}, length({t}) - {n}) ELSE {t} END"


#: One round of the canonical stem, on a column t.
BARE_SQL = "CASE " + " ".join(f"WHEN suffix(t, '{x}') THEN {_less('t', len(x))}" for x in STEM_SUFFIXES) + " ELSE t END"
ROUND_SQL = f"CASE WHEN length(b) >= 2 AND right(b, 1) = substr(b, length(b) - 1, 1) THEN {_less('b', 1)} WHEN suffix(b, 'i') THEN left(b, length(b) - 1) || 'y' WHEN suffix(b, 'e') THEN {_less('b', 1)} ELSE b END"
STEM_SQL = f"""rounds AS (SELECT word, word AS t, 0 AS i FROM voc UNION ALL SELECT word, u, i + 1 FROM (SELECT word, i, t, {ROUND_SQL} AS u FROM (SELECT word, i, t, {BARE_SQL} AS b FROM rounds WHERE length(word) >= 3)) WHERE u <> t),
stem AS MATERIALIZED (SELECT word, arg_max(t, i) AS stem FROM rounds GROUP BY word)"""
RANKED_LABEL_SQL = "CASE split_part(value_path, '[', 1) " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}' || chr(10) || chr(10)" for k, v in RANKED_LABELS.items()) + " ELSE '' END"
FIELD_AWARE_SQL = f"""WITH RECURSIVE {SNAPSHOT_SQL}, {FAR_SQL},
    keyed AS MATERIALIZED (SELECT chunk_id, row_number() OVER (ORDER BY {KEY}) AS place FROM snap),
    toks AS MATERIALIZED (SELECT chunk_id, unnest({tokens_sql(f"{RANKED_LABEL_SQL} || text")}) AS word FROM snap),
    asked AS MATERIALIZED (SELECT item_id AS query_id, unnest({tokens_sql("text")}) AS word FROM benchmark),
    voc AS MATERIALIZED (SELECT word FROM toks UNION SELECT word FROM asked), {STEM_SQL},
    tf AS MATERIALIZED (SELECT chunk_id, stem AS word, count(*) AS tf FROM toks JOIN stem USING (word) GROUP BY ALL),
    dl AS MATERIALIZED (SELECT chunk_id, CAST(sum(tf) AS BIGINT) AS dl FROM tf GROUP BY chunk_id),
    stats AS (SELECT (SELECT count(*) FROM snap) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM snap) AS avgdl),
    raw AS MATERIALIZED (SELECT word, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT word, count(*) AS df FROM tf GROUP BY word), stats),
    idf AS MATERIALIZED (SELECT word, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
    q AS MATERIALIZED (SELECT query_id, stem AS word, count(*) AS qf FROM asked JOIN stem USING (word) GROUP BY ALL),
    bm AS MATERIALIZED (SELECT query_id, chunk_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN idf USING (word) JOIN tf USING (word) JOIN dl USING (chunk_id), stats GROUP BY query_id, chunk_id),
    lex AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, place) AS lexical_rank FROM bm JOIN keyed USING (chunk_id) WHERE round(score, 9) > 0),
    sem AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), place) AS semantic_rank FROM far JOIN keyed USING (chunk_id)),
    both_ranks AS (SELECT query_id, chunk_id, lexical_rank, semantic_rank, coalesce(1.0::DOUBLE / (60 + lexical_rank), 0.0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0.0) AS fused FROM lex FULL OUTER JOIN sem USING (query_id, chunk_id))
    SELECT query_id, chunk_id, lexical_rank, semantic_rank, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, place) AS fused_rank, round(fused, 9) AS fused_score FROM both_ranks JOIN keyed USING (chunk_id)"""

FILTERED_SNAPSHOT = SNAPSHOT_SQL.replace("FROM documents)", "FROM documents WHERE lang IN ('en', 'fr') AND doc_id % 7 <> 0)")

QUERIES = {
    "tokenize_documents": (tokenize_documents, f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, ts[i] AS token FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT doc_id, {tokens_sql('text')} AS ts FROM documents))"),
    "token_document_frequency": (token_document_frequency, f"WITH t AS (SELECT doc_id, unnest({tokens_sql('text')}) AS word FROM documents) SELECT word, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY word"),
    "corpus_length_stats": (corpus_length_stats, f"SELECT count(*) AS n, round(avg(len({tokens_sql('text')})), 6) AS avgdl FROM documents"),
    "bm25_scores": (bm25_scores, f"WITH {BM25_SQL} SELECT query_id, chunk_id, round(score, 6) + 0.0 AS score FROM bm"),
    "lexical_stage": (
        lexical_stage,
        f"""WITH {BM25_SQL}, {LEX_SQL},
        p AS (SELECT item_id AS query_id, chunk_id FROM benchmark, snap)
        SELECT query_id, chunk_id, round(coalesce(score, 0), 6) + 0.0 AS score, lexical_rank AS rank,
               CASE WHEN score IS NULL THEN 'no_term_match' WHEN round(score, 9) <= 0 THEN 'nonpositive_score' WHEN lexical_rank IS NOT NULL THEN 'ranked' ELSE 'outside_top_24' END AS disposition
        FROM p LEFT JOIN bm USING (query_id, chunk_id) LEFT JOIN lex USING (query_id, chunk_id)""",
    ),
    "semantic_distances": (semantic_distances, f"WITH {FAR_SQL} SELECT query_id, chunk_id, round(distance, 6) + 0.0 AS distance FROM far"),
    "semantic_stage": (
        semantic_stage,
        # one number stands for a chunk's key, so that no text or digest of one is carried through the pairs
        f"""WITH {SNAPSHOT_SQL}, keyed AS MATERIALIZED (SELECT chunk_id, row_number() OVER (ORDER BY {KEY}) AS place FROM snap),
        q AS MATERIALIZED (SELECT b.item_id AS query_id, v.embedding::DOUBLE[] AS qv FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id),
        c AS MATERIALIZED (SELECT e.vec_id AS chunk_id, place, e.embedding::DOUBLE[] AS cv FROM embeddings e JOIN keyed ON keyed.chunk_id = e.vec_id),
        f AS MATERIALIZED (SELECT query_id, chunk_id, place, greatest(0.0, least(2.0, list_cosine_distance(cv, qv))) AS distance FROM q CROSS JOIN c),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), place) AS n FROM f)
        SELECT query_id, chunk_id, round(distance, 6) + 0.0 AS distance, round(1.0 - distance, 6) + 0.0 AS similarity,
               CASE WHEN n <= 24 THEN n END AS rank, CASE WHEN n <= 24 THEN 'ranked' ELSE 'outside_top_24' END AS disposition FROM r""",
    ),
    "rrf_fusion": (rrf_fusion, f"WITH {BM25_SQL}, {LEX_SQL}, {FAR_SQL}, {SEM_SQL}, {FUSED_SQL} SELECT query_id, chunk_id, lexical_rank, semantic_rank, round(fused_score, 9) AS fused_score, fused_rank FROM fused"),
    "diversity_selection": (
        diversity_selection,
        f"""WITH {BM25_SQL}, {LEX_SQL}, {FAR_SQL}, {SEM_SQL}, {FUSED_SQL}, {DIVERSE_SQL}
        SELECT query_id, chunk_id, record_id, fused_rank, breadth, selection_pass, final_rank, CASE WHEN final_rank IS NULL THEN 'outside_top_8' ELSE 'accepted' END AS final_disposition FROM div""",
    ),
    "hybrid_retrieve": (
        hybrid_retrieve,
        f"""WITH {BM25_SQL}, {LEX_SQL}, {FAR_SQL}, {SEM_SQL}, {FUSED_SQL}, {DIVERSE_SQL}
        SELECT query_id, final_rank, chunk_id, record_id, value_path, round(fused_score, 9) AS fused_score, selection_pass FROM div WHERE final_rank IS NOT NULL""",
    ),
    "hybrid_retrieve_filtered": (
        hybrid_retrieve_filtered,
        f"""WITH {BM25_SQL.replace(SNAPSHOT_SQL, FILTERED_SNAPSHOT)}, {LEX_SQL}, {FAR_SQL}, {SEM_SQL}, {FUSED_SQL}, {DIVERSE_SQL}
        SELECT query_id, final_rank, chunk_id, round(fused_score, 9) AS fused_score FROM div WHERE final_rank IS NOT NULL""",
    ),
    "canonical_stems": (canonical_stems, f"WITH RECURSIVE voc AS MATERIALIZED (SELECT DISTINCT unnest({tokens_sql('text')}) AS word FROM documents), {STEM_SQL} SELECT word AS token, stem FROM stem"),
    "field_aware_ranks": (field_aware_ranks, FIELD_AWARE_SQL),
    "filter_trace": (
        filter_trace,
        f"""WITH {SNAPSHOT_SQL}, r AS (SELECT chunk_id, list_filter([
            CASE WHEN record_id NOT IN ('src1', 'src2', 'src3') THEN 'record_id' END,
            CASE WHEN record_status IS NULL OR record_status NOT IN ('en', 'fr') THEN 'status' END,
            CASE WHEN NOT list_has_any(record_tags, ['en', 'src2']) THEN 'tag' END,
            CASE WHEN NOT (value_path = 'decision.chosen' OR regexp_matches(value_path, '^body\\[(0|[1-9][0-9]*)\\]$')) THEN 'value_path' END], lambda x: x IS NOT NULL) AS rs FROM snap)
        SELECT chunk_id, CASE WHEN len(rs) = 0 THEN 'accepted' ELSE 'excluded' END AS state, array_to_string(rs, ',') AS reasons FROM r""",
    ),
    "filter_accepted": (
        filter_accepted,
        f"""WITH {SNAPSHOT_SQL} SELECT chunk_id, record_id, record_status, value_path FROM snap WHERE record_id IN ('src1', 'src2', 'src3') AND record_status IN ('en', 'fr')
        AND list_has_any(record_tags, ['en', 'src2']) AND (value_path = 'decision.chosen' OR regexp_matches(value_path, '^body\\[(0|[1-9][0-9]*)\\]$'))""",
    ),
    "value_path_selector": (
        value_path_selector,
        f"""WITH {SNAPSHOT_SQL} SELECT chunk_id, value_path, regexp_matches(value_path, '^body\\[(0|[1-9][0-9]*)\\]$') AS s0, value_path = 'body[3]' AS s1,
        value_path = 'decision.chosen' AS s2, regexp_matches(value_path, '^decision\\[(0|[1-9][0-9]*)\\]$') AS s3 FROM snap""",
    ),
    "record_value_paths": (
        tag_value_paths,
        f"""WITH {SNAPSHOT_SQL} SELECT record_id, array_to_string(list_sort(list(DISTINCT value_path)), ',') AS value_paths, count(*) FILTER (record_status = 'en') AS n_en,
        count(*) FILTER (record_status IS NULL) AS n_unparsed FROM snap GROUP BY record_id""",
    ),
}

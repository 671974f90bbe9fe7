"""Shared pieces of the query catalog: table access and SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import STOPWORDS, TOKEN
from tessera.operators.corpus import document_snapshot


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly if the scan has fewer tasks than there are cores (a small file of one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` for work that is heavy on each text."""
    return spread(table(spark, sf_dir, "documents"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_snapshot(texts(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return rows.join(docs, "chunk_id", "left_semi")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage is a question."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return rows.join(asked, "query_id", "left_semi")


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tokens_sql(text: str) -> str:
    """Lexical tokens of a text in SQL."""
    pattern = TOKEN.replace("'", "''")
    return f"list_filter(regexp_extract_all(lower({text}), '{pattern}'), lambda t: NOT list_contains([{quoted(STOPWORDS)}], t))"


SNAPSHOT_SQL = """snap AS (
    SELECT doc_id AS chunk_id, source AS record_id, 'Record ' || source AS record_title, lang AS record_status, [source, lang] AS record_tags,
           CASE WHEN doc_id % 7 = 0 THEN 'decision.chosen' ELSE 'body[' || (doc_id % 5) || ']' END AS value_path,
           sha256(text) AS fingerprint, doc_id AS ordinal, text FROM documents)"""
KEY = "record_id, fingerprint, value_path, ordinal"

BM25_SQL = f"""{SNAPSHOT_SQL},
toks AS MATERIALIZED (SELECT chunk_id, {tokens_sql("text")} AS ts FROM snap),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks),
tf AS MATERIALIZED (SELECT chunk_id, len(any_value(ts)) AS dl, word, count(*) AS tf FROM (SELECT chunk_id, ts, unnest(ts) AS word FROM toks) GROUP BY chunk_id, word),
raw AS (SELECT word, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT word, count(*) AS df FROM tf GROUP BY word), stats),
idf AS (SELECT word, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
q AS (SELECT query_id, word, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({tokens_sql("text")}) AS word FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM q JOIN idf USING (word) JOIN tf USING (word), stats GROUP BY query_id, chunk_id)"""
LEX_SQL = f"""lex AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {KEY}) AS lexical_rank
       FROM bm JOIN snap USING (chunk_id) WHERE round(score, 9) > 0) WHERE lexical_rank <= 24)"""
FAR_SQL = """far AS MATERIALIZED (SELECT b.item_id AS query_id, d.doc_id AS chunk_id,
       greatest(0.0, least(2.0, list_cosine_distance(e.embedding::DOUBLE[], v.embedding::DOUBLE[]))) AS distance
       FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id, embeddings e JOIN documents d ON d.doc_id = e.vec_id)"""
SEM_SQL = f"""sem AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), {KEY}) AS semantic_rank
       FROM far JOIN snap USING (chunk_id)) WHERE semantic_rank <= 24)"""
FUSED_SQL = f"""fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused_score, 9) DESC, {KEY}) AS fused_rank FROM (
       SELECT query_id, chunk_id, lexical_rank, semantic_rank, coalesce(1.0::DOUBLE / (60 + lexical_rank), 0.0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0.0) AS fused_score
       FROM lex FULL OUTER JOIN sem USING (query_id, chunk_id)) JOIN snap USING (chunk_id))"""
DIVERSE_SQL = """e AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, record_id ORDER BY fused_rank) <= 2 THEN 1 ELSE 0 END AS e FROM fused),
c AS (SELECT *, sum(e) OVER (PARTITION BY query_id ORDER BY fused_rank ROWS UNBOUNDED PRECEDING) AS cum, least(8, sum(e) OVER (PARTITION BY query_id)) AS tot FROM e),
b AS (SELECT *, CASE WHEN cum - e >= 8 THEN 'accepted_limit_reached' WHEN e = 1 THEN 'accepted' ELSE 'record_cap' END AS breadth FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, breadth ORDER BY fused_rank) AS fr FROM b),
div AS (SELECT *, CASE WHEN breadth = 'accepted' THEN CAST(cum AS INTEGER) WHEN breadth = 'record_cap' AND tot + fr <= 8 THEN CAST(tot + fr AS INTEGER) END AS final_rank,
        CASE WHEN breadth = 'accepted' THEN 'breadth' WHEN breadth = 'record_cap' AND tot + fr <= 8 THEN 'fill' END AS selection_pass FROM f)"""

"""Validation, index maintenance and evaluation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.claims import base_set
from tessera.operators import evaluate, index, validate
from tessera.operators import retrieval as r
from tessera.operators.corpus import active_chunks as assemble
from tessera.plans.base import FAR_SQL, question_vectors, snapshot, table, vectors
from tessera.plans.ingest import with_digest
from tessera.plans.text_queries import RECORDS_SQL, VOCAB_SQL, _base_sql, _vocabulary, records
from tessera.schemas import RECORD
from tessera.store.generation import Store
from tessera.store.shared import shared_dir
from tessera.streaming import cdc


def _manifest(spark, d):
    """Documents seen as manifest entries; every tenth is missing."""
    docs = table(spark, d, "documents")
    return docs.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("record_id"), F.sha2("text", 256).alias("fingerprint"), F.sha2(F.concat("source", "text"), 256).alias("entry_digest"))


def _ledger(spark, d):
    """The same documents as an older ledger: some unknown, changed, failed or removed."""
    k, docs = F.col("doc_id"), table(spark, d, "documents").where("doc_id % 7 <> 0")
    state = F.when(k % 11 == 0, "removed").when(k % 13 == 0, "failed").otherwise("current")
    print_ = F.sha2("text", 256)
    active = F.when(k % 13 == 0, None).when(k % 3 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(print_)
    entry = F.when(k % 5 == 0, "old").otherwise(F.sha2(F.concat("source", "text"), 256))
    return docs.select(k.alias("record_id"), state.alias("state"), active.alias("active_fingerprint"), print_.alias("desired_fingerprint"), entry.alias("entry_digest"))


BOOKS_SQL = """manifest AS (SELECT doc_id AS record_id, sha256(text) AS fingerprint, sha256(source || text) AS entry_digest FROM documents WHERE doc_id % 10 <> 0),
ledger AS (SELECT doc_id AS record_id, CASE WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 13 = 0 THEN 'failed' ELSE 'current' END AS state,
    CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS active_fingerprint, sha256(text) AS desired_fingerprint,
    CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(source || text) END AS stored FROM documents WHERE doc_id % 7 <> 0)"""


def ingest_plan_diff(spark, d):
    return index.ingest_plan(_manifest(spark, d), _ledger(spark, d))


def adapt_plan(spark, d):
    specs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.sha2("text", 256).alias("fingerprint"))
    before = _ledger(spark, d).select("record_id", F.col("active_fingerprint").alias("fingerprint")).where("fingerprint is not null")
    return index.adapt_plan(specs, before, _manifest(spark, d).select("record_id"))


def manifest_drift_reasons(spark, d):
    return index.drift_reasons(_manifest(spark, d), _ledger(spark, d))


def orphan_vectors(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return index.orphans(rows, table(spark, d, "documents").where("doc_id % 4 <> 1").select(F.col("doc_id").alias("chunk_id")))


def parity_problems(spark, d):
    chunks = snapshot(spark, d).select("chunk_id", F.col("record_status").alias("a"), (F.col("chunk_id") % 4).alias("b"))
    rows = table(spark, d, "embeddings").select((F.col("vec_id") * 2).alias("chunk_id"), "label")
    rows = rows.join(chunks.select("chunk_id", "a"), "chunk_id", "left").select("chunk_id", F.coalesce("a", F.lit("none")).alias("a"), F.when(F.col("label") % 3 == 0, F.col("chunk_id") % 4).otherwise(F.lit(0).cast("bigint")).alias("b"))
    return index.parity_problems(chunks, rows, ["a", "b"])


def stale_citations(spark, d):
    stale = index.stale_records(_ledger(spark, d)).withColumn("stale", F.lit(True))
    cites = table(spark, d, "embeddings").select(F.col("vec_id").alias("citation_id"), F.col("vec_id").alias("record_id"))
    return cites.join(stale, "record_id", "left").select("citation_id", F.when(F.col("stale"), "stale_version").otherwise("current").alias("freshness"))


def supersession_edges(spark, d):
    return index.supersession_edges(records(spark, d))


def supersession_notices(spark, d):
    recs = records(spark, d)
    seen = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("P-"), F.col("l_partkey").cast("string")).alias("record_id"))
    rows = index.supersession_notices(seen, index.supersession_edges(recs), recs)
    return rows.select("query_id", "predecessor_id", "successor_id", "disclosure_no", "sentence")


def supersession_cycles(spark, d):
    """Customers that name a predecessor by a fixed rule: cycles with tails, and chains that end."""
    k = F.col("c_custkey")
    edges = table(spark, d, "customer").select(k.alias("successor_id"), F.when(k % 7 == 0, k - 6).when(k % 7 < 4, k + 1).when(k % 11 == 0, None).otherwise(k - 1).alias("predecessor_id"))
    return index.cyclic_records(edges)


def citation_numbering(spark, d):
    """Turns as sentences that cite: each turn cites the first word and the role of the turns up to it."""
    turns = table(spark, d, "conversations")
    uses = turns.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("sentence_pos"), F.lit(0).alias("chunk_pos"), F.posexplode(F.array(F.substring_index("text", " ", 1), F.col("role"))).alias("source_pos", "path"), F.col("role").alias("chunk_id"), F.lit("body").alias("section"))
    rows = index.number_citations(uses)
    return rows.select("query_id", "chunk_id", "path", F.col("citation_no").cast("bigint").alias("citation_no"), F.array_join(F.transform("sentences", lambda s: s.cast("string")), ",").alias("sentences"))


def active_set_digest(spark, d):
    return index.active_set_digest(snapshot(spark, d))


def latest_state_per_record(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("record_id"), "ts", "event_id", F.col("event_type").alias("state"))
    return index.latest_state(rows, ["ts", "event_id"]).select("record_id", "event_id", "state")


def streamed_latest_state(spark, d):
    """``events`` as a stream of files, each batch upserted into a table in buckets; its last generation."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("record_id"), "ts", "event_id", F.col("event_type").alias("state"))
    home = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    store = Store(spark, f"{home}/store", {"state": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)})
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/event[s].parquet")  # as a pattern, the table may be a file or a folder
    changes = stream.select(F.col("user_id").alias("record_id"), "ts", "event_id", F.col("event_type").alias("state"))
    query = cdc.upsert_stream(changes, store, "state", f"{home}/checkpoint", name="events", order=["ts", "event_id"])
    query.awaitTermination()
    return store.table("state").select("record_id", "event_id", "state")


def store_diff(spark, d):
    """Two stores of chunk texts by their stable triple."""
    docs = table(spark, d, "documents")
    one = docs.select(F.col("source").alias("record_id"), F.sha2("text", 256).alias("fingerprint"))
    two = docs.where("doc_id % 9 <> 2").select(F.col("source").alias("record_id"), F.when(F.col("doc_id") % 6 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("fingerprint"))
    return index.store_diff(one, two, ["record_id", "fingerprint"])


def replace_rows(spark, d):
    docs = table(spark, d, "documents")
    old = docs.select(F.col("source").alias("record_id"), "doc_id", F.lit("old").alias("age"))
    new = docs.where("source in ('src1', 'src4')").select(F.col("source").alias("record_id"), (F.col("doc_id") + 1_000_000).alias("doc_id"), F.lit("new").alias("age"))
    return index.replace_rows(old, new, ["record_id"])


def active_chunks(spark, d):
    """Lines of orders assembled with their order's status, tags and provenance."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    chunk = lines.select(key.alias("chunk_id"), F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("ordinal"))
    snap = orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"))
    tags = lines.select(F.col("l_orderkey").alias("record_id"), F.col("l_returnflag").alias("tag"))
    sources = lines.where("l_linestatus = 'F'").select(key.alias("chunk_id"), F.concat(F.lit("p/"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_returnflag").alias("section"))
    rows = assemble(chunk, snap, tags, sources)
    return rows.select("chunk_id", "record_title", "record_status", F.array_join("record_tags", ",").alias("tags"), F.array_join(F.transform("provenance", lambda p: F.concat(p["path"], F.lit("#"), p["section"])), ",").alias("provenance"))


def validation_violations(spark, d):
    return validate.record_violations(records(spark, d)).select("id", "field", "severity", "rule", "reason")


def _commits(spark, d):
    return table(spark, d, "supplier").select(F.sha2("s_name", 256).alias("commit"))


def evidence_commit_resolution(spark, d):
    targets = validate.evidence_rows(records(spark, d)).where("kind = 'commit'")
    return validate.commit_matches(targets, _commits(spark, d))


def evidence_violations(spark, d):
    paths = table(spark, d, "part").where("p_size < 25").select(F.concat(F.lit("docs/specs/"), "p_brand").alias("path")).distinct()
    paths = paths.unionByName(table(spark, d, "part").where("p_size >= 48").select(F.concat(F.lit("src/"), "p_brand").alias("path")).distinct())
    return validate.evidence_violations(records(spark, d), paths, _commits(spark, d)).select("id", "field", "rule")


def _results(spark, d):
    """Turns as runs of a battery: assistants answer, users abstain, a system turn fails."""
    turns = table(spark, d, "conversations")
    answered = F.col("role") == "assistant"
    none = F.array().cast("array<string>")
    head = F.substring("text", 1, 1)
    return turns.select(
        F.col("conv_id").alias("query_id"),
        F.col("turn").alias("run"),
        F.when(answered, "answered").when(F.col("role") == "user", "abstained").otherwise("failed").alias("state"),
        F.when(answered, F.array(head)).otherwise(none).alias("cited_records"),
        F.when(answered, F.array(F.struct(head.alias("record_id"), F.concat(F.lit("body["), (F.length("text") % 3).cast("string"), F.lit("]")).alias("value_path")))).otherwise(F.array().cast("array<struct<record_id:string,value_path:string>>")).alias("cited_paths"),
        F.when(answered, 1).otherwise(0).alias("n_sentences"),
        F.when(F.length("text") % 2 == 0, "uncovered_facet").otherwise("no_emitted_sentences").alias("cause"),
    )


def _oracles(spark, d):
    k = F.col("conv_id")
    convs = table(spark, d, "conversations").select("conv_id").distinct()
    return convs.select(
        k.alias("query_id"),
        F.when(k % 3 == 0, "abstained").otherwise("answered").alias("expected_state"),
        F.when(k % 3 == 1, F.array(F.lit("T"))).otherwise(F.array().cast("array<string>")).alias("required_records"),
        F.when(k % 3 == 2, F.array(F.lit("body[1"))).otherwise(F.array().cast("array<string>")).alias("value_paths"),
        F.when(k % 6 == 0, "uncovered_facet").alias("cause"),
    )


def oracle_check(spark, d):
    return evaluate.check(_results(spark, d), _oracles(spark, d))


def pass_rates(spark, d):
    return evaluate.pass_rates(evaluate.check(_results(spark, d), _oracles(spark, d)))


def unsatisfiable_oracles(spark, d):
    snap = snapshot(spark, d)
    oracles = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.array(F.concat(F.lit("src"), F.col("n_nationkey").cast("string"))).alias("required_records"), F.array(F.concat(F.lit("body["), (F.col("n_nationkey") % 7).cast("string"))).alias("value_paths"))
    return evaluate.unsatisfiable(oracles, snap.select("record_id"), snap)


def reingest_check(spark, d):
    snap = snapshot(spark, d)
    before = snap.where("record_id <> 'src3'").select("record_id", "chunk_id")
    after = snap.where("record_id <> 'src4'").select("record_id", F.when(F.col("record_id").isin("src1", "src2"), F.col("chunk_id") + 5).otherwise(F.col("chunk_id")).alias("chunk_id"))
    return evaluate.reingest_check(before, after)


def facet_failure(spark, d):
    turns = table(spark, d, "conversations")
    facets = turns.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("facet_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", "why was it so").otherwise("what was decided").alias("text"))
    rows = turns.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("facet_id"), (F.length("text") % 2 == 0).alias("covered"))
    results = turns.select(F.col("conv_id").alias("query_id")).distinct().withColumn("state", F.when(F.col("query_id") % 5 == 0, "failed").when(F.col("query_id") % 2 == 0, "answered").otherwise("abstained"))
    return evaluate.facet_failure(facets, rows, results)


def provider_attempt_summary(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("concern"), (F.col("event_id") % 4 + 1).alias("attempt_number"), F.col("value").alias("elapsed_ms"), F.when(F.col("event_id") % 4 < 2, "success").when(F.col("event_id") % 4 == 2, "retryable_failure").otherwise("final_failure").alias("outcome"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"))
    return evaluate.attempts(rows)


def ledger_live(spark, d):
    return index.live_ledger(_ledger(spark, d), "active_fingerprint")


def source_resolution(spark, d):
    """Order priorities and parts as paths, against the parts that are listed."""
    refs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 9 == 0, F.concat(F.lit("/p/"), "l_partkey")).when(F.col("l_partkey") % 9 == 1, "a/../b").otherwise(F.concat(F.lit("p/"), F.col("l_partkey"))).alias("path"))
    return index.source_states(refs, table(spark, d, "part").where("p_size < 30").select(F.concat(F.lit("p/"), F.col("p_partkey")).alias("path")))


def semantic_integrity(spark, d):
    """A vector search over documents whose id is not a multiple of three, held against all with a vector."""
    far = r.distances(vectors(spark, d), question_vectors(spark, d))
    accepted = far.where("chunk_id % 3 <> 0").select("query_id", "chunk_id")
    answered = far.where("chunk_id % 5 <> 0").withColumn("distance", F.when(F.col("chunk_id") % 7 == 0, 3.0).otherwise(F.col("distance")))
    return r.search_problems(answered, accepted)


def stem_relation_counts(spark, d):
    """How many pairs of vocabulary words the directional relation and the shared bases hold for."""
    bases = _vocabulary(spark, d).select("token", F.explode(base_set(F.col("token"))).alias("base"))
    one = bases.join(bases.select(F.col("token").alias("base")).distinct(), "base").where("token <> base").agg(F.count("*").alias("directional"))
    other = bases.select(F.col("token").alias("other"), "base")
    two = bases.join(other, "base").where("token < other").select("token", "other").distinct().agg(F.count("*").alias("shared"))
    return one.join(two, how="cross")


def change_windows(spark, d):
    """Events counted in windows of ten minutes, by type: what the stream operator counts, over a table."""
    rows = cdc.windowed_counts(table(spark, d, "events"), by=("event_type",))
    return rows.select(F.col("window.start").cast("string").alias("start"), "event_type", "changes")


def change_latest(spark, d):
    """The last change of each key of a batch."""
    rows = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "event_type")
    return cdc.latest(rows, key="user_id", stamp="at").select("user_id", "event_id", "event_type")


def record_digests(spark, d):
    """Canonical digests of the part records: equal content, equal digest."""
    rows = records(spark, d)
    return with_digest(rows.select(F.struct(*RECORD.fieldNames()).alias("record"))).select("record.id", "record_digest")


RESULTS_SQL = """res AS (SELECT conv_id AS query_id, turn AS run, CASE role WHEN 'assistant' THEN 'answered' WHEN 'user' THEN 'abstained' ELSE 'failed' END AS state,
    role = 'assistant' AS answered, substr(text, 1, 1) AS head, 'body[' || (length(text) % 3) || ']' AS path,
    CASE WHEN length(text) % 2 = 0 THEN 'uncovered_facet' ELSE 'no_emitted_sentences' END AS cause, CASE WHEN conv_id % 3 = 0 THEN 'abstained' ELSE 'answered' END AS expected FROM conversations),
chk AS (SELECT query_id, run, CASE WHEN state <> expected THEN 'state ' || state || ', expected ' || expected
    WHEN expected = 'abstained' AND query_id % 6 = 0 AND cause <> 'uncovered_facet' THEN 'cause ' || cause
    WHEN expected = 'answered' AND query_id % 3 = 1 AND head <> 'T' THEN 'missing records T'
    WHEN expected = 'answered' AND query_id % 3 = 2 AND NOT starts_with(path, 'body[1') THEN 'missing paths body[1' END AS detail FROM res)"""
NORMAL = "array_to_string(list_filter(string_split(regexp_replace(trim(target), '^\\./', ''), '/'), lambda s: s <> ''), '/')"

QUERIES = {
    "ingest_plan_diff": (
        ingest_plan_diff,
        f"""WITH {BOOKS_SQL} SELECT * FROM (SELECT coalesce(m.record_id, l.record_id) AS record_id,
        CASE WHEN m.record_id IS NULL THEN CASE WHEN state <> 'removed' THEN 'removed' END WHEN state = 'current' AND active_fingerprint = fingerprint THEN 'unchanged'
             WHEN active_fingerprint IS NOT NULL THEN 'updated' ELSE 'added' END AS action FROM manifest m FULL OUTER JOIN ledger l ON m.record_id = l.record_id) WHERE action IS NOT NULL""",
    ),
    "adapt_plan": (
        adapt_plan,
        f"""WITH {BOOKS_SQL} SELECT d.doc_id AS record_id, CASE WHEN l.active_fingerprint IS NULL THEN 'written' WHEN l.active_fingerprint = sha256(d.text) AND m.record_id IS NOT NULL THEN 'unchanged' ELSE 'rewritten' END AS action
        FROM documents d LEFT JOIN ledger l ON l.record_id = d.doc_id LEFT JOIN manifest m ON m.record_id = d.doc_id""",
    ),
    "manifest_drift_reasons": (
        manifest_drift_reasons,
        f"""WITH {BOOKS_SQL}, live AS (SELECT * FROM ledger WHERE state <> 'removed') SELECT DISTINCT reason FROM (
        SELECT CASE WHEN l.record_id IS NULL THEN 'record_added' WHEN m.record_id IS NULL THEN 'record_removed' WHEN entry_digest <> stored THEN 'record_changed' END AS reason
        FROM manifest m FULL OUTER JOIN live l ON m.record_id = l.record_id UNION ALL SELECT 'failed_ingest' FROM ledger WHERE state = 'failed') WHERE reason IS NOT NULL""",
    ),
    "orphan_vectors": (orphan_vectors, "SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 1)"),
    "parity_problems": (
        parity_problems,
        """WITH c AS (SELECT doc_id AS chunk_id, lang AS a, doc_id % 4 AS b FROM documents),
        v AS (SELECT vec_id * 2 AS chunk_id, coalesce(c.a, 'none') AS a, CASE WHEN label % 3 = 0 THEN (vec_id * 2) % 4 ELSE 0 END AS b FROM embeddings LEFT JOIN c ON c.chunk_id = vec_id * 2)
        SELECT * FROM (SELECT coalesce(c.chunk_id, v.chunk_id) AS chunk_id, CASE WHEN v.chunk_id IS NULL THEN 'missing_vector' WHEN c.chunk_id IS NULL THEN 'orphan_vector'
        WHEN c.a <> v.a OR c.b <> v.b THEN 'locator_mismatch' END AS problem FROM c FULL OUTER JOIN v ON c.chunk_id = v.chunk_id) WHERE problem IS NOT NULL""",
    ),
    "stale_citations": (stale_citations, f"WITH {BOOKS_SQL} SELECT vec_id AS citation_id, CASE WHEN l.record_id IS NOT NULL THEN 'stale_version' ELSE 'current' END AS freshness FROM embeddings LEFT JOIN ledger l ON l.record_id = vec_id AND l.desired_fingerprint IS DISTINCT FROM l.active_fingerprint"),
    "supersession_edges": (supersession_edges, f"""WITH {RECORDS_SQL} SELECT id AS successor_id, supersedes AS predecessor_id, 'mev_' || sha256('["supersession-v1","' || supersedes || '","' || id || '"]') AS evidence_id FROM rec WHERE supersedes IS NOT NULL"""),
    "supersession_notices": (
        supersession_notices,
        f"""WITH {RECORDS_SQL} SELECT query_id, predecessor_id, id AS successor_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY id, predecessor_id) AS INTEGER) AS disclosure_no,
        'This decision was later changed by ' || title || ' (' || id || ').' AS sentence
        FROM (SELECT DISTINCT l_orderkey AS query_id, 'P-' || l_partkey AS predecessor_id FROM lineitem) JOIN rec ON supersedes = predecessor_id""",
    ),
    "supersession_cycles": (
        supersession_cycles,
        """WITH RECURSIVE e AS (SELECT c_custkey AS s, CASE WHEN c_custkey % 7 = 0 THEN c_custkey - 6 WHEN c_custkey % 7 < 4 THEN c_custkey + 1 WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey - 1 END AS p FROM customer),
        w AS (SELECT s AS origin, p AS here FROM e WHERE p IS NOT NULL UNION SELECT origin, e.p FROM w JOIN e ON e.s = w.here WHERE e.p IS NOT NULL)
        SELECT DISTINCT origin AS record_id FROM w WHERE origin = here""",
    ),
    "citation_numbering": (
        citation_numbering,
        """WITH u AS (SELECT conv_id AS query_id, turn, 0 AS source_pos, split_part(text, ' ', 1) AS path, role AS chunk_id FROM conversations UNION ALL SELECT conv_id, turn, 1, role, role FROM conversations),
        f AS (SELECT query_id, chunk_id, path, min((turn, source_pos)) AS first, array_to_string(list_sort(list(DISTINCT turn)), ',') AS sentences FROM u GROUP BY ALL)
        SELECT query_id, chunk_id, path, row_number() OVER (PARTITION BY query_id ORDER BY first, chunk_id, path) AS citation_no, sentences FROM f""",
    ),
    "active_set_digest": (
        active_set_digest,
        """SELECT count(*) AS n, sha256('["' || string_agg(c, '","' ORDER BY c) || '"]') AS digest FROM (SELECT CAST(doc_id AS VARCHAR) AS c FROM documents)""",
    ),
    "latest_state_per_record": (latest_state_per_record, "SELECT user_id AS record_id, event_id, event_type AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "streamed_latest_state": (streamed_latest_state, "SELECT user_id AS record_id, event_id, event_type AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "store_diff": (
        store_diff,
        """WITH a AS (SELECT source AS record_id, sha256(text) AS fingerprint, count(*) AS in_one FROM documents GROUP BY ALL),
        b AS (SELECT source AS record_id, CASE WHEN doc_id % 6 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS fingerprint, count(*) AS in_two FROM documents WHERE doc_id % 9 <> 2 GROUP BY ALL)
        SELECT record_id, fingerprint, coalesce(in_one, 0) AS in_one, coalesce(in_two, 0) AS in_two FROM a FULL OUTER JOIN b USING (record_id, fingerprint) WHERE coalesce(in_one, 0) <> coalesce(in_two, 0)""",
    ),
    "replace_rows": (replace_rows, "SELECT source AS record_id, doc_id, 'old' AS age FROM documents WHERE source NOT IN ('src1', 'src4') UNION ALL SELECT source, doc_id + 1000000, 'new' FROM documents WHERE source IN ('src1', 'src4')"),
    "active_chunks": (
        active_chunks,
        """WITH t AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS tags FROM lineitem GROUP BY l_orderkey),
        s AS (SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list(DISTINCT 'p/' || l_partkey || '#' || l_returnflag)), ',') AS provenance FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
        SELECT l_orderkey || '-' || l_linenumber AS chunk_id, o_orderpriority AS record_title, o_orderstatus AS record_status, tags, coalesce(provenance, '') AS provenance
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN t USING (l_orderkey) LEFT JOIN s USING (l_orderkey, l_linenumber)""",
    ),
    "validation_violations": (
        validation_violations,
        f"""WITH {RECORDS_SQL}
        SELECT id, 'status' AS field, 'error' AS severity, 'required.missing' AS rule, 'status is required' AS reason FROM rec WHERE status IS NULL
        UNION ALL SELECT id, 'decision.chosen', 'error', 'required.missing', 'decision.chosen is required' FROM rec WHERE trim(chosen) = ''
        UNION ALL SELECT id, 'date', 'error', 'date.malformed', 'date ''2024-02-31'' is not a real calendar date' FROM rec WHERE date = '2024-02-31'
        UNION ALL SELECT id, 'date', 'error', 'date.malformed', 'date ''soon'' is not a valid YYYY-MM-DD date' FROM rec WHERE date = 'soon'
        UNION ALL SELECT id, '', 'error', 'rationale.missing', 'at least one of why or rationale_summary must be populated' FROM rec WHERE k % 5 = 0 AND k % 2 <> 0
        UNION ALL SELECT id, 'supersedes', 'error', 'supersedes.self_reference', 'supersedes must not equal this record''s own id' FROM rec WHERE supersedes = id
        UNION ALL SELECT id, 'evidence[0].kind', 'error', 'required.missing', 'evidence kind is required' FROM rec WHERE kind IS NULL
        UNION ALL SELECT id, 'evidence[0].target', 'error', 'evidence.empty_target', 'evidence target is empty' FROM rec WHERE target = ''
        UNION ALL SELECT id, 'decision.alternatives[0].rejection_reason', 'warning', 'alternative.missing_rejection_reason', 'alternative has no rejection reason' FROM rec WHERE k % 3 <> 0""",
    ),
    "evidence_commit_resolution": (
        evidence_commit_resolution,
        f"WITH {RECORDS_SQL}, t AS (SELECT DISTINCT target FROM rec WHERE kind = 'commit' AND target <> '') SELECT target, count(c) AS n FROM t LEFT JOIN (SELECT sha256(s_name) AS c FROM supplier) ON starts_with(c, target) GROUP BY target",
    ),
    "evidence_violations": (
        evidence_violations,
        f"""WITH {RECORDS_SQL}, ps AS (SELECT 'docs/specs/' || p_brand AS path FROM part WHERE p_size < 25 UNION SELECT 'src/' || p_brand FROM part WHERE p_size >= 48),
        cs AS (SELECT target, count(c) AS n FROM (SELECT DISTINCT target FROM rec WHERE kind = 'commit' AND target <> '') LEFT JOIN (SELECT sha256(s_name) AS c FROM supplier) ON starts_with(c, target) GROUP BY target)
        SELECT id, 'evidence[0].target' AS field, 'evidence.path_unresolved' AS rule FROM rec WHERE kind IN ('spec', 'file') AND {NORMAL} NOT IN (SELECT path FROM ps)
        UNION ALL SELECT id, 'evidence[0].target', CASE WHEN n = 0 THEN 'evidence.commit_unresolved' ELSE 'evidence.commit_ambiguous' END FROM rec JOIN cs USING (target) WHERE kind = 'commit' AND n <> 1""",
    ),
    "oracle_check": (oracle_check, f"WITH {RESULTS_SQL} SELECT query_id, run, detail IS NULL AS passed, detail FROM chk"),
    "pass_rates": (
        pass_rates,
        f"WITH {RESULTS_SQL} SELECT query_id, count(*) AS runs, count(*) FILTER (detail IS NULL) AS passed, round(avg(CASE WHEN detail IS NULL THEN 1.0 ELSE 0.0 END), 6) AS rate, arg_min(detail, run) FILTER (detail IS NOT NULL) AS first_failure FROM chk GROUP BY query_id",
    ),
    "unsatisfiable_oracles": (
        unsatisfiable_oracles,
        """WITH o AS (SELECT n_nationkey AS query_id, 'src' || n_nationkey AS r, 'body[' || (n_nationkey % 7) AS p FROM nation)
        SELECT query_id, 'no record ' || r AS problem FROM o WHERE r NOT IN (SELECT source FROM documents)
        UNION ALL SELECT query_id, 'no path ' || p FROM o WHERE NOT EXISTS (SELECT 1 FROM documents WHERE source = r AND doc_id % 7 <> 0 AND starts_with('body[' || (doc_id % 5) || ']', p))""",
    ),
    "reingest_check": (reingest_check, "SELECT DISTINCT source AS record_id, source IN ('src1', 'src2') AS passed FROM documents"),
    "facet_failure": (
        facet_failure,
        """WITH k AS (SELECT conv_id AS query_id, bool_or(role = 'user') AS has_reason, bool_or(role <> 'user') AS has_decision, arg_min(length(text) % 2 = 0, turn) FILTER (role <> 'user') AS covered FROM conversations GROUP BY conv_id)
        SELECT query_id, CASE WHEN query_id % 5 = 0 THEN NULL WHEN NOT (has_reason AND has_decision) THEN 'facet_extraction' WHEN covered THEN 'coverage_directness' WHEN query_id % 2 = 0 THEN 'query_state' END AS stage FROM k""",
    ),
    "change_windows": (change_windows, "SELECT strftime(time_bucket(INTERVAL '10 minutes', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS changes FROM events GROUP BY ALL"),
    "change_latest": (change_latest, "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "record_digests": (
        record_digests,
        f"""WITH {RECORDS_SQL}, t AS (SELECT id, '\\n' AS nl, CASE WHEN k % 4 = 0 THEN '"' || p_type || '"' ELSE 'null' END AS trigger, CASE WHEN k % 3 = 0 THEN '"too small"' ELSE 'null' END AS lost,
            coalesce('"' || kind || '"', 'null') AS kind, CASE WHEN k % 2 = 0 THEN '"' || p_type || '"' ELSE 'null' END AS summary, coalesce('"' || status || '"', 'null') AS status,
            coalesce('"' || supersedes || '"', 'null') AS supersedes, CASE WHEN k % 5 = 0 THEN '' ELSE '"' || p_name || '","' || p_brand || '"' END AS why, p_name, p_brand, p_type, p_size, chosen, target, date FROM rec)
        SELECT id, sha256('{{"body":"Intro of ' || p_name || nl || '## Notes' || nl || p_type || nl || '## Size' || nl || p_size || '","consequences":{{"negative":[],"positive":["' || p_type || '"]}},"context":{{"problem":"' || p_brand
            || '","triggering_change":' || trigger || '}},"date":"' || date || '","decision":{{"alternatives":[{{"rejection_reason":' || lost || ',"title":"' || p_brand || '"}}],"chosen":"' || chosen
            || '"}},"evidence":[{{"kind":' || kind || ',"note":null,"target":"' || target || '"}}],"id":"' || id || '","rationale_summary":' || summary || ',"status":' || status || ',"supersedes":' || supersedes
            || ',"tags":["' || p_brand || '"],"title":"' || p_name || '","why":[' || why || ']}}') AS record_digest FROM t""",
    ),
    "ledger_live": (ledger_live, f"WITH {BOOKS_SQL} SELECT record_id, active_fingerprint FROM ledger WHERE state <> 'removed'"),
    "source_resolution": (
        source_resolution,
        """WITH f AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 9 WHEN 0 THEN '/p/' || l_partkey WHEN 1 THEN 'a/../b' ELSE 'p/' || l_partkey END AS path FROM lineitem)
        SELECT l_orderkey, l_linenumber, path, CASE WHEN starts_with(path, '/') OR path = 'a/../b' THEN 'invalid_relative_path' WHEN path IN (SELECT 'p/' || p_partkey FROM part WHERE p_size < 30) THEN 'resolved' ELSE 'missing' END AS resolution FROM f""",
    ),
    "semantic_integrity": (
        semantic_integrity,
        f"""WITH {FAR_SQL} SELECT * FROM (SELECT query_id, chunk_id, CASE WHEN chunk_id % 5 = 0 THEN CASE WHEN chunk_id % 3 <> 0 THEN 'missing' END WHEN chunk_id % 3 = 0 THEN 'unexpected'
        WHEN chunk_id % 7 = 0 THEN 'distance' END AS problem FROM far) WHERE problem IS NOT NULL""",
    ),
    "stem_relation_counts": (
        stem_relation_counts,
        f"""WITH {VOCAB_SQL}, b AS MATERIALIZED (SELECT token, unnest({_base_sql("token")}) AS base FROM vocab)
        SELECT (SELECT count(*) FROM b WHERE token <> base AND base IN (SELECT token FROM vocab)) AS directional,
        (SELECT count(*) FROM (SELECT DISTINCT x.token, y.token AS other FROM b x JOIN b y USING (base) WHERE x.token < y.token)) AS shared""",
    ),
    "provider_attempt_summary": (
        provider_attempt_summary,
        """SELECT event_type AS concern, CASE WHEN event_id % 4 < 2 THEN 'success' WHEN event_id % 4 = 2 THEN 'retryable_failure' ELSE 'final_failure' END AS outcome, count(*) AS attempts,
        count(*) FILTER (event_id % 4 > 0) AS retries, round(sum(value), 3) AS elapsed_ms, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY ALL""",
    ),
}

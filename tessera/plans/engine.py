"""Answering batches of questions from the active generation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.digest import pipeline_signature
from tessera.operators import claims, index, retrieval
from tessera.operators.corpus import active_chunks
from tessera.providers.ports import Invalid, Providers, Retryable, in_order
from tessera.schemas import ACCEPTED, BM25_B, BM25_EPSILON, BM25_K1, CANDIDATES, RECORD_CAP, RRF_K
from tessera.store.generation import Store, StoreError
from tessera.store.shared import cut

MAX_QUESTION_TOKENS = 8191
#: What every trace says of the retrieval behind it.
SETTINGS = {"bm25_k1": BM25_K1, "bm25_b": BM25_B, "bm25_epsilon": BM25_EPSILON, "lexical_limit": CANDIDATES, "semantic_limit": CANDIDATES, "rrf_constant": RRF_K, "accepted_limit": ACCEPTED, "record_cap": RECORD_CAP, "metric": "cosine"}
FAILURE = "struct<step int, code string, message string>"


@dataclass(frozen=True)
class Manifest:
    """The manifest a store should agree with: its entries and a digest of its bytes, read when asked for.

    ``entries`` has record_id, entry_digest and field_sources (a map of value
    path to references).
    """

    entries: DataFrame
    raw_digest: Callable[[], str]


def _tried(call: Callable, *args) -> tuple[object, str | None]:
    """What a provider says, or why it failed; a failure ends one question, not the batch."""
    try:
        return call(*args), None
    except (Invalid, Retryable) as e:
        return None, str(e) or type(e).__name__


class Engine:
    """A pinned generation; every method is one job over all its questions."""

    def __init__(self, spark: SparkSession, store: Store, providers: Providers | None = None):
        self.spark, self.providers, self.generation = spark, providers or Providers(), store.active()
        if self.generation is None:
            raise StoreError("the store has no active generation")
        p = self.providers
        self.meta = store.meta(self.generation)
        if self.meta["signature"] != pipeline_signature(p.model, p.dimensions, p.encoding):
            raise StoreError("the store was built by another pipeline")
        self.tables = {name: store.table(name, self.generation) for name in ("chunk", "vector", "tag", "chunk_source", "snapshot", "ledger", "link")}
        t = self.tables
        self.snapshot = active_chunks(t["chunk"], t["snapshot"], t["tag"], t["chunk_source"])

    def freshness(self, manifest: Manifest | None) -> tuple[str, list[str]]:
        """(state, reasons): current, drift, or unknown if a manifest was recorded and none is at hand."""
        if manifest is None:
            return ("unknown", ["manifest_unavailable"]) if self.meta.get("manifest_digest") else ("current", [])
        reasons = sorted(r["reason"] for r in index.drift_reasons(manifest.entries, self.tables["ledger"]).collect())  # a closed vocabulary
        return ("drift" if reasons else "current"), reasons

    def retrieve(self, questions: DataFrame, filters: retrieval.Filters | None = None) -> DataFrame:
        """Every fused candidate of (query_id, question), ranked and selected."""
        providers = self.providers

        def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"query_id": f["query_id"], "vector": providers.checked_embedding(f["question"].tolist()) if len(f) else []})

        kind = questions.schema["query_id"].dataType.simpleString()
        asked = questions.select("query_id", "question").mapInPandas(embed, f"query_id {kind}, vector array<double>")
        return retrieval.hybrid(self.snapshot, self.tables["vector"].select("chunk_id", "vector"), questions, asked, filters)

    def ask(self, questions: DataFrame, filters: retrieval.Filters | None = None, *, manifest: Manifest | None = None, allow_stale: bool = False) -> DataFrame:
        """A row for each question: what is answered and how it came about.

        query_id, state (answered, abstained, failed), stage, cause, sentences,
        citations, notices, disclosures (what the notices cite), failure (code,
        message) and trace, whose sections settings, freshness, retrieval,
        generation and verification are always there.

        A question without an accepted chunk abstains at retrieval; one whose
        verified sentences leave a facet uncovered abstains at verification. A
        blank question fails, so does one that a provider fails on, and so do all
        if the store differs from the manifest or that changes meanwhile, unless
        stale answers are allowed.
        """
        raw = manifest.raw_digest() if manifest else None
        state, reasons = self.freshness(manifest)
        if state != "current" and not allow_stale:
            return self._assembled(questions.select("query_id", _failure(0, "stale.refused", "the index is stale")), {}, state, reasons)
        blank = F.trim(F.coalesce("question", F.lit(""))) == ""
        failed = [questions.where(blank).select("query_id", _failure(0, "usage.empty_question", "the question is empty"))]
        asked = questions.where(~blank)
        parts = self._answered(asked, filters, manifest, failed)
        out = cut(self._assembled(questions.select("query_id", F.lit(None).cast(FAILURE).alias("failure")), parts, state, reasons, failed))
        if manifest and manifest.raw_digest() != raw:
            reasons = [*reasons, "manifest_changed_during_query"]
            if not allow_stale:
                return self._assembled(questions.select("query_id", _failure(0, "stale.refused", "the manifest changed during the query")), {}, state, reasons)
            out = out.withColumn("trace", F.col("trace").withField("freshness", _fresh(state, reasons)))
        return out

    def _answered(self, questions: DataFrame, filters: retrieval.Filters | None, manifest: Manifest | None, failed: list[DataFrame]) -> dict[str, DataFrame]:
        """The tables that results are put together from, by query_id; ``failed`` grows."""
        providers, t = self.providers, self.tables
        kind = questions.schema["query_id"].dataType.simpleString()
        found = cut(self.retrieve(questions, filters).where("final_rank is not null"))
        texts = self.snapshot.select("chunk_id", "text")
        evidence = found.join(texts, "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("final_rank", "chunk_id", "text"))).alias("evidence"))  # 8 at most
        rows = questions.join(evidence, "query_id")

        def draft(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                asks = [(providers.checked_answer, text, [(e["chunk_id"], e["text"]) for e in ev]) for text, ev in zip(f["question"], f["evidence"], strict=True)]
                for q, (said, problem) in zip(f["query_id"], in_order(_tried, asks, providers.at_once), strict=True):
                    out += [(q, i, s, list(c), None) for i, (s, c) in enumerate(said)] if problem is None else [(q, -1, None, None, problem)]
                yield pd.DataFrame(out, columns=["query_id", "pos", "text", "chunk_ids", "problem"])

        drafts = cut(rows.mapInPandas(draft, f"query_id {kind}, pos int, text string, chunk_ids array<string>, problem string").withColumn("sentence_id", F.concat_ws("/", F.col("query_id").cast("string"), "pos")))
        failed.append(drafts.where("problem is not null").select("query_id", _failure(1, "provider.draft", F.col("problem"))))
        drafts = drafts.where("problem is null")
        cited = drafts.select("sentence_id", F.explode("chunk_ids").alias("chunk_id")).join(texts, "chunk_id")
        whole = claims.contained(drafts.select(F.col("sentence_id").alias("claim_id"), "text"), cited.select(F.col("sentence_id").alias("claim_id"), "text"))
        loose = cut(drafts.join(whole.where("not contained").select(F.col("claim_id").alias("sentence_id")), "sentence_id").select("query_id", "sentence_id", "text"))

        def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                told = in_order(_tried, [(providers.checked_decomposition, s) for s in f["text"]], providers.at_once)
                out = [(q, i, *t) for q, i, t in zip(f["query_id"], f["sentence_id"], told, strict=True)]
                yield pd.DataFrame(out, columns=["query_id", "sentence_id", "sub_claims", "problem"])

        shape = f"query_id {kind}, sentence_id string, sub_claims array<string>, problem string"
        once = cut(loose.mapInPandas(split, shape).withColumn("attempt", F.lit(1)))
        said = claims.decomposition_verdicts(once.where("problem is null").join(loose.select("sentence_id", F.col("text").alias("parent")), "sentence_id"))
        again = loose.join(said.where("disposition in ('not_additive', 'incomplete')").select("sentence_id"), "sentence_id")
        tried = cut(once.unionByName(again.mapInPandas(split, shape).withColumn("attempt", F.lit(2))))
        failed.append(tried.where("problem is not null").select("query_id", _failure(2, "provider.decompose", F.col("problem"))))
        tried = tried.where("problem is null").select("sentence_id", "attempt", "sub_claims")

        def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                told = in_order(_tried, [(providers.checked_entailment, c, list(e)) for c, e in zip(f["sub_claim"], f["evidence"], strict=True)], providers.at_once)
                out = [(q, i, c, *t) for q, i, c, t in zip(f["query_id"], f["sentence_id"], f["sub_claim"], told, strict=True)]
                yield pd.DataFrame(out, columns=["query_id", "sentence_id", "sub_claim", "supported", "problem"])

        shown = cited.groupBy("sentence_id").agg(F.collect_list("text").alias("evidence"))
        asked = tried.select("sentence_id", F.explode("sub_claims").alias("sub_claim")).distinct().join(drafts.select("query_id", "sentence_id"), "sentence_id").join(shown, "sentence_id")
        verdicts = cut(asked.mapInPandas(judge, f"query_id {kind}, sentence_id string, sub_claim string, supported boolean, problem string"))
        failed.append(verdicts.where("problem is not null").select("query_id", _failure(3, "provider.entail", F.col("problem"))))
        fates = cut(claims.sentence_fates(drafts, texts, tried, verdicts))
        emitted = cut(drafts.join(fates.where("fate = 'emitted'").select("sentence_id"), "sentence_id"))
        kept = emitted.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("said"))

        def covered(text: str, said: list[str] | None) -> tuple[list, list | None, str | None]:
            facets, problem = _tried(providers.checked_facets, text)
            named = [(f"F{i + 1}", x) for i, x in enumerate(facets or [])]
            sentences = [(f"S{i + 1}", s) for i, s in enumerate([] if said is None else said)]
            judged, problem = (None, problem) if problem is not None or not sentences else _tried(providers.checked_coverage, text, named, sentences)
            return named, judged, problem

        def cover(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for q, (named, judged, problem) in zip(f["query_id"], in_order(covered, zip(f["question"], f["said"], strict=True), providers.at_once), strict=True):
                    if problem is not None:
                        out.append((q, None, None, False, None, problem))
                        continue
                    judged = judged or [{"facet_id": i, "covered": False, "reason": "no_emitted_sentence"} for i, _ in named]
                    out += [(q, r["facet_id"], x, r["covered"], r["reason"], None) for r, (_, x) in zip(judged, named, strict=True)]
                yield pd.DataFrame(out, columns=["query_id", "facet_id", "facet", "covered", "reason", "problem"])

        facets = cut(rows.join(kept, "query_id", "left").select("query_id", "question", "said").mapInPandas(cover, f"query_id {kind}, facet_id string, facet string, covered boolean, reason string, problem string"))
        failed.append(facets.where("problem is not null").select("query_id", _failure(4, "provider.coverage", F.col("problem"))))
        facets = facets.where("problem is null").drop("problem")
        listed = lambda rows, *cols: rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("list"))
        return {
            "found": found,
            "retrieval": listed(found, "final_rank", "chunk_id", "record_id", "value_path", "fused_score", "selection_pass"),
            "drafts": listed(drafts, "pos", "text", "chunk_ids"),
            "facets": listed(facets, "facet_id", "facet"),
            "fates": listed(fates.join(drafts.select("sentence_id", "query_id", "pos"), "sentence_id"), "pos", "fate", "reason"),
            "coverage": listed(facets, "facet_id", "covered", "reason"),
            "verdict": claims.coverage(facets.select("query_id", "facet_id"), facets),
            "said": kept,
        } | self._cited(found, emitted, manifest)

    def _cited(self, found: DataFrame, emitted: DataFrame, manifest: Manifest | None) -> dict[str, DataFrame]:
        """Numbered citations of the emitted sentences, notices of successors and what these cite."""
        t = self.tables
        uses = emitted.select("query_id", F.col("pos").alias("sentence_pos"), F.posexplode("chunk_ids").alias("chunk_pos", "chunk_id")).join(self.snapshot.select("chunk_id", "record_id", F.posexplode("provenance").alias("source_pos", "source")), "chunk_id")
        numbered = cut(index.number_citations(uses.select("query_id", "sentence_pos", "chunk_pos", "source_pos", "chunk_id", "source.path", "source.section")))
        stale = index.stale_records(t["ledger"])
        cites = numbered.join(t["chunk"].select("chunk_id", "record_id"), "chunk_id").join(stale.withColumn("stale", F.lit(True)), "record_id", "left")
        freshness = F.when(F.col("stale"), "stale_version").otherwise("current").alias("freshness")
        notices = cut(index.supersession_notices(found, t["link"], t["snapshot"].withColumnRenamed("record_id", "id")))
        sources = None
        if manifest:
            refs = manifest.entries.select("record_id", F.try_element_at("field_sources", F.lit("supersedes")).alias("refs")).where(F.size("refs") > 0)
            sources = refs.select("record_id", F.col("refs")[0]["path"].alias("path"), F.col("refs")[0]["section"].alias("section"))
        told = index.disclosure_citations(notices, sources, stale, numbered.groupBy("query_id").agg(F.max("citation_no").alias("last")))
        return {
            "citations": cites.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("citation_no", "chunk_id", "record_id", "path", "section", freshness))).alias("list")),
            "notices": notices.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("disclosure_no", "sentence"))), lambda s: s["sentence"]).alias("list")),
            "disclosures": told.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("disclosure_no", "citation_no", "evidence_id", "record_id", "path", "section", "resolution", "freshness"))).alias("list")),
        }

    def _assembled(self, rows: DataFrame, parts: dict[str, DataFrame], state: str, reasons: list[str], failed: list[DataFrame] | None = None) -> DataFrame:
        """Results of ``rows`` (query_id, failure); sections that nothing was said in are empty, never left out."""
        for more in failed or []:
            rows = rows.unionByName(more)
        out = rows.groupBy("query_id").agg(F.min("failure").alias("failure"))
        lists = {
            "retrieval": "array<struct<final_rank int, chunk_id string, record_id string, value_path string, fused_score double, selection_pass string>>",
            "drafts": "array<struct<pos int, text string, chunk_ids array<string>>>",
            "facets": "array<struct<facet_id string, facet string>>",
            "fates": "array<struct<pos int, fate string, reason string>>",
            "coverage": "array<struct<facet_id string, covered boolean, reason string>>",
            "citations": "array<struct<citation_no int, chunk_id string, record_id string, path string, section string, freshness string>>",
            "notices": "array<string>",
            "disclosures": "array<struct<disclosure_no int, citation_no int, evidence_id string, record_id string, path string, section string, resolution string, freshness string>>",
        }
        for name, kind in lists.items():
            have = out.join(parts[name].withColumnRenamed("list", f"__{name}"), "query_id", "left") if parts else out.withColumn(f"__{name}", F.lit(None))
            out = have.withColumn(f"__{name}", F.coalesce(F.col(f"__{name}").cast(kind), F.array().cast(kind)))
        if parts:
            out = out.join(parts["said"], "query_id", "left").join(parts["verdict"], "query_id", "left")
        else:
            out = out.withColumn("said", F.lit(None).cast("array<string>")).withColumn("abstains", F.lit(None).cast("boolean")).withColumn("cause", F.lit(None).cast("string"))
        fine = F.col("failure").isNull()
        nothing = F.size("__retrieval") == 0
        answered = fine & ~nothing & ~F.coalesce("abstains", F.lit(True))
        shown = lambda name: F.when(answered, F.col(f"__{name}")).alias(name)
        trace = F.struct(
            F.struct(*[F.lit(v).alias(k) for k, v in SETTINGS.items()]).alias("settings"),
            _fresh(state, reasons).alias("freshness"),
            F.col("__retrieval").alias("retrieval"),
            F.struct(F.col("__facets").alias("facets"), F.col("__drafts").alias("drafts")).alias("generation"),
            F.struct(F.col("__fates").alias("sentences"), F.col("__coverage").alias("coverage")).alias("verification"),
        )
        return out.select(
            "query_id",
            F.when(~fine, "failed").when(answered, "answered").otherwise("abstained").alias("state"),
            F.when(fine & nothing, "retrieval").when(fine & ~answered, "claim_verification").alias("stage"),
            F.when(fine & ~answered, F.col("cause")).alias("cause"),
            F.when(answered, F.col("said")).alias("sentences"),
            shown("citations"),
            shown("notices"),
            shown("disclosures"),
            F.when(~fine, F.struct("failure.code", "failure.message")).alias("failure"),
            trace.alias("trace"),
        )


def _failure(step: int, code: str, message: Column | str) -> Column:
    """Failures sort by the step they happen in: the first counts."""
    return F.struct(F.lit(step).alias("step"), F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message")).alias("failure")


def _fresh(state: str, reasons: list[str]) -> Column:
    return F.struct(F.lit(state).alias("state"), F.array(*[F.lit(r) for r in reasons]).cast("array<string>").alias("reasons"))

"""Ranked lexical search by sort-based accumulation.

One pass over the texts keeps of each document its number of terms and the questions' terms in it with their counts; that
table, a small part of the texts, gives the corpus statistics and is all that scoring reads. A scoring task takes its
documents in groups, concatenates the (question, document, impact) entries of all matched terms, sorts their packed keys
by radix, 16 bits a pass, adds equal keys up with ``reduceat``, and keeps each question's best documents in a heap. The
tasks' winners are range-partitioned by (question, document), cut to each range's best, and range-partitioned by question
alone. Documents are never collected: the driver holds a block of questions at a time, at most ``block_terms`` different
(question, term) pairs or one question, and the corpus is read once for each block.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z. The arithmetic
is whole but for a term's weight, see ``weights``. A null text has no term and still is a document without one, like a
text without terms: neither counts, neither is found. Rows that repeat an id are documents of their own; a null id is
ranked after all others of its score. Question rows equal in id and text count once; questions that share an id but not
the text are ranked each on its own. Questions without a known term, or with a null text, get no row. Ties go to the
smaller id. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bare, cut, discard, stored

#: A term in UTF-8 bytes, after A-Z became a-z: every byte of a character beyond ASCII is 0x80 or more.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Entries that are sorted at once; one document may add as many as the block of questions has pairs.
ENTRIES = 2_000_000
LOW = np.uint64(0xFFFFFFFF)


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order; ``lower`` of bytes changes A-Z alone."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned 64-bit keys, least significant 16 bits first; digits that all keys share take no pass."""
    order = np.arange(keys.size)
    differs = int(np.bitwise_or.reduce(keys ^ keys[0])) if keys.size else 0
    for shift in range(0, 64, 16):
        if differs >> shift & 0xFFFF:
            digit = (keys >> np.uint64(shift)).astype(np.uint16)
            order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16-bit numbers by radix
    return order


def added_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sum of their values."""
    if not keys.size:
        return keys, values
    order = radix_order(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as its size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if ends.size else 0) + np.repeat(starts - ends + sizes, sizes)


def question_pairs(items: DataFrame) -> DataFrame:
    """(item_id, question, term, qf) of (item_id, text): how often each question holds each of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter(terms(text.as_py())) for text in b.column(2)]
            row = pa.array(np.repeat(np.arange(b.num_rows), [len(f) for f in found]))
            term, qf = (pa.array([x[i] for f in found for x in f.items()], kind) for i, kind in enumerate((pa.binary(), pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), term, qf], ["item_id", "question", "term", "qf"])

    rows = items.dropDuplicates().select("item_id", F.xxhash64("text").alias("question"), "text")
    return rows.mapInArrow(run, "item_id bigint, question bigint, term binary, qf bigint")


def in_blocks(pairs: DataFrame, limit: int) -> Iterator[list]:
    """Pairs of whole questions, ``limit`` at most unless one question alone has more."""
    block, one = [], []
    for row in pairs.orderBy("item_id", "question", "term").toLocalIterator():
        if one and (row["item_id"], row["question"]) != (one[0]["item_id"], one[0]["question"]):
            if block and len(block) + len(one) > limit:
                yield block
                block = []
            block, one = block + one, []
        one.append(row)
    if block and len(block) + len(one) > limit:
        yield block
        block = []
    if block + one:
        yield block + one


def matched(docs: DataFrame, known: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: all its terms, and where in ``known`` those stand that it shares, with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(known)})

    def packed(ids: pa.Array, sizes: list[int], hits: list[np.ndarray]) -> pa.RecordBatch:
        row = np.repeat(np.arange(len(hits), dtype=np.uint64), [h.size for h in hits])
        keys, tfs = added_up((row << np.uint64(32)) | np.concatenate(hits), np.ones(row.size, np.int64))
        kept = np.flatnonzero(sizes)
        offsets = pa.array(np.concatenate([[0], np.searchsorted(keys >> np.uint64(32), kept, side="right")]).astype(np.int32))
        columns = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((keys & LOW).astype(np.int32), tfs)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(kept)), pa.array(np.array(sizes, np.int64)[kept]), *columns], ["doc_id", "n", "terms", "tfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for b in batches:
            sizes, hits, first, held = [], [], 0, 0
            for text in b.column(1):
                found = terms(text.as_py())
                sizes.append(len(found))
                hits.append(np.array([at for at in map(place.get, found) if at is not None], np.uint64))
                held += hits[-1].size
                if held > ENTRIES or first + len(hits) == b.num_rows:
                    yield packed(b.column(0).slice(first, len(hits)), sizes, hits)
                    sizes, hits, first, held = [], [], first + len(hits), 0

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def weights(documents: int, frequency: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2df + 1))) of each term, in doubles."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term adds to a document's score: whole numbers, every division rounding down."""
    m = 75 + (25 * n * documents) // total
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Best:
    """The ``k`` best (score, id) of each question in heaps, whose first is the worst; null ids come last."""

    def __init__(self, k: int):
        self.k, self.heaps, self.added = k, {}, 0

    def least(self, question: int) -> int:
        """What a score must reach."""
        heap = self.heaps.get(question, ())
        return heap[0][0] if len(heap) == self.k else 1

    def add(self, question: int, score: int, known: int | None) -> None:
        heap = self.heaps.setdefault(question, [])
        self.added += 1
        entry = (score, -(2**63) if known is None else -known, self.added, known)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry[:2] > heap[0][:2]:
            heapq.heapreplace(heap, entry)

    def rows(self) -> pa.RecordBatch:
        """(question, doc_id, score, rank), each question's best first."""
        out = [(q, known, score, rank) for q, heap in self.heaps.items() for rank, (score, _, _, known) in enumerate(sorted(heap, reverse=True), 1)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int32()))], ["question", "doc_id", "score", "rank"])


RANKED = "question int, doc_id bigint, score bigint, rank int"


def scored(index: DataFrame, pairs: np.ndarray, weight: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """(question, doc_id, score, rank): each task's k best documents of each question. ``pairs``: rows of (term, question, qf), by term."""
    starts = np.searchsorted(pairs[:, 0], np.arange(len(weight) + 1))
    shared = index.sparkSession.sparkContext.broadcast((starts, pairs[:, 1].astype(np.uint64), pairs[:, 2], weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, question, qf, weight = shared.value
        best = Best(k)
        for b in batches:
            ids, n = b.column(0), b.column(1).to_numpy()
            order = ids.fill_null(2**63 - 1).to_numpy()
            sizes = b.column(2).value_lengths().to_numpy()
            term, tf = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
            doc = np.repeat(np.arange(b.num_rows), sizes)
            impact = impacts(tf, n[doc], weight[term], documents, total)
            fans = np.where(impact > 0, starts[term + 1] - starts[term], 0)
            done = np.cumsum(np.bincount(doc, fans, b.num_rows).astype(np.int64))
            at = 0
            while at < b.num_rows:  # documents in groups of bounded entries
                to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + ENTRIES, side="right")))
                mine = slice(*np.searchsorted(doc, [at, to]))
                pick = spans(starts[term[mine]], fans[mine])
                docs = np.repeat(doc[mine], fans[mine]).astype(np.uint64)
                keys, sums = added_up((question[pick] << np.uint64(32)) | docs, qf[pick] * np.repeat(impact[mine], fans[mine]))
                which, found = (keys >> np.uint64(32)).astype(np.int64), (keys & LOW).astype(np.int64)
                edges = np.flatnonzero(np.diff(which, prepend=-1, append=-1))
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    q, own = int(which[lo]), sums[lo:hi]
                    good = np.flatnonzero(own >= max(best.least(q), np.partition(own, -k)[-k] if hi - lo > k else 1)) + lo
                    for i in good[np.lexsort((order[found[good]], -sums[good]))][:k].tolist():
                        best.add(q, int(sums[i]), ids[int(found[i])].as_py())
                at = to
        yield best.rows()

    return index.mapInArrow(run, RANKED)


def selected(rows: DataFrame, k: int) -> DataFrame:
    """Each partition's k best of each question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for b in batches:
            for q, known, score in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                best.add(q, score, known)
        yield best.rows()

    return rows.mapInArrow(run, RANKED)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", *, k: int = 20, block_terms: int = 200_000) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each question: item_id, rank (from 1), doc_id, score."""
    docs = bare(docs, doc_id, doc_text).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    items = bare(items, item_id, item_text).toDF("item_id", "text").withColumn("item_id", F.col("item_id").cast("bigint"))
    spark, out = docs.sparkSession, []
    for block in in_blocks(cut(question_pairs(items)), block_terms):
        places, asked = {}, {}
        pairs = np.array(sorted((places.setdefault(bytes(r["term"]), len(places)), asked.setdefault((r["item_id"], r["question"]), len(asked)), r["qf"]) for r in block), np.int64)
        index = stored(matched(docs, list(places)))
        size = index.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
        frequency = np.zeros(len(places), np.int64)
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a row for each term of the block
            frequency[r["term"]] = r["count"]
        if size["documents"]:
            best = cut(scored(index, pairs, weights(size["documents"], frequency), size["documents"], size["total"], k))
            best = selected(selected(best.repartitionByRange("question", "doc_id"), k).repartitionByRange("question"), k)
            named = spark.createDataFrame([(at, key[0]) for key, at in asked.items()], "question int, item_id bigint")
            out.append(cut(best.join(F.broadcast(named), "question").select("item_id", "rank", "doc_id", "score")))  # ``block_terms`` questions at most
        discard(index)
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")

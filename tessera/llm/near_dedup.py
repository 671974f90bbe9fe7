"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct runs of ``width`` words (A-Z lower-cased,
words split at [\\x20\\x09-\\x0D]); a shorter document's whole word sequence is
one run; a document without words has an empty set and no links. Documents are
linked when 100 * |A & B| >= percent * |A | B|, confirmed on full sets.
Documents with equal sets form one class first, so copies cost one row each.

Bands and rows leave out a pair exactly at the threshold with a probability
under 1e-5, and candidates are dropped before verification only when their
estimate is six standard errors below the threshold.

Null text is empty. Rows with a null id are linked with nothing: component_id
is null, kept is true. Rows that repeat an id are grouped each by its own
text. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bare, cut, discard, joined, shingle_hashes, stored, word_hashes
from tessera.llm.hyperminhash import registers
from tessera.llm.near_links import near_components

BANDS, ROWS = 30, 5


def signed(docs: DataFrame, width: int, k: int) -> DataFrame:
    """(id, copy, n, print, sig) of rows (id, copy, text): size, 128-bit digest and registers of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingle_hashes(word_hashes(t.as_py()), width) for t in part.column(2)]
                n = np.array([s.size for s in sets], np.int64)
                full = np.flatnonzero(n)
                sig = [b""] * len(sets)
                if full.size:
                    starts = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    for i, r in zip(full, registers(np.concatenate([sets[i] for i in full]), starts, k), strict=True):
                        sig[i] = r.tobytes()
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(prints, pa.binary()), pa.array(sig, pa.binary())], ["id", "copy", "n", "print", "sig"])

    return docs.mapInArrow(run, "id bigint, copy bigint, n bigint, print binary, sig binary")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, members) of rows (node, text): the sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingle_hashes(word_hashes(t.as_py()), width).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["node", "members"])

    return docs.mapInArrow(run, "node bigint, members binary")


def _copy(text: F.Column) -> F.Column:
    """Tells the texts of rows that repeat an id apart."""
    return F.xxhash64(text)


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, copy, n, head, kept) of each row."""
    text = F.col(f"`{text_col}`")
    slim = bare(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), _copy(text).alias("copy"), text.alias("text"))
    rows = stored(signed(slim, width, BANDS * ROWS))
    named = rows.where("id is not null and n > 0")
    classes = named.groupBy("print").agg(F.min(F.struct("id", "copy")).alias("own"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("size"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "print", "own.id", "own.copy", "n", "sig", "size"))  # an id may be in several classes

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = classes.select("node", "id", "copy").join(nodes, "node", "left_semi")
        return full_sets(slim.join(wanted, ["id", "copy"]).select("node", "text"), width)

    found = near_components(classes.select("node", "n", "sig"), sets_of, percent=percent, bands=BANDS, rows=ROWS, slack=0.2)
    found = cut(found.join(classes.select("node", "id", "print"), "node"))
    first = cut(found.groupBy("component").agg(F.min(F.struct("id", "print")).alias("first"), F.count("*").alias("size")))
    heads = classes.select("print", "node", "id", "size").join(joined(found.select("node", "component"), first, ["component"]).select("node", "first"), "node", "left")
    heads = heads.select("print", "size", F.coalesce("first.id", "id").alias("head"), F.coalesce(F.col("first.print") == F.col("print"), F.lit(True)).alias("main"))
    heads = cut(heads)
    discard(classes)
    placed = joined(named.select("id", "copy", "n", "print"), heads, ["print"]).select("id", "copy", "n", "head", ((F.col("id") == F.col("head")) & F.col("main")).alias("kept"))
    return placed.unionByName(rows.where("id is null or n = 0").select("id", "copy", "n", F.col("id").alias("head"), F.lit(True).alias("kept")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept. Ids are integers."""
    out = _grouped(docs, id_col, text_col, width, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("head").alias("component_id"), "kept")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with all their columns."""
    gone = _grouped(docs, id_col, text_col, width, percent).where(~F.col("kept")).select(F.col("id").alias("__gone"), F.col("copy").alias("__copy")).distinct()
    return docs.join(gone, (docs[f"`{id_col}`"].cast("bigint") == gone["__gone"]) & (_copy(docs[f"`{text_col}`"]) == gone["__copy"]), "left_anti")

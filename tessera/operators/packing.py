"""Chunks by a token counter that isn't additive, such as byte-pair encoding.

The counter of ``chunking`` counts a joined text as the sum of its pieces, which lets packing run inside Spark's own
expressions. A byte-pair encoder merges across joints, so the joined pieces themselves have to be counted. That is one
Arrow pass over the units; each step counts a text of about the target's length, so a unit takes time in proportion to
its length. The rules are those of ``chunking``: paragraphs are packed greedily, a longer paragraph by sentences and on
its own, and each chunk after the first begins with the end of the one before it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessera.functions.text import BLANK_LINES, CLOSERS, END_MARKS
from tessera.operators.chunking import MODEL_LIMIT, OVERLAP, TARGET, chunk_id, embedding_input

#: Where a text ends for a Java pattern's ``$``: at its end or before the line end that closes it.
_END = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
_SENTENCE = re.compile(f"([{re.escape(END_MARKS)}][{re.escape(CLOSERS)}]*(?:\\s+|{_END}))", re.ASCII)
_MARGIN = re.compile(rf"\A\s+|\s+{_END}", re.ASCII)
_EDGE = re.compile(rf"\A[ \t\n]+|[ \t\n]+{_END}")
_BLANK = re.compile(BLANK_LINES)
_WORD = re.compile(r"\w+|[^\w \t\n\x0b\f\r]")

Count = Callable[[str], int]


def word_count(text: str) -> int:
    """Words and single marks: additive over blanks."""
    return len(_WORD.findall(text))


@cache
def bpe_counter(vocabulary: str, pattern: str) -> Count:
    """Counts by a byte-pair vocabulary, a file of base64 tokens and ranks; ``pattern`` cuts texts before merging."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def paragraphs(text: str) -> list[str]:
    trimmed = _EDGE.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    return [p for p in _BLANK.split(trimmed) if p.strip(" \t\n")]


def sentences(text: str) -> list[str]:
    return [s for s in (_MARGIN.sub("", p) for p in _SENTENCE.sub("\\1\x1e", text).split("\x1e")) if s]


def pack(pieces: Iterable[str], joiner: str, count: Count, target: int) -> list[str]:
    """Greedy packs of ``target`` tokens at most when joined, or of one piece."""
    done, current = [], None
    for piece in pieces:
        joined = piece if current is None else f"{current}{joiner}{piece}"
        if current is not None and count(joined) > target:
            done.append(current)
            joined = piece
        current = joined
    return done if current is None else [*done, current]


def chunks(text: str, count: Count, target: int = TARGET, overlap: float = OVERLAP) -> list[str]:
    """The chunks of a text, each but the first after the end of its predecessor."""
    packs, open_ones = [], []
    for p in paragraphs(text):
        if count(p) > target:
            packs += [*pack(open_ones, "\n\n", count, target), *pack(sentences(p), " ", count, target)]
            open_ones = []
        else:
            open_ones.append(p)
    packs += pack(open_ones, "\n\n", count, target)
    return [c if i == 0 else "\n\n".join(filter(None, (tail(packs[i - 1], count, overlap), c))) for i, c in enumerate(packs)]


def tail(chunk: str, count: Count, overlap: float = OVERLAP) -> str:
    """The longest run of whole sentences at a chunk's end whose count is within ``overlap`` of the chunk's."""
    limit, run = max(1, int(count(chunk) * overlap)), ""
    for s in reversed(sentences(chunk)):
        longer = f"{s} {run}" if run else s
        if count(longer) > limit:
            break
        run = longer
    return run


def plan(unit_rows: DataFrame, generation: str, counter: Callable[..., Count], *args: str) -> DataFrame:
    """Like ``chunking.plan`` by the counter that ``counter(*args)`` makes in each task."""
    columns = ["id", "title", "fingerprint", "schema_order", "i", "value_path", "text"]
    fields = [f for f in unit_rows.select(*columns[:-1]).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(*args) if args else counter
        for b in batches:
            rows, ordinals, texts = [], [], []
            for row, text in enumerate(b.column(6)):
                made = chunks(text.as_py(), count)
                rows += [row] * len(made)
                ordinals += range(len(made))
                texts += made
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(at) for i in range(6)], pa.array(ordinals, pa.int32()), pa.array(texts, pa.string()), pa.array([count(t) for t in texts], pa.int32())], [*columns[:-1], "ordinal", "text", "evidence_tokens"])

    @F.arrow_udf("int")
    def counted(texts: pa.Array) -> pa.Array:
        count = counter(*args) if args else counter
        return pa.array([count(t) for t in texts.to_pylist()], pa.int32())

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    rows = unit_rows.select(*columns).where("text is not null").mapInArrow(run, f"{kinds}, ordinal int, text string, evidence_tokens int")
    rows = rows.withColumn("chunk_id", chunk_id(generation, F.col("id"), F.col("fingerprint"), F.col("value_path"), F.col("ordinal"))).withColumn("embedding_input", embedding_input(F.col("title"), F.col("value_path"), F.col("text")))
    # a column, so that a query that doesn't ask for it doesn't count each chunk once more
    rows = rows.withColumn("input_tokens", counted(F.col("embedding_input")))
    return rows.withColumn("oversize", F.col("input_tokens") > MODEL_LIMIT)


@udtf(returnType="ordinal int, chunk string, tokens int")
class TextChunks:
    """A table function for SQL: ``SELECT ... FROM documents, LATERAL text_chunks(text, vocabulary, pattern)``.

    Without a vocabulary words and marks are counted. A null text has no chunks.
    """

    def eval(self, text: str, vocabulary: str | None = None, pattern: str | None = None):
        count = bpe_counter(vocabulary, pattern) if vocabulary else word_count
        for i, chunk in enumerate(chunks(text or "", count)):
            yield i, chunk, count(chunk)


def token_counts(text: Column, vocabulary: str, pattern: str) -> Column:
    """Tokens of each text by a byte-pair vocabulary; null for a null text."""

    @F.arrow_udf("int")
    def counted(texts: pa.Array) -> pa.Array:
        count = bpe_counter(vocabulary, pattern)
        return pa.array([None if t is None else count(t) for t in texts.to_pylist()], pa.int32())

    return counted(text)

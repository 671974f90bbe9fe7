"""Packing along a space-filling curve.

Each document is tokenized once; a hashed bag of its tokens is projected to a
few dimensions and turned into a Hilbert key. Slices of documents are
range-sorted by (key, id, start), so that like documents become neighbours,
while equal keys and very long documents still spread over tasks, and each
task cuts its stretch of the curve into full sequences. The last, partial stretch of a task is cut at powers of two, which
need no padding, so no padding remains.

Null text counts as empty: such a document is its end id alone. Rows that
repeat an id are packed as documents of their own; a hash of the text keeps the
slices of different texts under one id apart. An empty table packs to an empty
result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bare, mix64, stored

PIECES = "id {id}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def load_encoder(name: str = "byte_bpe_50k"):
    """An encoder of the public byte-level BPE vocabulary ``name``.

    Gives the ids that ``tokenizers`` gives for ``<name>.json`` with
    add_special_tokens=False (the end-of-text string in a text is its special
    id there too); the rank file of the same vocabulary is read because its
    encoder takes a third of the time.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
    core = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return lambda text: core.encode(text, allowed_special="all") if "<|endoftext|>" in text else core.encode_ordinary(text)


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, d), each coordinate below 2**bits."""
    x = points.T.astype(np.int64).copy()
    d = x.shape[0]
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the coarsest cell to the finest
        p = q - 1
        for i in range(d):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def project(ids: np.ndarray, dims: int) -> np.ndarray:
    """Mean random sign of a document's tokens in each dimension, squashed to 0..1."""
    h = mix64(ids.astype(np.uint64) + np.uint64(1))
    v = [1.0 - 2.0 * float(((h >> np.uint64(7 * i)) & np.uint64(1)).mean()) for i in range(dims)]
    return 0.5 + 0.5 * np.tanh(4.0 * np.array(v))


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, dims: int, bits: int, slice_tokens: int) -> DataFrame:
    """(id, copy, key, start, n, ids): slices of a document's ids, ``end_id`` last, its Hilbert key and a hash of its text.

    ``ids`` are little-endian 16-bit numbers, ``n`` counts the whole document.
    Slices bound the size of a row, and with it what a range of rows weighs.
    """
    names = ["id", "copy", "key", "start", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids, where = [], []
                for t in part.column(1):
                    text = t.as_py()
                    own = np.array(encode(text) + [end_id] if text else [end_id], np.uint16)
                    ids.append(own)
                    where.append(project(own, dims))
                spot = np.minimum((np.array(where) * (1 << bits)).astype(np.int64), (1 << bits) - 1)
                keys = hilbert_key(spot, bits)
                rows = [(i, at, x[at : at + slice_tokens].tobytes()) for i, x in enumerate(ids) for at in range(0, x.size, slice_tokens)]
                which = np.array([r[0] for r in rows])
                sizes = np.array([x.size for x in ids])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), part.column(2).take(pa.array(which)), pa.array(keys[which], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(sizes[which], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names)

    slim = bare(docs, id_col, text_col).toDF("id", "text").withColumn("copy", F.xxhash64("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, copy bigint, key bigint, start bigint, n bigint, ids binary")


class _Packer:
    """Cuts a stream of documents (id, copy) into sequences; holds one open sequence."""

    def __init__(self, task: int, size: int):
        self.next, self.size, self.at, self.open, self.done = task << 40, size, 0, [], []

    def add(self, doc: tuple, first: int, total: int, ids: np.ndarray) -> None:
        start = 0
        while start < ids.size:
            take = min(ids.size - start, self.size - self.at)
            own, last = ids[start : start + take], self.open[-1] if self.open else None
            if last and last[0] == doc and last[3] == total and last[1] + last[2].size == first + start:
                self.open[-1] = (doc, last[1], np.concatenate((last[2], own)), total)  # a slice goes on where the one before ended
            else:
                self.open.append((doc, first + start, own, total))
            self.at += take
            start += take
            if self.at == self.size:
                self._close(self.size)

    def _close(self, upto: int) -> None:
        """Close a sequence with the first ``upto`` ids that are open."""
        offset, rest = 0, []
        for doc, start, ids, total in self.open:
            take = min(ids.size, upto - offset)
            if take:
                self.done.append((doc[0], start, take, ids[:take].astype("<u4").tobytes(), total, self.next, offset))
                offset += take
            if take < ids.size:
                rest.append((doc, start + take, ids[take:], total))
        self.open, self.at, self.next = rest, self.at - upto, self.next + 1

    def finish(self) -> None:
        while self.at:
            self._close(1 << (self.at.bit_length() - 1))

    def flush(self, schema: pa.Schema) -> pa.RecordBatch:
        cols = list(zip(*self.done, strict=True)) if self.done else [[]] * 7
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 1024, tokenizer: str = "byte_bpe_50k", end_id: int = 0, dims: int = 4, bits: int = 10) -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset) of sequences of ``size``.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers;
    ``size`` is a power of two. Number and size of the sorted stretches follow
    ``spark.sql.shuffle.partitions`` and adaptive coalescing.
    """
    rows = stored(tokenized(docs, id_col, text_col, tokenizer, end_id, dims, bits, size))
    kind = rows.schema["id"].dataType.simpleString()
    schema = pa.schema([("id", _arrow(rows, "id")), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId(), size)
        for b in batches:
            for doc, copy, first, total, ids in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                packer.add((doc, copy), first, total, np.frombuffer(ids.as_buffer(), np.uint16))
                if len(packer.done) >= 4096:
                    yield packer.flush(schema)
        packer.finish()
        yield packer.flush(schema)

    ranged = rows.repartitionByRange("key", "id", "copy", "start").sortWithinPartitions("key", "id", "copy", "start", "ids")
    return ranged.select("id", "copy", "start", "n", "ids").mapInArrow(run, PIECES.format(id=kind)).withColumnRenamed("id", id_col)


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

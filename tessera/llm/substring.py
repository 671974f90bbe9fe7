"""Substring dedup: passages that repeat across documents, found by MinHash banding of paragraphs.

Two kinds of paragraph, so that neither line ends nor edits hide a passage:

* ``line``: a line of at least ``line_words`` words, as a set of five-word runs.
  Bands are tuned for recall: the fewest registers for which a pair at the
  threshold shares a bucket with the wanted probability. Colliding lines are
  joined, confirmed by exact Jaccard on full sets, and clustered by connected
  components. Lines with equal sets form one class first.
* ``run``: every run of ``min_words`` words, wherever it lies: inside a longer
  line, across line ends, over many short lines. Its signature is one register,
  the smallest hash of its runs of 0.3 times as many words, so equal paragraphs
  always share a bucket. Neighbouring runs with one register form a block, which
  is all that is shuffled. Where all blocks of a bucket are equal they are
  confirmed as wholes; elsewhere one block of each kind is read again and
  confirmed run by run; both on 128 bits. Equal runs are a cluster, and what
  goes on side by side in one cluster document joins to maximal spans.

In each cluster the first occurrence (smallest document id, then position)
stays and all others are marked for removal. Clusters within one document are
no repeats across documents and are left alone. A run that a removed line alone
held may go with it: a line that is near enough stays.

Null or empty text has no paragraphs. Rows with a null id are left alone.
Offsets count code points. Rows that repeat an id and text count as one
document; rows that repeat an id with other text keep their own paragraphs.
Extra columns are ignored by ``repeats`` and kept by ``remove_repeats``.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import MIX_A, POLY, Located, bare, cut, discard, heavy_keys, in_parts, inverse, joined, located_together, located_words, mix64, powers, run_hashes, shingles_in_order, stored, stored_apart
from tessera.llm.hyperminhash import registers
from tessera.llm.near_links import near_components

WIDTH = 5


def tune(percent: int, recall: float = 0.9998, rows: int = 2) -> tuple[int, int]:
    """(bands, rows): so many bands of ``rows`` registers that pairs at the threshold meet with ``recall``."""
    hit = (percent / 100) ** rows
    return int(np.ceil(np.log(1 - recall) / np.log(1 - hit))), rows


def distinct_runs(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the runs of ``WIDTH`` words of each range of words, one after the other, and their number in each."""
    size = np.maximum(hi - lo - WIDTH + 1, 0)
    first = np.cumsum(size) - size
    runs = shingles_in_order(words, WIDTH)[np.repeat(lo - first, size) + np.arange(size.sum())]
    for a, b in zip(first.tolist(), (first + size).tolist(), strict=True):
        runs[a:b].sort()
    new = np.ones(runs.size, bool)
    new[1:] = runs[1:] != runs[:-1]
    new[first[size > 0]] = True
    upto = np.concatenate(([0], np.cumsum(new)))
    return runs[new], upto[first + size] - upto[first]


def split_lines(located: Located, begin: np.ndarray, min_words: int) -> list[np.ndarray]:
    """text, start, length, words, members of each long enough line of texts as ``located_together``, and all members; start and length in code points."""
    words, first, _, raw = located
    ends = np.append(np.flatnonzero(raw == 10), raw.size)
    begins = np.append(0, ends[:-1] + 1)
    lo, hi = np.searchsorted(first, begins), np.searchsorted(first, ends)
    long = np.flatnonzero(hi - lo >= max(min_words, WIDTH))
    members, n = distinct_runs(words, lo[long], hi[long])
    text = np.searchsorted(begin, begins[long], "right") - 1
    start, stop = _points(raw, begins[long]), _points(raw, ends[long])
    return [text, start - _points(raw, begin)[text], stop - start, hi[long] - lo[long], n, members]


def _prints(members: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A digest of each set of ``n`` neighbours."""
    said, ends = memoryview(members.tobytes()), (8 * np.cumsum(n)).tolist()
    return [hashlib.blake2b(said[a:b], digest_size=16).digest() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


LINE = "id bigint, start bigint, length bigint, words bigint, n bigint, print binary, sig binary"
BLOCK = "copy bigint, anchor bigint, place bigint, span bigint, form bigint"


def marked(docs: DataFrame, line_words: int, min_words: int, k: int) -> DataFrame:
    """The paragraphs of rows (id, copy, text), in one pass over the texts: ``role`` 0 is a line (LINE), 1 a block (id and BLOCK)."""
    fields = [("role", pa.int32()), *[(c, pa.binary() if c in ("print", "sig") else pa.int64()) for c in ("id", "start", "length", "words", "n", "print", "sig", "copy", "anchor", "place", "span", "form")]]
    schema = pa.schema(fields)

    def rows(n: int, /, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high in in_parts(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False)):
                part = b.slice(low, high - low)
                located, begin = located_together(part.column(2).to_pylist())
                text, *found, members = split_lines(located, begin, line_words)
                n = found[-1]
                if n.size:
                    sig = registers(members, np.cumsum(n) - n, k)
                    sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * k), n.size, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                    cols = {c: pa.array(x, pa.int64()) for c, x in zip(("start", "length", "words", "n"), found, strict=True)}
                    yield rows(n.size, role=pa.array(np.zeros(n.size, np.int32)), id=part.column(0).take(pa.array(text)), **cols, print=pa.array(_prints(members, n), pa.binary()), sig=sig)
                text, *found = _blocks(located, begin, min_words)
                if text.size:
                    cols = {c: pa.array(x) for c, x in zip(("anchor", "place", "span", "form"), found, strict=True)}
                    times = pa.array(text)
                    yield rows(text.size, role=pa.array(np.ones(text.size, np.int32)), id=part.column(0).take(times), copy=part.column(1).take(times), **cols)

    return docs.mapInArrow(run, f"role int, {LINE}, {BLOCK}")


def _sets(docs: DataFrame, units: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, members) of paragraphs ``nodes``, read again from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high in in_parts(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)):
                part = b.slice(low, high - low)
                (words, starts, *_), begin = located_together(part.column(1).to_pylist())
                at = np.append(np.searchsorted(starts, begin), starts.size)
                members, n = distinct_runs(words, at[:-1], at[1:])
                ok = pa.array([p == q for p, q in zip(_prints(members, n), part.column(2).to_pylist(), strict=True)], pa.bool_())  # else another text of the same id
                ends = pa.py_buffer(np.concatenate(([0], 8 * np.cumsum(n))).astype(np.int32).tobytes())
                sets = pa.Array.from_buffers(pa.binary(), n.size, [None, ends, pa.py_buffer(members.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), sets.filter(ok)], ["node", "members"])

    where = units.select(F.col("uid").alias("node"), "id", "start", "length", "print").join(nodes, "node", "left_semi")
    cutout = F.substring("text", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    return docs.join(where, "id").select("node", cutout, "print").mapInArrow(run, "node bigint, members binary").dropDuplicates(["node"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 80, min_words: int = 50, line_words: int = 15, recall: float = 0.9998) -> DataFrame:
    """A row for each occurrence of a paragraph that repeats across documents.

    id, kind ("line", or "run": a maximal span of runs), start, length, words,
    cluster_doc and cluster_start (the occurrence that stays), removed.
    Documents without such a paragraph have no row; a line that repeats as it
    is and has ``min_words`` words has a row of either kind. A span ends where
    the first occurrence of its words does not go on, so spans of a document
    may overlap. Ids are integers.
    """
    if min(min_words, line_words) < 2:
        raise ValueError("a paragraph has two words or more")
    slim = bare(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("copy"), F.col(f"`{text_col}`").alias("text")).where("id is not null and text is not null")
    cols = [F.col("id").alias(id_col), "kind", "start", "length", "words", "cluster_doc", "cluster_start", "removed"]
    bands, rows = tune(percent, recall)
    lines, blocks = stored_apart(marked(slim, line_words, min_words, bands * rows).withColumn("uid", F.monotonically_increasing_id()), "role", [0, 1])
    runs = equal_runs(slim, blocks.select("id", "copy", "anchor", "place", "span", "form"), min_words, lambda: discard(blocks))
    near = near_lines(slim.select("id", "text"), lines.drop("copy", "anchor", "place", "span", "form"), percent, bands, rows)
    discard(lines)
    return near.unionByName(runs).select(*cols)


def near_lines(docs: DataFrame, units: DataFrame, percent: int, bands: int, rows: int) -> DataFrame:
    """The rows of kind ``line``: of documents (id, text) and their lines (LINE and ``uid``)."""
    classes = stored(units.groupBy("print").agg(F.min("uid").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("size")))
    found = near_components(classes.select("node", "n", "sig"), lambda nodes: _sets(docs, units, nodes), percent=percent, bands=bands, rows=rows, slack=0.6)
    # classes that repeat exactly or are linked; single lines end here
    heads = classes.select("print", "node", "size").join(found, "node", "left").where("size > 1 or component is not null").select("print", "size", F.coalesce("component", "node").alias("head"))
    hits = cut(joined(units.select("id", "start", "length", "words", "print"), cut(heads), ["print"]).select("head", "id", "start", "length", "words").distinct())
    discard(classes)
    clusters = hits.groupBy("head").agg(F.min(F.struct("id", "start")).alias("first"), F.max("id").alias("last"), F.count("*").alias("size"))
    out = joined(hits, cut(clusters.where(F.col("first.id") < F.col("last"))), ["head"])
    stays = (F.col("id") == F.col("first.id")) & (F.col("start") == F.col("first.start"))
    return out.select("id", F.lit("line").alias("kind"), "start", "length", "words", F.col("first.id").alias("cluster_doc"), F.col("first.start").alias("cluster_start"), (~stays).alias("removed"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """``docs`` with the removed spans cut out of the text; a line that goes as a whole takes its line end along."""
    gone = repeats(docs, id_col, text_col, **kwargs).where("removed").groupBy(F.col(id_col).alias("__id")).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("__gone"))
    at = docs.columns.index(text_col)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, gone in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                texts.append(without(t, [(g["start"], g["start"] + g["length"]) for g in gone]) if gone and t is not None else t)
            cols = list(b.columns[: len(names)])
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.join(gone, docs[f"`{id_col}`"].cast("bigint") == gone["__id"], "left").drop("__id").mapInArrow(run, schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text less its spans (start, stop), sorted by start; they may overlap."""
    parts, upto = [], 0
    for i, (start, stop) in enumerate(spans):
        parts.append(text[upto:start])
        upto = max(upto, stop)
        open_end = i + 1 == len(spans) or spans[i + 1][0] > upto
        if open_end and (start == 0 or text[start - 1] == "\n") and text[upto : upto + 1] == "\n":
            upto += 1
    return "".join([*parts, text[upto:]])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, in time that does not depend on the width."""
    n = x.size - width + 1
    rows = np.concatenate((x, np.full(-x.size % width, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places in bytes as places in code points."""
    more = (raw & 0xC0) == 0x80
    return at - np.concatenate(([0], np.cumsum(more)))[at] if more.any() else at


def _paired(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two numbers below 2**31 as one of 64 bits."""
    return (high.astype(np.int64) << 32) | low.astype(np.int64)


def _blocks(located: Located, begin: np.ndarray, min_words: int) -> list[np.ndarray]:
    """text, anchor, place (first window, windows), span (start, stop) and form of each block of texts as ``located_together``.

    A window is a run of ``min_words`` words, its anchor the run of ``gram`` words
    in it with the least hash; a block is a maximal run of windows with one
    anchor, so no two of its windows are equal. Blocks of one form have the
    same words in the same distances.
    """
    words, starts, ends, raw = located
    if words.size < min_words:
        return [np.empty(0, np.int64)] * 5
    gram = max(2, 3 * min_words // 10)
    runs = run_hashes(words, gram)
    bits = np.uint64(int(runs.size).bit_length())  # the lowest bits give way to the place: of equal hashes the first counts
    least = sliding_least((runs >> bits << bits) | np.arange(runs.size, dtype=np.uint64), min_words - gram + 1)
    head = np.searchsorted(starts, begin)  # the first word of each text
    text = np.repeat(np.arange(head.size), np.diff(np.append(head, words.size)))
    inside = np.flatnonzero(text[: least.size] == text[min_words - 1 :])  # windows of one text
    at = (least[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (np.diff(inside) > 1)))[: at.size])
    lo, n = inside[new], np.diff(np.append(new, at.size))
    last = lo + n + min_words - 2
    text = text[lo]
    starts, ends, begin = _points(raw, starts), _points(raw, ends), _points(raw, begin)
    gaps = np.zeros(words.size, np.uint64)
    gaps[1:] = starts[1:] - ends[:-1]
    up, down = powers(int(MIX_A), words.size), powers(inverse(int(MIX_A)), words.size)
    with np.errstate(over="ignore"):
        said, apart = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up, dtype=np.uint64))) for x in (words, gaps))
        form = mix64((said[last + 1] - said[lo]) * down[lo] + mix64((apart[last + 1] - apart[lo + 1]) * down[lo])) + n.astype(np.uint64)
        form = mix64(form)
    return [text, runs[at[new]].view(np.int64), _paired(lo - head[text], n), _paired(starts[lo] - begin[text], ends[last] - begin[text]), form.view(np.int64)]


def _high(pair: str) -> F.Column:
    return F.shiftright(pair, 32).cast("int")


def _low(pair: str) -> F.Column:
    return F.col(pair).bitwiseAND(0x7FFFFFFF).cast("int")


def with_facts(rows: DataFrame, key: str, **facts: F.Column) -> DataFrame:
    """``rows``, cut from their lineage, with aggregates over the rows of their key.

    Frequent keys (more than a 1,024th of the rows, so 1,024 at most) are
    aggregated map-side and their facts broadcast; all others take one shuffle.
    """
    heavy = heavy_keys(rows.select(key))
    often = F.coalesce(F.col(key).isin(heavy), F.lit(False)) if heavy else F.lit(False)
    group = Window.partitionBy(key)
    rest = rows.where(~often).withColumns({name: c.over(group) for name, c in facts.items()})
    few = rows.where(often)
    return rest.unionByName(few.join(F.broadcast(few.groupBy(key).agg(*[c.alias(name) for name, c in facts.items()])), key))


def equal_runs(slim: DataFrame, every: DataFrame, min_words: int, read: Callable[[], None]) -> DataFrame:
    """The rows of kind ``run``: of documents (id, copy, text) and their blocks (id and BLOCK); ``read`` is called once these are read.

    ``copy`` tells rows of one id apart by their texts.
    """
    where = F.struct("id", "copy", _high("place").alias("pos"), _high("span").alias("start"))
    shared = with_facts(every, "anchor", first=F.min(where), last=F.max("id"), least=F.min("form"), most=F.max("form"))
    shared = stored(shared.where(F.col("first.id") < F.col("last")).withColumn("alike", F.col("least") == F.col("most")).drop("last", "least", "most"))
    read()
    spot = [_high("place").alias("pos"), _low("place").alias("n"), _high("span").alias("start"), _low("span").alias("stop")]
    whole = shared.where("alike").select("id", "copy", *spot, "first")

    # of the blocks of one form in a mixed bucket, one is read again
    mixed = shared.where("not alike").drop("first", "alike")
    forms = mixed.groupBy("anchor", "form").agg(F.min(F.struct("id", "copy", "place", "span")).alias("r"), F.max("id").alias("hi"), F.count("*").alias("size"))
    forms = stored(forms.select(F.monotonically_increasing_id().alias("node"), "anchor", "form", "r.*", "hi", "size"))
    wanted = forms.groupBy("id", "copy").agg(F.collect_list(F.struct("node", "place", "hi")).alias("blocks"))

    def reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list[np.ndarray]] = []
            for doc, copy, text, blocks in zip(*(b.column(i) for i in range(4)), strict=True):
                words, starts, ends, raw = located_words(text.as_py())
                starts, ends = _points(raw, starts), _points(raw, ends)
                node, place, hi = (blocks.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                lo, n = place >> 32, place & 0x7FFFFFFF
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pos = np.repeat(lo, n) + off
                prints = np.stack([run_hashes(words, min_words, int(base))[pos] for base in (POLY, MIX_A)], axis=1)
                parts.append([np.repeat(node, n), off.astype(np.int32), np.full(pos.size, doc.as_py()), np.full(pos.size, copy.as_py()), pos.astype(np.int32), _paired(starts[pos], ends[pos + min_words - 1]), np.repeat(hi, n), prints])
                if sum(p[1].size for p in parts) > 50_000:
                    yield from told(parts)
                    parts = []
            if parts:
                yield from told(parts)

    def told(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        *cols, prints = (np.concatenate(c) for c in zip(*parts, strict=True))
        for at in range(0, len(prints), 100_000):
            own = prints[at : at + 100_000]
            own = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(own), [None, pa.py_buffer(own.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*[pa.array(c[at : at + 100_000]) for c in cols], own], ["node", "off", "id", "copy", "pos", "span", "hi", "print"])

    windows = slim.join(wanted, ["id", "copy"]).dropDuplicates(["id", "copy"]).select("id", "copy", "text", "blocks")
    windows = stored(windows.mapInArrow(reread, "node bigint, off int, id bigint, copy bigint, pos int, span bigint, hi bigint, print binary"))
    where = F.struct("id", "copy", "pos", _high("span").alias("start"))
    runs = with_facts(windows, "print", first=F.min(where), last=F.max("hi")).where(F.col("first.id") < F.col("last"))
    line = ["node", "cluster_doc", "cluster_copy", "ahead"]
    runs = runs.select("node", "off", _high("span").alias("start"), _low("span").alias("stop"), F.col("first.id").alias("cluster_doc"), F.col("first.copy").alias("cluster_copy"), (F.col("first.pos") - F.col("off")).alias("ahead"), F.col("first.start").alias("cluster_start"))
    runs = runs.withColumn("island", F.col("off") - F.row_number().over(Window.partitionBy(*line).orderBy("off")))
    parts = runs.groupBy(*line, "island").agg(F.min("off").alias("off"), F.count("*").cast("int").alias("n"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("cluster_start").alias("cluster_start"))
    parts = parts.groupBy("node").agg(F.collect_list(F.struct("off", "n", "start", "stop", "cluster_doc", "cluster_copy", "ahead", "cluster_start")).alias("parts"))  # as many as a block has windows at most
    found = stored(forms.join(parts, "node").select("anchor", "form", F.col("span").alias("from"), "size", "parts"))
    back = joined(mixed, found, ["anchor", "form"]).select("id", "copy", *spot, F.explode("parts").alias("p"), _high("from").alias("base"))
    shift = F.col("start") - F.col("base")
    pieces = back.select("id", "copy", (F.col("pos") + F.col("p.off")).alias("pos"), F.col("p.n").alias("n"), (F.col("p.start") + shift).alias("start"), (F.col("p.stop") + shift).alias("stop"), "p.cluster_doc", "p.cluster_copy", (F.col("p.ahead") - F.col("pos")).alias("ahead"), "p.cluster_start")
    hits = whole.select("id", "copy", "pos", "n", "start", "stop", F.col("first.id").alias("cluster_doc"), F.col("first.copy").alias("cluster_copy"), (F.col("first.pos") - F.col("pos")).alias("ahead"), F.col("first.start").alias("cluster_start")).unionByName(pieces)
    discard(windows)
    return _spans(hits, min_words)


def _spans(hits: DataFrame, min_words: int) -> DataFrame:
    """Maximal spans of blocks that go on side by side in their cluster document."""
    same = ["id", "copy", "cluster_doc", "cluster_copy", "ahead"]
    along = Window.partitionBy(*same).orderBy("pos")
    upto = F.max(F.col("pos") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    parted = hits.withColumn("fresh", F.coalesce(F.col("pos") > upto, F.lit(True)).cast("int")).withColumn("part", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = parted.groupBy(*same, "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("cluster_start").alias("cluster_start"), (F.max(F.col("pos") + F.col("n")) - F.min("pos") + min_words - 1).alias("words"))
    stays = (F.col("id") == F.col("cluster_doc")) & (F.col("copy") == F.col("cluster_copy")) & (F.col("ahead") == 0)
    long = [F.col(c).cast("bigint").alias(c) for c in ("start", "words", "cluster_doc", "cluster_start")]
    return spans.select("id", F.lit("run").alias("kind"), *long, (F.col("stop") - F.col("start")).cast("bigint").alias("length"), (~stays).alias("removed"))

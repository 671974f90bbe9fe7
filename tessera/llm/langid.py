"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: slot i holds a 64-bit mask
whose bit l says that slot i is set in the filter of language l. ANDing the
masks of an n-gram's slots therefore returns all languages that contain it, at
once. A text's n-grams are looked up, the bits are counted per language,
corrected for each filter's false-positive rate, and the largest share decides.

Training: n-grams are counted per language over a bounded sample of labelled
documents (``per_language`` distinct texts of each, those with the smallest
hash). A language's filter gets the n-grams whose relative frequency
there is at least ``keep`` of the highest relative frequency in any language,
so that strays (loan words, mislabelled documents) do not enter.

Prediction reads the whole text. Null text or text without a letter is ``und``
with score 0. Text with letters of which no n-gram is known gets the language
with most labelled texts, with score 0. Ties go to the first language in order
of name. Rows with null language or null text teach nothing; with no labelled
rows at all, everything is ``und``. At most 64 languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import MIX_A, MIX_B, bare, mix64

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter or a mark on one; made once a process."""
    return np.array([category(chr(i))[0] in "LM" for i in range(0x110000)])


def points_of(text: str) -> np.ndarray:
    """The code points of a text in lower case between two gaps; whatever is no letter or mark is a gap, and a run of gaps counts once."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letters()[points], points, 32).astype(np.uint32)
    points = np.concatenate(([np.uint32(32)], points, [np.uint32(32)]))
    keep = np.ones(points.size, bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[keep]


def window_hashes(points: np.ndarray, sizes: tuple[int, ...], first: int, last: int) -> np.ndarray:
    """Hashes of the n-grams of ``points`` that begin at ``first`` to ``last`` (exclusive)."""
    out = [np.empty(0, np.uint64)]
    with np.errstate(over="ignore"):
        for n in sizes:
            stop = min(last, points.size - n + 1)
            if stop > first:
                h = np.full(stop - first, n, np.uint64)
                for i in range(n):
                    h = (h ^ points[first + i : stop + i].astype(np.uint64)) * MIX_A
                    h ^= h >> np.uint64(29)
                out.append(h * MIX_B)
    return np.concatenate(out)


def ngram_hashes(text: str, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of the code-point n-grams of a text."""
    points = points_of(text)
    return window_hashes(points, sizes, 0, points.size)


@dataclass(frozen=True)
class Filters:
    """Bit-sliced filters: ``masks`` (2**bits slots), the languages, fill of each, the most frequent language."""

    languages: tuple[str, ...]
    masks: np.ndarray
    bits: int
    probes: int
    sizes: tuple[int, ...]
    false_rate: np.ndarray
    common: str = UNKNOWN

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The mask of languages that contain each n-gram."""
        top = np.uint64(64 - self.bits)
        found = self.masks[hashes >> top]
        for _ in range(1, self.probes):
            hashes = mix64(hashes)
            found = found & self.masks[hashes >> top]
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        hits, total, points = np.zeros(len(self.languages)), 0, points_of(text)
        for at in range(0, points.size, 1 << 16):  # all n-grams of the whole text, by where they begin
            found = self.lookup(window_hashes(points, self.sizes, at, at + (1 << 16)))
            total += found.size
            if self.masks.dtype == np.uint8:
                counts = np.bincount(found, minlength=256)
                hits += [counts[_HAS[i]].sum() for i in range(len(self.languages))]
            else:
                hits += [np.count_nonzero(found & np.uint64(1 << i)) for i in range(len(self.languages))]
        true = np.maximum(0.0, (hits - total * self.false_rate) / (1.0 - self.false_rate))
        if not true.sum() > 0:
            return self.common, 0.0
        best = int(np.argmax(true))
        return self.languages[best], float(min(1.0, true[best] / max(1, total)))


_HAS = [np.flatnonzero(np.arange(256) >> i & 1) for i in range(8)]


def language_sizes(labelled: DataFrame, lang: str, text: str) -> dict[str, int]:
    """About how many distinct texts each language has."""
    rows = _labelled(labelled, lang, text)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if len(sizes) > 64:
        raise ValueError("at most 64 languages")
    return sizes


def _labelled(labelled: DataFrame, lang: str, text: str) -> DataFrame:
    rows = bare(labelled, lang, text).toDF("lang", "text").where("lang is not null and text is not null")
    return rows.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))


def sample_texts(labelled: DataFrame, lang: str, text: str, per_language: int, sizes: dict[str, int]) -> DataFrame:
    """(lang, text): at most ``per_language`` distinct texts a language, those with the smallest hash.

    A hash threshold drawn from the number of distinct texts settles nearly
    all rows map-side, so neither a common text nor a common language gathers.
    """
    rows = _labelled(labelled, lang, text)
    if not sizes:
        return rows.select("lang", "text")
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int((1 << 40) * min(1.0, 1.3 * per_language / max(1, n))))) for k, n in sizes.items()])
    few = rows.where(F.col("h") <= limit).groupBy("lang", "h").agg(F.min("text").alias("text"))
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    return ranked.where(F.col("r") <= per_language).select("lang", "text")


def count_ngrams(labelled: DataFrame, lang: str, text: str, sizes: tuple[int, ...]) -> DataFrame:
    """(lang, gram, c): occurrences of hashed n-grams per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list[np.ndarray]] = {}
            for name, own in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found.setdefault(name, []).append(ngram_hashes(own.as_py(), sizes))
            for name, parts in found.items():
                gram, c = np.unique(np.concatenate(parts).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * gram.size, pa.string()), pa.array(gram), pa.array(c.astype(np.int64))], ["lang", "gram", "c"])

    return bare(labelled, lang, text).mapInArrow(run, "lang string, gram bigint, c bigint").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", *, per_language: int = 600, sizes: tuple[int, ...] = (2, 3, 4, 5), bits: int = 20, probes: int = 2, keep: float = 0.5, least: int = 3) -> Filters:
    """Fit the filters on at most ``per_language`` distinct texts of each language.

    What reaches the driver is the n-grams of that bounded sample.
    """
    per = language_sizes(labelled, lang, text)
    sample = sample_texts(labelled, lang, text, per_language, per).repartition(12)
    counts = count_ngrams(sample, "lang", "text", sizes).where(F.col("c") >= least).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    grams, at = np.unique(counts.column("gram").to_numpy(), return_inverse=True)
    order = {n: i for i, n in enumerate(names)}
    table = np.zeros((len(names), grams.size))
    table[np.array([order[x] for x in counts.column("lang").to_pylist()], np.int64), at] = counts.column("c").to_numpy()
    share = table / np.maximum(1, table.sum(axis=1, keepdims=True))
    chosen = (table > 0) & (share >= keep * share.max(axis=0, initial=0.0))
    masks = np.zeros(1 << bits, np.uint8 if len(names) <= 8 else np.uint64)
    for i in range(len(names)):
        h = grams[chosen[i]].view(np.uint64)
        for _ in range(probes):
            masks[h >> np.uint64(64 - bits)] |= masks.dtype.type(1 << i)
            h = mix64(h)
    fill = np.array([np.count_nonzero(masks & masks.dtype.type(1 << i)) for i in range(len(names))]) / (1 << bits)
    return Filters(tuple(names), masks, bits, probes, sizes, fill**probes, min(per, key=lambda x: (-per[x], x), default=UNKNOWN))


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, which replace columns so named."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    where = names.index(text)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            said = [model.predict(t.as_py()) for t in b.column(where)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], [*names, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, f"{schema}, lang_pred string, score double")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))

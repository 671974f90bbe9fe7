"""Main text of web pages by a linear-chain conditional random field.

A page's leaf blocks form a chain; each is article or other. Features are the
ancestors' tags and the words of their classes and ids, and the block's text:
length, link density, punctuation, place. The field is trained on labelled
pages (``html_pages``: ``training_pages`` of them, generated, so the bound is
fixed), and pages are decoded by Viterbi, each on its own.

Null or empty html gives an empty text. Character references are decoded,
white space in a block becomes one space, blocks are joined by one newline;
nothing else is dropped or cut. Rows that repeat are extracted each. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bare
from tessera.llm.html_blocks import Block, Path, blocks
from tessera.llm.html_pages import labelled_pages

WORD = re.compile(r"[a-z]+")


def own_features(name: str, in_article: bool) -> set[str]:
    """Of one ancestor: its tag, the words and whole names of its classes and ids."""
    tag, _, words = name.partition(" ")
    out = {f"t={tag}"}
    if in_article:
        out.add(f"in-article={tag}")
    for token in words.split():
        out.add(f"n={token}")
        out.update(f"w={w}" for w in WORD.findall(token))
    return out


def near_features(path: Path | None) -> list[str]:
    """The nearest three tags."""
    return [f"up{i}={p.name.partition(' ')[0]}" for i, p in enumerate(islice(path.up(), 3))] if path else []


def opens_article(name: str) -> bool:
    return name.partition(" ")[0] in ("article", "main")


def path_features(path: Path | None) -> set[str]:
    """The features of all ancestors."""
    out, article = set(near_features(path)), False
    for p in reversed(list(path.up()) if path else []):
        article = article or opens_article(p.name)
        out |= own_features(p.name, article)
    return out


def text_features(b: Block) -> list[str]:
    words = b.text.count(" ") + 1
    density = min(4, int(5 * b.linked / max(1, len(b.text))))
    out = [f"len={min(7, words.bit_length())}", f"links={density}", f"links={density},len={min(4, words.bit_length())}"]
    if b.text[-1] in ".!?:;\"'”»)…":
        out.append("ends")
    if "©" in b.text or "copyright" in b.text.lower():
        out.append("copyright")
    if sum(c in ".!?," for c in b.text) * 25 >= len(b.text):
        out.append("stops")
    return out


def places(n: int) -> list[list[str]]:
    return [[f"place={4 * i // max(1, n)}"] + (["first"] if i == 0 else []) + (["last"] if i == n - 1 else []) for i in range(n)]


NONE = (0.0, 0.0)


@dataclass
class Field:
    """Weights: a row (other, article) per feature, and between neighbours."""

    weights: dict[str, tuple[float, float]]
    between: np.ndarray
    start: np.ndarray

    def of_path(self, path: Path | None) -> tuple[float, float]:
        """The summed weights of a path's features. What is above is summed once, whatever stands below it."""
        todo = []
        for p in path.up() if path else ():
            if p.known is not None:
                break
            todo.append(p)
        for p in reversed(todo):
            x, y, seen, article = p.above.known[:4] if p.above else (0.0, 0.0, frozenset(), False)
            article = article or opens_article(p.name)
            new = {f for f in own_features(p.name, article) if f in self.weights} - seen
            for f in sorted(new):
                x, y = x + self.weights[f][0], y + self.weights[f][1]
            nx, ny = x, y
            for f in near_features(p):
                w = self.weights.get(f, NONE)
                nx, ny = nx + w[0], ny + w[1]
            p.known = (x, y, seen | new if new else seen, article, nx, ny)
        return path.known[4:] if path else NONE

    def scores(self, page: list[Block]) -> np.ndarray:
        out = []
        for b, place in zip(page, places(len(page)), strict=True):
            x, y = self.of_path(b.path)
            for f in (*text_features(b), *place):
                w = self.weights.get(f, NONE)
                x, y = x + w[0], y + w[1]
            out.append((x, y))
        return np.array(out).reshape(-1, 2)

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi: which blocks are article."""
        if not page:
            return []
        scores, back = self.scores(page).tolist(), []
        (t00, t01), (t10, t11) = self.between.tolist()
        a, b = scores[0][0] + self.start[0], scores[0][1] + self.start[1]
        for x, y in scores[1:]:
            back.append((a + t00 < b + t10, a + t01 < b + t11))
            a, b = max(a + t00, b + t10) + x, max(a + t01, b + t11) + y
        at = bool(b > a)
        out = [at]
        for from_article in reversed(back):
            at = bool(from_article[at])
            out.append(at)
        return out[::-1]

    def extract(self, html: str | None) -> str:
        page = blocks(html)
        return "\n".join(b.text for b, keep in zip(page, self.decode(page), strict=True) if keep)


def train(pages: list[list[Block]], *, steps: int = 250, rate: float = 0.1, decay: float = 2e-4, least: int = 3) -> Field:
    """Maximum likelihood by forward-backward and Adam, all pages at once."""
    pages = sorted((p for p in pages if p), key=len, reverse=True)
    seen: dict[str, int] = {}
    rows = []
    for p in pages:
        for b, place in zip(p, places(len(p)), strict=True):
            own = [*path_features(b.path), *text_features(b), *place]
            rows.append(own)
            for f in own:
                seen[f] = seen.get(f, 0) + 1
    names = sorted(f for f, n in seen.items() if n >= least)
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, own in enumerate(rows):
        x[i, [at[f] for f in own if f in at]] = 1.0
    longest, n = max(map(len, pages)), len(pages)
    where = np.full((n, longest), -1)
    upto = 0
    for i, p in enumerate(pages):
        where[i, : len(p)] = np.arange(upto, upto + len(p))
        upto += len(p)
    there = where >= 0
    going = there.sum(axis=0)  # so many pages, the first, have a block at each place
    gold = np.array([b.label == "1" for p in pages for b in p]).astype(int)
    y = np.where(there, gold[np.maximum(where, 0)], 0)
    both = there[:, 1:]
    pair_gold = np.zeros((2, 2))
    np.add.at(pair_gold, (y[:, :-1][both], y[:, 1:][both]), 1)
    start_gold = np.bincount(y[:, 0], minlength=2)
    params = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)]
    memory = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        w, t, s = params
        # with two labels a message is one number: by how much "article" is ahead of "other"
        emit = np.zeros((longest, n))
        emit.T[there] = x @ (w[:, 1] - w[:, 0]).astype(np.float32)
        (t00, t01), (t10, t11) = t
        fore, rear = np.zeros_like(emit), np.zeros_like(emit)
        (e00, e01), (e10, e11) = np.exp(t)
        fore[0] = s[1] - s[0] + emit[0]
        for j in range(1, longest):
            here = slice(0, going[j])
            odds = np.exp(fore[j - 1, here].clip(-300, 300))
            fore[j, here] = np.log((e01 + e11 * odds) / (e00 + e10 * odds)) + emit[j, here]
        for j in range(longest - 2, -1, -1):
            here = slice(0, going[j + 1])
            odds = np.exp((emit[j + 1, here] + rear[j + 1, here]).clip(-300, 300))
            rear[j, here] = np.log((e10 + e11 * odds) / (e00 + e01 * odds))
        chance = 1 / (1 + np.exp(-(fore + rear).T))
        over = (chance[there] - gold).astype(np.float32) @ x
        left, right = fore[:-1].T[both], (emit + rear)[1:].T[both]
        four = np.stack([np.full_like(left, t00), t01 + right, t10 + left, t11 + left + right])
        four = np.exp(four - four.max(axis=0))
        pair = (four / four.sum(axis=0)).sum(axis=1).reshape(2, 2)
        first = np.array([(1 - chance[:, 0]).sum(), chance[:, 0].sum()])
        grads = [np.stack([-over, over], axis=1) / n + decay * w, (pair - pair_gold) / n + decay * t, (first - start_gold) / n]
        for p, g, (m, v) in zip(params, grads, memory, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({f: (float(a), float(b)) for f, (a, b) in zip(names, params[0], strict=True)}, params[1], params[2])


@lru_cache(maxsize=2)
def default_field(training_pages: int = 600, seed: int = 11) -> Field:
    return train([blocks(h) for h in labelled_pages(training_pages, seed)])


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), *, training_pages: int = 600) -> DataFrame:
    """The ``keep`` columns of each page with ``text`` and ``n_chars`` (code points)."""
    model = default_field(training_pages)
    shared = pages.sparkSession.sparkContext.broadcast(Field(model.weights, model.between, model.start))
    slim = bare(pages, *keep, html_col)
    names = [*keep, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for b in batches:
            texts = [crf.extract(h.as_py()) for h in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*[F.col(f"`{c}`") for c in keep]).schema)
    return slim.mapInArrow(run, f"{schema}, text string, n_chars bigint")

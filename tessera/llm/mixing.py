"""Mixing to target weights by soft membership. DataFrame and SQL functions only.

1. A naive Bayes classifier learns from a labelled table (id, domain): the
   words whose presence tells most between domains (likelihood ratio), over a
   bounded sample of ``labelled_rows`` labelled documents. Words are not
   independent, so its scores are calibrated on a quarter of the sample that
   taught no words: a softmax regression, held to the identity by one pseudo
   document.
2. Every document gets a posterior over domains and a token (word) count.
3. Nonnegative rates x are fitted so that the expected tokens of each domain,
   sum of tokens * rate * posterior, match the target weights times the budget
   in least squares, each domain's error weighed by its mass. Projected
   gradient fits them: plain steps first (in that metric the largest curvature
   is 1, so steps of 1 are safe), then, or at once if the total is open, steps
   scaled by the totals' own curvature over the rates free to move, which halve
   the gaps or more each. Only where those come no nearer, as when no rates match,
   proximal steps decide, each solved by Newton's method on its dual, which has
   one number a domain. Every step is one aggregation to a few numbers; a
   document's rate is a fold over the moves, stored every few of them. The fit
   ends when the totals match or no rates match them better, else it raises.

Null text is empty: no tokens, prior posterior. Rows with a null or unknown
label teach nothing; with no labels at all every posterior is uniform.
Rows with a null id are mixed like others. Rows that repeat are separate
documents. Extra columns pass through unless named like a result column, which
replaces them. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard, stored


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; no empty ones."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], *, id_col: str = "doc_id", text_col: str = "text", labelled_rows: int = 4000, vocabulary: int = 1000, alpha: float = 0.5) -> tuple[list[float], list[tuple]]:
    """(offsets, rows (word, weight per domain)) from labelled (id, domain): calibrated log priors and log-likelihood ratios.

    What reaches the driver is at most ``vocabulary`` words and the scores of
    ``labelled_rows`` documents.
    """
    known = labelled.select(F.col(f"`{id_col}`").alias("__id"), "domain").where(F.col("domain").isin(domains) & F.col("__id").isNotNull())
    have = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(have.values())
    if not total:
        return [math.log(1 / len(domains))] * len(domains), []
    # a share of each domain by hash of the id: its size is bounded by labelled_rows (but for chance)
    share = labelled_rows / len(domains)
    limit = F.coalesce(*[F.when(F.col("domain") == d, F.lit(min(1.0, share / n))) for d, n in have.items()])
    few = known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_003)) < limit * 1_000_003).dropDuplicates(["__id"])
    few = few.limit(2 * labelled_rows)
    text = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    taught = text.join(F.broadcast(few), "__id")  # 2 * labelled_rows rows at most
    held = F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(4)) == 0
    every = cut(taught.select("domain", held.alias("held"), F.array_distinct(words_of(F.col("__text"))).alias("words")))
    seen = every.where("not held")
    n = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    size = [n.get(d, 0) for d in domains]
    here = F.explode("words").alias("word")
    counts = seen.select("domain", here).groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(f"c{i}") for i, d in enumerate(domains)])
    all_docs = sum(size) or 1
    df = sum((F.col(f"c{i}") for i in range(len(domains))), F.lit(0))

    def entropy_part(c: Column, row: Column, column: float) -> Column:
        return F.when((c > 0) & (row > 0) & F.lit(column > 0), c * F.log(c * all_docs / (row * max(column, 1)))).otherwise(0.0)

    gain = sum((entropy_part(F.col(f"c{i}"), df, size[i]) + entropy_part(F.lit(size[i]) - F.col(f"c{i}"), F.lit(all_docs) - df, size[i]) for i in range(len(domains))), F.lit(0.0))
    best = counts.where(df >= 3).withColumn("gain", gain).where("gain > 8").orderBy(F.desc("gain"), "word").limit(vocabulary).collect()
    rows = []
    for r in best:
        rate = [(r[f"c{i}"] + alpha) / (size[i] + 2 * alpha) for i in range(len(domains))]
        mean = sum(rate) / len(rate)
        rows.append((r["word"], *[math.log(p / mean) for p in rate]))
    priors = [math.log((have.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    base, sums = evidence_of(every.where("held").select("domain", "words"), "words", rows, len(domains))
    scored = base.select("domain", *[x.alias(f"s{i}") for i, x in enumerate(sums)]).collect()
    return calibrated(priors, rows, np.array([[r[f"s{i}"] for i in range(len(domains))] for r in scored]), np.array([domains.index(r["domain"]) for r in scored], int))


def calibrated(priors: list[float], rows: list[tuple], sums: np.ndarray, domain: np.ndarray, steps: int = 30) -> tuple[list[float], list[tuple]]:
    """Offsets and weights under which held-out documents (summed evidence, domain) are most likely.

    Softmax regression on the centred scores by Newton's method, with a ridge
    towards the scores as they are. It is linear, so it goes into the weights.
    """
    k = len(priors)
    centre = np.eye(k) - 1 / k
    start = np.vstack([np.zeros(k), np.eye(k)])
    way = start.copy()
    if len(domain):
        x = np.column_stack([np.ones(len(domain)), (np.array(priors) + sums) @ centre])
        wide = k * (k + 1)

        def loss(w: np.ndarray) -> float:
            z = x @ w
            top = z.max(axis=1)
            return float((top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - z[np.arange(len(z)), domain]).sum() + ((w - start) ** 2).sum() / 2)

        for _ in range(steps):
            z = x @ way
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            slope = x.T @ (p - np.eye(k)[domain]) + (way - start)
            curve = np.einsum("ni,nj,nab->aibj", x, x, p[:, :, None] * (np.eye(k) - p[:, None, :])).reshape(wide, wide) + np.eye(wide)
            move, part, now = np.linalg.solve(curve, slope.T.ravel()).reshape(k, k + 1).T, 1.0, loss(way)
            while part > 1e-4 and loss(way - part * move) > now:
                part /= 2
            way = way - part * move
            if np.abs(move).max() < 1e-6:
                break
    turn = centre @ way[1:]
    return (way[0] + np.array(priors) @ turn).tolist(), [(r[0], *(np.array(r[1:]) @ turn).tolist()) for r in rows]


def evidence_of(docs: DataFrame, words: str, model: list[tuple], k: int, evidence: float = 20.0) -> tuple[DataFrame, list[Column]]:
    """``docs`` with the vocabulary's words among their ``words``, and the evidence for each domain.

    More than ``evidence`` found words count as that many of their average,
    since neighbouring words are not independent.
    """
    slots = _slots(model)
    kept = [r for r in model if slots.get(_slot_key(r[0])) == r[0]]
    if not kept:
        return docs, [F.lit(0.0)] * k
    vocabulary = F.split(F.lit(" ".join(r[0] for r in kept)), " ")
    damp = F.lit(float(evidence)) / (F.lit(float(evidence)) + F.size("__found"))
    sums = []
    for i in range(k):
        weight = [0.0] * SLOTS
        for r in kept:
            weight[_slot_key(r[0])] = r[1 + i]
        table = F.split(F.lit(",".join(f"{w:.6g}" for w in weight)), ",").cast("array<double>")  # folded to one constant
        sums.append(_looked_up("__found", table) * damp)
    return docs.withColumn("__found", F.array_intersect(words, vocabulary)), sums


def posteriors(docs: DataFrame, domains: list[str], priors: list[float], model: list[tuple], *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``tokens`` and ``posterior`` (an array in the order of ``domains``).

    Row by row: the text's words are intersected with the vocabulary, and the
    weights of those found are summed.
    """
    names = [c for c in docs.columns if c not in ("tokens", "posterior", "rate", "copies", "miss")]
    base = docs.select(*[F.col(f"`{c}`") for c in names], words_of(F.col(f"`{text_col}`")).alias("__words"))
    base, sums = evidence_of(base, "__words", model, len(domains))
    scores = [F.lit(float(p)) + x for p, x in zip(priors, sums, strict=True)]
    scored = base.select(*[F.col(f"`{c}`") for c in names], F.size("__words").cast("bigint").alias("tokens"), F.array(*scores).alias("__scores"))
    top = F.array_max("__scores")
    raised = F.transform("__scores", lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return scored.select(*[F.col(f"`{c}`") for c in names], "tokens", F.transform(raised, lambda x: x / total).alias("posterior"))


def _looked_up(words: str, table: Column) -> Column:
    """Sum of the table's entries for the words."""
    slot = lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(SLOTS)).cast("int")
    return F.aggregate(words, F.lit(0.0), lambda s, w: s + F.get(table, slot(w)))


#: Entries in the constant-time word table; a word whose entry is taken by a better word is left out.
SLOTS = 16_411


def _slot_key(word: str) -> int:
    return zlib.crc32(word.encode("utf-8")) % SLOTS


def _slots(model: list[tuple]) -> dict[int, str]:
    taken: dict[int, str] = {}
    for r in model:
        taken.setdefault(_slot_key(r[0]), r[0])
    return taken


def fit_rates(mass: DataFrame, weights: list[float], *, budget: float | None = None, floor: float | Column = 0.0, rounds: int = 40, tolerance: float = 1e-6, passes: int = 400) -> tuple[list[list[float]], dict]:
    """The moves of the rates from 1, and a report.

    ``mass`` has (tokens, posterior). ``budget`` is the expected tokens wanted
    in all, by default those there are. With a ``floor`` on the rates (a number,
    or a column of a document's posterior, see ``at_least_once``) and no budget the total is left open, and each domain's total is fitted to its
    share of whatever the total becomes. The first ``rounds`` moves are plain
    projected-gradient steps unless the total is open; the next are scaled ones. The report's ``miss`` is the
    largest gap between totals got and wanted, as a share of all tokens: over
    ``tolerance`` only if no rates come nearer. A fit that has not ended after
    ``passes`` aggregations raises RuntimeError.
    """
    if not weights or min(weights) < 0 or not sum(weights) > 0:
        raise ValueError("weights must be nonnegative, with a positive sum")
    rates = _Rates(mass, len(weights), floor)
    try:
        return _fitted(rates, np.array(weights, float) / sum(weights), budget, budget is None and (isinstance(floor, Column) or floor > 0), rounds, tolerance, passes)
    finally:
        rates.discard()


#: Rates are stored anew after so many moves.
SETTLE = 8


class _Rates:
    """Documents and their rates after some moves.

    Every ``SETTLE`` moves the rates are stored, so that a pass folds no more
    moves than that over a document, however many came before.
    """

    def __init__(self, mass: DataFrame, k: int, floor: float | Column):
        self.at, self.k, self.floor, self.moves = mass.select("tokens", "posterior"), k, floor, 0
        self.domain = [F.col("posterior")[i] for i in range(k)]
        self.pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def after(self, steps: list[list[float]]) -> Column:
        """The rate after ``steps``, of which the first ``moves`` are in the stored one."""
        return rate_of(steps[self.moves :], self.floor, F.col("__rate") if self.moves else None)

    def measured(self, steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray, float]:
        """Totals, their curvature along the last move and half its squared length, token-weighted."""
        at = self.at.withColumn("__from", self.after(steps[:-1])).withColumn("__to", rate_of(steps[-1:], self.floor, F.col("__from")))
        least = self.floor if isinstance(self.floor, Column) else F.lit(float(self.floor))
        free = F.when(F.col("__to") > least, F.col("tokens")).otherwise(0.0) if steps else F.col("tokens")  # at first any rate may rise
        sums = [F.col("tokens") * F.col("__to") * p for p in self.domain] + [free * self.domain[i] * self.domain[j] for i, j in self.pairs]
        sums.append(F.col("tokens") * (F.col("__to") - F.col("__from")) * (F.col("__to") - F.col("__from")) / 2)
        row = [float(v or 0.0) for v in at.agg(*[F.sum(c).alias(f"t{i}") for i, c in enumerate(sums)]).first()]
        curve = np.zeros((self.k, self.k))
        for (i, j), v in zip(self.pairs, row[self.k : -1], strict=True):
            curve[i, j] = curve[j, i] = v
        return np.array(row[: self.k]), curve, row[-1]

    def settle(self, steps: list[list[float]]) -> None:
        """Moves are made and will not be taken back."""
        if len(steps) - self.moves >= SETTLE:
            now = stored(self.at.select("tokens", "posterior", self.after(steps).alias("__rate")))
            self.discard()
            self.at, self.moves = now, len(steps)

    def discard(self) -> None:
        if self.moves:
            discard(self.at)


def _fitted(rates: _Rates, goal: np.ndarray, budget: float | None, open_total: bool, rounds: int, tolerance: float, passes: int) -> tuple[list[list[float]], dict]:
    """See ``fit_rates``; ``goal`` sums to 1."""
    k, measured = goal.size, rates.measured
    got, curve, moved = measured([])
    have, all_tokens = got.tolist(), got.sum()
    if not all_tokens:
        return [], {"have": have, "want": [0.0] * k, "got": have, "miss": 0.0}
    share = np.maximum(got / all_tokens, 1e-12)
    # the gaps are ``gap @ totals - aim``
    gap = np.eye(k) - (goal[:, None] if open_total else 0.0)
    aim = np.zeros(k) if open_total else goal * (budget or all_tokens) / all_tokens
    steps: list[list[float]] = []
    used = 1

    def report() -> dict:
        want = goal * got.sum() if open_total else aim * all_tokens
        return {"have": have, "want": want.tolist(), "got": got.tolist(), "miss": float(np.abs(miss).max())}

    while True:
        miss = gap @ got / all_tokens - aim
        if np.abs(miss).max() <= tolerance:
            return steps, report()
        if open_total or len(steps) >= rounds:
            break
        rates.settle(steps)
        steps.append((miss / share).tolist())
        got, curve, moved = measured(steps)
        used += 1

    while np.abs(miss).max() > tolerance and used < passes:
        rates.settle(steps)
        push = gap.T @ np.linalg.lstsq(gap @ curve @ gap.T / all_tokens, miss, rcond=1e-9)[0]
        for part in (1.0, 0.3, 0.1):
            tried = measured([*steps, (part * push).tolist()])
            used += 1
            left = gap @ tried[0] / all_tokens - aim
            if (left * left / share).sum() <= (miss * miss / share).sum() / 2:
                break
        else:
            break  # no shorter step helps: the dual decides
        steps.append((part * push).tolist())
        (got, curve, moved), miss = tried, left

    while np.abs(miss).max() > tolerance:
        # least squares and moved / PULL at once: max over y of the dual, which is concave; its gradient is ``slope``
        rates.settle(steps)
        y = np.zeros(k)
        got, curve, moved = measured([*steps, [0.0] * k])
        used += 1
        value, slope = 0.0, miss
        while np.abs(slope).max() > tolerance / 10:
            way = np.linalg.solve(gap @ curve @ gap.T / all_tokens + np.diag(share / PULL), slope)
            part = 1.0
            while True:
                if used >= passes:
                    raise RuntimeError(f"rates not fitted after {used} passes: gaps are {miss.tolist()}")
                tried = y + part * way
                got, curve, moved = measured([*steps, (gap.T @ tried).tolist()])
                used += 1
                miss = gap @ got / all_tokens - aim
                now = moved / all_tokens + tried @ miss - (share * tried * tried).sum() / (2 * PULL)
                if now >= value + 1e-4 * part * (slope @ way) - 1e-12 * max(1.0, abs(value)):
                    break
                part /= 4
            y, value, slope = tried, now, miss - share * tried / PULL
        steps.append((gap.T @ y).tolist())
        if math.sqrt(2 * moved / all_tokens) <= PULL * tolerance / 100:
            break  # no gradient left: nothing comes nearer
    return steps, report()


#: How far a proximal step goes: its length counts 1/PULL as much as the gaps.
PULL = 1e4


def rate_of(steps: list[list[float]], floor: float | Column = 0.0, start: Column | None = None) -> Column:
    """A document's rate: from ``start`` (1), each step moves it against its gradient and projects it to ``floor`` or more."""
    start = F.lit(1.0) if start is None else start
    if not steps:
        return start
    k = len(steps[0])
    least = floor if isinstance(floor, Column) else F.lit(float(floor))
    history = F.split(F.lit(",".join(repr(x) for g in steps for x in g)), ",").cast("array<double>")


    def step(x: Column, i: Column) -> Column:
        push = [F.get(history, i * k + j) * F.col("posterior")[j] for j in range(k)]
        return F.greatest(least, x - sum(push[1:], push[0]))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), start, step)


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text", floor: float | Column = 0.0, budget: float | None = None, labelled_rows: int = 4000, vocabulary: int = 1000, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with tokens, posterior, rate, copies and miss.

    ``copies`` rounds the rate to a whole number, up with the probability of
    its fraction, drawn from a hash of the id and the text's length: its expectation is the rate.
    Weights that no rates match give the nearest rates and a warning; ``miss``,
    the same in all rows, is the report's (see ``fit_rates``).
    """
    names = sorted(weights)
    priors, model = learn(docs, labelled, names, id_col=id_col, text_col=text_col, labelled_rows=labelled_rows, vocabulary=vocabulary)
    draw = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.length(F.col(f"`{text_col}`")), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    carried = [c for c in (docs.columns if keep is None else keep) if c not in ("tokens", "posterior", "rate", "copies", "miss")]
    # texts are scored once; the steps then read the two columns they need
    scored = posteriors(docs.withColumn("__draw", draw), names, priors, model, text_col=text_col)
    scored = stored(scored.select(*[F.col(f"`{c}`") for c in carried], "__draw", "tokens", "posterior"))
    steps, report = fit_rates(scored.select("tokens", "posterior"), [weights[n] for n in names], budget=budget, floor=floor)
    if report["miss"] > 1e-6:
        warnings.warn(f"no rates match the weights: tokens wanted {dict(zip(names, report['want'], strict=True))}, got {dict(zip(names, report['got'], strict=True))}", stacklevel=2)
    mixed = scored.withColumn("rate", rate_of(steps, floor))
    return mixed.withColumn("copies", F.floor(F.col("rate") + F.col("__draw")).cast("bigint")).drop("__draw").withColumn("miss", F.lit(report["miss"]))


def at_least_once(domains: list[str], which: list[str]) -> Column:
    """A floor of 1 for documents whose most probable domain is one of ``which``, else 0."""
    best = F.array_position("posterior", F.array_max("posterior"))
    return F.when(best.isin([sorted(domains).index(d) + 1 for d in which]), 1.0).otherwise(0.0)


def realise(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as many times as its ``copies`` say."""
    times = F.explode(F.expr("CASE WHEN copies > 0 THEN sequence(1L, copies) ELSE array() END"))
    return mixed.withColumn("__copy", times).select(*[F.col(f"`{c}`") for c in columns])


def domains_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, quality, toxic) as (id, domain): toxic, good or low; null labels have none."""
    domain = F.when(F.col("toxic") == 1, "toxic").when((F.col("toxic") == 0) & (F.col("quality") == 1), "good").when((F.col("toxic") == 0) & (F.col("quality") == 0), "low")
    return labels.select(F.col(f"`{id_col}`"), domain.alias("domain")).where("domain is not null")

"""Model providers: what they must answer, checks of their answers, retries, offline defaults."""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

# Attempts and pauses, bounds of answers.
PAUSES = (0.5, 1.0, 2.0)
MAX_FACETS, MAX_SENTENCES, MAX_CITED = 8, 12, 8


class Retryable(Exception):
    """A failure that another attempt may mend (time-outs, 408, 409, 429, 5xx)."""


class Invalid(Exception):
    """An answer that breaks its contract."""


def with_retries(call: Callable, pauses: tuple[float, ...] = PAUSES, sleep: Callable[[float], None] = time.sleep, log: list | None = None, concern: str = ""):
    """``call`` with up to len(pauses) + 1 attempts; every attempt is logged."""

    def run(*args):
        for n in range(len(pauses) + 1):
            began = time.monotonic()
            outcome = "success"
            try:
                return call(*args)
            except Retryable:
                outcome = "final_failure" if n == len(pauses) else "retryable_failure"
                if n == len(pauses):
                    raise
            except Exception:
                outcome = "final_failure"
                raise
            finally:
                if log is not None:
                    log.append({"concern": concern, "attempt_number": n + 1, "outcome": outcome, "elapsed_ms": round(1000 * (time.monotonic() - began), 3)})
            sleep(pauses[n])

    return run


def schema_of(shape: object) -> dict:
    """The strict JSON schema of a shape: a dict of fields, a list of one shape, or ``str`` or ``bool``."""
    if isinstance(shape, dict):
        return {"type": "object", "properties": {k: schema_of(v) for k, v in shape.items()}, "required": list(shape), "additionalProperties": False}
    if isinstance(shape, list):
        return {"type": "array", "items": schema_of(shape[0])}
    return {"type": {str: "string", bool: "boolean"}[shape]}


def mismatch(value: object, shape: object, at: str = "answer") -> str | None:
    """Where a parsed answer departs from its shape; None if nowhere."""
    if isinstance(shape, dict):
        if not isinstance(value, dict) or set(value) != set(shape):
            return f"{at} must be an object of exactly {', '.join(shape)}"
        inner = [(value[k], s, f"{at}.{k}") for k, s in shape.items()]
    elif isinstance(shape, list):
        if not isinstance(value, list):
            return f"{at} must be a list"
        inner = [(v, shape[0], f"{at}[{i}]") for i, v in enumerate(value)]
    else:
        return None if type(value) is shape else f"{at} must be of type {schema_of(shape)['type']}"
    return next((m for v, s, where in inner if (m := mismatch(v, s, where))), None)


#: What each concern answers (fixed values: field names of the answers).
SHAPES = {
    "facets": {"facets": [{"id": str, "text": str}]},
    "draft": {"sentences": [{"id": str, "text": str, "chunk_ids": [str]}]},
    "decompose": {"sub_claims": [{"text": str}]},
    "entail": {"supported": bool, "reason": str},
    "coverage": {"rows": [{"facet_id": str, "covered": bool, "reason": str, "sentence_ids": [str]}]},
}


def structured(ask: Callable[[dict, str | None], str | None], concern: str, check: Callable = lambda value: value, pauses: tuple[float, ...] = PAUSES, log: list | None = None):
    """The checked answer of a model that is asked with a JSON schema.

    ``ask`` takes the schema and the problem of the answer before (None at
    first) and gives text. An answer that is no JSON object, not of the shape,
    or refused by ``check`` (which raises ``Invalid``) is asked for once more.
    """
    problem = None
    for _ in range(2):
        text = with_retries(ask, pauses, log=log, concern=concern)(schema_of(SHAPES[concern]), problem)
        try:
            value = json.loads(text or "")
        except ValueError:
            problem = "answer is not JSON"
            continue
        problem = mismatch(value, SHAPES[concern])
        if problem is None:
            try:
                return check(value)
            except Invalid as e:
                problem = str(e)
    raise Invalid(f"{concern}: {problem}")


def tokens(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]


def hash_embedding(texts: list[str], dimensions: int = 64) -> list[list[float]]:
    """A unit vector of hashed token counts; the same text always gives the same vector."""
    out = []
    for t in texts:
        v = [0.0] * dimensions
        for w in tokens(t) or [""]:
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            v[int.from_bytes(h[:4], "big") % dimensions] += 1.0 if h[4] & 1 else -1.0
        size = math.sqrt(sum(x * x for x in v))
        out.append([x / size for x in v] if size else [1.0, *v[1:]])
    return out


def one_facet(question: str) -> list[str]:
    return [question.strip()]


def extract_answer(question: str, evidence: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """Of each chunk the sentence that shares most words with the question, word for word."""
    asked, out = set(tokens(question)), []
    for chunk_id, text in evidence[:MAX_SENTENCES]:
        best = max(sentences(text), key=lambda s: (len(asked & set(tokens(s))), -len(s)), default="")
        if asked & set(tokens(best)):
            out.append((best, [chunk_id]))
    return out


def split_sentence(sentence: str) -> list[str]:
    return sentences(sentence)


def entailed(claim: str, evidence: list[str]) -> bool:
    flat = " ".join(claim.split()).casefold()
    return any(flat in " ".join(e.split()).casefold() for e in evidence)


def covered_by(question: str, facets: list[tuple[str, str]], said: list[tuple[str, str]]) -> list[dict]:
    """A row for each facet: the sentences that share a longer word with it."""
    rows = []
    for facet_id, facet in facets:
        named = [i for i, s in said if covers(facet, [s])]
        rows.append({"facet_id": facet_id, "covered": bool(named), "reason": "shares a word" if named else "shares no word", "sentence_ids": named})
    return rows


def covers(facet: str, said: list[str]) -> bool:
    asked = {w for w in tokens(facet) if len(w) > 3}
    return any(asked & set(tokens(s)) for s in said)


@dataclass(frozen=True)
class Providers:
    """The callables that stages use; the defaults need no network."""

    embed: Callable[[list[str]], list[list[float]]] = hash_embedding
    facets: Callable[[str], list[str]] = one_facet
    answer: Callable[[str, list[tuple[str, str]]], list[tuple[str, list[str]]]] = extract_answer
    decompose: Callable[[str], list[str]] = split_sentence
    entail: Callable[[str, list[str]], bool] = entailed
    coverage: Callable[[str, list[tuple[str, str]], list[tuple[str, str]]], list[dict]] = covered_by
    model: str = "hash-64"
    dimensions: int = 64
    encoding: str = "words-and-marks"
    #: A byte-pair vocabulary file and its pattern, by which chunks are counted and packed; name it in ``encoding``.
    vocabulary: tuple[str, str] | None = None
    pauses: tuple[float, ...] = field(default=PAUSES)
    #: Calls that one task has under way at once.
    at_once: int = 4

    def checked_facets(self, question: str) -> list[str]:
        out = [f.strip() for f in with_retries(self.facets, self.pauses)(question)]
        if not 1 <= len(out) <= MAX_FACETS or len(set(out)) < len(out) or "" in out:
            raise Invalid("a question has 1 to 8 different facets")
        return out

    def checked_answer(self, question: str, evidence: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
        out, known = with_retries(self.answer, self.pauses)(question, evidence), {c for c, _ in evidence}
        if len(out) > MAX_SENTENCES or any(not s.strip() or not 1 <= len(cited) <= MAX_CITED or set(cited) - known for s, cited in out):
            raise Invalid("an answer has at most 12 sentences, each citing 1 to 8 known chunks")
        return out

    def checked_decomposition(self, sentence: str) -> list[str]:
        """Sub-claims, trimmed; any number (the verdict judges it), none of them blank."""
        out = [c.strip() for c in with_retries(self.decompose, self.pauses)(sentence)]
        if "" in out:
            raise Invalid("a sub-claim is blank")
        return out

    def checked_entailment(self, claim: str, evidence: list[str]) -> bool:
        return with_retries(self.entail, self.pauses)(claim, evidence)

    def checked_coverage(self, question: str, facets: list[tuple[str, str]], said: list[tuple[str, str]]) -> list[dict]:
        """One row for each facet, in order; a covered one names sentences, in order, another none."""
        rows, place = with_retries(self.coverage, self.pauses)(question, facets, said), {i: n for n, (i, _) in enumerate(said)}
        if [r["facet_id"] for r in rows] != [i for i, _ in facets]:
            raise Invalid("coverage has one row for each facet, in their order")
        for r in rows:
            named = r["sentence_ids"]
            if not r["reason"].strip() or set(named) - set(place) or [place[i] for i in named] != sorted({place[i] for i in named}) or bool(named) != r["covered"]:
                raise Invalid(f"coverage of {r['facet_id']} needs a reason, and sentences if and only if it is covered")
        return rows

    def checked_embedding(self, texts: list[str]) -> list[list[float]]:
        out = with_retries(self.embed, self.pauses)(texts)
        if len(out) != len(texts) or any(len(v) != self.dimensions or not all(map(math.isfinite, v)) for v in out):
            raise Invalid("an embedding has one finite vector of the stated size for each text")
        return out


def in_order(call: Callable, rows: Iterable[tuple], at_once: int) -> Iterator:
    """What ``call`` says of each row, in their order, with ``at_once`` calls under way at most."""
    if at_once < 2:
        yield from (call(*row) for row in rows)
        return
    with ThreadPoolExecutor(at_once) as pool:
        waiting: deque = deque()
        for row in rows:
            waiting.append(pool.submit(call, *row))
            if len(waiting) == at_once:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def model_providers(ask: Callable[[str, dict, dict, str | None], str | None], **options) -> Providers:
    """Providers that put every question to one model, as structured calls.

    ``ask`` takes the concern, what it is about, the JSON schema of the answer
    and, after an answer that broke the contract, what was wrong with it; it
    gives text and raises ``Retryable`` for failures that may pass.
    ``options`` are those of ``Providers``.
    """

    def call(concern: str, payload: dict, check: Callable):
        return structured(lambda schema, problem: ask(concern, payload, schema, problem), concern, check, pauses=())

    def distinct(rows: list[dict], key: str, what: str) -> list[dict]:
        if len({r[key] for r in rows}) < len(rows) or not all(r[key].strip() for r in rows):
            raise Invalid(f"{what} need different {key}s")
        return rows

    def facets(question: str) -> list[str]:
        def check(value: dict) -> list[str]:
            rows = distinct(value["facets"], "id", "facets")
            if not 1 <= len(rows) <= MAX_FACETS:
                raise Invalid(f"a question has 1 to {MAX_FACETS} facets")
            return [r["text"] for r in distinct(rows, "text", "facets")]

        return call("facets", {"question": question}, check)

    def answer(question: str, evidence: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
        known = {chunk_id for chunk_id, _ in evidence}

        def check(value: dict) -> list[tuple[str, list[str]]]:
            rows = distinct(value["sentences"], "id", "sentences")
            if len(rows) > MAX_SENTENCES:
                raise Invalid(f"an answer has at most {MAX_SENTENCES} sentences")
            for r in rows:
                if not r["text"].strip() or not 1 <= len(r["chunk_ids"]) <= MAX_CITED or set(r["chunk_ids"]) - known:
                    raise Invalid(f"sentence {r['id']} needs a text and 1 to {MAX_CITED} known chunks")
            return [(r["text"], r["chunk_ids"]) for r in rows]

        return call("draft", {"question": question, "evidence": [{"chunk_id": c, "text": t} for c, t in evidence]}, check)

    def decompose(sentence: str) -> list[str]:
        return call("decompose", {"sentence": sentence}, lambda value: [r["text"] for r in value["sub_claims"]])

    def entail(claim: str, evidence: list[str]) -> bool:
        return call("entail", {"claim": claim, "evidence": evidence}, lambda value: value["supported"])

    def coverage(question: str, named: list[tuple[str, str]], said: list[tuple[str, str]]) -> list[dict]:
        def check(value: dict) -> list[dict]:
            if [r["facet_id"] for r in value["rows"]] != [i for i, _ in named]:
                raise Invalid("coverage has one row for each facet, in their order")
            return value["rows"]

        return call("coverage", {"question": question, "facets": [{"id": i, "text": t} for i, t in named], "sentences": [{"id": i, "text": t} for i, t in said]}, check)

    return Providers(facets=facets, answer=answer, decompose=decompose, entail=entail, coverage=coverage, **options)

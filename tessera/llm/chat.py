"""Chat formatting from an event log.

A conversation is a log of events. The log is partitioned by conversation and
sorted by sequence number; one pass folds streamed deltas, edits and
regenerations into the final messages and renders them. A task holds one
conversation at a time, however many share its partition.

Events (conv_id, seq, kind, message_id, role, text), kinds:

``message``     a whole message; a repeated id replaces its role and text
``delta``       text appended to the message (begun if it is new)
``edit``        the message's text replaced; begun if it is new
``regenerate``  the message is emptied and all after it are dropped; its text
                follows as deltas
``delete``      the message is dropped

A null kind is ``message``, a null message_id a message of its own, null role
or text is empty, null conv_id is a conversation of its own. Events with equal
seq are ordered by kind, message_id, role and text. Unknown kinds raise an
error. Extra columns are ignored; an empty log gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import bare

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("message", "delta", "edit", "regenerate", "delete")


def escape(text: str) -> str:
    r"""Break every control string: ``<|`` becomes ``<\|``, ``<\|`` becomes ``<\\|``, ..."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role is one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Fold:
    """The messages of one conversation, as of the last event applied."""

    def __init__(self) -> None:
        self.messages: dict[object, list] = {}  # id -> [role, list of text parts], in order of appearance
        self.loose = 0

    def apply(self, kind: str | None, key: object, role: str | None, text: str | None) -> None:
        kind, text = kind or "message", text or ""
        if kind not in KINDS:
            raise ValueError(f"unknown event kind: {kind}")
        if key is None:
            self.loose += 1
            key = ("loose", self.loose)
        if kind == "delete":
            self.messages.pop(key, None)
            return
        known = self.messages.setdefault(key, [role or "", []])
        if role is not None:
            known[0] = role
        if kind == "delta":
            known[1].append(text)
        elif kind == "regenerate":
            ids = list(self.messages)
            for later in ids[ids.index(key) + 1 :]:
                del self.messages[later]
            known[1] = [text]
        else:
            known[1] = [text]

    def final(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts in self.messages.values()]


def render(messages: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans (code points, end exclusive) under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted text; exact inverse of ``render``."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        if not formatted.startswith(START, at):
            raise ValueError("not a formatted conversation")
        out.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return out


def format_chats(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans."""
    log = bare(events, "conv_id", "seq", "kind", "message_id", "role", "text")
    kind = log.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, fold, done, held = None, None, [], 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        def close() -> int:
            text, spans = render(fold.final(), learn)
            done.append((here[0], text, [{"start": a, "end": b} for a, b in spans]))
            return len(text)

        for b in batches:
            for conv, *event in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if here is None or here[0] != conv:
                    if here is not None:
                        held += close()
                        if held > 4_000_000:
                            yield flush()
                            done, held = [], 0
                    here, fold = (conv,), Fold()
                fold.apply(*event)
        if here is not None:
            close()
        yield flush()

    ordered = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind", "message_id", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind.simpleString()}, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def digest(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as counts and digests."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(text)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def from_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log of whole messages."""
    return bare(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("message_id"), "role", "text"
    )

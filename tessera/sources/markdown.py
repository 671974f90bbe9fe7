"""Specification folders in Markdown, adapted to decision records.

A text is read once into classified lines; sections, labels, bullets and
options are views of them. Folders are parsed next to their files by executors;
mentions of code paths are resolved by a join with the corpus listing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.digest import fingerprint
from tessera.schemas import FIELD_SOURCES, RECORD, B, S, array, struct
from tessera.sources.frontmatter import decode

VERSION = "1"
# What the spec format calls its states, and the endings that make a word a path.
STATUS = {"Accepted": "accepted", "Proposed": "proposed", "Done": "accepted", "In Progress": "proposed"}
ENDINGS = (".md", ".py", ".json", ".ts", ".tsx", ".js", ".jsx", ".toml", ".yaml", ".yml", ".txt", ".lock", ".cfg", ".ini", ".sh")
MAPPED = ("Context", "Decision", "Options considered", "Rationale", "Consequences")
POINTERS = ("see", "read", "refer", "point to", "look at")
STUB_LENGTH = 80


@dataclass
class Line:
    """A line and what it is: fenced, heading (level, text), label (name, value), bullet (text) or plain."""

    raw: str
    fenced: bool = False
    level: int = 0
    heading: str = ""
    label: str | None = None
    value: str = ""
    bullet: str | None = None
    lead: bool = False  # the label opens the line, without a list mark


def read_lines(text: str) -> list[Line]:
    lines = [Line(raw) for raw in text.split("\n")]
    opened: tuple[int, str] | None = None
    for i, line in enumerate(lines):  # only fences that close cover anything
        if m := re.match(r"\s*(`{3,}|~{3,})", line.raw):
            if opened is None:
                opened = (i, m[1])
            elif m[1][0] == opened[1][0] and len(m[1]) >= len(opened[1]):
                for inside in lines[opened[0] : i + 1]:
                    inside.fenced = True
                opened = None
    for line in lines:
        bare = line.raw.strip()
        if not line.fenced and (m := re.match(r"(#{1,6})\s+(.*)$", line.raw)):
            line.level, line.heading = len(m[1]), m[2].strip()
        if m := re.match(r"(?:[-*]\s+)?\*\*([^*]+?)\*\*\s*[:：]?\s*(.*)$", bare):
            line.label, line.value, line.lead = m[1].strip(), m[2].strip(), bare.startswith("**")
        if m := re.match(r"[-*]\s+(.+)$", bare):
            line.bullet = m[1].strip()
    return lines


def text_of(lines: list[Line]) -> str:
    return "\n".join(x.raw for x in lines).strip("\n")


def split_at(lines: list[Line], levels: tuple[int, ...]) -> list[tuple[Line, list[Line]]]:
    """(heading line, lines below it) for the headings of some levels; what precedes the first is left out."""
    starts = [i for i, x in enumerate(lines) if x.level in levels]
    return [(lines[a], lines[a + 1 : b]) for a, b in zip(starts, [*starts[1:], len(lines)], strict=False)]


def sections(lines: list[Line]) -> dict[str, list[Line]]:
    """Lines by second-level heading, in order; a repeated heading continues the first."""
    out: dict[str, list[Line]] = {}
    for head, below in split_at(lines, (1, 2)):
        if head.level == 2:
            if head.heading in out:
                out[head.heading] = read_lines(text_of(out[head.heading]) + "\n\n" + text_of(below))
            else:
                out[head.heading] = below
    return out


def preamble(lines: list[Line]) -> list[Line]:
    end = next((i for i, x in enumerate(lines) if re.match(r"#{2,6}\s", x.raw)), len(lines))
    return lines[:end]


def field(lines: list[Line], name: str) -> str | None:
    """The value of the first ``**name**`` line."""
    return next((x.value or None for x in lines if x.label == name), None)


def h2_headings(text: str) -> set[str]:
    """The distinct second-level headings outside closed fences, without a closing run of ``#``."""
    out = set()
    for x in read_lines(text):
        if not x.fenced and (m := re.match(r"##(?:[ \t]+(.*))$", x.raw)):
            out.add(re.sub(r"(?:^|(?<=[ \t]))(?<!\\)#+$", "", m[1].rstrip(" \t")).strip(" \t"))
    return out


def is_pointer(lines: list[Line], siblings: tuple[str, ...] = ("index.md", "rationale.md")) -> bool:
    """A short section that only points at a sibling file."""
    flat = " ".join(re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text_of(lines)).split()).lower().replace("`", "")
    if len(flat) > STUB_LENGTH:
        return False
    trim = lambda t: t.strip(" .,;:!?")
    return any(trim(flat) == name or name in flat and trim(flat.replace(name, "", 1)).startswith(POINTERS) for name in siblings)


def names_label(label: str | None, name: str) -> bool:
    """``Negative / tradeoffs`` names Negative, ``Negatively`` does not."""
    return label is not None and re.match(rf"{name}(?![^\W_])", label.strip(), re.I) is not None


@dataclass
class Option:
    key: str
    title: str
    line: str
    cons: str | None


def options_of(lines: list[Line]) -> list[Option]:
    """Options as bold ``**Option N`` lines, or else as third-level headings."""
    mark = re.compile(r"\*\*Option\s+([A-Za-z0-9]+)\s*[:—-]\s*(.*)$")
    starts = [i for i, x in enumerate(lines) if mark.match(x.raw)]
    out = []
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=False):
        end = next((i for i in range(a + 1, b) if lines[i].level), b)
        key, rest = mark.match(lines[a].raw).groups()
        title = rest.removeprefix("**").partition("**")[0]
        out.append(Option(key, clean_title(title), lines[a].raw, cons_of(lines[a + 1 : end])))
    if not out:
        for head, below in split_at(lines, (3,)):
            if m := re.match(r"Option\s+([A-Za-z0-9]+)(?:\s*[:：—-]\s*)?(.*)$", head.heading):
                out.append(Option(m[1], clean_title(m[2]), head.heading, cons_of(below)))
    return out


def clean_title(text: str) -> str:
    return re.sub(r"\s*\((?:chosen|recommended)\)\s*$", "", text.strip()).strip()


def cons_of(lines: list[Line]) -> str | None:
    """The text after ``**Cons**`` up to the next label or heading."""
    at = next((i for i, x in enumerate(lines) if x.label == "Cons"), None)
    if at is None:
        return None
    parts = [lines[at].value] if lines[at].value else []
    for x in lines[at + 1 :]:
        if not x.fenced and (x.label is not None or x.level):
            break
        parts.append(x.raw if x.fenced else x.bullet if x.bullet is not None else x.raw.strip())
    return "\n".join(parts).strip() or None


def comparable(text: str) -> str:
    """Lower case, without trailing parentheses and marks."""
    before = None
    while before != text:
        before, text = text, re.sub(r"(?:\([^)]*\)|[.,;:!?]+)\s*$", "", text.strip())
    return text.lower()


def alternatives(lines: list[Line] | None, chosen: str) -> tuple[list[dict], bool]:
    """The options that lost, over all units, and whether some unit has no clear winner."""
    if lines is None:
        return [], True
    panels = [(h.heading, below) for h, below in split_at(lines, (3,)) if h.heading.startswith("Panel")]
    lost, unclear = [], False
    for heading, unit in panels or [("", lines)]:
        found = options_of(unit)
        winner = pick(heading, unit, found, chosen)
        if winner is None:
            unclear = True
            continue
        asked = None
        if heading:
            m = re.match(r"Panel\s+\w+\s*[:：—-]\s*(.+)$", heading)
            asked = field(unit, "Question") or (m[1].strip() if m else None)
        lost += [{"title": f"{asked}: {o.title}" if asked else o.title, "rejection_reason": o.cons} for o in found if o is not winner]
    return lost, unclear


def pick(heading: str, unit: list[Line], found: list[Option], chosen: str) -> Option | None:
    """The winner: the panel's letter, the number in the chosen line, its title, the one mark ``(chosen)``."""
    letter = re.search(r"\bOption\s+([A-Za-z])\b", field(unit, "Decision") or "") if heading else None
    number = re.search(r"\bOption\s+(\d+)\b", chosen)
    wanted = comparable(chosen)
    marked = [o for o in found if "(chosen)" in o.line]
    tests = [
        lambda o: letter is not None and o.key == letter[1],
        lambda o: number is not None and o.key == number[1],
        lambda o: wanted != "" and comparable(o.title) == wanted,
        lambda o: len(marked) == 1 and o is marked[0],
    ]
    return next((o for test in tests for o in found if test(o)), None)


def mentions(text: str) -> list[tuple[str, bool]]:
    """(path, shaped) of the words in inline code that may name a file; ``shaped`` ones count if they don't."""
    prose = "\n".join("" if x.fenced else x.raw for x in read_lines(text))
    runs, out, at = list(re.finditer("`+", prose)), [], 0
    while at < len(runs):
        close = next((j for j in range(at + 1, len(runs)) if len(runs[j][0]) == len(runs[at][0])), None)
        if close is None:
            at += 1
            continue
        for word in prose[runs[at].end() : runs[close].start()].split():
            word = re.sub(r":\d+$", "", word)
            target = word.removesuffix("/")
            if target and not target.startswith(("/", "@")) and "*" not in target:
                shaped = "/" in word or word.startswith(".") or word.lower().endswith(ENDINGS)
                out.append(("/".join(p for p in target.removeprefix("./").split("/") if p), shaped))
        at = close + 1
    return out


def residue(body: list[Line]) -> str:
    """What of Consequences neither Positive nor Negative takes."""
    parts, group, taken = [], [], False

    def close() -> None:
        kept = [x.raw for x in group if not (taken and (x.bullet is not None or x.label is not None))]
        if text := "\n".join(kept).strip():
            parts.append(text)

    for x in body:
        if x.lead:
            close()
            group, taken = [], names_label(x.label, "Positive") or names_label(x.label, "Negative")
        group.append(x)
    close()
    return "\n\n".join(parts)


def under_label(body: list[Line], name: str) -> list[str]:
    items, inside = [], False
    for x in body:
        if x.lead and names_label(x.label, name):
            inside = True
            items += [x.value] if x.value else []
        elif inside and x.lead:
            break
        elif inside and x.bullet is not None:
            items.append(x.bullet)
    return items


def parse_spec(spec_id: str, folder: str, index: str, rationale: str | None) -> dict:
    """One folder's record without evidence that needs the corpus: record, sources, attempted, mentions."""
    home, more = f"{folder}/index.md", f"{folder}/rationale.md"
    lines = read_lines(index)
    main, side = sections(lines), sections(read_lines(rationale)) if rationale is not None else {}
    top, attempted = preamble(lines), set()
    sources: dict[str, list[dict]] = {}
    siblings = ("index.md", "rationale.md") if rationale is not None else ("index.md",)

    def found(name: str) -> tuple[list[Line], str] | None:
        for own, path in ((side, more), (main, home)):
            body = own.get(name)
            if body is not None and text_of(body).strip() and not is_pointer(body, siblings):
                return body, path
        return None

    def note(path: str, file: str, section: str) -> None:
        sources[path] = [{"path": file, "section": section}]

    context, rationale_section = found("Context"), found("Rationale")
    if context:
        note("context.problem", context[1], "Context")
    else:
        attempted.add("context.problem")
    chosen = field(main["Decision"], "Chosen option") if "Decision" in main else None
    if chosen is None:
        attempted.add("decision.chosen")
    else:
        note("decision.chosen", home, "Decision")
    options = found("Options considered")
    lost, unclear = alternatives(options[0] if options else None, chosen or "")
    if unclear:
        attempted.add("decision.alternatives")
    for i, a in enumerate(lost):
        for leaf in ("title", "rejection_reason"):
            if a[leaf] is not None:
                note(f"decision.alternatives[{i}].{leaf}", options[1], "Options considered")
    why, summary = [], None
    if rationale_section:
        why = [x.bullet for x in rationale_section[0] if x.bullet is not None]
        summary = " ".join(" ".join(x.raw for x in rationale_section[0] if x.bullet is None).split()) or None
        for i in range(len(why)):
            note(f"why[{i}]", rationale_section[1], "Rationale")
        if summary:
            note("rationale_summary", rationale_section[1], "Rationale")
    else:
        attempted |= {"why", "rationale_summary"}
    title = next((re.sub(r"^\d+\.\s*", "", x.heading) for x in lines if x.level == 1), None)
    if title is None:
        attempted.add("title")
    else:
        note("title", home, "preamble")
    effects = main.get("Consequences")
    usable = effects is not None and text_of(effects).strip() and not is_pointer(effects, siblings)
    good, bad = (under_label(effects, "Positive"), under_label(effects, "Negative")) if usable else ([], [])
    mapped = set(MAPPED)
    if not good and not bad:
        attempted |= {"consequences.positive", "consequences.negative"}
        if usable:
            mapped.discard("Consequences")
    for name, items in (("positive", good), ("negative", bad)):
        for i in range(len(items)):
            note(f"consequences.{name}[{i}]", home, "Consequences")
    kept: list[tuple[str, str]] = []
    parts = []
    for name in dict.fromkeys([*main, *side]):
        if name not in mapped and (there := found(name)):
            parts.append(f"## {name}\n\n{text_of(there[0])}")
            kept.append((name, there[1]))
    rest = residue(effects) if good or bad else ""
    for i, (name, path) in enumerate(kept):
        note(f"body[{i}]", path, name)
    if rest:
        parts.append(rest)
        if kept:
            sources[f"body[{len(kept) - 1}]"].append({"path": home, "section": "Consequences"})
        else:
            note("body[0]", home, "Consequences")
    supersedes = field(top, "Supersedes")
    if supersedes is not None:
        note("supersedes", home, "preamble")
    state = field(top, "Status")
    record = {
        "id": spec_id, "title": title, "status": STATUS.get(state), "date": field(top, "Date"), "body": "\n\n".join(parts),
        "context": {"problem": text_of(context[0]), "triggering_change": None} if context else None,
        "decision": {"chosen": chosen, "alternatives": lost}, "why": why, "rationale_summary": summary,
        "consequences": {"positive": good, "negative": bad} if good or bad else None, "evidence": [], "tags": [f"source-status:{state}"], "supersedes": supersedes,
    }
    named = [m for text in (index, rationale) if text is not None for m in mentions(text)]
    return {"record": record, "field_sources": sources, "attempted_fields": sorted(attempted), "mentions": [{"path": p, "shaped": s} for p, s in named]}


FOLDER = struct(folder=S, record_id=S, skip_reason=S, fingerprint=S, files=array(S), record=RECORD, field_sources=FIELD_SOURCES, attempted_fields=array(S), mentions=array(struct(path=S, shaped=B)))


def adapt_folder(folder: str, index: bytes | None, rationale: bytes | None) -> dict:
    """A folder's row: a reason to skip it, or its record."""
    out = dict.fromkeys(FOLDER.fieldNames()) | {"folder": folder}
    digits = re.match(r"\d+", folder.rsplit("/", 1)[-1])
    if index is None:
        return out | {"skip_reason": "no index.md"}
    if digits is None:
        return out | {"skip_reason": "no leading digits in directory name"}
    text = decode(index)
    if text is None:
        return out | {"skip_reason": "cannot read index.md"}
    lines = read_lines(text)
    if "Decision" not in sections(lines):
        return out | {"skip_reason": "no ## Decision section"}
    state = field(preamble(lines), "Status")
    if state not in STATUS:
        return out | {"skip_reason": f"status {state!r} is not a known status"}
    files = [(f"{folder}/index.md", index)] + ([(f"{folder}/rationale.md", rationale)] if rationale is not None else [])
    made = parse_spec(f"DM-{digits[0]}", folder, text, decode(rationale))
    return out | made | {"record_id": f"DM-{digits[0]}", "fingerprint": fingerprint(VERSION, files), "files": [f for f, _ in files]}


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files under a folder, relative to it; files that go meanwhile are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root).select("path")
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath()
    name = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    return files.select(F.substring(name, F.lit(len(base) + 2), F.length(name)).alias("path"))


def folders(spark: SparkSession, root: str) -> list[tuple[str, bool, bool]]:
    """(folder, has index.md, has rationale.md) of the folders under ``docs/specs``; a listing, no contents."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(f"{root}/docs/specs")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        raise FileNotFoundError(f"{root} has no docs/specs")
    found = [x.getPath() for x in fs.listStatus(base) if x.isDirectory()]
    return sorted((f"docs/specs/{p.getName()}", fs.exists(hadoop.Path(p, "index.md")), fs.exists(hadoop.Path(p, "rationale.md"))) for p in found)


def adapt(spark: SparkSession, root: str) -> DataFrame:
    """A row for each folder under ``docs/specs``: FOLDER's columns, ``used`` and ``unresolved_mentions``.

    Of folders with the same id the first by name is used. Evidence is the
    folder's own files, then every mentioned file that the listing has.
    """
    there = spark.createDataFrame(folders(spark, root), "folder string, has_index boolean, has_rationale boolean")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/docs/specs").select("path", "content")
    parts = files.select(F.regexp_extract("path", r"(docs/specs/[^/]+)/", 1).alias("folder"), F.regexp_extract("path", r"docs/specs/[^/]+/(.+)$", 1).alias("name"), "content").where("folder <> ''")
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("content")))
    read = parts.groupBy("folder").agg(of("index.md").alias("index"), of("rationale.md").alias("rationale"))
    kept = lambda name: F.when(F.col(f"has_{name}"), F.coalesce(name, F.lit(b"")))  # noqa: E731  the reader passes over empty files
    specs = there.join(read, "folder", "left").select("folder", kept("index").alias("index"), kept("rationale").alias("rationale"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([adapt_folder(*row) for row in zip(f["folder"], f["index"], f["rationale"], strict=True)], columns=FOLDER.fieldNames())

    rows = specs.mapInPandas(run, FOLDER)
    named = rows.select("folder", F.posexplode("mentions").alias("pos", "m")).select("folder", "pos", "m.path", "m.shaped")
    known = named.join(listing(spark, root).withColumn("there", F.lit(True)), "path", "left")
    first = known.where("there").groupBy("folder", "path").agg(F.min("pos").alias("pos"))
    cited = first.groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("cited"))
    lost = known.where("there is null and shaped").groupBy("folder").agg(F.count("*").cast("int").alias("unresolved_mentions"))
    firsts = rows.where("record_id is not null").groupBy("record_id").agg(F.min("folder").alias("first_folder"))
    rows = rows.join(cited, "folder", "left").join(lost, "folder", "left").join(firsts, "record_id", "left")
    note = F.lit(None).cast("string").alias("note")
    evidence = F.concat(
        F.transform("files", lambda p: F.struct(F.lit("spec").alias("kind"), p.alias("target"), note)),
        F.transform(F.coalesce("cited", F.array().cast("array<string>")), lambda p: F.struct(F.lit("file").alias("kind"), p.alias("target"), note)),
    )
    rows = rows.withColumn("record", F.when(F.col("record").isNotNull(), F.col("record").withField("evidence", evidence)))
    return rows.withColumn("used", F.col("folder") == F.col("first_folder")).withColumn("unresolved_mentions", F.coalesce("unresolved_mentions", F.lit(0))).drop("cited", "first_folder", "mentions")



import pytest

from tessera.functions import digest
from tessera.sources import frontmatter, markdown

INDEX = """# 0007. Cache the survey

**Date**: 2024-03-01
**Status**: Accepted
**Supersedes**: DM-0003

## Summary

Short text with `src/app.py:12`, `lib/` and `missing/file.py`, `word`.

## Context

Surveys were slow.

## Decision

**Chosen option**: Option 2: Keep a cache

## Options considered

**Option 1:** Do nothing
- **Pros**: simple
- **Cons**: stays slow
  and gets slower

**Option 2:** Keep a cache (chosen)
**Cons**: needs care

## Consequences

**Positive**:
- faster
- **cheaper**: by half

**Negative / tradeoffs**:
- stale reads

**Neutral**: none

## Rationale

See `rationale.md`.

```sh
## not a heading
```
"""
RATIONALE = """# Why

## Rationale

Because it is slow
in practice.

- users wait
- cpu is idle

## Notes

More.
"""


@pytest.fixture
def corpus(tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())

    put("docs/specs/0007-cache/index.md", "﻿" + INDEX.replace("\n", "\r\n"))
    put("docs/specs/0007-cache/rationale.md", RATIONALE)
    put("docs/specs/0007-other/index.md", INDEX)
    put("docs/specs/0008-broken/index.md", b"\xff\xfe\xfa")
    put("docs/specs/0009-draft/index.md", INDEX.replace("Accepted", "Dreaming"))
    put("docs/specs/0010-empty/index.md", "")
    put("docs/specs/notes/index.md", INDEX)
    put("docs/specs/0011-lost/rationale.md", RATIONALE)
    put("src/app.py", "x = 1")
    return str(tmp_path)


def test_adapt_a_corpus(spark, corpus):
    rows = {r["folder"].rsplit("/", 1)[-1]: r for r in markdown.adapt(spark, corpus).collect()}
    reasons = {k: r["skip_reason"] for k, r in rows.items() if r["skip_reason"]}
    assert reasons == {
        "0008-broken": "cannot read index.md",
        "0009-draft": "status 'Dreaming' is not a known status",
        "0010-empty": "no ## Decision section",
        "notes": "no leading digits in directory name",
        "0011-lost": "no index.md",
    }
    assert rows["0007-cache"]["used"] and not rows["0007-other"]["used"]
    r = rows["0007-cache"]["record"]
    assert (r["id"], r["title"], r["status"], r["date"], r["supersedes"]) == ("DM-0007", "Cache the survey", "accepted", "2024-03-01", "DM-0003")
    assert r["context"]["problem"] == "Surveys were slow."
    assert r["decision"]["chosen"] == "Option 2: Keep a cache"
    assert [(a["title"], a["rejection_reason"]) for a in r["decision"]["alternatives"]] == [("Do nothing", "stays slow\nand gets slower")]
    assert r["why"] == ["users wait", "cpu is idle"]
    assert r["rationale_summary"] == "Because it is slow in practice."
    assert r["consequences"]["positive"] == ["faster", "**cheaper**: by half"]
    assert r["consequences"]["negative"] == ["stale reads"]
    assert r["body"].startswith("## Summary\n\nShort text") and "## Notes\n\nMore." in r["body"] and r["body"].endswith("**Neutral**: none")
    assert r["tags"] == ["source-status:Accepted"]
    assert [(e["kind"], e["target"]) for e in r["evidence"]] == [("spec", "docs/specs/0007-cache/index.md"), ("spec", "docs/specs/0007-cache/rationale.md"), ("file", "src/app.py")]
    assert rows["0007-cache"]["unresolved_mentions"] == 3  # lib/, missing/file.py, rationale.md
    sources = rows["0007-cache"]["field_sources"]
    assert sources["why[0]"][0]["path"].endswith("rationale.md") and sources["decision.chosen"][0]["section"] == "Decision"
    assert [s["section"] for s in sources["body[1]"]] == ["Notes", "Consequences"]
    assert rows["0007-cache"]["fingerprint"] != rows["0007-other"]["fingerprint"]


def test_panels_and_heading_options():
    lines = markdown.read_lines("### Panel 1: Which store\n**Option A — Files (chosen)**: x\n**Option B — Tables**\n**Cons**: slow\n**Decision**: Option A\n### Panel 2\n**Option A:** One\n**Option B:** Two")
    assert markdown.alternatives(lines, "") == ([{"title": "Which store: Tables", "rejection_reason": "slow"}], True)
    lines = markdown.read_lines("### Option 1: Alpha\n**Cons**\n- dear\n### Option 2: Beta (recommended)\n")
    assert markdown.alternatives(lines, "Beta.") == ([{"title": "Alpha", "rejection_reason": "dear"}], False)
    assert markdown.alternatives(None, "x") == ([], True)


def test_fences_and_headings():
    assert markdown.h2_headings("## a ##\n```\n## no\n```\n## b#\n~~~\n## c\n##\n##  ") == {"a", "b#", "c", ""}
    assert markdown.read_lines("```\nx")[1].fenced is False


def test_label_matching():
    assert markdown.names_label("Negative / tradeoffs", "Negative")
    assert not markdown.names_label("Negatively", "Negative")


RECORD = {
    "id": "DM-1", "title": "T: with 'quotes'", "status": "accepted", "date": "2024-01-02", "context": {"problem": "p\nq", "triggering_change": None},
    "decision": {"chosen": "c", "alternatives": [{"title": "a", "rejection_reason": None}, {"title": "b", "rejection_reason": "r"}]}, "why": ["w1", "- w2"], "rationale_summary": None,
    "consequences": {"positive": ["x"], "negative": []}, "evidence": [{"kind": "file", "target": "a/b.py", "note": None}], "tags": ["t"], "supersedes": None, "body": "## H\n\ntext\n",
}


@pytest.mark.parametrize("small", [True, False])
def test_record_files_read_back(small, monkeypatch):
    if small:
        monkeypatch.setattr(frontmatter, "yaml", None)
    got = frontmatter.parse(frontmatter.dump(RECORD))
    assert got == {"record": RECORD, "violations": [], "unknown_fields": []}


@pytest.mark.parametrize(
    ("text", "rule"),
    [
        (None, "file.unreadable"),
        ("no fence", "file.no_frontmatter"),
        ("---\nid: 1", "file.no_frontmatter"),
        ("---\n[1, 2\n---\n", "file.frontmatter_unparseable"),
        ("---\njust text\n---\n", "file.frontmatter_not_mapping"),
        ("---\nid: [1]\n---\n", "field.wrong_type"),
        ("---\nstatus: maybe\n---\n", "field.unknown_value"),
    ],
)
def test_bad_record_files(text, rule):
    assert [v["rule"] for v in frontmatter.parse(text)["violations"]] == [rule]


def test_unknown_fields_are_kept_apart():
    got = frontmatter.parse("---\nid: a\nextra: 1\ncontext:\n  problem: p\n  odd: 2\n---\nbody")
    assert got["unknown_fields"] == ["context.odd", "extra"] and got["record"]["body"] == "body"


def test_read_and_write_records(spark, tmp_path):
    (tmp_path / "a.md").write_text(frontmatter.dump(RECORD))
    (tmp_path / "b.md").write_bytes(b"\xff")
    rows = frontmatter.read_records(spark, str(tmp_path)).collect()
    assert sorted(r["record"]["id"] if r["record"] else r["violations"][0]["rule"] for r in rows) == ["DM-1", "file.unreadable"]
    good = frontmatter.read_records(spark, str(tmp_path)).where("record is not null").select("record.*")
    text = frontmatter.record_files(good).first()
    assert text["record_path"] == "DM-1.md" and frontmatter.parse(text["text"])["record"] == RECORD


def test_digests():
    assert digest.canonical_json({"b": "é\r\n", "a": None}) == '{"a":null,"b":"é\\n"}'
    assert digest.canonical_json({"k": [1, True, 2.5, "e\u0301\r", {"z": "\n\u0303", "y": '"\\'}], 1: {}}) == '{"1":{},"k":[1,true,2.5,"\u00e9\\n",{"y":"\\"\\\\","z":"\\n\u0303"}]}'
    assert digest.record_digest(RECORD) == digest.record_digest(dict(reversed(RECORD.items())))
    assert digest.record_digest(RECORD) != digest.record_digest(RECORD | {"title": "U"})
    entry = {"id": "a", "fingerprint": "f", "contributing_files": ["x"], "record_path": "p", "record_digest": "d", "field_sources": {"why[0]": [{"path": "x", "section": "s"}] * 2}}
    assert digest.entry_digest(entry) == digest.entry_digest(entry | {"field_sources": {"why[0]": [{"path": "x", "section": "s"}]}})
    manifest = {"schema_version": 2, "adapter_version": "1", "source_root_hint": "/x", "generated_at": "now", "entries": [entry | {"entry_digest": "e"}]}
    assert digest.manifest_digest(manifest) == digest.manifest_digest(manifest | {"generated_at": "later"})


def test_walk_and_doctor(spark, tmp_path):
    from tessera.operators import doctor
    from tessera.sources.walk import survey

    for name, text in {"a.md": "## X\n## Y", "d/b.md": "## X\n```\n## Z\n```", "d/c.txt": "no", ".git/d.md": "## H"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.md").write_bytes(b"\xff")
    (tmp_path / "link").symlink_to(tmp_path / "d")
    docs, skips = survey(spark, str(tmp_path))
    assert {r["heading"]: (r["file_count"], r["percentage"]) for r in doctor.heading_frequency(docs).collect()} == {"X": (2, 100.0), "Y": (1, 50.0)}
    assert {(r["path"], r["reason"], r["unseen_contents"]) for r in skips.collect()} == {(".git", "hidden directory", True), ("link", "descendant symbolic link", True), ("bad.md", "unreadable Markdown file", False)}
    assert [r["reason"] for r in doctor.skip_summary(skips).orderBy("position").collect()] == ["descendant symbolic link", "hidden directory", "unreadable Markdown file"]


def test_manifest_config_battery(spark, tmp_path):
    import json

    from tessera.sources import files

    entry = {"id": "b", "fingerprint": "f", "contributing_files": [], "record_path": "p", "record_digest": "d", "entry_digest": "e", "field_sources": {"title": [{"path": "x", "section": "s"}] * 2}}
    path = tmp_path / "m.json"
    path.write_text(files.manifest_text({"adapter_version": "1", "generated_at": "t", "source_root_hint": "h", "entries": [entry, entry | {"id": "a"}], "skipped": [], "collisions": []}))
    assert [r["id"] for r in files.read_manifest(spark, str(path)).collect()] == ["a", "b"]
    path.write_text(path.read_text().replace('"schema_version": 2', '"schema_version": 1'))
    with pytest.raises(files.InputError):
        files.read_manifest(spark, str(path))
    assert files.previous_fingerprints(spark, str(path)).count() == 0
    (tmp_path / "sub/.git").mkdir(parents=True)
    assert files.find_config(str(tmp_path / "sub")) is None
    (tmp_path / "sub" / files.CONFIG).write_text("adapter: flat-records\noutput: out\n")
    assert files.find_config(str(tmp_path / "sub"))[1] == {"adapter": "flat-records", "output": str(tmp_path / "sub/out")}
    (tmp_path / "sub" / files.CONFIG).write_text("adaptor: x\n")
    with pytest.raises(files.InputError):
        files.find_config(str(tmp_path / "sub"))
    assert files.setting("a", None, {"a": "c"}, "d") == "c" and files.setting("a", "x", {"a": "c"}) == "x"
    battery = tmp_path / "b.json"
    query = {"id": "q", "text": "t", "expected_record": "R", "expected_state": "answered", "expected_value_paths": ["why"], "expected_abstention": None}
    battery.write_text(json.dumps({"queries": [query]}))
    assert files.read_battery(spark, str(battery)).first()["required_records"] == ["R"]
    battery.write_text(json.dumps({"queries": [query | {"odd": 1}]}))
    with pytest.raises(files.InputError):
        files.read_battery(spark, str(battery))
    (tmp_path / "c.tsv").write_text("# note\nrecords\trepo\tdirectory\n3\ta/b\tdocs\n")
    assert tuple(files.read_candidates(spark, str(tmp_path / "c.tsv")).first()) == (3, "a/b", "docs")
    (tmp_path / "r.jsonl").write_text('{"run_id": "1", "dropped": [{"sentence_id": "s", "reason": "r"}], "usd_cost": 0.5}\n')
    assert files.read_runs(spark, str(tmp_path / "r.jsonl")).first()["dropped"][0]["reason"] == "r"


def test_adapters_conform(spark, corpus, tmp_path):
    from tessera.sources import adapters

    made = adapters.load("spec-folders")
    assert all(ok for _, ok in adapters.conformance(spark, made, corpus, "docs/specs/0007-cache/index.md"))
    flat = tmp_path / "flat"
    (flat / "decisions").mkdir(parents=True)
    (flat / "decisions/a.md").write_text(frontmatter.dump(RECORD))
    (flat / "decisions/b.md").write_text(frontmatter.dump(RECORD | {"id": "DM-2"}))
    assert all(ok for _, ok in adapters.conformance(spark, adapters.load("tessera.sources.adapters:FlatRecords"), str(flat), "decisions/a.md"))
    for bad, error in (("nothing", ValueError), ("tessera.schemas:RECORD", TypeError)):
        with pytest.raises(error):
            adapters.load(bad)


def test_command_line(spark, corpus, tmp_path, capsys):
    from tessera.__main__ import main

    assert main(["version"]) == 0
    assert main(["adapt", "--corpus-root", corpus]) == 0
    assert main(["doctor", "--corpus-root", corpus]) == 0
    assert main(["validate", "--corpus-root", corpus]) in (0, 1)
    store = str(tmp_path / "store")
    assert main(["ingest", "--corpus-root", corpus, "--store", store, "--dry-run"]) == 0
    assert main(["ingest", "--corpus-root", corpus, "--store", store]) == 0
    assert main(["query", "Why are surveys slow?", "--store", store]) == 0
    assert "Surveys were slow." in capsys.readouterr().out


def test_the_tree_is_listed_level_by_level(spark, tmp_path):
    from tessera.operators.index import source_states
    from tessera.sources import walk

    for name in ("a/b/c/deep.md", "a/b/One.py", "a/x.txt", ".hid/y.md", "top.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "a/link").symlink_to(tmp_path / "a/b")
    (tmp_path / "a/up.md").symlink_to(tmp_path / "top.md")
    got = {(r["path"], r["kind"], r["reason"]) for r in walk.tree(spark, str(tmp_path)).collect()}
    assert got == {
        ("a", "folder", None), ("a/b", "folder", None), ("a/b/c", "folder", None), ("a/b/c/deep.md", "file", None), ("a/b/One.py", "file", None), ("a/x.txt", "file", None), ("top.md", "file", None),
        (".hid", "skipped", walk.HIDDEN), ("a/link", "skipped", walk.LINK), ("a/up.md", "skipped", walk.LINK),
    }
    refs = spark.createDataFrame([(p,) for p in ("a/b/One.py", "a/b/one.py", "a/link/One.py", "a/up.md", "../top.md", "a//x.txt", "top.md", "a/b")], "path string")
    states = {r["path"]: r["resolution"] for r in source_states(refs, walk.files(spark, str(tmp_path))).collect()}
    assert {p for p, s in states.items() if s == "resolved"} == {"a/b/One.py", "top.md"}
    assert {p for p, s in states.items() if s == "invalid_relative_path"} == {"../top.md", "a//x.txt"}
    (gone,) = walk.entries(str(tmp_path), "nowhere")
    assert gone == ("nowhere", "skipped", walk.DISAPPEARED)

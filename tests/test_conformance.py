"""Adapters that keep the rules, and ones that lie, write, fail, or don't look at their files."""

from pathlib import Path

import pytest
from test_sources import corpus  # noqa: F401  (a fixture)

from tessera.sources import conformance
from tessera.sources.adapters import SpecFolders
from tessera.sources.conformance import Case, first_difference, row_differences, run_cases


@pytest.fixture
def case(corpus):  # noqa: F811
    rows = SpecFolders().rows(corpus)
    used = [r for r in rows if r["used"]]
    sources = [
        {
            "id": r["record_id"], "root": r["folder"], "contributing_files": r["files"], "required_files": r["files"][:1], "record": r["record"],
            "result": {"record": None, "attempted_fields": r["attempted_fields"], "unresolved_mention_count": r["unresolved_mentions"], "violations": [], "field_sources": r["field_sources"]},
        } for r in used
    ]
    same = sorted(r["folder"] for r in rows if r["record_id"] == "DM-0007")
    return Case("all", "collision", Path(corpus), sources, [r["folder"] for r in rows if r["skip_reason"]], [{"id": "DM-0007", "paths": same, "used": same[0]}])


def adapters():
    """Made in a function, so that executors get them by value."""

    class Lying(SpecFolders):
        def rows(self, root):
            out = super().rows(root)
            return [r | {"record": r["record"] | {"title": "another"}} if r["record"] else r for r in out]

    class Writing(SpecFolders):
        def rows(self, root):
            with open(f"{root}/trace.txt", "a") as f:
                f.write("seen")
            return super().rows(root)

    class Failing(SpecFolders):
        def rows(self, root):
            raise RuntimeError("no corpus for me")

    class Careless(SpecFolders):
        def rows(self, root):
            return [r | {"fingerprint": "f" if r["fingerprint"] else None} for r in super().rows(root) if not r["skip_reason"]]

    class Moody(SpecFolders):
        def rows(self, root):
            return [r | {"fingerprint": root if r["fingerprint"] else None} for r in super().rows(root)]

    return {a.__name__: a() for a in (Lying, Writing, Failing, Careless, Moody)}


def failures(report):
    return {r["rule"] for r in report.collect() if not r["passed"]}


def test_the_adapter_keeps_every_rule(spark, case):
    report = run_cases(spark, SpecFolders(), [case]).collect()
    assert [r for r in report if not r["passed"]] == []
    rules = {r["rule"] for r in report}
    assert {"contract.metadata", "discovery.collisions", "parse.record", "fingerprint.follows_file", "corruption.noticed", "corruption.others_unaffected", "fixture.unchanged"} <= rules
    assert {r["variant"] for r in report} == {None, "original", "again", "probe", "empty", "invalid_utf8"}


@pytest.mark.parametrize(
    ("name", "broken"),
    [("Lying", {"parse.record"}), ("Writing", {"fixture.unchanged"}), ("Failing", {"adapter.exception"}), ("Careless", {"discovery.skips", "fingerprint.follows_file"}), ("Moody", {"discovery.deterministic", "corruption.others_unaffected"})],
)
def test_adapters_that_break_a_rule(spark, case, name, broken, tmp_path):
    keep = str(tmp_path / "kept")
    found = failures(run_cases(spark, adapters()[name], [case], keep))
    assert found == broken if name != "Moody" else "discovery.deterministic" in found
    assert Path(keep).exists() == (name in ("Writing", "Failing"))


def test_adapters_without_local_rows_run_on_the_driver(spark, case):
    class Session:
        adapter_id, adapter_version = "session", "1"

        def adapt(self, spark, root):
            return SpecFolders().adapt(spark, root)

    assert failures(run_cases(spark, Session(), [Case("few", "valid", case.corpus, [], case.skips, case.collisions)])) == {"discovery.sources"}

    class Wrong:
        adapter_id, adapter_version = "", "1"

        def adapt(self):
            return None

    assert failures(run_cases(spark, Wrong(), [case])) == {"contract.metadata", "contract.signature"}


def test_comparison():
    assert first_difference({"a": [1, {"b": None}]}, {"a": [1, {}]}) is None
    assert first_difference({"a": [1, {"b": "x"}]}, {"a": [1, {"b": "y"}]}) == "a[1].b: 'x', expected 'y'"
    assert first_difference([1, 2], [1]) == ": 2 entries, expected 1"
    assert conformance.variants(Case("x", "skip", Path("."), [], [], [])) == [("original", None), ("again", None)]


def test_row_differences(spark):
    a, b = (spark.createDataFrame(rows, "x int, y string") for rows in ([(1, "a"), (1, "a"), (2, "b")], [(1, "a"), (3, "c")]))
    assert sorted(map(tuple, row_differences(a, b).collect())) == [(1, "a", "unexpected"), (2, "b", "unexpected"), (3, "c", "missing")]

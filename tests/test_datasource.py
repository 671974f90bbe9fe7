"""The spec-folder data source gives the rows of the adapter, reads what filters leave, and follows changes."""

import os

import pytest
from pyspark.sql import functions as F
from test_sources import INDEX, corpus  # noqa: F401  (a fixture)

from tessera.sources import datasource, markdown


def plain(rows):
    return {r["folder"]: r.asDict(recursive=True) for r in rows.collect()}


@pytest.mark.parametrize("size", [64, 1])
def test_same_rows_as_the_adapter(spark, corpus, size):  # noqa: F811
    rows = datasource.register(spark).read.format("spec-folders").option("folders", size).load(corpus)
    want = plain(markdown.adapt(spark, corpus))
    assert plain(rows) == want and len(want) == 7
    assert rows.rdd.getNumPartitions() == (1 if size == 64 else 7)
    assert any(e["kind"] == "file" for r in want.values() if r["record"] for e in r["record"]["evidence"])


def test_filters_reach_the_listing(spark, corpus):  # noqa: F811
    rows = datasource.register(spark).read.format("spec-folders").option("folders", 1).load(corpus)
    one = rows.where("folder = 'docs/specs/0007-other'")
    assert one.rdd.getNumPartitions() == 1 and [(r["folder"], r["used"]) for r in one.collect()] == [("docs/specs/0007-other", False)]
    both = rows.where("record_id = 'DM-0007' and folder like 'docs/specs/0007%'")
    assert both.rdd.getNumPartitions() == 2 and both.count() == 2
    assert rows.where("record_id in ('DM-0007', 'DM-0009')").count() == 2  # 0009 was skipped and has no id
    assert rows.where(F.col("skip_reason").isNotNull()).count() == 5


def test_direct_reader(corpus):  # noqa: F811
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringStartsWith

    reader = datasource.FolderReader(corpus, 2)
    given = [EqualTo(("folder",), "docs/specs/0007-cache"), IsNotNull(("folder",)), EqualTo(("record_id",), "DM-0007"), In(("folder",), ("docs/specs/0007-cache", "x")), StringStartsWith(("folder",), "docs/")]
    assert list(reader.pushFilters(given)) == [given[1], given[2]]
    assert [p.folders for p in reader.partitions()] == [[("docs/specs/0007-cache", [])]]
    (row,) = reader.read(reader.partitions()[0])
    assert row[datasource.ROW.fieldNames().index("record_id")] == "DM-0007"
    with pytest.raises(FileNotFoundError):
        datasource.FolderReader(f"{corpus}/src", 2).partitions()


def test_changed_folders_come_again(spark, corpus, tmp_path):  # noqa: F811
    seen = []

    def go():
        rows = datasource.register(spark).readStream.format("spec-folders").load(corpus)
        query = rows.writeStream.foreachBatch(lambda df, n: seen.append(sorted(r["folder"] for r in df.collect()))).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        query.processAllAvailable()
        query.stop()

    go()
    assert sorted(sum(seen, [])) == sorted(plain(markdown.adapt(spark, corpus)))
    seen.clear()
    path = f"{corpus}/docs/specs/0009-draft/index.md"
    with open(path, "w") as f:
        f.write(INDEX)
    os.utime(path, ns=(2**61, 2**61))
    go()
    assert sum(seen, []) == ["docs/specs/0009-draft"]

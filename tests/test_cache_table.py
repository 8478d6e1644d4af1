"""The cache table: batches, commits, writers that die or collide, one bucket for a key, compaction and retention."""

import pytest

from quillspark.sources.cache_table import CacheTable, Conflict
from quillspark.sources.shared import new_folder

COLUMNS = "ns string, key string, t timestamp, v string"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "ns string, key string, t string, v string").selectExpr("ns", "key", "to_timestamp(t) t", "v")


def held(table):
    return {(r["ns"], r["key"]): r["v"] for r in table.read().collect()}


@pytest.fixture()
def table(spark):
    return CacheTable(spark, new_folder(spark, "cache"), COLUMNS, 8)


def test_batches(spark, table):
    assert held(table) == {} and table.vacuum() == 0
    table.upsert(batch(spark, ("web", "a", "2024-01-01 10:00:00", "1"), ("web", "b", "2024-01-02 10:00:00", "2"), ("llm", "a", "2024-01-01 10:00:00", "3")))
    table.upsert(batch(spark, ("web", "a", "2024-01-03 10:00:00", "4"), ("web", "b", "2024-01-01 10:00:00", "late"), ("llm", "a", "2024-01-01 10:00:00", "same time")))
    want = {("web", "a"): "4", ("web", "b"): "2", ("llm", "a"): "same time"}
    assert held(table) == want
    table.compact()
    assert held(table) == want and table.vacuum() == 2 and held(table) == want
    table.compact("2024-02-01 00:00:00", 30)
    assert held(table) == {("web", "a"): "4", ("web", "b"): "2"}
    table.upsert(batch(spark))
    assert held(table) == {("web", "a"): "4", ("web", "b"): "2"}


def test_a_writer_that_dies(spark, table, monkeypatch):
    table.upsert(batch(spark, ("web", "a", "2024-01-01 10:00:00", "1")))
    monkeypatch.setattr(CacheTable, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        table.upsert(batch(spark, ("web", "a", "2024-01-09 10:00:00", "lost")))
    monkeypatch.undo()
    assert held(table) == {("web", "a"): "1"}
    # ... and one that dies within its commit.
    fs, where = table._fs(f"{table.path}/manifests/00000002.json")
    out = fs.create(where, False)
    out.write(bytearray(b'{"versions": ["half'))
    out.close()
    assert held(table) == {("web", "a"): "1"}
    table.upsert(batch(spark, ("web", "a", "2024-01-05 10:00:00", "2")))
    assert held(table) == {("web", "a"): "2"} and table.vacuum() == 1 and held(table) == {("web", "a"): "2"}


def test_two_writers(spark, table, monkeypatch):
    table.upsert(batch(spark, ("web", "a", "2024-01-01 10:00:00", "1")))
    other, write = CacheTable(spark, table.path, COLUMNS, 8), CacheTable._write

    def between(self, rows):
        made = write(self, rows)
        monkeypatch.undo()
        other.upsert(batch(spark, ("web", "b", "2024-01-01 10:00:00", "other")))
        return made

    monkeypatch.setattr(CacheTable, "_write", between)
    with pytest.raises(Conflict):
        table.upsert(batch(spark, ("web", "a", "2024-01-02 10:00:00", "2")))
    assert held(table) == {("web", "a"): "1", ("web", "b"): "other"}


def test_one_bucket_is_read(spark, table):
    table.upsert(batch(spark, *(("web", f"k{i}", f"2024-01-{1 + i % 28:02d} 10:00:00", str(i)) for i in range(120))))
    got = table.get("web", "k7", "2024-01-08 20:00:00")
    assert [r["v"] for r in got.collect()] == ["7"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "(day" in plan
    assert table.get("web", "k7", "2024-01-09 20:00:00").count() == 0 and table.get("web", "none", "2024-01-08 20:00:00").count() == 0

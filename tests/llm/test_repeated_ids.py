"""Rows that repeat a doc_id: all their texts are one class, of which one row stays."""

from quillspark.llm import near_duplicates


def test_repeated_ids(spark):
    a, b, c, x = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcx")
    rows = [(10, a), (11, b), (12, c), (20, a), (20, b), (20, c), (30, x), (30, x), (None, x), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.classes(docs).collect()}
    assert got == {10: 10, 11: 10, 12: 10, 20: 10, 30: 30, None: None}
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(10, a), (30, x), (None, x), (None, None)], key=str)

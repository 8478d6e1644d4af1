"""Entries of videos of any length, against DuckDB."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from quillspark import queries as q
from quillspark.plans import briefing


def test_video_entries_of_large_ids(spark, tmp_path):
    ids = [0, 1, 7, 359_899, 400_001, 1_000_001, 4_000_000_001]
    docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": ["a text. " * 60] * len(ids)})
    pq.write_table(docs, tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.register("documents", docs)
    want = sorted(c.execute(q.SQL["p18_video_entries"]).fetchall())
    got = sorted((r["id"], r["summary"], r["basis"], r["points"]) for r in q.QUERIES["p18_video_entries"](spark, str(tmp_path)).collect())
    assert got == want and any(r[3] for r in want if r[0] > 400_000)


def test_video_entries_of_odd_documents(spark, tmp_path):
    """Texts are null, empty or white space; ids repeat, with the same text and with others, and are null."""
    ids = [0, 1, 2, 3, 5, 5, 6, 6, 7, 8, 9, 1, 1, 13, 13, None, None]
    texts = [None, "told", "", " \t\n", "", "other", "one", "one", "7", None, " a  b ", "told", "again", None, "", "x", None]
    docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})
    pq.write_table(docs, tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.register("documents", docs)
    order = lambda rows: sorted(map(repr, rows))
    want = order(c.execute(q.SQL["p18_video_entries"]).fetchall())
    got = order((r["id"], r["summary"], r["basis"], r["points"]) for r in q.QUERIES["p18_video_entries"](spark, str(tmp_path)).collect())
    assert got == want


def test_videos_of_no_description(spark):
    videos = spark.createDataFrame([(0, k, 9, t, 60, False) for k, t in enumerate([None, "", " \n ", "a  b"])], "topic_id int, id long, place int, text string, duration int, has_transcript boolean")
    replies = spark.createDataFrame([], "topic_id int, id long, reply string")
    got = {r["id"]: r["summary"] for r in briefing.video_entries(videos, replies).collect()}
    assert got == {k: f"{t} [S{k}]" for k, t in enumerate(["No description available."] * 3 + ["a b"])}

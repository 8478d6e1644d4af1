"""Searches whose shuffles don't grow with what is found, against DuckDB and plain Python."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from quillspark import queries as q
from quillspark.operators import substring


def _plain(texts, needles):
    return sorted((s, k) for s, n in needles for k, t in texts if n in t)


def test_what_is_found_is_not_shuffled(spark, monkeypatch):
    """Each kept table but that of what is found, and the rows that meet, grow no faster than the input."""
    texts = [(i, f"common title {i:04d}") for i in range(400)]
    needles = [(i, f"common title {i // 10:03d}") for i in range(400)]
    kept, sizes = substring.kept, []
    monkeypatch.setattr(substring, "kept", lambda rows, name, *used: made.setdefault(name, kept(rows, name)))
    for n in (200, 400):
        made = {}
        rows, asked = spark.createDataFrame(texts[:n], "id long, title string"), spark.createDataFrame(needles[:n], "search_id long, needle string")
        got = sorted(map(tuple, substring.find(asked, rows, substring.grams(rows, ["id"], "title"), ["id"], "title").collect()))
        assert got == _plain(texts[:n], needles[:n])
        sizes.append({k: t.count() for k, t in made.items() if k != "found"})
    assert all(sizes[1][k] <= 2.2 * sizes[0][k] for k in sizes[0]) and "postings" not in sizes[0]


def test_searches_in_many_groups(spark, monkeypatch):
    """Rows of copies are split, grams are dealt over many groups, keys repeat and are null."""
    monkeypatch.setattr(substring, "TOGETHER", 4)
    monkeypatch.setattr(substring, "MET", 8)
    monkeypatch.setattr(substring, "PAIRS", 16)
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 9)))) for i in range(120)] + [(i, "abcabc") for i in range(200, 260)] + [(7, "abba"), (7, "abba"), (8, "cab"), (None, "cabc"), (None, "bab")]
    needles = [(i, "".join(rng.choice("abc") for _ in range(i % 5))) for i in range(60)]
    rows, asked = spark.createDataFrame(texts, "id long, title string"), spark.createDataFrame(needles, "search_id long, needle string")
    got = [tuple(r) for r in substring.find(asked, rows, substring.grams(rows, ["id"], "title"), ["id"], "title").collect()]
    order = lambda x: sorted((s, -1 if k is None else k) for s, k in x)
    assert order(got) == order((s, k) for s, n in needles for k, t in texts if n in t)


def test_searches_of_odd_documents(spark, tmp_path):
    texts = ["Alpha beta gamma delta", None, "", "  ", "ALPHA BETA GAMMA DELTA EPSILON", "a\nb", "alpha beta gamma delta", "Alpha beta gamma delta", "x" * 70, "ΟΔΟΣ ΟΔΟΣ ΟΔΟΣΑ"] * 3
    ids = [*range(28), 5, None]
    docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})
    pq.write_table(docs, tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.register("documents", docs)
    order = lambda x: sorted((s, -1 if k is None else k) for s, k in x)
    want = order(c.execute(q.SQL["f13_substring_searches"]).fetchall())
    assert order(map(tuple, q.QUERIES["f13_substring_searches"](spark, str(tmp_path)).collect())) == want and any(k == -1 for _, k in want)

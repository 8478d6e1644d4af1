"""Many equal needles and texts meet once."""

from quillspark.operators import substring


def test_equal_texts_are_compared_once(spark, monkeypatch):
    made = {}
    kept = substring.kept
    monkeypatch.setattr(substring, "kept", lambda rows, name, *used: made.setdefault(name, kept(rows, name, *used)))
    rows = spark.createDataFrame([(i, "Alpha beta" if i % 2 else "gamma") for i in range(200)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " BETA ") for i in range(50)] + [(50, "zz"), (51, None)], "search_id long, needle string")
    got = {(r["search_id"], r["doc_id"]) for r in substring.find(asked, rows, substring.grams(rows, ["doc_id"], "text"), ["doc_id"], "text").collect()}
    assert got == {(s, i) for s in range(50) for i in range(1, 200, 2)} | {(51, i) for i in range(200)}
    assert made["texts"].count() == 2 and made["found"].count() == 3

"""A support check sends each different word of a sentence once, and none of a short sentence."""

from quillspark.operators import citations


def test_words_that_meet(spark, monkeypatch):
    sources = spark.createDataFrame([(0, 1, "Rivers carry gravel."), (0, 2, "Glaciers carry stones."), (0, 3, None)], "r int, source_id int, text string")
    text = "rivers " * 300 + "carry gravel stones marble [S9][S2][S1]. Rivers carry [S1]. Nothing known regarding several different words [S3]."
    sent, plain = [], citations.counted_words

    def counted(*a, **b):
        rows = plain(*a, **b)
        sent.append(rows.count())
        return rows

    monkeypatch.setattr(citations, "counted_words", counted)
    got = citations.support_check(spark.createDataFrame([(0, 0, text)], "r int, text_ord int, text string"), sources, ["r"]).orderBy("ord").collect()
    assert [(r["ord"], list(r["ids"]), round(r["overlap"] * 304)) for r in got] == [(0, [2, 1], 303), (2, [3], 0)]
    # With a row of the empty word each: river, carry, gravel, stone, marble, and the third sentence's words; those of the sources.
    assert sent[0] - 6 in (6, 7) and sent[1] == 4 + 4 + 1

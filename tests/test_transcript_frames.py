"""No frame of a transcript's lines shrinks from row to row: Spark sums such a frame up anew for each row."""

from quillspark.operators import passages


def test_frames_grow(spark, monkeypatch):
    plans = {}
    kept = passages.kept

    def seen(rows, name, *used):
        plans.setdefault(name, rows._jdf.queryExecution().analyzed().toString().lower())
        return kept(rows, name, *used)

    monkeypatch.setattr(passages, "kept", seen)
    rows = spark.createDataFrame([("a", i, float(10 * i), str(i)) for i in range(20)], "talk string, pos long, start double, text string")
    got = [(r["line"], r["start"], r["text"]) for r in passages.timed_lines(rows, ["talk"]).orderBy("line").collect()]
    assert got == [(k + 1, 40.0 * k, " ".join(map(str, range(4 * k, 4 * k + 4)))) for k in range(5)]
    assert "rangeframe" in plans["pointers"] and "rangeframe, unboundedpreceding" in plans["pointers"].replace("specifiedwindowframe(rangeframe", "rangeframe")
    assert "unboundedfollowing" not in plans["pointers"]

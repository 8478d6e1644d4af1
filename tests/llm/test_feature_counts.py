"""A rare kind keeps its marks beside a common kind of many, and no count is lost."""

from quillspark.llm import personal_data


def test_feature_counts(spark):
    rows = [(0, f"m{i}", 0.25) for i in range(700) for _ in range(3)] + [(1, "+", 1.0), (1, "-", 0.5)]
    got = personal_data._feature_counts(spark.createDataFrame(rows, "kind int, marks string, p double"), "marks")
    assert {r["value"] for r in got if r["kind"] == 1} == {"+", "-"}
    assert len([r for r in got if r["kind"] == 0]) == 501
    assert [round(sum(r["yes"] + r["no"] for r in got if r["kind"] == k)) for k in (0, 1)] == [2100, 2]

"""The chain of models is joined without dealing attempts by model."""

import re

from quillspark.plans import completion


def test_attempts_are_not_dealt_by_model(spark, tmp_path):
    rows = [(k, m, 1, "ok", f"{m} {k}" if k % 2 or m == "b" else "", "", "") for k in range(200) for m in "ab"]
    attempts = spark.createDataFrame(rows, "key bigint, model string, attempt int, kind string, text string, served string, detail string")
    chain = spark.createDataFrame([("a", 0), ("b", 1)], "model string, ord int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    try:
        got = completion.complete(attempts.select("key").distinct(), attempts, chain)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(model#\d+, \d+\)", plan)
        assert {(r["key"], r["reply"], r["model"]) for r in got.collect()} == {(k, f"{m} {k}", m) for k in range(200) for m in ["a" if k % 2 else "b"]}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

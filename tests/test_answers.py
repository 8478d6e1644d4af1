"""Captured answers: attempts, charsets, cuts in bytes and error classes."""

from quillspark.sources import answers


def test_attempts(spark):
    ok, bad = ("text/html; charset=utf-8", "zweite é".encode()), (None, b"x")
    rows = [
        (1, "https://a.org/x", 1, 200, *ok, None), (1, "https://a.org/x", 2, 500, *bad, None), (2, "https://a.org:8080/x", 1, 429, *bad, None), (2, "https://a.org:8080/x", 2, 429, *bad, None),
        (3, "https://a.org/y?q=1", 1, 403, *bad, None), (3, "https://a.org/y?q=1", 2, 200, *ok, None), (4, "https://a.org/z", 1, None, None, None, "reset"), (4, "https://a.org/z", 2, 200, *ok, None),
        (5, "https://a.org/w", 3, 200, *ok, None), (5, "https://a.org/w", 1, 502, *bad, None), (6, "https://a.org/v", 1, None, None, None, None), (None, "https://a.org/n", 1, 204, None, None, None)]
    frame = spark.createDataFrame(rows, "id int, url string, attempt int, status int, content_type string, content binary, detail string")
    got = {r["id"]: (r["text"], r["error"]) for r in answers.answers(frame, ["id"]).collect()}
    assert got == {
        1: ("zweite é", None), 2: (None, "a.org:8080 failed after 2 attempts: HTTP 429 from a.org:8080"), 3: (None, "HTTP 403 from https://a.org/y?q=1"), 4: ("zweite é", None),
        5: (None, "a.org failed after 2 attempts: HTTP 502 from a.org"), 6: (None, "a.org failed after 2 attempts: no answer"), None: ("", None)}
    assert answers.answers(frame.limit(0), ["id"]).count() == 0


def test_charsets():
    assert answers.decoded("naïve €".encode("cp1252"), "ISO-8859-1") == "naïve €" and answers.decoded("é".encode(), None) == "é" and answers.decoded("é".encode(), "no-such") == "é"
    assert answers.decoded("日本".encode("shift_jis"), "Shift_JIS") == "日本" and answers.decoded(b"\xef\xbb\xbfab", "UTF-8") == "ab" and answers.decoded("ab".encode("utf-16-le"), "utf-16") == "ab"
    assert answers.decoded("aé".encode()[:2], None) == "a�" and answers.decoded(b"", None) == "" and answers.decoded(None, None) is None and answers.decoded(b"a", "base64") == "a"


def test_json(spark):
    rows = [(1, '{"a": [1, 2]}', None), (2, "<html>no \"json\"" + "x" * 200, None), (3, None, "HTTP 404 from https://a.org/3"), (4, "", None), (5, "7", None)]
    frame = spark.createDataFrame([(i, f"https://a.org/{i}", t, e) for i, t, e in rows], "id int, url string, text string, error string")
    got = {r["id"]: (r["v"], r["error"]) for r in answers.json_answers(frame, ["id"]).selectExpr("id", "to_json(json) as v", "error").collect()}
    assert got[1] == ('{"a":[1,2]}', None) and got[3] == (None, "HTTP 404 from https://a.org/3") and got[5] == ("7", None)
    assert got[2] == (None, 'a.org returned non-JSON: "<html>no \\"json\\"' + "x" * 85 + '"') and got[4] == (None, 'a.org returned non-JSON: ""')

"""A block on many pages of a large host is its template, however small its share."""

from quillspark.llm import html_text


def test_block_of_one_section_of_a_large_host(spark):
    notice = "<div><p>Notice of this section</p></div>"
    rows = [(i, f"http://big.example/{i}", f"<body>{notice if i % 12 == 0 else ''}<div><p>Text number {i}</p></div></body>") for i in range(720)]
    rows += [(1000 + i, f"http://small.example/{i}", f"<body>{'<div><p>Said twice</p></div>' if i < 2 else ''}<div><p>Text number {i}</p></div></body>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Text number {i}" for i in range(720))
    assert got[1000] == "Said twice\nText number 0" and got[1005] == "Text number 5" and len(got) == len(rows)

"""Captured HTTP answers: attempts put together to a text or an error of its class for each key."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import host_port

# Bytes that are read of an answer, and tries of a request.
MOST_BYTES, TRIES = 2_000_000, 2
# Names by which the browsers' standard means windows-1252, and the bytes that it has beside latin-1.
_WESTERN = frozenset("ascii us-ascii iso-8859-1 iso8859-1 latin1 l1 windows-1252 cp1252".split())
_EXTRA = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def decoded(data: bytes | None, charset: str | None) -> str | None:
    """Bytes as text, by a charset's name or else as UTF-8; what can't be read becomes U+FFFD, a byte order mark goes."""
    if data is None:
        return None
    name = (charset or "utf-8").lower()
    if name in _WESTERN:
        return data.decode("latin-1").translate(_EXTRA)
    try:
        name = {"utf-16": "utf-16-le"}.get(codecs.lookup(name).name, name)
        text = data.decode(name, "replace")
    except (LookupError, ValueError):
        text = data.decode("utf-8", "replace")
    return text.removeprefix("\ufeff")


@F.pandas_udf(T.StringType())
def _decoded(data: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([decoded(None if d is None else bytes(d), c) for d, c in zip(data, charset)], dtype=object)


def answers(attempts: DataFrame, keys: list[str], max_bytes: int = MOST_BYTES, tries: int = TRIES) -> DataFrame:
    """keys, url, text, error: what asking came to for each key; one of text and error is null.

    attempts: keys, url, attempt (from 1), status (null: no answer), content_type, content (bytes), detail (of no answer). The first attempt with a text
    or with a status of 400 to 499 other than 429 ends the asking; answers of 429, 500 and more, and none at all, are tried again, up to ``tries``.
    A text is the first max_bytes bytes by the charset of content_type. Contents travel once, with the attempt that counts.
    """
    status = F.col("status")
    kind = F.when(status.isNull() | (status == 429) | (status >= 500), "retry").when(status >= 400, "fatal").otherwise("ok")
    rows = attempts.where(F.col("attempt").between(1, tries)).withColumn("_kind", kind)
    # The earliest that ends the asking, or else the last: as one partial aggregate.
    order = F.struct((F.col("_kind") == "retry").alias("r"), F.when(F.col("_kind") == "retry", -F.col("attempt")).otherwise(F.col("attempt")).alias("a"))
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct("url", "status", "content_type", F.substring("content", 1, max_bytes).alias("content"), "detail", "_kind"), order).alias("x"), F.count("*").alias("_n"))
    host = host_port(F.col("x.url"))
    code = F.concat(F.lit("HTTP "), F.col("x.status").cast("string"), F.lit(" from "))
    last = F.when(F.col("x.status").isNull(), F.coalesce("x.detail", F.lit("no answer"))).otherwise(F.concat(code, host))
    failed = F.concat(host, F.lit(f" failed after {tries} attempts: "), last)
    error = F.when(F.col("x._kind") == "fatal", F.concat(code, "x.url")).when(F.col("x._kind") == "retry", failed)
    charset = F.nullif(F.regexp_extract(F.coalesce("x.content_type", F.lit("")), r"(?i)charset=([\w-]+)", 1), F.lit(""))
    return picked.select(*keys, "x.url", F.when(F.col("x._kind") == "ok", _decoded(F.coalesce("x.content", F.lit(b"")), charset)).alias("text"), error.alias("error"))


def json_answers(answered: DataFrame, keys: list[str]) -> DataFrame:
    """keys, url, text, json (VARIANT), error: as answers(), a text that is no JSON being an error with its beginning."""
    parsed = F.try_parse_json("text")
    begins = F.to_json(F.struct(F.substring("text", 1, 100).alias("x")))
    quoted = F.regexp_extract(begins, r'(?s)^\{"x":(.*)\}\z', 1)
    broken = F.concat(host_port(F.col("url")), F.lit(" returned non-JSON: "), quoted)
    return answered.select(*keys, "url", F.when(parsed.isNotNull(), F.col("text")).alias("text"), parsed.alias("json"), F.coalesce("error", F.when(parsed.isNull(), broken)).alias("error"))

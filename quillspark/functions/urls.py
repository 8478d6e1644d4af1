"""Addresses: hosts, canonical forms, trust and blocking, as Columns. Broken addresses never throw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BLOCKED, DEFAULT_TRUST, LOW_QUALITY, LOW_TRUST, TRACKING, TRUSTED

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)((?::[0-9]+)?)([^?#]*)\??([^#]*)"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), _PARTS, i)


def host(url: Column, strip_www: bool = True) -> Column:
    """Lower-cased host, or the empty string."""
    h = F.regexp_replace(F.lower(_part(url, 2)), r"^\[|\]\z", "")
    return F.regexp_replace(h, r"^www\.", "") if strip_www else h


def host_port(url: Column) -> Column:
    """Lower-cased host with the port, where one is named."""
    return F.lower(F.concat(_part(url, 2), _part(url, 3)))


def origin(url: Column) -> Column:
    return F.lower(F.concat(_part(url, 1), F.lit("://"), _part(url, 2), _part(url, 3)))


def path_query(url: Column) -> Column:
    """Path and query, as robots rules see them."""
    return F.concat(F.when(_part(url, 4) == "", "/").otherwise(_part(url, 4)), F.when(_part(url, 5) == "", "").otherwise(F.concat(F.lit("?"), _part(url, 5))))


def canonical_url(url: Column) -> Column:
    path = F.regexp_replace(_part(url, 4), r"/+\z", "")
    kept = F.array_join(F.filter(F.split(_part(url, 5), "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(TRACKING)), "&")
    made = F.concat(F.lower(_part(url, 1)), F.lit("://"), F.regexp_replace(F.lower(F.concat(_part(url, 2), _part(url, 3))), r"^www\.", ""), F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(_part(url, 2) == "", url).otherwise(made)


def is_private_host(url: Column) -> Column:
    h = host(url, strip_www=False)
    octet = lambda i: F.regexp_extract(h, r"^(\d{1,9})\.(\d{1,9})\.(\d{1,9})\.(\d{1,9})\z", i).try_cast("int")
    a, b = octet(1), octet(2)
    v4 = a.isin(10, 127, 0) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a >= 224)
    v6 = h.isin("::1", "::") | h.rlike("^(fc|fd|fe[89ab])")
    return (h == "") | (h == "localhost") | h.rlike(r"\.(local|internal|localhost)\z") | F.coalesce(v4, F.lit(False)) | (h.contains(":") & v6)


def is_binary(url: Column) -> Column:
    return url.rlike(r"(?i)\.(pdf|zip|mp4|mp3|png|jpe?g)(\?|\z)")


def safe_url(url: Column) -> Column:
    """An http(s) address without characters that could leave an attribute; else the empty string."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?U)^\s+|\s+\z", "")
    out = u
    for c in " \t\n\r\f\v<>\"'`()":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.when(u.rlike("(?i)^https?://"), out).otherwise("")


def suffixes(h: Column) -> Column:
    """Struct array of a host's domains: the host, what follows its first dot, and so on; proper: all but the host."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("domain"), (i > 1).alias("proper")))


def trust_table(spark) -> DataFrame:
    """domain, score, class (trusted, low, blocked). A leading dot stands for proper ends of a host only."""
    rows = [(d, s, "trusted") for d, s in TRUSTED.items()] + [(d, LOW_TRUST, "low") for d in LOW_QUALITY] + [(d, 0.0, "blocked") for d in BLOCKED]
    return spark.createDataFrame(rows, "domain string, score double, class string")


def with_trust(rows: DataFrame, url: str, table: DataFrame | None = None, most_rows: int = 1_000_000) -> DataFrame:
    """rows with host, trust and blocked, by the ends of the host: each distinct host is joined once, on equal domains.

    A table of up to most_rows is sent to every task; a larger one is joined by shuffle.
    """
    table = trust_table(rows.sparkSession) if table is None else table
    small = table.limit(most_rows + 1).count() <= most_rows
    hosted = rows.withColumn("host", host(F.col(url)))
    ends = hosted.select("host").distinct().where("host <> ''").select("host", F.explode(suffixes(F.col("host"))).alias("s"))
    keyed = table.select(F.regexp_replace("domain", r"^\.", "").alias("key"), F.col("domain").startswith(".").alias("dotted"), "score", "class")
    met = ends.join(F.broadcast(keyed) if small else keyed, F.col("s.domain") == F.col("key")).where(~F.col("dotted") | F.col("s.proper"))
    best = met.groupBy("host").agg(F.max(F.when(F.col("class") == "trusted", F.col("score"))).alias("best"), F.max(F.col("class") == "low").alias("low"), F.max(F.col("class") == "blocked").alias("blocked"))
    out = hosted.join(best, "host", "left")
    trust = F.when(F.col("low"), LOW_TRUST).otherwise(F.greatest(F.lit(DEFAULT_TRUST), F.coalesce("best", F.lit(DEFAULT_TRUST))))
    return out.select(*rows.columns, "host", trust.alias("trust"), F.coalesce("blocked", F.lit(False)).alias("blocked"))

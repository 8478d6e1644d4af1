"""Queries over the driver's tables, one or more for each operator, and their DuckDB equivalents.

Small inputs that the tables can't give are inline rows, the same for both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import BLOCKED, DEAD_MARKERS, EXPLICIT_WORDS, LOW_QUALITY, STOPWORDS, TRUSTED
from .functions import media, safety, text as tx, urls
from .operators import citations, dedup, index, passages as pg, protocols, ranking, substring
from .plans import briefing, render
from .sources import pages as pages_, store
from .sources.shared import kept, new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
YEAR = 2025


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) v({names})"


# ---- DuckDB text expressions -------------------------------------------------------------------------
STOP_SQL = "[" + ", ".join(map(quoted, STOPWORDS)) + "]"


def words_sql(x: str, keep: bool = False, least: int = 2) -> str:
    raw = rf"list_transform(regexp_extract_all(coalesce({x}, ''), '[A-Za-z0-9][A-Za-z0-9''\-]*'), lambda t: regexp_replace(lower(t), '^[-'']+|[-'']+$', '', 'g'))"
    return f"list_filter({raw}, lambda t: length(t) >= {least}" + ("" if keep else f" AND NOT list_contains({STOP_SQL}, t)") + ")"


def stems_sql(x: str) -> str:
    cut = lambda n: f"left(t, length(t) - {n})"
    one = f"CASE WHEN length(t) <= 3 THEN t WHEN t LIKE '%ies' THEN {cut(3)} || 'y' WHEN regexp_matches(t, '(sses|xes|zes|ches|shes)$') THEN {cut(2)} WHEN t LIKE '%s' AND NOT regexp_matches(t, '(ss|us|is)$') THEN {cut(1)} ELSE t END"
    two = "CASE " + " ".join(f"WHEN t LIKE '%{s}' AND length(t) >= {len(s) + 3} THEN {cut(len(s))}" for s in ("ingly", "edly", "ing", "ed")) + " ELSE t END"
    three = f"CASE WHEN length(t) > 3 AND t LIKE '%e' THEN {cut(1)} ELSE t END"
    four = f"CASE WHEN length(t) > 3 AND right(t, 1) = left(right(t, 2), 1) AND right(t, 1) NOT IN ('l', 's', 'z') THEN {cut(1)} ELSE t END"
    for step in (one, two, three, four):
        x = f"list_transform({x}, lambda t: {step})"
    return x


def tokens_sql(x: str, keep: bool = False) -> str:
    return stems_sql(words_sql(x, keep))


def hits_sql(terms: str, x: str) -> str:
    return f"len(list_filter({stems_sql(terms)}, lambda s: list_contains({tokens_sql(x, True)}, s)))"


# ---- scalars over documents --------------------------------------------------------------------------
TERMS = ["license", "released", "mit", "apache"]
TERMS_SQL = "['license', 'released', 'mit', 'apache']"
terms_ = lambda: F.array(*map(F.lit, TERMS))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY ALL")
def t01_tokenize_tf(spark, d):
    return ranking.term_counts(table(spark, d, "documents"), ["doc_id"]).select("doc_id", "term", "tf")


@query(f"SELECT doc_id, len({words_sql('text', True)}) - len({words_sql('text')}) AS stop_words FROM documents")
def t02_stopword_count(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", (F.size(tx.words(t, True)) - F.size(tx.words(t))).cast("long").alias("stop_words"))


STEMS = [(w,) for w in "cuts cutting running rates rate studies ties classes class boxes bus status analysis using seed agreed falling exceedingly supposedly".split()]


@query(f"SELECT word, {stems_sql('[word]')}[1] AS stem FROM {values(STEMS, 'word')}")
def t03_stem_pairs(spark, d):
    return spark.createDataFrame(STEMS, "word string").select("word", tx.stem(F.col("word")).alias("stem"))


@query(f"""SELECT item_id, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i)[1:8], lambda i: w[i]), ' ') AS terms
FROM (SELECT item_id, {words_sql('text', least=3)} AS w FROM benchmark)""")
def t04_keyword_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(tx.keyword_terms(F.col("text"), 8), " ").alias("terms"))


@query(f"SELECT doc_id, {hits_sql(TERMS_SQL, 'text')} AS hits FROM documents")
def t05_term_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.term_hits(terms_(), F.col("text")).cast("long").alias("hits"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def t07_squash(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.squash(F.col("text")).alias("text"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def t09_esc(spark, d):
    return table(spark, d, "pages").select("page_id", tx.esc(F.col("html")).alias("escaped"))


HOST_SQL = r"regexp_replace(lower(regexp_extract(url, '^\w+://([^/?#:]*)', 1)), '^www\.', '')"


@query(f"SELECT page_id, {HOST_SQL} AS host FROM pages")
def t10_host(spark, d):
    return table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


CANON_SQL = r"""(SELECT page_id, html, lower(u.s) || '://' || regexp_replace(lower(u.a), '^www\.', '') || CASE WHEN regexp_replace(u.p, '/+$', '') = '' THEN '/' ELSE regexp_replace(u.p, '/+$', '') END
  || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical FROM (SELECT *, array_to_string(list_filter(string_split(u.q, '&'), lambda x: x <> '' AND NOT regexp_matches(regexp_extract(x, '^[^=]*'), '(?i)^(utm_|fbclid|gclid|mc_|ref$|ref_|cmpid|igshid|yclid|_hs)')), '&') AS q
  FROM (SELECT page_id, html, regexp_extract(url, '^(\w+)://([^/?#]*)([^?#]*)\??([^#]*)', ['s', 'a', 'p', 'q']) AS u FROM pages)))"""


@query(f"SELECT page_id, canonical FROM {CANON_SQL}")
def t11_canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT min(page_id) AS page_id, canonical FROM {CANON_SQL} GROUP BY canonical")
def d03_first_wins_canonical(spark, d):
    rows = table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))
    return dedup.first_of_each(rows, ["canonical"], ["page_id"])


ADDRESSES = [("http://localhost/x", True), ("http://10.1.2.3/", True), ("http://172.20.0.1", True), ("http://172.40.0.1", False), ("http://8.8.8.8", False), ("http://[::1]/", True), ("http://a.internal", True), ("bad", True), ("https://example.org", False), ("http://224.0.0.1", True), ("http://169.254.1.1", True)]


@query(f"SELECT url, expected AS private FROM {values(ADDRESSES, 'url, expected')}")
def t12_private_host(spark, d):
    return spark.createDataFrame([(u,) for u, _ in ADDRESSES], "url string").select("url", urls.is_private_host(F.col("url")).alias("private"))


DATES = [("20240105T101112Z", "2024-01-05"), ("Tue, 02 Jan 2024 10:00:00 GMT", "2024-01-02"), ("2024-03-04T05:06:07Z", "2024-03-04"), ("2023-12-31", "2023-12-31"), ("2 years ago", ""), ("", "")]


@query(f"SELECT value, expected AS date FROM {values(DATES, 'value, expected')}")
def t13_parse_date(spark, d):
    return spark.createDataFrame([(v,) for v, _ in DATES], "value string").select("value", media.parse_date(F.col("value")).alias("date"))


DURATIONS = [("PT1H2M3S", 3723), ("1:02:03", 3723), ("4:05", 245), ("90", 90), ("x", 0), ("PT45S", 45), ("", 0)]


@query(f"SELECT value, seconds FROM {values(DURATIONS, 'value, seconds')}".replace("seconds FROM", "CAST(seconds AS BIGINT) AS seconds FROM"))
def t14_parse_duration(spark, d):
    return spark.createDataFrame([(v,) for v, _ in DURATIONS], "value string").select("value", media.parse_duration(F.col("value")).alias("seconds"))


@query("""SELECT event_id, CASE WHEN s <= 0 THEN 'length unknown' WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(((s % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS length
FROM (SELECT event_id, (event_id * 37) % 9000 AS s FROM events)""")
def t15_fmt_duration(spark, d):
    return table(spark, d, "events").select("event_id", media.fmt_duration(F.col("event_id") * 37 % 9000).alias("length"))


STAMPS = [("1:02:03", 3723), ("75:00", 4500), ("1:2", None), ("0:09", 9), ("x", None)]


@query(f"SELECT value, CAST(seconds AS BIGINT) AS seconds FROM {values(STAMPS, 'value, seconds')}")
def t16_parse_timestamp(spark, d):
    return spark.createDataFrame([(v,) for v, _ in STAMPS], "value string").select("value", media.parse_timestamp(F.col("value")).alias("seconds"))


@query("SELECT event_id, 'https://www.youtube.com/watch?v=v' || event_id || CASE WHEN event_id % 5 > 0 THEN '&t=' || (event_id % 5) || 's' ELSE '' END AS url FROM events")
def t17_video_url(spark, d):
    return table(spark, d, "events").select("event_id", media.video_url(F.concat(F.lit("v"), F.col("event_id").cast("string")), F.col("event_id") % 5).alias("url"))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN replace(replace(replace(replace(url, ' ', '%20'), '<', '%3C'), '(', '%28'), ')', '%29') ELSE '' END AS url FROM pages""")
def t18_safe_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.safe_url(F.col("url")).alias("url"))


@query("""SELECT doc_id, coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(left(text, 80)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-+$', ''), ''), 'topic') AS slug FROM documents""")
def t19_slugify(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.slugify(F.substring("text", 1, 80)).alias("slug"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'high' ELSE 'unverified' END AS label FROM labels")
def t20_reliability_label(spark, d):
    return table(spark, d, "labels").select("doc_id", tx.reliability_label(F.when(F.col("quality") == 1, 0.8).otherwise(0.4)).alias("label"))


@query(r"""SELECT doc_id, CASE WHEN length(t) <= 320 THEN t WHEN length(regexp_extract(t, '(?s)^(.{0,320}\. )', 1)) - 2 > 120 THEN left(t, length(regexp_extract(t, '(?s)^(.{0,320}\. )', 1)) - 1) ELSE rtrim(left(t, 320)) || '...' END AS excerpt
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def t21_excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


@query(f"SELECT doc_id, round(greatest(0.0, 0.1 - 0.01 * greatest(0, {YEAR} - (2010 + doc_id % 20))), 6)::DOUBLE AS bonus FROM documents")
def t22_recency(spark, d):
    date = F.concat((2010 + F.col("doc_id") % 20).cast("string"), F.lit("-05-05"))
    return table(spark, d, "documents").select("doc_id", F.round(media.recency_bonus(date, YEAR), 6).alias("bonus"))


EXTRA_TRUST = [("example.org", 0.7, "trusted"), (".example.net", 0.8, "trusted"), ("example.com", 0.2, "low")]
TRUST_SQL = values([(k, v, "trusted") for k, v in TRUSTED.items()] + [(k, 0.2, "low") for k in LOW_QUALITY] + [(k, 0.0, "blocked") for k in BLOCKED] + EXTRA_TRUST, "domain, score, class")
MATCH_SQL = "(h = domain OR h LIKE '%.' || domain OR (domain LIKE '.%' AND h LIKE '%' || domain))"


def _trust(spark):
    return urls.trust_table(spark).unionByName(spark.createDataFrame(EXTRA_TRUST, "domain string, score double, class string"))


@query(f"""WITH p AS (SELECT page_id, {HOST_SQL} AS h FROM pages), m AS (SELECT page_id, domain, score, class FROM p JOIN {TRUST_SQL} ON {MATCH_SQL})
SELECT page_id, h AS host, CASE WHEN (SELECT count(*) FROM m WHERE m.page_id = p.page_id AND class = 'low') > 0 THEN 0.2 ELSE greatest(0.5, coalesce((SELECT max(score) FROM m WHERE m.page_id = p.page_id AND class = 'trusted'), 0.5)) END::DOUBLE AS trust FROM p""")
def t23_domain_trust(spark, d):
    return urls.with_trust(table(spark, d, "pages").select("page_id", "url"), "url", _trust(spark)).select("page_id", "host", "trust")


COMPLETIONS = [("<think>a\nb</think> hello ", "hello"), ("```md\n# A\nb\n```", "# A\nb"), ("plain", "plain"), ("x ```y```", "x ```y```")]


@query(f"SELECT raw, clean FROM {values(COMPLETIONS, 'raw, clean')}")
def t24_clean_completion(spark, d):
    return spark.createDataFrame([(r,) for r, _ in COMPLETIONS], "raw string").select("raw", tx.clean_completion(F.col("raw")).alias("clean"))


NAMES = [(1, "Ada L"), (2, "Ada L, Bob M, Cy N"), (3, "Ada L, Bob M, Cy N et al."), (4, "")]


@query(f"SELECT CAST(id AS INTEGER) AS id, line FROM {values(NAMES, 'id, line')}")
def s09_authors_line(spark, d):
    rows = [(1, ["Ada L", ""]), (2, ["Ada L", "Bob M", None, "Cy N"]), (3, ["Ada L", "Bob M", "Cy N", "Di O"]), (4, [])]
    return spark.createDataFrame(rows, "id int, names array<string>").select("id", tx.authors_line(F.col("names")).alias("line"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Encyclopedia' WHEN 1 THEN 'Web page' WHEN 2 THEN 'Research paper' WHEN 3 THEN 'News' ELSE 'podcast' END AS label FROM documents")
def t31_kind_label(spark, d):
    kinds = F.array(*map(F.lit, ("encyclopedia", "web", "academic", "news", "podcast")))
    return table(spark, d, "documents").select("doc_id", tx.kind_label(F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int"))).alias("label"))


@query("SELECT event_id, CASE WHEN date_trunc('day', ts) + INTERVAL 8 HOUR > ts THEN date_trunc('day', ts) + INTERVAL 8 HOUR ELSE date_trunc('day', ts) + INTERVAL 32 HOUR END AS next FROM events")
def t32_next_run(spark, d):
    return table(spark, d, "events").select("event_id", media.next_run(F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("next"))


# ---- predicates --------------------------------------------------------------------------------------
@query("SELECT doc_id FROM documents WHERE length(text) < 600 OR " + " OR ".join(f"contains(lower(left(text, 500)), {quoted(m)})" for m in DEAD_MARKERS))
def f03_looks_dead(spark, d):
    return table(spark, d, "documents").where(safety.looks_dead(F.col("text"))).select("doc_id")


@query(r"SELECT page_id, regexp_matches(url, '(?i)\.(pdf|zip|mp4|mp3|png|jpe?g)(\?|$)') AS is_binary FROM pages")
def f04_binary(spark, d):
    return table(spark, d, "pages").select("page_id", urls.is_binary(F.col("url")).alias("is_binary"))


@query(f"SELECT doc_id FROM documents WHERE doc_id % 4 NOT IN (2, 3) OR {hits_sql(TERMS_SQL, 'left(text, 60)')} >= 1 OR {hits_sql(TERMS_SQL, 'left(text, 1500)')} >= 2")
def f01_relevant(spark, d):
    kinds = F.array(*map(F.lit, ("encyclopedia", "web", "academic", "news")))
    kind = F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").where(safety.is_relevant(kind, terms_(), F.substring("text", 1, 60), F.col("text"))).select("doc_id")


# ---- ranking -----------------------------------------------------------------------------------------
QUERY = "license released mit apache unknownword"
BM25_SQL = f"""toks AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents), lens AS (SELECT doc_id, greatest(len(t), 1) AS len FROM toks), stats AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens),
terms AS (SELECT DISTINCT unnest({tokens_sql(quoted(QUERY))}) AS term), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) JOIN terms USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scores AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score FROM tf JOIN df USING (term) JOIN lens USING (doc_id), stats GROUP BY doc_id)"""


def _bm25(spark, d):
    queries = spark.createDataFrame([(QUERY,)], "query string")
    return ranking.bm25(table(spark, d, "documents").select("doc_id", "text"), queries, ["doc_id"], [], [])


@query(f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM scores ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def j06_bm25_documents(spark, d):
    return _bm25(spark, d).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


ITEMS_SQL = f"""toks AS (SELECT doc_id, source, {tokens_sql('text')} AS t FROM documents), lens AS (SELECT doc_id, source, greatest(len(t), 1) AS len FROM toks), stats AS (SELECT source, count(*) AS n, avg(len) AS avg_len FROM lens GROUP BY source),
terms AS (SELECT DISTINCT item_id, 'src' || (item_id % 20) AS source, unnest({tokens_sql('text')}) AS term FROM benchmark), tf AS (SELECT doc_id, source, term, count(*) AS tf FROM (SELECT doc_id, source, unnest(t) AS term FROM toks) GROUP BY ALL),
df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL),
found AS (SELECT item_id, source, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM terms JOIN tf USING (source, term) JOIN df USING (source, term) JOIN lens USING (doc_id, source) JOIN stats USING (source) GROUP BY ALL)"""


@query(f"WITH {ITEMS_SQL} SELECT item_id, source, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM found QUALIFY place <= 10")
def j06_index_search(spark, d):
    """Each benchmark item searched among the documents of one source, over a kept index."""
    made = _index(spark, d)
    asked = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("src"), F.pmod("item_id", F.lit(20)).cast("string")).alias("source"), F.col("text").alias("query"))
    return made.search(asked, ["item_id"], 10).select("item_id", "source", "doc_id", "score", F.col("rank").cast("long").alias("place"))


@query("WITH " + ITEMS_SQL + " SELECT source, term, df FROM df")
def a03_index_df(spark, d):
    return _index(spark, d).frequencies


def _index(spark, d) -> index.Index:
    """The index of all documents, one pool for each source."""
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    return index.build(docs, ["source", "doc_id"], ["source"], new_folder(spark, "index"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY term")
def a03_df(spark, d):
    return ranking.term_counts(table(spark, d, "documents"), ["doc_id"]).groupBy("term").agg(F.count("*").alias("df"))


@query(f"SELECT doc_id, greatest(len({tokens_sql('text')}), 1) AS len FROM documents")
def a02_passage_length(spark, d):
    return table(spark, d, "documents").select("doc_id", F.greatest(F.size(tx.tokens(F.col("text"))), F.lit(1)).cast("long").alias("len"))


COVER = [(0, "license"), (1, "mit license"), (2, "apache released"), (3, "zzzq")]


@query(f"""WITH t AS (SELECT ord, term, list_distinct({tokens_sql('term', True)}) AS p FROM {values(COVER, 'ord, term')}), d AS (SELECT doc_id, {tokens_sql('text', True)} AS k FROM documents),
c AS (SELECT ord, term, count(*) FILTER (WHERE list_has_all(k, p)) AS coverage FROM t, d GROUP BY ALL) SELECT CAST(ord AS INTEGER) AS ord, term, coverage FROM c WHERE coverage > 0""")
def a05_term_coverage(spark, d):
    terms = spark.createDataFrame(COVER, "ord int, term string")
    return ranking.term_coverage(terms, table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text"), []).select("ord", "term", "coverage")


SOURCE_SQL = f"""src AS (SELECT doc_id AS ord, ['encyclopedia', 'web', 'academic', 'news'][doc_id % 4 + 1] AS kind, left(string_split(text, chr(10))[1], 60) AS title, text, 2015 + doc_id % 10 AS y, doc_id % 100 AS cited FROM documents),
rel AS (SELECT *, {hits_sql(TERMS_SQL, "title || ' ' || left(replace(text, chr(10), chr(10) || chr(10)), 800)")} / 4.0 AS relevance FROM src),
ranked AS (SELECT *, 0.45 * 0.5 + 0.45 * relevance + greatest(0.0, 0.1 - 0.01 * greatest(0, {YEAR} - y)) + log10(cited + 1) / 10 AS rank FROM rel)"""
KIND_SQL = "list_position(['encyclopedia', 'web', 'academic', 'news'], kind)"


def _ranked(spark, d):
    rows = briefing.document_sources(table(spark, d, "documents"))
    rows = rows.withColumn("relevance", ranking.relevance(terms_(), F.col("title"), F.col("text")))
    return rows.withColumn("rank", F.round(ranking.source_rank(F.col("trust"), F.col("relevance"), F.col("date"), F.col("cited_by"), YEAR), 9))


@query(f"WITH {SOURCE_SQL} SELECT ord, round(relevance, 6) AS relevance, round(rank, 6) AS rank FROM ranked")
def r02_relevance(spark, d):
    return _ranked(spark, d).select("ord", F.round("relevance", 6).alias("relevance"), F.round("rank", 6).alias("rank"))


CAPS_SQL = "CASE kind WHEN 'encyclopedia' THEN 2 WHEN 'web' THEN 8 WHEN 'academic' THEN 9 ELSE 6 END"
TOP_SQL = f"top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(rank, 9) DESC, ord) AS place FROM ranked) WHERE place <= {CAPS_SQL})"
CAPS = {"encyclopedia": 2, "web": 8, "academic": 9, "news": 6}


@query(f"WITH {SOURCE_SQL}, {TOP_SQL} SELECT kind, place, ord FROM top")
def r03_topk_per_kind(spark, d):
    return ranking.top_per_kind(_ranked(spark, d), CAPS, ["topic_id"]).select("kind", F.col("place").cast("long").alias("place"), "ord")


@query(f"WITH {SOURCE_SQL}, {TOP_SQL} SELECT row_number() OVER (ORDER BY {KIND_SQL}, place) AS id, ord FROM top")
def r04_dense_ids(spark, d):
    return ranking.dense_ids(ranking.top_per_kind(_ranked(spark, d), CAPS, ["topic_id"]), ["topic_id"]).select(F.col("id").cast("long").alias("id"), "ord")


@query(f"""WITH {BM25_SQL}, s AS (SELECT doc_id, doc_id % 20 AS source_id, round(score, 6) AS score FROM scores), c AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, doc_id) AS r FROM s)
SELECT doc_id, score FROM c WHERE r <= 2 ORDER BY score DESC, source_id, doc_id LIMIT 12""")
def r06_per_source_cap(spark, d):
    rows = _bm25(spark, d).select(F.lit(1).alias("g"), (F.col("doc_id") % 20).alias("source_id"), F.col("doc_id").alias("idx"), F.round("score", 6).alias("score"))
    return ranking.best_passages(rows, ["g"], 12, 2).select(F.col("idx").alias("doc_id"), "score")


@query()
def r06_budgeted(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    named = [F.lit(1).alias("g"), (F.col("doc_id") % 20).alias("source_id"), F.col("doc_id").alias("idx"), "text"]
    rows = _bm25(spark, d).join(docs, "doc_id").select(*named, F.round("score", 6).alias("score"))
    return ranking.budgeted_passages(rows, ["g"], 12, 2, 12_000, docs.select(*named)).select("source_id", "idx", "score")


VIDEOS = [(1, "license talk", "mit license", 600, 999999, "TED", "https://v/1"), (2, "license", "", 60, 5, "a", "https://v/2"), (3, "apache", "apache", 7000, 0, "b", "https://v/shorts/3"), (4, "released mit", "", 0, 100, "ted", "https://v/4"), (5, "none", "none", 400, 1, "c", "https://v/5")]


@query()
def r08_video_score(spark, d):
    v = spark.createDataFrame(VIDEOS, "ord int, title string, text string, seconds int, views bigint, publisher string, url string")
    return v.select("ord", F.round(ranking.video_score(terms_(), F.col("title"), F.col("text"), F.col("seconds"), F.col("views"), F.col("publisher"), F.col("url")), 6).alias("score"))


@query()
def r09_pick_videos(spark, d):
    v = spark.createDataFrame(VIDEOS, "ord int, title string, text string, seconds int, views bigint, publisher string, url string").withColumn("topic_id", F.lit(1))
    args = (terms_(), F.col("title"), F.col("text"), F.col("seconds"))
    good = v.where(ranking.is_eligible_video(*args, F.col("url"))).withColumn("score", ranking.video_score(*args, F.col("views"), F.col("publisher"), F.col("url")))
    return ranking.pick_videos(good, ["topic_id"], 4).select("ord", "place", "relevance")


# ---- joins, dedup, store -----------------------------------------------------------------------------
@query()
def d02_greedy_dedup(spark, d):
    rows = table(spark, d, "pages").select(F.lit(1).alias("topic_id"), F.col("page_id").alias("ord"), "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return dedup.greedy_two_key(rows, ["topic_id"]).select("ord")


AS_OF = "2024-01-31 00:00:00"


@query(f"SELECT event_id FROM events WHERE epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) <= CASE event_type WHEN 'click' THEN 720 WHEN 'view' THEN 24 ELSE 168 END * 3600000000")
def s21_ttl_cache(spark, d):
    return store.fresh(table(spark, d, "events"), AS_OF, {"click": 720, "view": 24}, "event_type", "ts").select("event_id")


@query("SELECT event_type AS ns, user_id AS key, ts AS t, props AS v FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1")
def k01_latest_per_key(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("ns"), F.col("user_id").alias("key"), F.col("ts").alias("t"), F.col("props").alias("v"), "event_id")
    return store.latest(rows, ["ns", "key"], "t", "event_id").drop("event_id")


@query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY")
def k02_prune(spark, d):
    return store.pruned(table(spark, d, "events"), AS_OF, 10, "ts").select("event_id")


@query("SELECT DISTINCT lower(event_type) AS topic FROM events")
def k05_distinct_topics(spark, d):
    return store.studied(table(spark, d, "events").select(F.col("event_type").alias("topic")))


# ---- citations and protocols -------------------------------------------------------------------------
CITED = [(0, "x [S7] y [S3][S7]"), (1, "z [S9] [S3]"), (2, "none")]


@query(f"""WITH c AS (SELECT ord, unnest(range(1, len(i) + 1)) AS pos, unnest(i) AS id FROM (SELECT ord, regexp_extract_all(text, '\\[S(\\d+)\\]', 1) AS i FROM {values(CITED, 'ord, text')}))
SELECT id::BIGINT AS id, row_number() OVER (ORDER BY min(ord * 1000 + pos)) AS n FROM c GROUP BY id""")
def c04_renumber(spark, d):
    rows = spark.createDataFrame(CITED, "ord int, text string").withColumn("report", F.lit(1))
    return citations.renumber(rows, ["report"], ["ord"]).select("id", F.col("n").cast("long").alias("n"))


GROUPS = [("a [S1, s2] b 【s3】 c [S4;S5&S6]", "a [S1][S2] b [S3] c [S4][S5][S6]"), ("none", "none")]


@query(f"SELECT raw, text FROM {values(GROUPS, 'raw, text')}")
def c01_normalize(spark, d):
    return spark.createDataFrame([(r,) for r, _ in GROUPS], "raw string").select("raw", citations.normalize(F.col("raw")).alias("text"))


@query("SELECT 'Fact one [S1]. Two [S2]' AS text, 2::BIGINT AS removed")
def c02_strip_invalid(spark, d):
    r = spark.createDataFrame([("Fact one [S1] [S9]. Two [S2,S9]",)], "t string").select(citations.strip_invalid(F.col("t"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("r"))
    return r.select("r.text", "r.removed")


@query("SELECT 'x [1] y [2][1] ' AS text")
def c05_apply_mapping(spark, d):
    m = F.create_map(F.lit(7).cast("long"), F.lit(1), F.lit(3).cast("long"), F.lit(2))
    return spark.createDataFrame([("x [S7] y [S3][S7] [S8]",)], "t string").select(citations.apply_mapping(F.col("t"), m).alias("text"))


@query()
def c07_support_check(spark, d):
    """Every sentence of every document, each tagged with the document of the next doc_id (the smallest, where there is none)."""
    docs = briefing.document_sources(table(spark, d, "documents"))
    ids = docs.select("ord").distinct()
    after = ids.select((F.col("ord") - 1).alias("ord"), F.col("ord").alias("cited"))
    cites = ids.join(after, "ord", "left").crossJoin(F.broadcast(ids.agg(F.min("ord").alias("least")))).select("ord", F.coalesce("cited", "least").alias("cited"))  # least is one row
    tag = F.concat(F.lit(" [S"), F.col("cited").cast("string"), F.lit("]"))
    tagged = F.array_join(F.transform(F.split("text", "\n"), lambda line: F.array_join(F.transform(citations.sentences(line), lambda x: F.concat(x, tag)), "")), "\n")
    texts = docs.join(cites, "ord").select("topic_id", F.col("ord").alias("text_ord"), tagged.alias("text"))
    return citations.support_check(texts, docs.select("topic_id", F.col("ord").alias("source_id"), "text"), ["topic_id"]).select("text_ord", "ord", "sentence", F.round("overlap", 6).alias("overlap"), "flagged")


@query("SELECT item_id, left(text, 80) AS q1, left(text, 80) || ' explained' AS q2, 3::BIGINT AS n FROM benchmark")
def p01_fallback_plan(spark, d):
    plan = protocols.build_plan(F.substring("text", 1, 80), F.lit(None).cast("string"), 3)
    return table(spark, d, "benchmark").select("item_id", plan.alias("p")).select("item_id", F.get("p.queries", F.lit(0)).alias("q1"), F.get("p.queries", F.lit(1)).alias("q2"), F.size("p.queries").cast("long").alias("n"))


REPLY = "QUERY: a b\n- **QUERY**: \"A B\"\n2. QUESTION: why?\nTERM: t1\nterm: T1\nTERM: t2\nx"


@query("SELECT 'a b' AS queries, 'why?' AS questions, 't1,t2' AS terms")
def p02_parse_plan(spark, d):
    r = spark.createDataFrame([(REPLY,)], "t string")
    return r.select(*(F.array_join(protocols.parse_plan(F.col("t"), k), ",").alias(n) for k, n in (("QUERY", "queries"), ("QUESTION", "questions"), ("TERM", "terms"))))


@query("SELECT 'Alpha' AS term, 'first thing [S1]' AS definition UNION ALL SELECT 'Beta', 'second'")
def p08_parse_glossary(spark, d):
    r = spark.createDataFrame([("- **Alpha** :: first thing [S1] [S9]\n1. Beta :: second\nalpha :: again\nno",)], "t string")
    return r.select(F.explode(protocols.parse_glossary(F.col("t"), F.array(F.lit(1).cast("long")))).alias("g")).select("g.term", "g.definition")


@query("SELECT 'one?' AS question, 'yes' AS answer UNION ALL SELECT 'two?', 'no'")
def p09_parse_quiz(spark, d):
    return spark.createDataFrame([("Q:: one? || A:: yes [S1]\nA:: stray\n2. Q:: two?\nA:: no",)], "t string").select(F.explode(protocols.parse_quiz(F.col("t"))).alias("q")).select("q.question", "q.answer")


@query("SELECT 'T1' AS topic, 'w1' AS why UNION ALL SELECT 'T2', 'w2'")
def p10_parse_next(spark, d):
    return spark.createDataFrame([("NEXT:: T1 | w1\n- NEXT:: **T2** — w2\nNEXT:: bad",)], "t string").select(F.explode(protocols.parse_next(F.col("t"))).alias("n")).select("n.topic", "n.why")


@query("SELECT 's' AS summary, 65::BIGINT AS second, 'k' AS text")
def p11_parse_video(spark, d):
    r = spark.createDataFrame([("SUMMARY:: s\nKEYPOINT:: 1:05 | k\nKEYPOINT:: 9:00 - late",)], "t string").select(protocols.parse_video(F.col("t"), F.lit(100)).alias("v"))
    return r.select("v.summary", F.explode("v.points").alias("p")).select("summary", "p.second", "p.text")


def _lines_sql(segments: str, key: str) -> str:
    """seg (key, i, start, text) walked one by one: lines (key, line, start, text, n)."""
    full = "w.start - w.began >= 30"
    return f"""seg AS ({segments}), w AS (SELECT {key}, i, start AS began, start, 1 AS line, text FROM seg WHERE i = 1 UNION ALL
SELECT s.{key}, s.i, CASE WHEN {full} THEN s.start ELSE w.began END, s.start, CASE WHEN {full} THEN line + 1 ELSE line END, s.text FROM w JOIN seg s ON s.{key} = w.{key} AND s.i = w.i + 1),
lines AS (SELECT {key}, line, min(began) AS start, string_agg(text, ' ' ORDER BY i) AS text, count(*) AS n FROM w GROUP BY ALL)"""


STAMP_SQL = "CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(((s % 3600) // 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0')"


@query(f"""WITH RECURSIVE {_lines_sql("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i, turn * 10.0 AS start, text FROM conversations", "conv_id")},
told AS (SELECT conv_id, line, '[' || {STAMP_SQL} || '] ' || text AS t FROM (SELECT *, start::BIGINT AS s FROM lines)), sized AS (SELECT *, greatest(1, ceil(sum(length(t) + 1) OVER (PARTITION BY conv_id) / 9000.0))::BIGINT AS step FROM told)
SELECT conv_id, left(string_agg(t, chr(10) ORDER BY line), 9000) AS text FROM sized WHERE (line - 1) % step = 0 GROUP BY conv_id""")
def p12_windows(spark, d):
    """Conversations as transcripts, a turn each ten seconds."""
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), (F.col("turn") * 10).cast("double").alias("start"), "text")
    return pg.timed_text(rows, ["conv_id"])


@query(f"""WITH RECURSIVE {_lines_sql("SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, doc_id * 0.25 AS start, left(text, 40) AS text FROM documents", "source")}
SELECT source, line::BIGINT AS line, start::DOUBLE AS start, n AS segments, text FROM lines""")
def p12_transcript_lines(spark, d):
    """A transcript for each source, with a segment for each document's first forty characters."""
    rows = table(spark, d, "documents").select("source", F.col("doc_id").alias("pos"), (F.col("doc_id") * 0.25).alias("start"), F.substring("text", 1, 40).alias("text"))
    return pg.timed_lines(rows, ["source"]).select("source", "line", "start", "segments", "text")


# ---- pages, passages, plans, forms -------------------------------------------------------------------
#: src (ord, text) of sources split as split_passages splits them: made (ord, step, text) by walking lines and what is left of long ones, cut (ord, idx, text) without short ones.
PASSAGES_SQL = """lines AS (SELECT ord, row_number() OVER (PARTITION BY ord ORDER BY pos) AS i, line FROM (SELECT ord, pos, regexp_replace(l[pos], '^\\s+|\\s+$', '', 'g') AS line FROM (SELECT ord, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT ord, string_split(text, chr(10)) AS l FROM src))) WHERE line <> ''),
walk AS (
  SELECT ord, 0 AS i, 0 AS step, '' AS rest, '' AS buf, '' AS a, '' AS b FROM src
  UNION ALL
  SELECT ord, CASE WHEN cur IS NULL THEN -1 ELSE nxt END, step + 1, CASE WHEN long THEN regexp_replace(substr(cur, cut + 1), '^\\s+|\\s+$', '', 'g') ELSE '' END,
    CASE WHEN cur IS NULL OR long THEN '' WHEN buf = '' OR (NOT head AND length(buf) + length(cur) + 1 > 900) THEN cur ELSE buf || chr(10) || cur END,
    CASE WHEN cur IS NULL OR long OR (NOT head AND length(buf) + length(cur) + 1 > 900) THEN buf ELSE '' END, CASE WHEN long THEN regexp_replace(left(cur, cut), '\\s+$', '') ELSE '' END
  FROM (SELECT *, cur IS NOT NULL AND NOT head AND length(cur) > 900 AS long, CASE WHEN length(regexp_extract(left(cur, 902), '(?s)^(.*)\\. ', 1)) > 120 THEN length(regexp_extract(left(cur, 902), '(?s)^(.*)\\. ', 1)) + 1 ELSE 900 END AS cut
    FROM (SELECT w.ord, w.step, w.buf, coalesce(nullif(w.rest, ''), x.line) AS cur, CASE WHEN w.rest <> '' THEN w.i ELSE w.i + 1 END AS nxt, w.rest = '' AND coalesce(regexp_full_match(x.line, '=+ .+ =+'), false) AS head
      FROM walk w LEFT JOIN lines x ON x.ord = w.ord AND x.i = w.i + 1 AND w.rest = '' WHERE w.i >= 0))),
made AS (SELECT ord, 2 * step AS step, a AS text FROM walk WHERE a <> '' UNION ALL SELECT ord, 2 * step + 1, b FROM walk WHERE b <> ''),
cut AS (SELECT ord, row_number() OVER (PARTITION BY ord ORDER BY step) - 1 AS idx, text FROM (SELECT *, count(*) OVER (PARTITION BY ord) AS n FROM made) WHERE length(text) >= 120 OR n = 1)"""


@query(f"WITH RECURSIVE src AS (SELECT doc_id AS ord, text FROM documents WHERE text IS NOT NULL), {PASSAGES_SQL} SELECT ord, CAST(idx AS INTEGER) AS idx, text FROM cut")
def t06_passages(spark, d):
    return pg.passages(briefing.document_sources(table(spark, d, "documents")).select("ord", "text"), ["ord"])


@query()
def s15_page_text(spark, d):
    return table(spark, d, "pages").select("page_id", pages_.page_text(F.col("html")).alias("p")).select("page_id", "p.title", "p.date", "p.text")


#: Rules of every origin, made of the paths of its own pages: whole paths, parts of them with wildcards and ends, and ties of both kinds.
RULES_SQL = r"""p AS (SELECT page_id, regexp_extract(url, '^(\w+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^\w+://[^/?#]*([^#]*)', 1) AS path FROM pages), named AS (SELECT page_id, lower(origin) AS origin, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM p),
rules AS (SELECT origin, CASE page_id % 7 WHEN 0 THEN path WHEN 1 THEN left(path, 5) WHEN 2 THEN left(path, 4) || '*' || right(path, 2) WHEN 3 THEN path || '$' WHEN 4 THEN left(path, 2) || '*$' WHEN 5 THEN '*' || right(path, 1) || '$' ELSE '/en' END AS pattern, page_id % 3 = 0 AS allow FROM named),
shape AS (SELECT DISTINCT origin, allow, length(pattern) AS n, '^' || replace(regexp_replace(regexp_replace(pattern, '\$$', ''), '([.+?^${}()|\[\]\\])', '\\\1', 'g'), '*', '.*') || CASE WHEN pattern LIKE '%$' THEN '$' ELSE '' END AS rx FROM rules)"""


@query(f"""WITH {RULES_SQL}, best AS (SELECT page_id, allow FROM named JOIN shape USING (origin) WHERE regexp_matches(path, rx) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, allow DESC) = 1)
SELECT page_id, coalesce(allow, true) AS allowed FROM named LEFT JOIN best USING (page_id)""")
def s13_robots_rules(spark, d):
    p = table(spark, d, "pages").select("page_id", urls.origin(F.col("url")).alias("origin"), urls.path_query(F.col("url")).alias("path"))
    cut = lambda n: F.substring("path", 1, n)
    end = lambda n: F.expr(f"right(path, {n})")
    made = [F.col("path"), cut(5), F.concat(cut(4), F.lit("*"), end(2)), F.concat("path", F.lit("$")), F.concat(cut(2), F.lit("*$")), F.concat(F.lit("*"), end(1), F.lit("$")), F.lit("/en")]
    line = F.concat(F.when(F.col("page_id") % 3 == 0, "Allow: ").otherwise("Disallow: "), F.element_at(F.array(*made), (F.col("page_id") % 7 + 1).cast("int")))
    robots = p.groupBy("origin").agg(F.concat(F.lit("User-agent: *\n"), F.array_join(F.collect_list(line), "\n")).alias("body"))
    return pages_.allowed_by_robots(p, robots, "visitor").select("page_id", "allowed")


@query("""WITH s AS (SELECT doc_id, lower(left(string_split(text, chr(10))[1], 60)) AS t FROM documents) SELECT a.doc_id AS search_id, b.doc_id AS doc_id FROM (SELECT doc_id, trim(substr(t, 1 + doc_id % 20, 5 + doc_id % 7)) AS needle FROM s) a JOIN s b ON contains(b.t, a.needle)""")
def f13_substring_searches(spark, d):
    """Of each document's title a part of five to eleven characters is searched in all titles."""
    docs = kept(table(spark, d, "documents").where("text is not null").select("doc_id", F.lower(F.substring(F.element_at(F.split("text", "\n"), 1), 1, 60)).alias("title")), "titles")
    asked = docs.where("doc_id is not null").select(F.col("doc_id").alias("search_id"), F.substr("title", (F.col("doc_id") % 20 + 1).cast("int"), (F.col("doc_id") % 7 + 5).cast("int")).alias("needle"))
    return substring.find(asked, docs, substring.grams(docs, ["doc_id"], "title"), ["doc_id"], "title")


@query(f"""WITH t AS (SELECT item_id AS ord, text AS term, list_distinct({tokens_sql('left(text, 24)', True)}) AS p FROM benchmark), d AS (SELECT doc_id, {tokens_sql('text', True)} AS k FROM documents), c AS (SELECT ord, doc_id FROM t, d WHERE len(p) > 0 AND list_has_all(k, p))
SELECT ord, doc_id FROM c""")
def j10_term_containment(spark, d):
    """The documents that hold all words of a benchmark item's beginning."""
    terms = table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), F.substring("text", 1, 24).alias("term"))
    return ranking.containment(terms, table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text"), []).select("ord", F.col("source_id").alias("doc_id"))


ROBOTS = [("https://a", "User-agent: *\nDisallow: /x\nAllow: /x/y\nDisallow: /z*.pdf$\n\nUser-agent: me\nDisallow: /only")]
PATHS = [("https://a", "/x/1", False), ("https://a", "/x/y/2", True), ("https://a", "/z/a.pdf", False), ("https://a", "/z/a.pdfx", True), ("https://b", "/x", True)]


@query(f"SELECT origin, path, allowed FROM {values(PATHS, 'origin, path, allowed')}")
def s13_robots(spark, d):
    paths = spark.createDataFrame([p[:2] for p in PATHS], "origin string, path string")
    return pages_.allowed_by_robots(paths, spark.createDataFrame(ROBOTS, "origin string, body string"), "other").select("origin", "path", "allowed")


def _topics(spark):
    return spark.createDataFrame([(0, QUERY, TERMS)], "topic_id bigint, topic string, terms array<string>")


@query()
def p06_section_retrieval(spark, d):
    sources = briefing.gather(briefing.document_sources(table(spark, d, "documents")), _topics(spark), YEAR)
    return briefing.retrieve(sources, _topics(spark), briefing.section_table(spark)).select("section", "source_id", "idx", F.round("score", 6).alias("score"))


@query()
def r11_extractive_briefing(spark, d):
    """A whole briefing: gather, retrieve for every section, write extracts."""
    sources = briefing.gather(briefing.document_sources(table(spark, d, "documents")), _topics(spark), YEAR)
    return briefing.write(briefing.retrieve(sources, _topics(spark), briefing.section_table(spark)))


@query()
def p04_evidence(spark, d):
    sources = briefing.gather(briefing.document_sources(table(spark, d, "documents")), _topics(spark), YEAR)
    return briefing.evidence(briefing.retrieve(sources, _topics(spark), briefing.section_table(spark)), sources)


@query("""SELECT doc_id, row_number() OVER (ORDER BY n IS NULL, n, doc_id) AS place, n IS NOT NULL AS cited FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN doc_id // 7 + 1 END AS n FROM documents)""")
def k09_sources_json_order(spark, d):
    s = briefing.document_sources(table(spark, d, "documents")).withColumn("id", F.col("ord"))
    n = s.where("id % 7 = 0").select("topic_id", "id", F.expr("id div 7 + 1").alias("n"))
    return render.sources_json(s, n, ["topic_id"]).select(F.regexp_extract("url", r"/(\d+)$", 1).cast("long").alias("doc_id"), F.col("place").cast("long").alias("place"), "cited")


@query(r"""SELECT '#separator:tab' || chr(10) || '#html:true' || chr(10) || '#tags column:3' || chr(10) || 'A &amp; B' || chr(9) || 'def' || chr(9) || 'my-topic' || chr(10) || 'q?' || chr(9) || 'a<br>b' || chr(9) || 'my-topic' || chr(10) AS tsv""".replace("a<br>b", "a&lt;br&gt;b"))
def k08_anki(spark, d):
    reports = spark.createDataFrame([(1, "My topic")], "id int, topic string")
    cards = spark.createDataFrame([(1, 0, 0, "A & B", "def [2]"), (1, 1, 0, "q?", "a\nb")], "id int, part int, ord int, front string, back string")
    return render.anki(reports, cards, ["id"]).select("tsv")


from . import queries_briefing  # noqa: E402, F401  (adds to QUERIES and SQL)
from . import queries_tables  # noqa: E402, F401  (adds to QUERIES and SQL)

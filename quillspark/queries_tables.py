"""Rows over the driver's tables for operators of single values: inputs are built from the tables, so that there are as many as the tables have rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import media, text as tx, urls
from .operators import citations, dedup, protocols
from .plans import render
from .queries import query, stems_sql, table, words_sql
from .sources import answers, payloads, store


def _text(*c) -> F.Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))


def _s(c: str) -> F.Column:
    return F.col(c).cast("string")


@query(f"SELECT DISTINCT word, {stems_sql('[word]')}[1] AS stem FROM (SELECT unnest({words_sql('text')}) AS word FROM documents)")
def t03_stems_of_documents(spark, d):
    words = table(spark, d, "documents").select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    return words.select("word", tx.stem(F.col("word")).alias("stem"))


@query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN true WHEN 1 THEN (page_id % 32) BETWEEN 16 AND 31 WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN true WHEN 6 THEN false ELSE 200 + page_id % 56 >= 224 END AS private FROM pages""")
def t12_private_hosts(spark, d):
    i, n = F.col("page_id"), lambda m: (F.col("page_id") % m).cast("string")
    made = F.element_at(F.array(
        _text("http://10.", n(256), ".1.9/x"), _text("https://172.", n(32), ".0.1/"), _text("http://192.168.", n(256), ".7"), _text("http://8.8.", n(256), ".8/"), _text("http://169.254.", n(256), ".1/"), _text("http://host", n(9), ".internal/a"),
        _text("https://page", n(50), ".example.org/"), _text("http://", (200 + i % 56).cast("string"), ".1.2.3/")), (i % 8 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", urls.is_private_host(made).alias("private"))


@query("SELECT event_id, CASE event_id % 5 WHEN 4 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS date FROM events")
def t13_dates_of_events(spark, d):
    t = F.col("ts").cast("timestamp")
    made = F.element_at(F.array(F.date_format(t, "yyyyMMdd'T'HHmmss'Z'"), F.concat(F.date_format(t, "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(t, "yyyy-MM-dd"), F.lit("2 years ago")), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", media.parse_date(made).alias("date"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN 0 ELSE event_id * 37 % 9000 END AS seconds FROM events")
def t14_durations_of_events(spark, d):
    n = F.col("event_id") * 37 % 9000
    h, m, s = (n / 3600).cast("int"), (n % 3600 / 60).cast("int"), n % 60
    made = F.element_at(F.array(F.format_string("PT%dH%dM%dS", h, m, s), F.format_string("%d:%02d:%02d", h, m, s), n.cast("string"), F.lit("unknown")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", media.parse_duration(made).alias("seconds"))


@query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN -1 ELSE event_id * 41 % 5400 END AS seconds FROM events")
def t16_stamps_of_events(spark, d):
    n = F.col("event_id") * 41 % 5400
    made = F.element_at(F.array(F.format_string("%d:%02d", (n / 60).cast("int"), n % 60), F.format_string("%d:%02d:%02d", (n / 3600).cast("int"), (n % 3600 / 60).cast("int"), n % 60), F.lit("soon")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.coalesce(media.parse_timestamp(made), F.lit(-1)).alias("seconds"))


LINE_SQL = r"trim(regexp_replace(left(text, 300), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {LINE_SQL} AS clean FROM documents")
def t24_clean_replies(spark, d):
    """Replies with thoughts before them, in a code fence or not."""
    line = tx.squash(F.substring("text", 1, 300))
    made = F.when(F.col("doc_id") % 2 == 0, _text("<think>", F.col("text"), "</think>\n```md\n", line, "\n```\n")).otherwise(_text("  <THINK>a\nb</think>", line, "\n"))
    return table(spark, d, "documents").select("doc_id", tx.clean_completion(made).alias("clean"))


@query("""SELECT doc_id, array_to_string(n[1:3], ', ') || CASE WHEN len(n) > 3 THEN ' et al.' ELSE '' END AS line FROM (SELECT doc_id, list_filter(string_split(text, ' ')[1:doc_id % 6], lambda x: x <> '') AS n FROM documents)""")
def s09_authors_of_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.authors_line(F.slice(F.split("text", " "), F.lit(1), (F.col("doc_id") % 6).cast("int"))).alias("line"))


@query("SELECT doc_id, 'Fact ' || doc_id || ' [S' || doc_id % 8 || '][S' || doc_id % 5 || '] and [S3] [Sx] [S]' AS text FROM documents")
def c01_normalized_texts(spark, d):
    a, b = ((F.col("doc_id") % n).cast("string") for n in (8, 5))
    return table(spark, d, "documents").select("doc_id", citations.normalize(_text("Fact ", _s("doc_id"), " [S", a, " ; s", b, " ] and 【s3】 [Sx] [S]")).alias("text"))


@query("""SELECT doc_id, 'Fact ' || doc_id || CASE WHEN a BETWEEN 1 AND 4 OR b BETWEEN 1 AND 4 THEN ' ' ELSE '' END || CASE WHEN a BETWEEN 1 AND 4 THEN '[S' || a || ']' ELSE '' END || CASE WHEN b BETWEEN 1 AND 4 THEN '[S' || b || ']' ELSE '' END || '.' AS text,
(a NOT BETWEEN 1 AND 4)::BIGINT + (b NOT BETWEEN 1 AND 4)::BIGINT AS removed FROM (SELECT doc_id, doc_id % 8 AS a, doc_id % 5 AS b FROM documents)""")
def c02_stripped_texts(spark, d):
    a, b = ((F.col("doc_id") % n).cast("string") for n in (8, 5))
    r = citations.strip_invalid(_text("Fact ", _s("doc_id"), " [S", a, ", s", b, "]."), F.array(*(F.lit(k).cast("long") for k in (1, 2, 3, 4))))
    return table(spark, d, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.text", "r.removed")


@query("SELECT doc_id, 'x ' || CASE WHEN a BETWEEN 1 AND 3 THEN '[' || a * 10 || ']' ELSE '' END || ' y ' || CASE WHEN b BETWEEN 1 AND 3 THEN '[' || b * 10 || ']' ELSE '' END AS text FROM (SELECT doc_id, doc_id % 31 AS a, doc_id % 7 AS b FROM documents)")
def c05_mapped_texts(spark, d):
    a, b = ((F.col("doc_id") % n).cast("string") for n in (31, 7))
    numbers = F.create_map(*(x for k in (1, 2, 3) for x in (F.lit(k).cast("long"), F.lit(10 * k))))
    return table(spark, d, "documents").select("doc_id", citations.apply_mapping(_text("x [S", a, "] y [S", b, "]"), numbers).alias("text"))


@query("SELECT doc_id, 'q ' || doc_id AS queries, 'why ' || doc_id || '?' AS questions, 't' || doc_id || ',u' AS terms FROM documents")
def p02_plans_of_documents(spark, d):
    i = _s("doc_id")
    reply = _text("Here is a plan\n1. QUERY: q ", i, "\n- **query**: \"Q ", i, "\"\nQUESTION : why ", i, "?\nTERM: t", i, "\n* TERM: `u`\nterm: T", i, "\nQUERY:\n", F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", reply.alias("t"))
    return rows.select("doc_id", *(F.array_join(protocols.parse_plan(F.col("t"), k), ",").alias(n) for k, n in (("QUERY", "queries"), ("QUESTION", "questions"), ("TERM", "terms"))))


@query("SELECT doc_id, 'Term ' || doc_id AS term, 'means ' || doc_id || CASE WHEN doc_id % 4 IN (1, 2) THEN ' [S' || doc_id % 4 || ']' ELSE '' END AS definition FROM documents UNION ALL SELECT doc_id, 'Other', 'second' FROM documents")
def p08_glossaries_of_documents(spark, d):
    i = _s("doc_id")
    reply = _text("- **Term ", i, "** :: means ", i, " [S", (F.col("doc_id") % 4).cast("string"), "]\n2. Other :: second [S9]\nterm ", i, " :: again\nno line\n :: nothing")
    valid = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))
    return table(spark, d, "documents").select("doc_id", F.explode(protocols.parse_glossary(reply, valid)).alias("g")).select("doc_id", "g.term", "g.definition")


@query("SELECT doc_id, 'one ' || doc_id || '?' AS question, 'yes' AS answer FROM documents UNION ALL SELECT doc_id, 'two?', 'no ' || doc_id FROM documents")
def p09_quizzes_of_documents(spark, d):
    i = _s("doc_id")
    reply = _text("A:: stray\nQ:: one ", i, "? || A:: yes [S1]\nwords\n2. Q:: two?\n\nA:: no ", i, "\nQ:: open?")
    return table(spark, d, "documents").select("doc_id", F.explode(protocols.parse_quiz(reply)).alias("q")).select("doc_id", "q.question", "q.answer")


@query("SELECT doc_id, 'T' || k AS topic, 'w' || doc_id AS why FROM documents, (SELECT unnest(range(1, 7)) AS k)")
def p10_next_of_documents(spark, d):
    """Eight topics are named; six are taken."""
    reply = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: _text("NEXT:: **T", k.cast("string"), "** | w", _s("doc_id"))), "\n")
    return table(spark, d, "documents").select("doc_id", F.explode(protocols.parse_next(_text("NEXT:: bad\n", reply))).alias("n")).select("doc_id", "n.topic", "n.why")


@query("""SELECT doc_id, coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-+$', ''), ''), 'topic') AS slug FROM documents""")
def t19_slugs_of_whole_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.slugify(F.col("text")).alias("slug"))


@query("SELECT item_id, text AS q1, text || ' explained' AS q2, 3::BIGINT AS n FROM benchmark")
def p01_plans_of_whole_texts(spark, d):
    plan = protocols.build_plan(F.col("text"), F.lit(None).cast("string"), 3)
    return table(spark, d, "benchmark").select("item_id", plan.alias("p")).select("item_id", F.get("p.queries", F.lit(0)).alias("q1"), F.get("p.queries", F.lit(1)).alias("q2"), F.size("p.queries").cast("long").alias("n"))


@query("SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(s) AS w, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(lower(text), ' ') AS s FROM documents)) GROUP BY doc_id, w) GROUP BY doc_id")
def d05_distinct_words_of_whole_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(dedup.ordered_distinct(F.split(F.lower("text"), " ")), " ").alias("words"))


@query(r"""SELECT item_id, '#separator:tab' || chr(10) || '#html:true' || chr(10) || '#tags column:3' || chr(10) || 'A &amp; ' || item_id || chr(9) || e || chr(9) || 'topic-' || item_id || chr(10) || 'q ' || item_id || '?' || chr(9) || 'a&lt;br&gt;b' || chr(9) || 'topic-' || item_id || chr(10) AS tsv
FROM (SELECT item_id, replace(replace(replace(replace(replace(replace(replace(text, chr(9), ' '), chr(10), '<br>'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS e FROM benchmark)""")
def k08_anki_of_items(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", _text("Topic ", _s("item_id")).alias("topic"), "text")
    card = lambda part, front, back: rows.select("item_id", F.lit(part).alias("part"), F.lit(0).alias("ord"), front.alias("front"), back.alias("back"))
    cards = card(0, _text("A & ", _s("item_id")), _text(F.col("text"), " [2]")).unionByName(card(1, _text("q ", _s("item_id"), "? [1]"), F.lit("a\nb")))
    return render.anki(rows.select("item_id", "topic"), cards, ["item_id"])


@query("SELECT topic FROM (SELECT 'Topic ' || item_id AS topic, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark WHERE item_id % 3 > 0) WHERE i = (DATE '2024-03-09' - DATE '1970-01-01') % n")
def r15_topic_in_turn(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), _text("Topic ", _s("item_id")).alias("topic"))
    return store.ordinal_pick(rows, rows.where("ord % 3 = 0").select(F.lower("topic").alias("topic")), "2024-03-09")


@query(r"""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN left(latin, 500) WHEN 5 THEN left(latin, 500) WHEN 1 THEN left(text, 250) WHEN 4 THEN left(plain, 500) END AS text,
CASE doc_id % 7 WHEN 2 THEN 'h.example.org:81 failed after 2 attempts: HTTP 503 from h.example.org:81' WHEN 3 THEN 'HTTP 404 from https://h.example.org:81/' || doc_id WHEN 6 THEN 'h.example.org:81 failed after 2 attempts: timeout' END AS error
FROM (SELECT doc_id, text, regexp_replace(text, '[^\x00-\xFF]', '?', 'g') AS latin, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS plain FROM documents)""")
def s01_answers(spark, d):
    """Two attempts for each document, of seven kinds: three charsets, tries that are repeated or not, and none that succeeds; 500 bytes are read."""
    docs, i = table(spark, d, "documents"), F.col("doc_id") % 7
    latin, plain = (F.regexp_replace("text", f"[^\\x00-\\x{end}]", "?") for end in ("FF", "7F"))
    body = F.when(i == 1, F.encode("text", "UTF-16LE")).when(i == 4, F.encode(plain, "UTF-8")).otherwise(F.encode(latin, "ISO-8859-1"))
    charset = F.when(i == 1, "text/html; charset=utf-16le").when(i == 4, "text/html").otherwise("text/plain;charset=ISO-8859-1")
    status = lambda *codes: F.element_at(F.array(*(F.lit(c).cast("int") for c in codes)), (i + 1).cast("int"))
    attempt = lambda n, code, content: docs.select("doc_id", _text("https://H.example.org:81/", _s("doc_id")).alias("url"), F.lit(n).alias("attempt"), code.alias("status"), charset.alias("content_type"), content.alias("content"), F.lit("timeout").alias("detail"))
    tried = attempt(1, status(200, 429, 500, 404, None, 200, 503), body).unionByName(attempt(2, status(200, 200, 503, 200, 200, 200, None), F.when(i.isin(1, 4), body).otherwise(F.encode(F.lit("late"), "UTF-8"))))
    return answers.answers(tried, ["doc_id"], 500).select("doc_id", "text", F.replace("error", F.lit("https://H."), F.lit("https://h.")).alias("error"))


@query("""SELECT doc_id // 8 AS topic_id, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS pos, 'T ' || doc_id AS title, 'https://en.wikipedia.org/wiki/T_' || doc_id AS url, '2024-02-0' || (1 + doc_id % 9) AS date FROM documents WHERE doc_id % 8 % 4 < 2 AND doc_id % 8 <> 5 QUALIFY pos <= 2""")
def s03_wikipedia_articles(spark, d):
    """Eight answers a topic of four queries, of which two count; one is a disambiguation page."""
    i, at = F.col("doc_id"), F.col("doc_id") % 8
    page = _text('{"query":{"pages":{"', _s("doc_id"), '":{"title":"T ', _s("doc_id"), '","touched":"2024-02-0', (1 + i % 9).cast("string"), 'T01:02:03Z","extract":"', F.when(at == 5, "It May refer to: many").otherwise("Plain article."), '"}}}}')
    rows = table(spark, d, "documents").select(F.expr("doc_id div 8").alias("topic_id"), i.alias("ord"), (at % 4).alias("query_ord"), page.alias("body"))
    return payloads.wikipedia(rows, 2).select("topic_id", "pos", "title", "url", "date")


@query("""WITH m AS (SELECT doc_id // 6 AS listing, 'm/' || lpad((doc_id * 7 % 1000)::VARCHAR, 3, '0') || '-' || doc_id || CASE WHEN doc_id % 5 = 0 THEN ':free' ELSE '' END AS id, doc_id % 5 = 0 OR doc_id % 3 = 0 AS free, doc_id * 16 AS context FROM documents
UNION ALL SELECT DISTINCT doc_id // 6, 'openrouter/free', NULL, 0 FROM documents)
SELECT listing, row_number() OVER (PARTITION BY listing ORDER BY free IS NOT NULL, free DESC, id) - 1 AS ord, id, coalesce(free, true) AS free, context FROM m""")
def s20_hosted_models(spark, d):
    """Listings of six models, some free by name and some by price."""
    i = F.col("doc_id")
    name = _text("m/", F.lpad((i * 7 % 1000).cast("string"), 3, "0"), "-", _s("doc_id"), F.when(i % 5 == 0, ":free").otherwise(""))
    price = F.when(i % 3 == 0, '{"prompt":"0","completion":"0.0"}').when(i % 3 == 1, '{"prompt":"0","completion":"0.1"}').otherwise("null")
    model = _text('{"id":"', name, '","context_length":', (i * 16).cast("string"), ',"pricing":', price, "}")
    body = table(spark, d, "documents").groupBy(F.expr("doc_id div 6").alias("listing")).agg(_text('{"data":[', F.array_join(F.collect_list(model), ","), "]}").alias("body"))
    return payloads.hosted_models(body, ["listing"]).select("listing", F.col("ord").cast("long").alias("ord"), "id", "free", "context")


@query("""WITH d AS (SELECT doc_id, doc_id // 6 AS day, doc_id % 6 AS slot FROM documents)
SELECT day, CASE WHEN slot = 0 THEN 1 WHEN slot < 4 THEN 2 ELSE 3 END AS priority, CASE WHEN slot = 0 THEN 0 WHEN slot < 4 THEN row_number() OVER (PARTITION BY day, slot BETWEEN 1 AND 3 ORDER BY doc_id) - 1 ELSE slot + 7 END AS ord, 'Art ' || doc_id AS topic,
CASE WHEN slot = 0 THEN 'Wikipedia''s featured article today' WHEN slot < 4 THEN 'on this day (' || CASE WHEN slot = 2 THEN '?' ELSE (1900 + slot)::VARCHAR END || ')' ELSE 'random Wikipedia article' END AS why FROM d WHERE slot < 5""")
def s19_topic_feeds(spark, d):
    """Days of a featured article, three anniversaries of two articles each, and two random ones, of which one is drawn too late."""
    from pyspark.sql import Window

    docs = table(spark, d, "documents").select("doc_id", F.expr("doc_id div 6").alias("day"), (F.col("doc_id") % 6).alias("at"))
    title = _text("Art_", _s("doc_id"))
    year = F.when(F.col("at") == 2, "null").otherwise((F.col("at") + 1900).cast("string"))
    event = F.struct("doc_id", _text('{"year":', year, ',"pages":[{"title":"', title, '"},{"title":"Other_', _s("doc_id"), '"}]}').alias("e"))
    parts = docs.groupBy("day").agg(F.max(F.when(F.col("at") == 0, _text('"tfa":{"title":"', title, '"},'))).alias("t"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("at").between(1, 3), event))), lambda x: x["e"]), ",").alias("e"))
    feed = parts.select("day", _text("{", F.coalesce("t", F.lit("")), '"onthisday":[', F.col("e"), "]}").alias("body"))
    about = _text('{"title":"Art ', _s("doc_id"), '","extract":"x","type":"standard"}')
    summaries = docs.where("at < 4").select(_text("Art ", _s("doc_id")).alias("title"), about.alias("body"))
    randoms = docs.where("at >= 4").select("day", (F.col("at") + 7).alias("attempt"), about.alias("body"))
    return payloads.topic_feed(feed, summaries, randoms, ["day"]).select("day", F.col("priority").cast("int").alias("priority"), F.col("ord").cast("long").alias("ord"), "topic", "why")


@query("""SELECT doc_id, 'local-' || doc_id AS id, CASE doc_id % 3 WHEN 0 THEN '7B · Q4' WHEN 1 THEN '7B' ELSE '' END AS detail FROM documents WHERE doc_id % 4 <> 3
UNION ALL SELECT doc_id, 'plain-' || doc_id, '' FROM documents WHERE doc_id % 4 = 3""")
def s20_local_models(spark, d):
    i = _s("doc_id")
    details = F.when(F.col("doc_id") % 3 == 0, '{"parameter_size":"7B","quantization_level":"Q4"}').when(F.col("doc_id") % 3 == 1, '{"parameter_size":"7B","quantization_level":""}').otherwise("null")
    tags, plain = _text('{"models":[{"name":"local-', i, '","details":', details, "}]}"), _text('{"data":[{"id":"text-Embed-', i, '"},{"id":"plain-', i, '"}]}')
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 3, plain).otherwise(tags).alias("body"))
    return payloads.local_models(rows, ["doc_id"]).select("doc_id", "id", "detail")

"""Queries of text, date, number, header and encoding columns, gates and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.functions import pages as page
from weblake.functions import text
from weblake.jobs.query import query
from weblake.operators import aggregates, tables
from weblake.sources.tables import table


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a fetch report in which every gate has rows."""
    n = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.when(n % 11 == 0, "timeout").alias("fetch_error"), F.when(n % 7 == 0, "404").when(n % 7 == 1, "200.0").when(n % 13 != 0, "200").alias("http_status"),
        F.when(n % 5 == 0, "application/pdf").when(n % 17 != 0, "text/html").alias("mimetype"), F.when(n % 6 == 0, "klingon").when(n % 6 == 1, "UTF-8").alias("encoding"),
        F.when(n % 9 != 0, F.col("html")).alias("body"),
    )


REPORT = """r AS (SELECT page_id, url, CASE WHEN page_id % 11 = 0 THEN 'timeout' END AS fetch_error, CASE WHEN page_id % 7 = 0 THEN '404' WHEN page_id % 7 = 1 THEN '200.0' WHEN page_id % 13 <> 0 THEN '200' END AS http_status,
  CASE WHEN page_id % 5 = 0 THEN 'application/pdf' WHEN page_id % 17 <> 0 THEN 'text/html' END AS mimetype, CASE WHEN page_id % 6 = 0 THEN 'klingon' WHEN page_id % 6 = 1 THEN 'UTF-8' END AS encoding, CASE WHEN page_id % 9 <> 0 THEN html END AS body FROM pages)"""


@query(f"""WITH {REPORT} SELECT page_id, CASE WHEN fetch_error IS NOT NULL THEN 'http-errored' WHEN http_status IS NULL OR http_status = '404' THEN 'invalid-status' WHEN mimetype IS NULL OR mimetype NOT LIKE '%/htm%' THEN 'invalid-mimetype'
  WHEN body IS NULL THEN 'no-path-nor-body' WHEN encoding = 'klingon' THEN 'encoding-not-supported' END AS gate_error FROM r""")
def p1_gate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page.gate_pages(report(spark, sf_dir)).select("page_id", "gate_error")


@query(f"WITH {REPORT} SELECT coalesce(http_status, fetch_error, 'filtered') AS name, count(*) AS count, CASE WHEN regexp_matches(coalesce(http_status, fetch_error, 'filtered'), '^[0-9]+$') THEN 0 WHEN coalesce(http_status, fetch_error, 'filtered') = 'filtered' THEN 2 ELSE 1 END AS place FROM r GROUP BY 1, 3")
def a3_fetch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.fetch_stats(report(spark, sf_dir))


@query("""SELECT doc_id, len(regexp_extract_all(text, '(?i)the')) > 0 AS relevant, nullif(len(regexp_extract_all(text, '(?i)the')), 0)::INT AS matches,
  NOT regexp_matches(text, '(?i)the') AS inverted, regexp_matches(text, '^[A-Za-z_]') AS not_id, NOT regexp_matches(source, '^[a-zA-Z0-9_]{1,15}$') OR regexp_matches(source, '^[0-9]+$') AS not_name FROM documents""")
def p3_p6_relevance_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    r = text.relevance(t, "the")
    return table(spark, sf_dir, "documents").select("doc_id", r["relevant"].alias("relevant"), r["matches"].alias("matches"), text.relevance(t, "the", True)["relevant"].alias("inverted"), text.is_not_user_id(t).alias("not_id"), text.is_probably_not_screen_name(F.col("source")).alias("not_name"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def p4_p5_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page.filter_time_range(table(spark, sf_dir, "events"), "ts", "2024-01-05", "2024-01-20").select("event_id")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 500")
def p5_min_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page.filter_min_date(table(spark, sf_dir, "documents"), "n_chars", 500).select("doc_id", "n_chars")


@query("SELECT page_id, page_id % 5 IN (1, 3) AS for_html, page_id % 5 = 1 AS for_short, page_id % 5 <> 0 AND page_id % 5 <> 4 AS for_all FROM pages")
def p2_mark_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    url = F.when(k == 0, " ").when(k == 1, "https://bit.ly/abc").when(k == 2, "https://site.org/a.pdf").when(k == 3, "https://site.org/a.html")
    rows = table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    rows = page.mark_eligible(rows, "url", only_html=True).withColumnRenamed("eligible", "for_html")
    rows = page.mark_eligible(rows, "url", only_shortened=True).withColumnRenamed("eligible", "for_short")
    return page.mark_eligible(rows, "url").withColumnRenamed("eligible", "for_all").drop("url")


@query("""SELECT page_id, regexp_matches(html, '(?i)^\\s*<(?:html|head|body|title|meta|link|span|div|img|ul|ol|a|p|!|\\?)') AS html,
  (page_id % 3) <> 0 AS is_binary FROM pages""")
def p7_p8_mimetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, "application/ld+json").when(F.col("page_id") % 3 == 1, "image/png").otherwise("application/zip")
    return table(spark, sf_dir, "pages").select("page_id", text.looks_like_html(F.col("html")).alias("html"), text.is_binary_mimetype(kind).alias("is_binary"))


@query("SELECT page_id, '/canon/' || page_id AS canonical, (page_id % 9)::INT AS seconds, '/go/' || page_id AS refresh, 'https://x.org/' || page_id AS location FROM pages")
def r1_r2_regex_scrapers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    body = F.concat(
        F.lit('<link rel="stylesheet" href="/x"><LINK href=\'/canon/'), n, F.lit("' rel=canonical><meta http-equiv=refresh content=\""), (F.col("page_id") % 9).cast("string"),
        F.lit("; URL=/go/"), n, F.lit('"><script>window.location.replace("https:\\/\\/x.org\\/'), n, F.lit('")</script>'), F.col("html"),
    )
    meta = page.meta_refresh(F.col("body"))
    return table(spark, sf_dir, "pages").select("page_id", body.alias("body")).select("page_id", page.regex_canonical(F.col("body")).alias("canonical"), meta["seconds"].alias("seconds"), meta["url"].alias("refresh"), page.js_location(F.col("body")).alias("location"))


@query("SELECT page_id, 'utf8' AS encoding, 'utf-8' AS name, 1 AS count FROM pages UNION ALL SELECT page_id, 'iso88591', 'ISO-8859-1', 2 FROM pages")
def r3_declared_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = '<?xml version="1.0" encoding="iso8859_1"?><meta http-equiv="content-type" content="text/html; charset=ISO-8859-1">'
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(head), F.col("html")).alias("body"))
    return page.declared_encodings(pages, "page_id", "body")


_MEDIA = [
    # header, extension of the URL; media type, extension, whether it is text.
    ("text/html; charset=UTF-8", "png", "text/html", ".html", True), ("image/svg+xml", "html", "image/svg+xml", ".svg", False), ("application/javascript", "", "application/javascript", None, False),
    ("application/yaml", "", "application/yaml", None, True), (None, "webp", "image/webp", ".webp", False), (None, "doc", "application/msword", ".doc", False), (None, "jpe", "image/jpeg", ".jpg", False),
    ("text/plain, x;charset='utf-8'", "", "text/plain", ".txt", True), (None, "", "text/html", ".html", True), ("application/ld+json", "pdf", "application/ld+json", None, True), (None, "PDF", "application/pdf", ".pdf", False),
]
_SAID = lambda k: "[" + ", ".join("NULL" if m[k] is None else str(m[k]).lower() if isinstance(m[k], bool) else f"'{m[k]}'" for m in _MEDIA) + "]"


@query(f"""SELECT page_id, {_SAID(2)}[page_id % 11 + 1] AS mimetype, CASE WHEN page_id % 11 IN (0, 7) THEN 'utf-8' END AS charset, {_SAID(3)}[page_id % 11 + 1] AS ext, {_SAID(4)}[page_id % 11 + 1] AS is_text,
  page_id % 8 < 4 AS supported FROM pages""")
def r5_r7_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media types of pages by header, by extension and by look."""
    of = lambda k: F.get(F.array(*(F.lit(m[k]) for m in _MEDIA)), (F.col("page_id") % len(_MEDIA)).cast("int"))
    name = F.get(F.array(*map(F.lit, ("ISO 8859_1", "L1", "csISO2022-KR", "Shift_JIS 2004", "utf-8859-1", "nope", "xsjis", ""))), (F.col("page_id") % 8).cast("int"))
    url = F.concat(F.lit("https://site.org/file"), F.when(of(1) != "", F.concat(F.lit("."), of(1))).otherwise(""))
    parts, guess = page.content_type_parts(of(0)), page.guess_mimetype(url, of(0), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", guess["mimetype"].alias("mimetype"), parts["charset"].alias("charset"), guess["ext"].alias("ext"), guess["is_text"].alias("is_text"), page.is_supported_encoding(name).alias("supported"))


_TAGGED = "t AS (SELECT doc_id, coalesce(text, '') || ' #Tag' || doc_id % 7 || ', #été #été @Some.one_' || doc_id % 5 || ' end' AS x FROM documents)"


@query(f"""WITH {_TAGGED} SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(list_filter(string_split_regex(x, '[^\\p{{L}}\\p{{N}}_#]+'), lambda w: w LIKE '#%'), lambda w: lower(ltrim(w, '#'))), lambda w: w <> ''))) AS hashtags,
  list_sort(list_distinct(list_filter(list_transform(list_filter(string_split_regex(x, '[^\\p{{L}}\\p{{N}}_.@]+'), lambda w: w LIKE '@%'), lambda w: lower(ltrim(w, '@'))), lambda w: w <> ''))) AS handles FROM t""")
def f1_hashtags_and_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of whole texts, with some more at their ends."""
    n = F.col("doc_id")
    x = F.concat(F.coalesce("text", F.lit("")), F.lit(" #Tag"), (n % 7).cast("string"), F.lit(", #été #été @Some.one_"), (n % 5).cast("string"), F.lit(" end"))
    return table(spark, sf_dir, "documents").select("doc_id", text.extract_hashtags(x).alias("hashtags"), text.extract_handles(x).alias("handles"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 100 * 1000 + 500)::VARCHAR WHEN 1 THEN (o_orderkey % 100 * 1000000)::VARCHAR ELSE '1' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') END AS n,
  CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 100 * 1000000 END AS likes FROM orders""")
def f4_f5_human_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    hundred = (k % 100).cast("string")
    shown = F.when(k % 3 == 0, F.concat(hundred, F.lit(".5K shares"))).when(k % 3 == 1, F.concat(hundred, F.lit("M"))).otherwise(F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0")))
    likes = text.approx_likes(F.concat(F.lit("<b>"), shown, F.lit("</b>")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.clean_human_number(shown).alias("n"), F.when(k % 3 == 1, likes["likes"]).alias("likes"))


@query("""WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderkey % 3 AS k, o_orderdate AS t FROM orders)
  SELECT o_orderkey, CASE k WHEN 0 THEN date_trunc('year', t) WHEN 1 THEN date_trunc('month', t) ELSE date_trunc('day', t) END::TIMESTAMP AS low,
  CASE k WHEN 0 THEN date_trunc('year', t) + INTERVAL 1 YEAR WHEN 1 THEN date_trunc('month', t) + INTERVAL 1 MONTH ELSE date_trunc('day', t) + INTERVAL 1 DAY END::TIMESTAMP - INTERVAL 1 MICROSECOND AS high,
  left(d, [4, 7, 10][k + 1]) || ['-01-01', '-01', ''][k + 1] || 'T00:00:00Z' AS padded, strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%dT%H:%M:%S') AS iso FROM d""")
def f6_f8_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.get(F.array(F.lit(4), F.lit(7), F.lit(10)), (F.col("o_orderkey") % 3).cast("int"))
    part = F.left(F.date_format("o_orderdate", "yyyy-MM-dd"), cut)
    ntz = lambda c: c.cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select("o_orderkey", part.alias("p")).select("o_orderkey", ntz(text.parse_partial_iso(F.col("p"))).alias("low"), ntz(text.parse_partial_iso(F.col("p"), True)).alias("high"), text.pad_date(F.col("p")).alias("padded"), text.timestamp_to_iso(F.col("o_orderkey")).alias("iso"))


@query("SELECT o_orderkey, (o_orderkey * 4194304000)::VARCHAR AS tweet_id, make_timestamp((o_orderkey * 1000 + 1288834974657) * 1000) AS at FROM orders")
def f9_tweet_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = (F.col("o_orderkey") * 4194304000).cast("string")
    given = F.when(F.col("o_orderkey") % 2 == 0, id_).otherwise(F.concat(F.lit("https://twitter.com/a/status/"), id_))
    found = text.tweet_date(given)
    return table(spark, sf_dir, "orders").select("o_orderkey", found["tweet_id"].alias("tweet_id"), found["timestamp_utc"].cast("timestamp_ntz").alias("at"))


@query("SELECT o_orderkey, (o_orderkey * 987654321)::VARCHAR AS back, 'https://old.reddit.com/r/sub' || o_orderkey || '/' AS sub, (o_orderkey % 90)::INT AS comments, 'UU' || lpad(o_orderkey::VARCHAR, 22, 'x') AS playlist, 'é' || o_orderkey AS fixed FROM orders")
def f10_f13_platform_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    code = text.id_to_shortcode((k * 987654321).cast("string"))
    channel = F.concat(F.lit("https://www.youtube.com/channel/UC"), F.lpad(k.cast("string"), 22, "x"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.shortcode_to_id(code).alias("back"), text.subreddit_url(F.concat(F.lit("/r/sub"), k.cast("string"), F.lit("/new"))).alias("sub"),
        text.comment_count(F.concat((k % 90).cast("string"), F.lit(" comments"))).alias("comments"), text.channel_playlist_id(channel).alias("playlist"), text.fix_ascii_json(F.concat(F.lit("\\u00e9"), k.cast("string"))).alias("fixed"),
    )


@query("SELECT c_custkey, coalesce(sum(o_orderkey), 0)::BIGINT AS views FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a1_sum_pageviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("views"))
    return aggregates.sum_pageviews(table(spark, sf_dir, "customer").select("c_custkey"), items, "c_custkey")


@query("SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS start, (date_trunc('hour', ts) + INTERVAL 1 HOUR)::TIMESTAMP AS \"end\", count(*) AS count FROM events GROUP BY 1, 2, 3")
def a2_count_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_by_bucket(table(spark, sf_dir, "events"), "event_type", "ts", "1 hour")


@query("SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def a8_collapse_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.collapse_captions(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


@query("SELECT doc_id, unnest(string_split(source || '|' || lang, '|')) AS cell FROM documents")
def s9_explode_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", "source", "lang").alias("cell"))
    return tables.explode_cells(docs, "cell")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS original_index FROM orders WHERE o_orderkey % 3 <> 0")
def s8_s11_resume_and_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return tables.with_original_index(tables.resume(orders, orders.where("o_orderkey % 3 = 0"), "o_orderkey"), "o_orderkey")


@query(f"""WITH {REPORT} SELECT page_id, page_id % 4 = 0 AND body IS NOT NULL AS has_body, CASE WHEN page_id % 4 <> 0 OR body IS NULL THEN 'file-not-found' END AS body_error FROM r""")
def s3_attach_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = report(spark, sf_dir).withColumn("path", F.concat(F.col("page_id").cast("string"), F.lit(".html")))
    files = r.where("page_id % 4 = 0 and body is not null").select(F.concat(F.lit("in/"), F.col("path")).alias("path"), "body")
    found = tables.attach_bodies(r.drop("body"), files, "in")
    return found.select("page_id", F.col("body").isNotNull().alias("has_body"), "body_error")

"""Queries of joins, dedup, order and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.functions import urls
from weblake.jobs.query import query
from weblake.jobs.url_jobs import VARIED, normalized_sql, varied
from weblake.operators import frontier, joins
from weblake.sources.tables import table


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of every third page, and sections of every fifth: entity URLs of different lengths."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    sites = pages.where("page_id % 3 = 0").select(F.col("page_id").alias("entity"), host.alias("site"))
    sections = pages.where("page_id % 5 = 0").select((F.col("page_id") + 1000000).alias("entity"), F.concat(host, F.regexp_extract("url", "^https?://[^/?#]*(/[a-z]+)", 1)).alias("site"))
    return sites.unionByName(sections)


_KEY = "list_reverse(string_split(regexp_extract({0}, '^([^/?#]*)', 1), '.')) || list_filter(string_split(regexp_extract({0}, '^[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')"
#: right rows (page_id, entity) by longest prefix of normalized stems.
JOINED = rf"""{VARIED}, {normalized_sql('v')},
  e0 AS (SELECT page_id AS entity, regexp_extract(url, '^https?://([^/?#]*)', 1) AS site FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id + 1000000, regexp_extract(url, '^https?://([^/?#]*)', 1) || regexp_extract(url, '^https?://[^/?#]*(/[a-z]+)', 1) FROM pages WHERE page_id % 5 = 0),
  e1 AS (SELECT entity, site, regexp_replace(site, '^(?:(?:www[0-9]*|m|mobile)\.)+([^.]+\.)', '\1') AS nsite FROM e0),
  ents AS (SELECT stems, max_by(entity, entity) AS entity, max_by(site, entity) AS site FROM (SELECT *, {_KEY.format('nsite')} AS stems FROM e1) GROUP BY stems),
  probes AS (SELECT page_id, {_KEY.format("nhost || npath")} AS stems FROM norm),
  cand AS (SELECT p.page_id, e.entity, e.site, len(e.stems) AS n FROM (SELECT page_id, stems, unnest(range(1, len(stems) + 1)) AS k FROM probes) p JOIN ents e ON e.stems = p.stems[1:p.k]),
  joined AS (SELECT p.page_id, max_by(c.entity, c.n) AS entity, max_by(c.site, c.n) AS site FROM probes p LEFT JOIN cand c USING (page_id) GROUP BY 1)"""


@query(f"WITH {JOINED} SELECT page_id, entity, site FROM joined")
def j1_join_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join_by_url(entities(spark, sf_dir), "site", varied(spark, sf_dir), "u", order="entity").select("page_id", "entity", "site")


_LINKS = r"links AS (SELECT page_id, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || h AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS h FROM pages))"


@query(
    rf"""WITH {_LINKS}, hosts AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^(?:(?:www[0-9]*|m|mobile)\.)+([^.]+\.)', '\1') AS site FROM pages WHERE page_id % 2 = 0),
  l AS (SELECT regexp_replace(regexp_extract(link, '^https?://([^/?#]*)', 1), '^(?:(?:www[0-9]*|m|mobile)\.)+([^.]+\.)', '\1') AS host FROM links),
  suffixes AS (SELECT rowid AS r, host, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM (SELECT row_number() OVER () AS rowid, host FROM l)),
  m AS (SELECT r, max_by(site, length(site)) AS site FROM suffixes JOIN hosts ON site = array_to_string(list_slice(string_split(host, '.'), -k, -1), '.') GROUP BY r)
  SELECT site, count(*) AS n_links FROM (SELECT s.r, m.site FROM (SELECT DISTINCT r FROM suffixes) s LEFT JOIN m USING (r)) GROUP BY site"""
)
def j1_join_by_url_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages, resolved, joined with known sites on the longest prefix, counted by site."""
    pages = table(spark, sf_dir, "pages")
    hrefs = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    links = hrefs.where(urls.should_follow_href(F.col("href"))).select(urls.url_join(F.col("url"), F.col("href")).alias("link"))
    sites = pages.where("page_id % 2 = 0").select(urls.get_normalized_hostname(F.col("url")).alias("site")).distinct()
    # Links of one URL are one probe, so each is counted before the join.
    counted = links.groupBy("link").agg(F.count("*").alias("n"))
    return joins.join_by_url(sites, "site", counted, "link", order="site").groupBy("site").agg(F.sum("n").alias("n_links"))


_CORPUS = "c AS (SELECT o_custkey AS cust, o_orderkey AS k FROM orders)"


@query(
    """WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages),
  e AS (SELECT host, max(host) AS webentity, CASE WHEN min(page_id) % 3 = 0 THEN 'OUT' ELSE 'IN' END AS status FROM p WHERE page_id % 2 = 0 GROUP BY host),
  cand AS (SELECT p.page_id, e.webentity, e.status, length(e.host) AS n FROM p JOIN e ON (p.host = e.host OR p.host LIKE '%.' || e.host))
  SELECT p.page_id, max_by(c.webentity, c.n) AS webentity, max_by(c.status, c.n) AS status FROM p LEFT JOIN cand c USING (page_id) GROUP BY 1"""
)
def j2_match_webentities(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return joins.match_webentities(pages, "url", corpus(spark, sf_dir)).select("page_id", "webentity", "status")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of the even pages as web entities, each with its two prefixes; some are OUT."""
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    hosts = table(spark, sf_dir, "pages").where("page_id % 2 = 0").groupBy(host.alias("ID")).agg(F.min("page_id").alias("n"))
    return hosts.select("ID", F.when(F.col("n") % 3 == 0, "OUT").otherwise("").alias("STATUS"), F.concat(F.lit("http://"), "ID", F.lit(" https://"), "ID").alias("PREFIXES"), F.concat(F.lit("http://"), "ID", F.lit("/start")).alias("START_PAGES"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link from each page to the page 7 places on and to the one of half its number."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    to = pages.select(F.col("page_id").alias("to_id"), F.col("url").alias("to_url"))
    out = pages.withColumn("to_id", F.explode(F.array(F.col("page_id") + 7, F.floor(F.col("page_id") / 2))))
    return out.join(to, "to_id").select(F.col("page_id").alias("from_id"), "to_id", F.col("url").alias("from_url"), "to_url")


LINKS = "links AS (SELECT a.page_id AS from_id, b.page_id AS to_id, a.url AS from_url, b.url AS to_url FROM (SELECT page_id, url, unnest([page_id + 7, page_id // 2]) AS t FROM pages) a JOIN pages b ON b.page_id = a.t)"
ENTITIES = """p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages),
  e AS (SELECT host, CASE WHEN min(page_id) % 3 = 0 THEN 'OUT' ELSE 'IN' END AS status FROM p WHERE page_id % 2 = 0 GROUP BY host),
  cand AS (SELECT p.page_id, e.host AS webentity, e.status, length(e.host) AS n FROM p JOIN e ON (p.host = e.host OR p.host LIKE '%.' || e.host)),
  m AS (SELECT page_id, max_by(webentity, n) AS webentity, max_by(status, n) AS status FROM cand GROUP BY 1)"""
WELINKS = f"""{LINKS}, {ENTITIES}, wl AS (SELECT s.webentity AS source_webentity, t.webentity AS target_webentity FROM links l JOIN m s ON s.page_id = l.from_id AND s.status = 'IN' JOIN m t ON t.page_id = l.to_id AND t.status = 'IN')"""


@query(f"WITH {WELINKS} SELECT source_webentity, target_webentity, source_webentity = target_webentity AS follow, count(*) AS n FROM wl GROUP BY 1, 2, 3")
def j3_webentity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joins.webentity_links(links(spark, sf_dir), corpus(spark, sf_dir))
    return found.groupBy("source_webentity", "target_webentity", "follow").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, c_name AS name, c_mktsegment AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 <> 0")
def j4_lookup_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.concat(F.lit("did:"), F.col("c_custkey").cast("string")).alias("did"), F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("handle"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    key = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "did:").otherwise("@h"), F.col("o_custkey").cast("string"))
    return joins.lookup_enrich(table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key")), "key", people, ["did", "handle"], ["name", "segment"]).drop("key")


# Answers by page_id % 10: 0, 1, 2 lead on to the next page by location, refresh header and script; 3 answers, and every other one has a canonical link; 4 and 5 lead to each other;
# 6 points at itself; 7 has no location; 8 has a meta tag with a URL that is not asked for but carries the next page's; 9 is not found. Pages of another host lead on to the next,
# save every thirtieth: most of these chains are too long.
_STEPS = """p AS (SELECT page_id AS n, page_id % 10 AS k, 'https://s' || page_id || '.example.org/' AS url, 'https://s' || (page_id + 1) || '.example.org/' AS onward FROM pages),
  e AS (SELECT url, CASE WHEN k IN (0, 1, 2, 4) THEN onward WHEN k = 5 THEN 'https://s' || (n - 1) || '.example.org/' WHEN k = 6 THEN url WHEN k = 8 THEN 'https://go.example.org/?n=' || n || '&url=https%3A%2F%2Fs' || (n + 1) || '.example.org%2F' END AS next,
      CASE k WHEN 1 THEN 'refresh-header' WHEN 2 THEN 'js-relocation' WHEN 3 THEN 'hit' WHEN 8 THEN 'meta-refresh' WHEN 9 THEN 'hit' ELSE 'location-header' END AS kind, CASE WHEN k IN (0, 4, 5, 6, 7) THEN 301 WHEN k = 9 THEN 404 ELSE 200 END AS status,
      CASE WHEN n % 20 = 3 THEN url || 'canonical' END AS canonical FROM p
    UNION ALL SELECT 'https://go.example.org/?n=' || n || '&url=https%3A%2F%2Fs' || (n + 1) || '.example.org%2F', onward, 'infer', NULL, NULL FROM p WHERE k = 8
    UNION ALL SELECT 'https://l' || n || '.example.org/', CASE WHEN n % 30 <> 29 THEN 'https://l' || (n + 1) || '.example.org/' END, CASE WHEN n % 30 <> 29 THEN 'location-header' ELSE 'hit' END, CASE WHEN n % 30 <> 29 THEN 302 ELSE 200 END, NULL FROM p),
  w AS (SELECT url AS start, url AS here, [url] AS seen, []::VARCHAR[] AS kinds FROM e WHERE kind <> 'infer'
    UNION ALL SELECT start, e.next, list_append(seen, e.next), list_append(kinds, e.kind) FROM w JOIN e ON e.url = w.here WHERE e.next IS NOT NULL AND NOT list_contains(seen, e.next) AND len(seen) < 20),
  last AS (SELECT start, max_by(here, len(seen)) AS here, max_by(seen, len(seen)) AS seen, max_by(kinds, len(seen)) AS kinds FROM w GROUP BY start),
  r AS (SELECT start, here, e.*, CASE WHEN e.url IS NULL THEN kinds ELSE list_append(kinds, e.kind) END AS chain,
      CASE WHEN e.url IS NULL THEN 'not-recorded' WHEN e.next = here THEN 'self-redirect' WHEN e.next IS NULL AND e.kind <> 'hit' THEN 'invalid-redirect' WHEN e.next IS NULL THEN NULL WHEN list_contains(seen, e.next) AND len(seen) < 20 THEN 'infinite-redirects' ELSE 'max-redirects' END AS error
    FROM last LEFT JOIN e ON e.url = here)"""


@query(f"""WITH RECURSIVE {_STEPS} SELECT start AS url, CASE WHEN error IS NULL AND canonical IS NOT NULL THEN canonical ELSE here END AS resolved_url, status AS http_status, error AS resolution_error,
  (len(chain) - CASE WHEN list_contains(chain, 'hit') THEN 1 ELSE 0 END + CASE WHEN error IS NULL AND canonical IS NOT NULL THEN 1 ELSE 0 END)::INT AS redirect_count, array_to_string(chain, '|') || CASE WHEN error IS NULL AND canonical IS NOT NULL THEN '|canonical' ELSE '' END AS redirect_chain FROM r""")
def j5_resolve_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("page_id"), F.col("page_id") % 10
    url = lambda c, host="s": F.concat(F.lit(f"https://{host}"), c.cast("string"), F.lit(".example.org/"))
    carrier = F.concat(F.lit("https://go.example.org/?n="), n.cast("string"), F.lit("&url=https%3A%2F%2Fs"), (n + 1).cast("string"), F.lit(".example.org%2F"))
    pages = table(spark, sf_dir, "pages")
    body = (
        F.when(k == 2, F.concat(F.lit("<script>location = '"), url(n + 1), F.lit("'</script>"))).when(k == 8, F.concat(F.lit('<meta http-equiv="refresh" content="0; url='), carrier, F.lit('">')))
        .when(n % 20 == 3, F.lit('<link rel="canonical" href="/canonical">')).otherwise("<p>")
    )
    hops = pages.select(
        url(n).alias("url"), F.when(k.isin(0, 4, 5, 6, 7), 301).when(k == 9, 404).otherwise(200).alias("status"), F.when(k.isin(0, 4), url(n + 1)).when(k == 5, url(n - 1)).when(k == 6, url(n)).alias("location"),
        F.when(k == 1, F.concat(F.lit("0; url="), url(n + 1))).alias("refresh"), body.alias("body"),
    )
    on = n % 30 != 29
    none = F.lit(None).cast("string")
    long = pages.select(url(n, "l").alias("url"), F.when(on, 302).otherwise(200).alias("status"), F.when(on, url(n + 1, "l")).alias("location"), none.alias("refresh"), F.lit("<p>").alias("body"))
    hops = hops.unionByName(long)
    found = joins.resolve_redirects(hops.select("url"), hops, canonicalize=True)
    return found.withColumn("redirect_chain", F.array_join("redirect_chain", "|"))


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def j6_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    return joins.unseen(table(spark, sf_dir, "events").select("user_id").distinct(), seen, "user_id")


@query(
    """WITH t AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey // 2 END AS quoted_id, CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS retweeted_id, o_orderpriority AS text FROM orders)
  SELECT t.id, u.c_name AS name, q.text AS quoted_text, qu.c_name AS quoted_user, r.text AS retweeted_text,
    CASE WHEN u.c_name IS NULL THEN 'user-not-found' WHEN t.quoted_id IS NOT NULL AND q.id IS NULL THEN 'quoted-not-found' WHEN t.retweeted_id IS NOT NULL AND r.id IS NULL THEN 'retweeted-not-found' END AS error
  FROM t LEFT JOIN customer u ON u.c_custkey = t.user_id LEFT JOIN t q ON q.id = t.quoted_id LEFT JOIN customer qu ON qu.c_custkey = q.user_id LEFT JOIN t r ON r.id = t.retweeted_id"""
)
def j7_attach_referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    tweets = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("user_id"), F.when(k % 4 == 0, F.floor(k / 2)).alias("quoted_id"), F.when(k % 5 == 0, F.lit(1).cast("long")).alias("retweeted_id"), F.col("o_orderpriority").alias("text"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return joins.attach_referenced(tweets, users).select("id", "name", "quoted_text", "quoted_user", "retweeted_text", "error")


@query(
    """WITH t AS (SELECT o_orderkey AS k FROM orders)
  SELECT k AS tweet_id, CASE WHEN k % 8 = 0 THEN 'available_tweet' WHEN k % 8 = 1 THEN 'suspended_user' WHEN k % 8 = 2 THEN 'protected_user' WHEN k % 8 = 3 THEN 'censored_tweet' WHEN k % 8 = 4 THEN 'blocked_by_tweet_author'
    WHEN k % 3 = 0 THEN 'deactivated_user' WHEN k % 2 = 1 AND k % 5 = 0 THEN 'suspended_retweeted_user' WHEN k % 2 = 1 AND k % 5 = 1 THEN 'unavailable_retweet' ELSE 'unavailable_tweet' END AS current_tweet_status FROM t"""
)
def j8_tweet_attrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    null = F.lit(None).cast("int")
    base = table(spark, sf_dir, "orders").select(k.alias("tweet_id"), (k + 5000000000).alias("user_id"), F.when(k % 2 == 1, -k).alias("retweeted_id"))
    n = F.col("tweet_id") % 8
    replies = base.where("tweet_id % 8 < 7").select("tweet_id", F.when(n.isin(1, 2), 403).when(n == 4, 401).when(n.isin(3, 5, 6), 404).alias("status"), F.when(n == 1, 63).when(n == 2, 179).when(n == 3, 421).when(n == 4, 136).when(n.isin(5, 6), 144).alias("code"))
    gone = F.col("tweet_id") % 3 == 0
    users = base.select("user_id", F.when(gone, 404).otherwise(null).alias("status"), F.when(gone, 50).otherwise(null).alias("code"))
    five = F.abs(F.col("retweeted_id")) % 5
    originals = base.where(five.isin(0, 1)).select(F.col("retweeted_id").alias("tweet_id"), F.when(five == 0, 403).alias("status"), F.when(five == 0, 63).alias("code"))
    return joins.tweet_attrition(base, replies, users, originals).select("tweet_id", "current_tweet_status")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def w2_dedupe_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.dedupe_by_id(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id")


@query("SELECT user_id, max_by(value, event_id) AS value FROM events GROUP BY 1")
def w3_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.last_write_wins(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "value")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 3")
def w8_limit_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.limit_per_query(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 3).select("o_custkey", "o_orderkey")


@query("SELECT c AS o_custkey, min_by(lang, r) AS lang, min_by(k, r) AS o_orderkey FROM (SELECT o_custkey AS c, o_orderkey AS k, l AS lang, [CASE l WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 3 END::VARCHAR, CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END, l, lpad(o_orderkey::VARCHAR, 12, '0')] AS r FROM (SELECT *, ['de', 'en', 'es', 'fr', 'it'][o_orderkey % 5 + 1] AS l FROM orders)) GROUP BY 1")
def w6_best_caption_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    tracks = table(spark, sf_dir, "orders").groupBy("o_custkey", F.get(F.array(*map(F.lit, ["de", "en", "es", "fr", "it"])), (k % 5).cast("int")).alias("lang"), (k % 2 == 0).alias("generated")).agg(F.min(k).alias("o_orderkey"))
    return frontier.best_caption_track(tracks, "o_custkey", ["fr", "en"]).select("o_custkey", "lang", "o_orderkey")


@query(
    """WITH RECURSIVE c AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN NULL WHEN turn % 2 = 1 THEN turn - 1 ELSE 0 END AS up FROM conversations),
  t AS (SELECT conv_id, turn, 0 AS depth, [turn] AS way FROM c WHERE up IS NULL UNION ALL SELECT c.conv_id, c.turn, t.depth + 1, t.way || [c.turn] FROM c JOIN t ON c.conv_id = t.conv_id AND c.up = t.turn)
  SELECT conv_id, turn, depth::INT AS depth, row_number() OVER (PARTITION BY conv_id ORDER BY way)::INT AS position FROM t"""
)
def w7_thread_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    comments = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(t > 0, F.when(t % 2 == 1, t - 1).otherwise(0)).alias("up"), t.alias("at"))
    return frontier.thread_order(comments, "conv_id", "turn", "up", "at").select("conv_id", "turn", "depth", "position")


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, turn, 0 AS depth FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, t.depth + 1 FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn = t.turn + 1)
  SELECT c.conv_id, c.turn, t.depth::INT AS depth, t.depth::INT + 1 AS position, CASE WHEN t.depth IS NULL THEN 'no-root' END AS error FROM conversations c LEFT JOIN t ON c.conv_id = t.conv_id AND c.turn = t.turn"""
)
def w7_thread_order_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as the reply to the one before, as deep as conversations are long."""
    t = F.col("turn")
    comments = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(t > 0, t - 1).alias("up"), (t + 1_700_000_000_000).alias("at"))
    return frontier.thread_order(comments, "conv_id", "turn", "up", "at").select("conv_id", "turn", "depth", "position", "error")

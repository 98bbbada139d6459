"""Queries of frontiers, crawls and link graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.jobs.join_jobs import ENTITIES, LINKS, WELINKS, corpus, links
from weblake.jobs.query import query
from weblake.operators import aggregates, frontier, graph, joins
from weblake.operators.storage import shared_folder
from weblake.operators.visited import VisitedSet
from weblake.sources.tables import table


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl queue of events: group by user, priority by number, most still to do."""
    n = F.col("event_id")
    status = F.when(n % 10 == 0, "done").when(n % 10 == 1, "doing").otherwise("todo")
    return table(spark, sf_dir, "events").select(n.alias("index"), F.when(n % 50 != 7, F.col("user_id")).alias("group"), (n % 6).alias("priority"), status.alias("status"))


QUEUE = "q AS (SELECT event_id AS index, CASE WHEN event_id % 50 <> 7 THEN user_id END AS \"group\", event_id % 6 AS priority, CASE event_id % 10 WHEN 0 THEN 'done' WHEN 1 THEN 'doing' ELSE 'todo' END AS status FROM events)"


@query(f"WITH {QUEUE} SELECT \"group\", count(*) FILTER (status = 'todo') AS todo, count(*) FILTER (status = 'doing') AS doing, count(*) FILTER (status = 'done') AS done, greatest(0, 3 - count(*) FILTER (status = 'doing')) AS allowed FROM q GROUP BY 1")
def a4_crawl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.crawl_counts(queue(spark, sf_dir), parallelism=3)


@query(f"WITH {QUEUE} SELECT index, priority, row_number() OVER (ORDER BY priority, index DESC) AS place FROM q WHERE status = 'todo'")
def w4_frontier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs with their places."""
    return frontier.frontier_places(queue(spark, sf_dir), lifo=True).select("index", "priority", "place")


@query(f"WITH {QUEUE}, r AS (SELECT *, row_number() OVER (PARTITION BY \"group\" ORDER BY priority, index) - 1 AS p FROM q WHERE status = 'todo') SELECT index, CASE WHEN \"group\" IS NULL THEN 0 ELSE p // 2 END AS batch, CASE WHEN \"group\" IS NULL THEN 0.0 ELSE (p // 2) * 0.5::DOUBLE END AS start FROM r")
def w5_politeness_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.politeness_plan(queue(spark, sf_dir), throttle=0.5, parallelism=2).select("index", "batch", F.col("start").cast("double").alias("start"))


@query(f"WITH {QUEUE} SELECT index, CASE status WHEN 'doing' THEN 'todo' ELSE status END AS status FROM q WHERE status <> 'done' OR index = (SELECT max(index) FROM q)")
def w9_dump_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.dump_queue(queue(spark, sf_dir), resumed=True, cleanup=True).select("index", "status")


@query("""WITH f AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), seen AS (SELECT DISTINCT u FROM f WHERE page_id % 4 = 0)
  SELECT min(page_id) AS page_id FROM f WHERE u NOT IN (SELECT u FROM seen) GROUP BY u""")
def w10_next_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("url"))
    return frontier.next_frontier(pages.where("page_id % 2 = 1"), pages.where("page_id % 2 = 0"), pages.where("page_id % 4 = 0").select("url"), "url", "page_id").select("page_id")


@query("SELECT 'https://n' || user_id || '.example.org' AS key, min(event_id % 4)::INT AS batch FROM events GROUP BY 1")
def w10_visited_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which of four batches of events each user's URL is seen for the first time, by a set that stays on disk."""
    urls_ = table(spark, sf_dir, "events").select(F.concat(F.lit("https://n"), F.col("user_id").cast("string"), F.lit(".example.org")).alias("url"), (F.col("event_id") % 4).cast("int").alias("batch"))
    known = VisitedSet(spark, f"{shared_folder(spark)}/visited-{uuid.uuid4().hex}")
    new = [known.add(urls_.where(F.col("batch") == n), "url").withColumn("batch", F.lit(n)) for n in range(4)]
    return new[0].unionByName(new[1]).unionByName(new[2]).unionByName(new[3])


@query("SELECT j.page_id AS id, count(c.page_id) AS degree FROM pages j LEFT JOIN pages c ON c.page_id // 3 = j.page_id AND c.page_id > 0 GROUP BY 1")
def a5_crawl_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") > 0, F.floor(F.col("page_id") / 3)).alias("parent"))
    return aggregates.crawl_degree(jobs).select("id", "degree")


@query(f"""WITH {WELINKS}, pairs AS (SELECT DISTINCT source_webentity AS s, target_webentity AS t FROM wl WHERE source_webentity <> target_webentity),
  either AS (SELECT s, t FROM pairs UNION SELECT t, s FROM pairs), pc AS (SELECT webentity, count(*) AS pages FROM m WHERE status = 'IN' GROUP BY 1)
  SELECT webentity, (SELECT count(*) FROM pairs WHERE t = webentity) AS indegree, (SELECT count(*) FROM pairs WHERE s = webentity) AS outdegree,
    (SELECT count(*) FROM pairs WHERE t = webentity) + (SELECT count(*) FROM pairs WHERE s = webentity) AS degree, (SELECT count(*) FROM either WHERE s = webentity) AS undirected_degree, pages FROM pc""")
def a6_webentity_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = corpus(spark, sf_dir)
    pages = joins.match_webentities(table(spark, sf_dir, "pages").select("page_id", "url"), "url", known).where("status = 'IN'")
    return aggregates.webentity_degrees(joins.webentity_links(links(spark, sf_dir), known), pages.select("webentity"))


@query(f"WITH {ENTITIES} SELECT status, count(*) AS entities, 2 * count(*) AS prefixes, count(*) AS start_pages FROM e GROUP BY 1")
def a7_webentity_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.webentity_corpus_stats(corpus(spark, sf_dir))


@query("""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href FROM pages WHERE page_id % 7 <> 0)
  SELECT url AS from_url, count(*) AS n_links FROM (SELECT DISTINCT page_id, url, lower(regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)) || href AS link FROM h) GROUP BY 1""")
def c1_h9_link_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("http_status", F.when(F.col("page_id") % 7 == 0, "404").otherwise("200"))
    return graph.link_table(pages).groupBy("from_url").agg(F.count("*").alias("n_links"))


@query(f"""WITH RECURSIVE {LINKS}, edges AS (SELECT DISTINCT 'https://n' || from_id || '.example.org' AS a, 'https://n' || to_id || '.example.org' AS b FROM links),
  reach AS (SELECT 'https://n' || page_id || '.example.org' AS url, 0 AS depth FROM pages WHERE page_id % 10 = 3 UNION SELECT b, depth + 1 FROM reach JOIN edges ON a = url WHERE depth < 6)
  SELECT url, min(depth) AS depth, 'example.org' AS "group" FROM reach GROUP BY 1""")
def c2_crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a tenth of all pages."""
    node = lambda c: F.concat(F.lit("https://n"), F.col(c).cast("string"), F.lit(".example.org/"))
    edges = links(spark, sf_dir).select(node("from_id").alias("from_url"), node("to_id").alias("to_url"))
    start = table(spark, sf_dir, "pages").where("page_id % 10 = 3").select(node("page_id").alias("url"))
    return graph.crawl_bfs(start, edges, 6).select("url", "depth", "group")


@query("""SELECT page_id AS id, CASE WHEN page_id > 0 THEN page_id // 3 END AS parent, 'default' AS spider, 1 AS depth, url, (SELECT count(*) FROM pages c WHERE c.page_id > 0 AND c.page_id // 3 = p.page_id) AS degree,
  CASE WHEN page_id % 5 = 0 THEN 'not-fetched' END AS error, CASE WHEN page_id % 5 <> 0 THEN length(html) END AS body_size FROM pages p""")
def c3_crawl_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    jobs = table(spark, sf_dir, "pages").select(n.alias("id"), F.when(n > 0, F.floor(n / 3)).alias("parent"), F.lit("default").alias("spider"), F.lit(1).alias("depth"), F.concat("url", F.lit("#"), n).alias("url"))
    fetched = table(spark, sf_dir, "pages").where("page_id % 5 <> 0").select(F.concat("url", F.lit("#"), n).alias("url"), F.col("url").alias("resolved_url"), F.lit(None).cast("string").alias("error"), F.lit(200).alias("status"), F.lit(None).cast("timestamp").alias("datetime_utc"), F.lit("text/html").alias("mimetype"), F.length("html").alias("body_size"), F.lit("utf-8").alias("encoding"))
    found = graph.crawl_results(jobs, fetched)
    return found.select("id", "parent", "spider", "depth", F.regexp_replace("url", "#[0-9]+$", "").alias("url"), "degree", "error", "body_size")


_FOCUS = """p AS (SELECT doc_id AS page_id, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '(?i)the')) AS n FROM documents),
  f AS (SELECT page_id, n, CASE WHEN page_id % 7 = 0 THEN 'not-html' WHEN page_id % 5 = 0 THEN 'binary' WHEN n = 0 THEN 'irrelevant' END AS invalidity FROM p)"""


def _focus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with three links each; some are no HTML, some binary."""
    k = F.col("doc_id")
    said = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    links = F.concat(F.lit("<a href='/news/"), k.cast("string"), F.lit("'></a><a href='/other/"), k.cast("string"), F.lit("'></a><a href='/news/x.pdf'></a><a href='mailto:a@b.c'></a>"))
    page = F.when(k % 7 == 0, "plain text of the page").otherwise(F.concat(F.lit("<html><body><p>"), said, F.lit("</p>"), links, F.lit("</body></html>")))
    url = F.concat(F.lit("https://site.org/d/"), k.cast("string"))
    return table(spark, sf_dir, "documents").select(k.alias("page_id"), url.alias("url"), F.when(k % 5 == 0, "image/png").otherwise("text/html").alias("mimetype"), page.alias("html"))


@query(f"""WITH {_FOCUS} SELECT page_id, invalidity, invalidity IS NULL AS relevant, CASE WHEN coalesce(invalidity, 'irrelevant') = 'irrelevant' THEN nullif(n, 0)::INT END AS matches, invalidity IS NULL AS expand,
  CASE WHEN invalidity IS NULL THEN ['https://site.org/news/' || page_id] ELSE []::VARCHAR[] END AS next FROM f""")
def c4_focus_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.focus_crawl(_focus_pages(spark, sf_dir), "the", url_pattern="/news/").drop("url", "links")


@query(f"""WITH {_FOCUS} SELECT page_id, invalidity, invalidity = 'irrelevant' OR invalidity IS NULL AS expand, CASE WHEN coalesce(invalidity, 'irrelevant') = 'irrelevant' THEN ['https://site.org/news/' || page_id, 'https://site.org/other/' || page_id] ELSE []::VARCHAR[] END AS next FROM f""")
def c4_focus_crawl_goes_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.focus_crawl(_focus_pages(spark, sf_dir), "the", irrelevant_continue=True).select("page_id", "invalidity", F.coalesce("expand", F.lit(False)).alias("expand"), "next")


@query(r"""SELECT page_id, len(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS n_links, regexp_extract(url, '^(https?://[^/]+)', 1) || regexp_extract(html, 'href="(/[^"]*)"', 1) AS first_link FROM pages WHERE regexp_matches(html, 'href="/')""")
def d2_spider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spider that counts a page's links and wants the first of them."""
    from weblake.html.tree import select

    def follow(job, page):
        links = [a.attrs["href"] for a in select(page, "a[href]") if a.attrs["href"].startswith("/")]
        return {"n_links": len(links)}, links[:1]

    found = graph.spider(table(spark, sf_dir, "pages"), follow, "n_links:bigint")
    return found.where(F.size("next") > 0).select("page_id", "data.n_links", F.get("next", 0).alias("first_link"))


@query("SELECT page_id, ['own', 'fwd', 'par'][page_id % 3 + 1] AS routed, CASE WHEN page_id % 3 = 2 THEN 'unknown-spider' END AS route_error FROM pages")
def c6_route_spiders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    targets = table(spark, sf_dir, "pages").select("page_id", F.when(k == 0, "own").alias("spider"), F.when(k <= 1, "fwd").alias("forward"), F.lit("par").alias("parent_spider"))
    return graph.route_spiders(targets, ["own", "fwd"]).select("page_id", "routed", "route_error")


@query("""WITH d AS (SELECT p.page_id AS id, p.url, CASE WHEN p.page_id > 0 THEN p.page_id // 3 END AS parent, (SELECT count(*) FROM pages c WHERE c.page_id > 0 AND c.page_id // 3 = p.page_id) AS degree FROM pages p)
  SELECT id::VARCHAR AS key, url AS label, CASE WHEN degree > 0 THEN degree ELSE 1 END AS size, CASE WHEN id % 2 = 0 THEN 200 END AS status, CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS relevant, (SELECT count(*) FROM d e WHERE e.parent = d.id) AS n_edges FROM d""")
def c7_crawl_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl read from text: every value is a string, a degree of 0 is blank."""
    n = F.col("page_id")
    jobs = table(spark, sf_dir, "pages").select(n.alias("id"), F.when(n > 0, F.floor(n / 3)).alias("parent"), "url")
    rows = aggregates.crawl_degree(jobs).select(
        F.col("id").cast("string").alias("id"), F.coalesce(F.col("parent").cast("string"), F.lit("")).alias("parent"), "url", F.when(F.col("degree") > 0, F.col("degree").cast("string")).otherwise("").alias("degree"),
        F.when(F.col("id") % 2 == 0, "200").otherwise("").alias("status"), F.when(F.col("id") % 3 == 0, "yes").when(F.col("id") % 3 == 1, "no").otherwise("?").alias("relevant"),
    )
    nodes, edges = graph.crawl_graph(rows, label="url", attributes=("status", "relevant"))
    out = edges.groupBy(F.col("source").alias("key")).agg(F.count("*").alias("n_edges"))
    return nodes.join(out, "key", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


@query(f"WITH {ENTITIES} SELECT host AS webentity, unnest(['http://' || host, 'https://' || host, 'http://' || host || '/start']) AS url FROM e WHERE status = 'IN'")
def c8_start_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.start_pages(corpus(spark, sf_dir))


@query(f"""WITH {_FOCUS} SELECT page_id, ['https://site.org/other/' || page_id] AS next FROM f WHERE invalidity IS NULL""")
def c4_focus_crawl_inverted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.focus_crawl(_focus_pages(spark, sf_dir), "the", url_pattern="/news/", invert_url=True).where("relevant").select("page_id", "next")


@query(f"""WITH {_FOCUS} SELECT 'https://site.org/d/' || page_id AS source, ['https://site.org/news/' || page_id, 'https://site.org/other/' || page_id, 'https://site.org/news/x.pdf'][i] AS target, invalidity IS NULL AS source_relevant, invalidity AS source_invalidity,
  i = 1 AS target_relevant, CASE i WHEN 2 THEN 'irrelevant' WHEN 3 THEN 'not-html' END AS target_invalidity FROM f, (SELECT unnest([1, 2, 3]) AS i) WHERE coalesce(invalidity, 'irrelevant') = 'irrelevant'""")
def c5_focus_link_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages that were read; each page names its first link twice."""
    pages = _focus_pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("</body>"), F.concat(F.lit("<a href='/news/"), F.col("page_id").cast("string"), F.lit("'>again</a></body>"))))
    return graph.focus_link_report(graph.focus_crawl(pages, "the", url_pattern="/news/"))


# A crawl of the documents as pages: document k links to k + 7 (twice), 2 k and 3 k + 1, some of which are none.
_CRAWLED = f"""{_FOCUS}, u AS (SELECT *, 'https://site.org/d/' || page_id AS url FROM f), e AS (SELECT url AS a, 'https://site.org/d/' || unnest([page_id + 7, page_id * 2, page_id * 3 + 1]) AS b FROM u WHERE invalidity IS NULL),
  reach AS (SELECT url, 0 AS depth FROM u WHERE page_id % 40 = 3 UNION SELECT b, depth + 1 FROM reach JOIN e ON a = url WHERE depth < 5),
  least AS (SELECT url, min(depth) AS depth FROM reach GROUP BY 1), tree AS (SELECT l.url, l.depth, min(p.url) AS parent FROM least l LEFT JOIN e ON e.b = l.url LEFT JOIN least p ON p.url = e.a AND p.depth = l.depth - 1 GROUP BY ALL)"""


def crawled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    link = lambda n: F.concat(F.lit("<a href='"), n.cast("string"), F.lit("'>.</a>"))
    links = F.concat(link(k + 7), link(k * 2), link(k * 3 + 1), link(k + 7), F.lit("</body>"))
    return _focus_pages(spark, sf_dir).withColumn("html", F.replace(F.regexp_replace("html", "<a href='[^']*'></a>", ""), F.lit("</body>"), links))


@query(f"""WITH RECURSIVE {_CRAWLED} SELECT t.url, t.depth, t.parent, u.invalidity, CASE WHEN u.url IS NOT NULL THEN u.invalidity IS NULL END AS relevant, CASE WHEN coalesce(u.invalidity, 'irrelevant') = 'irrelevant' THEN nullif(u.n, 0)::INT END AS matches,
  CASE WHEN u.url IS NULL THEN 'not-fetched' END AS error, (SELECT count(*) FROM tree c WHERE c.parent = t.url) AS degree FROM tree t LEFT JOIN u ON u.url = t.url""")
def c4_focused_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are judged level by level; only relevant ones expand."""
    pages = crawled_documents(spark, sf_dir)
    found = graph.focused_crawl(pages.where("page_id % 40 = 3").select("url"), pages, "the", max_depth=5)
    return found.select("url", "depth", "parent", "invalidity", "relevant", "matches", "error", "degree")


@query("""WITH RECURSIVE u AS (SELECT doc_id AS k, 'https://site.org/d/' || doc_id AS url FROM documents),
  e AS (SELECT url AS a, CASE WHEN k % 7 = 0 THEN 'leaf' ELSE 'hub' END AS by, 'https://site.org/d/' || (k + 7) AS b, 'leaf' AS spider, 2 AS priority FROM u WHERE k % 7 <> 0 UNION ALL SELECT url, 'hub', 'https://site.org/d/' || (k * 2), 'hub', 1 FROM u WHERE k % 7 <> 0
    UNION ALL SELECT url, 'leaf', 'https://site.org/d/' || (k + 1), 'nobody', 1 FROM u WHERE k % 10 = 1 AND k % 7 <> 0),
  s AS (SELECT url, 0 AS depth, NULL::VARCHAR AS parent, 'hub' AS spider, NULL::INT AS priority FROM u WHERE k % 50 = 3),
  l1 AS (SELECT b AS url, 1 AS depth, arg_min(s.url, (e.priority, s.url)) AS parent, arg_min(e.spider, (e.priority, s.url)) AS spider, min(e.priority) AS priority FROM s JOIN e ON e.a = s.url AND e.by = s.spider WHERE b NOT IN (SELECT url FROM s) GROUP BY b),
  l2 AS (SELECT b AS url, 2 AS depth, arg_min(s.url, (e.priority, s.url)) AS parent, arg_min(e.spider, (e.priority, s.url)) AS spider, min(e.priority) AS priority FROM l1 s JOIN e ON e.a = s.url AND e.by = s.spider
    WHERE b NOT IN (SELECT url FROM s UNION SELECT url FROM l1) GROUP BY b),
  every AS (SELECT * FROM s UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)
  SELECT v.url, v.depth, v.parent, v.spider, v.priority, CASE WHEN u.k % 7 <> 0 AND v.spider <> 'nobody' THEN v.spider || u.k END AS said, CASE WHEN u.url IS NULL THEN 'not-fetched' END AS error, CASE WHEN v.spider = 'nobody' AND u.url IS NOT NULL THEN 'unknown-spider' END AS spider_error
  FROM every v LEFT JOIN u ON u.url = v.url""")
def c6_d2_spider_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spiders: hubs name the next page for leaves and the double for hubs, some leaves a page for a spider that is none; pages without HTML have no links."""
    from weblake.html.tree import select

    def hub(job, page):
        hrefs = [a.attrs["href"] for a in select(page, "a[href]")]
        return {"said": f"hub{job['job_url'].rsplit('/', 1)[1]}" if hrefs else None}, [{"url": hrefs[0], "spider": "leaf", "priority": 2}, {"url": hrefs[1], "priority": 1}] if hrefs else []

    def leaf(job, page):
        k = int(job["job_url"].rsplit("/", 1)[1])
        linked = bool(select(page, "a[href]"))
        return {"said": f"leaf{k}" if linked else None}, [{"url": f"/d/{k + 1}", "spider": "nobody", "priority": 1}] if linked and k % 10 == 1 else []

    pages = crawled_documents(spark, sf_dir)
    start = pages.where("page_id % 50 = 3").select("url", F.lit("hub").alias("spider"))
    found = graph.spider_crawl(start, pages, {"hub": hub, "leaf": leaf}, "said:string", max_depth=2)
    return found.select("url", "depth", "parent", "spider", "priority", "data.said", "error", "spider_error")

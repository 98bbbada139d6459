"""Queries of HTML operators over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.jobs.query import query
from weblake.jobs.text_jobs import REPORT, report
from weblake.operators import html
from weblake.sources.tables import table


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.named(table(spark, sf_dir, "pages"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a head of links, images and a table, by page_id."""
    n = F.col("page_id").cast("string")
    head = F.concat(
        F.lit("<link rel=canonical href=' /c/"), n, F.lit("'><link type='application/rss+xml' href='/feed/"), n, F.lit("'><img src='/i/"), n, F.lit(".png'><img src='data:x'>"),
        F.lit("<table><tr><th>k<th>v<tr><td>a<td>"), n, F.lit("<tr><td>b<td>2</table>"),
    )
    return table(spark, sf_dir, "pages").withColumn("html", F.concat(head, "html"))


# Character references are read as browsers read them: these names need no semicolon, as where a title is cut.
_TEXT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


@query(f"SELECT page_id, trim({_TEXT.format('''regexp_extract(html, '<title>([^<]*)</title>', 1)''')}) AS title FROM pages")
def h1_scrape_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.scrape_title(found(spark, sf_dir))


@query("SELECT page_id, '/c/' || page_id AS canonical FROM pages")
def h2_scrape_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.scrape_canonical(html.named(tagged(spark, sf_dir)))


@query(r"""WITH h AS (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages)
  SELECT page_id, (i - 1)::INT AS place, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || hs[i] AS link FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM h)""")
def h3_scrape_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.scrape_urls(found(spark, sf_dir))


@query(r"SELECT page_id, 0 AS place, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || '/i/' || page_id || '.png' AS src FROM pages")
def h4_scrape_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.scrape_images(html.named(tagged(spark, sf_dir)))


@query("SELECT page_id, (i - 1)::INT AS place, ms[i] AS charset FROM (SELECT page_id, ms, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<meta charset=\"([^\"]*)\"', 1) AS ms FROM pages))")
def h5_scrape_metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.scrape_metas(found(spark, sf_dir)).select("page_id", "place", "charset")


@query(r"SELECT page_id, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || '/feed/' || page_id AS feed FROM pages")
def h6_scrape_rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.scrape_rss(html.named(tagged(spark, sf_dir)))


@query(r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS ts FROM pages)
  SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS place, hs[i] AS href, trim(ts[i]) AS label FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM h)""")
def h8_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = {"iterator": "nav > ul li a", "fields": {"href": "href", "label": "text"}}
    return html.scrape(table(spark, sf_dir, "pages"), definition)


@query("""SELECT page_id, 0 AS place, [page_id::VARCHAR, '', 'last'] AS cells FROM pages UNION ALL SELECT page_id, 1, ['x', 'y'] FROM pages UNION ALL SELECT page_id, 2, ['in ' || page_id] FROM pages""")
def h10_tabulate_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in a cell of a table: its rows are its own, and come after."""
    n = F.col("page_id").cast("string")
    nested = F.concat(F.lit("<table><tr><td>"), n, F.lit("<td><table><tr><td>in "), n, F.lit("</table></td><td>last</tr><tr><td>x<td>y</table>"), F.col("html"))
    rows = html.tabulate(table(spark, sf_dir, "pages").withColumn("html", nested), headers_inference=None)
    return rows.select("page_id", "place", F.transform(F.array_sort(F.map_keys("cells")), lambda k: rows.cells[k]).alias("cells"))


@query("SELECT page_id, i::INT AS place, ['a', 'b'][i + 1] AS k, [page_id::VARCHAR, '2'][i + 1] AS v FROM pages, (SELECT unnest([0, 1]) AS i)")
def h10_tabulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.tabulate(tagged(spark, sf_dir))
    return rows.select("page_id", "place", rows.cells["k"].alias("k"), rows.cells["v"].alias("v"))


@query()
def h11_display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.display_texts(table(spark, sf_dir, "pages"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS first, len(regexp_extract_all(html, '<a href="[^"]*"')) AS n FROM pages""")
def h12_select_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.select_text(table(spark, sf_dir, "pages"), "ul > li:nth-child(1) a, li a").select("page_id", "first", F.size("matches").cast("long").alias("n"))


@query("SELECT page_id, lang FROM (SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages)")
def h13_scrape_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    def languages(row, root):
        for e in root.walk():
            if e.name == "html":
                yield {"lang": e.attrs.get("lang")}

    return html.scrape_with(table(spark, sf_dir, "pages"), languages, "lang:string")


@query()
def h14_h15_extract_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = html.extract_content(table(spark, sf_dir, "pages"))
    return content.withColumn("blurb", html.blurb("title", "description", "content", "tags"))


_GATED = "CASE WHEN fetch_error IS NOT NULL THEN 'http-errored' WHEN http_status IS NULL OR http_status = '404' THEN 'invalid-status' WHEN mimetype IS NULL OR mimetype NOT LIKE '%/htm%' THEN 'invalid-mimetype' WHEN body IS NULL THEN 'no-path-nor-body' WHEN encoding = 'klingon' THEN 'encoding-not-supported' END"


@query(rf"""WITH {REPORT}, g AS (SELECT page_id, {_GATED} AS extract_error, regexp_extract(body, '<article>(.*)</article>', 1, 's') AS article FROM r),
  t AS (SELECT *, regexp_replace(regexp_replace(article, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g') AS said FROM g)
  SELECT page_id, extract_error, CASE WHEN extract_error IS NULL THEN regexp_replace({_TEXT.format("regexp_replace(said, '&nbsp;?', ' ', 'g')")}, '[\s\xA0]+', '', 'g') END AS letters FROM t""")
def h14_extract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the articles of pages say, without white space; pages that the gate turns away stay as rows, with its reason."""
    found = html.extract_report(report(spark, sf_dir))
    return found.select("page_id", "extract_error", F.regexp_replace("content", "[\\s\u00a0]+", "").alias("letters"))


@query("SELECT page_id, url AS extracted_url FROM pages")
def h16_extract_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("see <"), "url", F.lit("> and (none).")).alias("said"))
    return html.extract_urls(said, "said").select("page_id", "extracted_url")


@query("SELECT page_id, 0 AS place, 'news·20240131·N' || page_id || '·x' AS id, 'T & ' || page_id AS title, 'Body' AS content, 'http://p/' || page_id AS url, '2024-01-31' AS date, 'Le Media' AS media, 'N' || page_id AS media_id FROM pages")
def h7_scrape_press_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    body = F.concat(
        F.lit("<article><span class='DocPublicationName'> Le Media, no. 3</span><p class=titreArticle>T &amp; "), n, F.lit("</p><div class=docOcurrContainer>&lt;b&gt;Body&lt;/b&gt;<a href='http://p/"), n,
        F.lit("'><i hidden>Cet article est paru dans X</i></a></div><div class='publiC-lblNodoc'>news·20240131·N"), n, F.lit("·x</div></article>"),
    )
    rows = html.scrape_press_articles(table(spark, sf_dir, "pages").select("page_id", body.alias("html")))
    return rows.withColumn("content", F.regexp_replace("content", "Cet article est paru dans X$", ""))


@query("SELECT doc_id, length(text)::INT AS n FROM documents")
def r4_decode_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    body = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.encode("text", "UTF-16")).otherwise(F.encode("text", "ISO-8859-1"))
    known = F.col("doc_id") % 2 == 0
    name = F.when(k == 0, F.when(known, "utf-8")).when(k == 1, F.when(known, "utf-16")).otherwise("iso-8859-1")
    docs = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"), name.alias("encoding"))
    return html.decode_body(docs).select("doc_id", F.length("text").alias("n"))

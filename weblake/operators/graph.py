"""Link graphs and crawls over stored pages."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblake.functions import text, urls
from weblake.functions.text import looks_like_html
from weblake.html.tree import Element, select
from weblake.operators.aggregates import crawl_degree
from weblake.operators.buckets import lookup_in_buckets, write_buckets
from weblake.operators.html import map_pages, named, page_links, read_content
from weblake.operators.storage import shared_folder, stored


def link_table(pages: DataFrame) -> DataFrame:
    """from_url, to_url of pages that answered 200 with HTML; once per page, without fragments."""
    good = pages.where((F.col("http_status").try_cast("double") == 200) & looks_like_html(F.col("html")))
    links = page_links(named(good, keep=("page_id", "url")), keep=("url",))
    return links.select(F.col("url").alias("from_url"), F.col("link").alias("to_url"))


def spider(pages: DataFrame, function: Callable, schema: str, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """What a spider function makes of each page: ``keep``, data (a struct of ``schema``) and next, URLs to crawl.

    function(job, page) -> (data, next): job is the mapping of the kept values, page the parsed tree, data
    a mapping or None, next a list of links, or None; they are joined with the page's URL.
    """

    def read(root: Element, row: dict[str, Any]) -> dict[str, Any]:
        data, targets = function(row, root)
        return {"data": data, "targets": list(targets or [])}

    found = map_pages(pages, html, read, f"data:struct<{schema.replace(' ', '')}>, targets:array<string>", keep)
    return found.select(*keep, "data", F.transform("targets", lambda t: urls.url_join(F.col("url"), t)).alias("next"))


def spider_links(found: DataFrame) -> DataFrame:
    """from_url, to_url of what a spider wants next: the edges of ``crawl_bfs``."""
    return found.select(F.col("url").alias("from_url"), F.explode("next").alias("to_url")).distinct()


def crawl_bfs(start: DataFrame, links: DataFrame, max_depth: int, normalized: bool = False) -> DataFrame:
    """Breadth-first crawl of a link table: url, depth, parent, group (domain).

    start: url; links: from_url, to_url. A URL is taken once, at its least depth, from its least parent
    in the order of URLs. Links are keyed and made distinct once; each level is one join of the new
    URLs with them, a dedup and an anti-join on the same key, written and read again.
    """
    key = urls.normalize_url if normalized else urls.canonicalize_url
    edges = stored(links.select(key(F.col("from_url")).alias("url"), key(F.col("to_url")).alias("next")).distinct())
    level = stored(start.select(key(F.col("url")).alias("url")).distinct().select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))
    found = level
    for depth in range(1, max_depth + 1):
        new = level.join(edges, "url").groupBy(F.col("next").alias("url")).agg(F.min("url").alias("parent"))
        level = stored(new.join(found.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth"), "parent"))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found.withColumn("group", urls.get_domain_name(F.col("url")))


RESULT = ("id", "parent", "spider", "depth", "url", "resolved_url", "error", "status", "datetime_utc", "mimetype", "degree", "body_size", "encoding")


def crawl_results(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """The thirteen columns of a crawl's results: jobs with their page and how many jobs they led to."""
    joined = crawl_degree(jobs).join(pages, "url", "left")
    return joined.withColumn("error", F.when(F.col("status").isNull() & F.col("error").isNull(), "not-fetched").otherwise(F.col("error"))).select(*RESULT)


def focus_crawl(
    pages: DataFrame, pattern: str | None, invert: bool = False, url_pattern: str | None = None, invert_url: bool = False, irrelevant_continue: bool = False, only_html: bool = True, extract: bool = False,
    extract_fields: tuple[str, ...] = ("title", "description", "content"), keep: tuple[str, ...] = ("page_id", "url"),
) -> DataFrame:
    """``keep``, invalidity, relevant, matches, expand, next (links to follow) and links of stored pages.

    invalidity is the first of not-html, binary, empty and irrelevant (``pattern`` is not in the text, or,
    with ``extract``, in the fields of the main content); only valid pages are relevant. ``links``: each
    link of a page that was read once, with its own invalidity: not-html if it can't be HTML, irrelevant
    if its URL lacks ``url_pattern`` (has it, with ``invert_url``). Links without one are followed if the page
    is relevant, or irrelevant and ``irrelevant_continue``. pages: url, mimetype, html and ``keep``.
    """
    every = tuple(dict.fromkeys((*keep, "url")))
    rows = pages.withColumn("like html", F.coalesce(looks_like_html(F.col("html")), F.lit(False))).withColumn("no bytes", F.coalesce(F.col("html"), F.lit("")) == "")

    def read(root: Element, row: dict[str, Any]) -> dict[str, Any]:
        content = {k: v for k, v in read_content(root).items() if k in extract_fields} if extract else {}
        said = [" ".join(v) if isinstance(v, list) else v for v in (content.get(f) for f in extract_fields) if v]
        return {"text": "\n".join(said) if extract else root.text(), "hrefs": [h for a in select(root, "a[href]") if (h := a.attrs["href"].strip())]}

    shown = map_pages(rows, "html", read, "text:string, hrefs:array<string>", (*every, "mimetype", "like html", "no bytes"))
    judged = text.relevance(F.col("text"), pattern, invert)
    broken = F.when(F.lit(only_html) & ~F.col("like html"), "not-html").when(text.is_binary_mimetype(F.col("mimetype")), "binary").when(F.col("no bytes"), "empty")
    out = shown.select(*every, "hrefs", broken.alias("broken"), judged.alias("j"))
    relevant = F.col("broken").isNull() & F.col("j.relevant")
    expand = F.col("broken").isNull() & (relevant | F.lit(irrelevant_continue))
    whole = F.array_distinct(F.transform(F.filter("hrefs", urls.should_follow_href), lambda h: urls.url_join(F.col("url"), h)))
    why = lambda u: F.when(F.lit(only_html) & ~urls.could_be_html(u), "not-html").when(~text.relevance(u, url_pattern, invert_url)["relevant"], "irrelevant")
    links = F.when(F.col("broken").isNull(), F.transform(whole, lambda u: F.struct(u.alias("url"), why(u).alias("invalidity"))))
    out = out.select(
        *every, F.coalesce("broken", F.when(~relevant, "irrelevant")).alias("invalidity"), relevant.alias("relevant"), F.when(F.col("broken").isNull(), F.col("j.matches")).alias("matches"), expand.alias("expand"), links.alias("links"),
    )
    good = F.transform(F.filter("links", lambda x: x["invalidity"].isNull()), lambda x: x["url"])
    return out.select(*keep, "invalidity", "relevant", "matches", "expand", F.when(F.col("expand"), good).otherwise(F.array().cast("array<string>")).alias("next"), "links")


def focus_link_report(focus: DataFrame) -> DataFrame:
    """source, target, whether each is relevant, and what is wrong with each, of what ``focus_crawl`` found.

    A row per link of a page, once; pages that were not read (no HTML, binary, empty) have none.
    """
    return focus.select("url", "relevant", "invalidity", F.explode("links").alias("link")).select(
        F.col("url").alias("source"), F.col("link.url").alias("target"), F.col("relevant").alias("source_relevant"), F.col("invalidity").alias("source_invalidity"),
        F.col("link.invalidity").isNull().alias("target_relevant"), F.col("link.invalidity").alias("target_invalidity"),
    )


TARGET = "struct<url:string,spider:string,priority:int>"


def crawl_through(start: DataFrame, pages: DataFrame, process: Callable[[DataFrame], DataFrame], max_depth: int = 10, buckets: int = 256) -> DataFrame:
    """A crawl of stored pages that goes on by what becomes of each: level by level, pages are read and then expand.

    start: url, and spider, priority if there are any. pages: url and what ``process`` needs; one page per URL,
    as ``crawl_bfs`` compares them. process: takes a level's pages with key, job_url, spider, depth, and returns key,
    ``targets`` (array of TARGET) and any columns. Returns url, depth, parent, spider, priority, error
    (not-fetched: no page), degree (targets that this page was the first to name) and the columns of ``process``.

    A URL is taken once, at its least depth, for its least priority, then its least parent. Pages are laid
    out once in buckets of their URL's hash; a level reads the buckets its URLs are in. Each level is stored:
    the lineage stays short, and a lost executor costs a read.
    """
    spark = start.sparkSession
    key = lambda c: urls.canonicalize_url(F.col(c))
    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.withColumn("key", F.lit("")).schema.fields)
    write_buckets(pages.withColumn("key", key("url")), "key", path, buckets)
    given = [F.col(c) if c in start.columns else F.lit(None).cast(t).alias(c) for c, t in (("spider", "string"), ("priority", "int"))]
    level = start.where("url is not null").select(key("url").alias("key"), *given, F.lit(None).cast("string").alias("parent"))
    job = F.struct("priority", "parent", "spider")
    seen, results = None, None
    for depth in range(max_depth + 1):
        one = level.groupBy("key").agg(F.min(job).alias("job")).select("key", "job.*")
        one = one if seen is None else one.join(seen, "key", "left_anti")
        one = stored(one)
        if one.isEmpty():
            break
        found = lookup_in_buckets(one.select("key", F.col("key").alias("job_url"), "spider", F.lit(depth).alias("depth")), "key", path, schema, buckets)
        done = stored(process(found))
        rest = [c for c in done.columns if c not in ("key", "targets")]
        rows = one.join(done.select("key", F.lit(True).alias("was read"), *rest), "key", "left")
        rows = rows.select(F.col("key").alias("url"), F.lit(depth).alias("depth"), "parent", "spider", "priority", F.when(F.col("was read").isNull(), "not-fetched").alias("error"), *rest)
        results = rows if results is None else results.unionByName(rows)
        seen = one.select("key") if seen is None else seen.unionByName(one.select("key"))
        level = done.select(F.col("key").alias("parent"), F.explode("targets").alias("t")).select(key("t.url").alias("key"), "t.spider", "t.priority", "parent")
    degrees = results.where("parent is not null").groupBy(F.col("parent").alias("url")).agg(F.count("*").alias("degree"))
    return results.join(degrees, "url", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def focused_crawl(start: DataFrame, pages: DataFrame, pattern: str | None, max_depth: int = 10, buckets: int = 256, **options) -> DataFrame:
    """A crawl whose pages are judged by ``focus_crawl`` before they expand: see ``crawl_through``; options are those of ``focus_crawl``."""

    def process(found: DataFrame) -> DataFrame:
        judged = focus_crawl(found, pattern, keep=("key",), **options)
        targets = F.transform("next", lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("spider"), F.lit(None).cast("int").alias("priority")))
        return judged.select("key", "invalidity", "relevant", "matches", targets.alias("targets"))

    return crawl_through(start, pages, process, max_depth, buckets)


def spider_crawl(start: DataFrame, pages: DataFrame, spiders: dict[str, Callable], schema: str, forward: dict[str, str] | None = None, max_depth: int = 10, buckets: int = 256) -> DataFrame:
    """A crawl in which each page is given to the spider that its URL is routed to: see ``crawl_through``.

    spiders: name to function(job, page) -> (data, targets): as in ``spider``, a target being a link or a mapping of
    url, spider and priority. A target without a spider goes to the one in ``forward`` for the spider that
    names it, else to that spider itself. Adds data (a struct of ``schema``) and spider_error, unknown-spider
    for a name without a function: such a page is not run.
    """

    def read(root: Element, row: dict[str, Any]) -> dict[str, Any]:
        function = spiders.get(row["spider"])
        if function is None:
            return {"data": None, "named": [], "spider_error": "unknown-spider"}
        data, targets = function(row, root)
        after = (forward or {}).get(row["spider"], row["spider"])
        named = [{"url": t} if isinstance(t, str) else t for t in targets or []]
        return {"data": data, "named": [{"url": t["url"], "spider": t.get("spider") or after, "priority": t.get("priority")} for t in named]}

    def process(found: DataFrame) -> DataFrame:
        run = map_pages(found, "html", read, f"data:struct<{schema.replace(' ', '')}>, named:array<{TARGET}>, spider_error:string", ("key", "job_url", "spider", "depth"))
        targets = F.transform("named", lambda t: F.struct(urls.url_join(F.col("job_url"), t["url"]).alias("url"), t["spider"].alias("spider"), t["priority"].alias("priority")))
        return run.select("key", "data", "spider_error", targets.alias("targets"))

    return crawl_through(start, pages, process, max_depth, buckets)


def route_spiders(targets: DataFrame, spiders: list[str]) -> DataFrame:
    """``targets`` and the spider that takes each: its own, else the forwarded, else the parent's; unknown names are errors."""
    chosen = targets.withColumn("routed", F.coalesce("spider", "forward", "parent_spider"))
    return chosen.withColumn("route_error", F.when(F.col("routed").isNull() | ~F.col("routed").isin(*spiders), "unknown-spider"))


# Types of a crawl's columns.
CRAWL_TYPES = {"depth": "int", "status": "int", "degree": "int", "body_size": "int", "relevant": "boolean", "matches": "int"}


def crawl_graph(results: DataFrame, label: str | None = None, attributes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, label, size, attributes) and edges (source, target) of a crawl, also one read from text.

    Attributes named in CRAWL_TYPES get their type, and are null where the text is none of it. A node's size is
    its degree, 1 where that is blank, zero or no number; blank parents are none.
    """
    degree = F.col("degree").try_cast("long")
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    named = F.coalesce(*([F.when(~blank(label), F.col(label).cast("string"))] if label else []), F.col("id").cast("string"))
    typed = [(F.col(a).try_cast(CRAWL_TYPES[a]) if a in CRAWL_TYPES else F.col(a)).alias(a) for a in attributes]
    nodes = results.select(F.col("id").alias("key"), named.alias("label"), F.when(degree > 0, degree).otherwise(1).alias("size"), *typed)
    return nodes, results.where(~blank("parent")).select(F.col("parent").alias("source"), F.col("id").alias("target"))


def start_pages(corpus: DataFrame) -> DataFrame:
    """webentity, url of what to crawl for entities that are IN: prefixes and start pages, canonical, once."""
    inside = corpus.where("trim(coalesce(STATUS, '')) in ('', 'IN')")
    cells = F.explode(F.split(F.concat_ws(" ", "PREFIXES", "START_PAGES"), " "))
    return inside.select(F.col("ID").alias("webentity"), cells.alias("url")).where("url <> ''").select("webentity", urls.canonicalize_url(F.col("url"), strip_fragment=True).alias("url")).distinct()

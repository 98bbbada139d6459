"""Queries of platform pages: pages are made of relational rows, so the rows are the answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.jobs.query import query
from weblake.operators import platform_pages
from weblake.sources.tables import spread, table


def joined(*parts):
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


def listing(spark: SparkSession, sf_dir: str, element: Callable[[Callable[[str], Column]], Column], key: str, order: str) -> DataFrame:
    """One page per customer with an element per order, written from an order's columns.

    Orders are shuffled, not the markup that is made of them, and stay in as many parts as the session has.
    """
    columns = tuple(dict.fromkeys((order, "o_orderpriority")))
    rows = spread(table(spark, sf_dir, "orders").select(key, *columns), key)
    rows = rows.groupBy(F.col(key).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("es"))
    written = F.transform("es", lambda e: element(lambda c: F.col("page_id") if c == key else e[c]))
    return rows.select("page_id", F.array_join(written, "").alias("html"))


@query("""SELECT o_custkey AS page_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS place, o_orderpriority AS title, 'https://www.reddit.com/r/x/' || o_orderkey AS url,
  CASE WHEN o_orderkey % 2 = 0 THEN 'score hidden' ELSE o_orderkey::VARCHAR END AS points, (o_orderkey % 50)::INT AS number_comments, CASE WHEN o_orderkey % 3 = 0 THEN '[Deleted]' ELSE 'a' || o_orderkey END AS author, 'https://site.org/' || o_orderkey AS external_link FROM orders""")
def g1_reddit_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def post(c: Callable[[str], Column]) -> Column:
        k = c("o_orderkey").cast("string")
        score = F.when(c("o_orderkey") % 2 == 0, "<div class='score-hidden'>•</div>").otherwise(joined("<div class='score unvoted' title='", k, "'>1k</div>"))
        author = F.when(c("o_orderkey") % 3 == 0, "").otherwise(joined("<a class=author>a", k, "</a>"))
        return joined(
            "<div id='thing_t3_", k, "'><a class='title may-blank' href='https://site.org/", k, "'>", c("o_orderpriority"), "</a>", score, author,
            "<ul class='flat-list buttons'><li><a class='bylink comments' href='https://old.reddit.com/r/x/", k, "'>", (c("o_orderkey") % 50).cast("string"), " comments</a></ul></div>",
        )

    return platform_pages.reddit_posts(listing(spark, sf_dir, post, "o_custkey", "o_orderkey")).select("page_id", "place", "title", "url", "points", "number_comments", "author", "external_link")


@query("""SELECT o_orderkey, o_custkey AS page_id, CASE WHEN o_orderkey % 4 > 1 THEN 'said ' || o_orderkey END AS author_text, CASE WHEN o_orderkey % 4 = 0 THEN 'page-not-found' END AS error FROM orders""")
def g1_reddit_author_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the authors of listed posts wrote, from stored pages of three quarters of the posts, of which a third is a mere link."""
    k = F.col("o_orderkey").cast("string")
    post = lambda c: joined("<div id='thing_t3_", c("o_orderkey").cast("string"), "'><a class=title href='/r/x/", c("o_orderkey").cast("string"), "'>t</a><ul class='flat-list buttons'><li><a class='bylink comments' href='https://old.reddit.com/r/x/", c("o_orderkey").cast("string"), "'>comment</a></li></ul></div>")
    posts = platform_pages.reddit_posts(listing(spark, sf_dir, post, "o_custkey", "o_orderkey"))
    said = F.when(F.col("o_orderkey") % 4 > 1, joined("<div class=usertext-body><div class=md>said ", k, "</div></div>")).otherwise("")
    html = joined("<div id=siteTable>", said, "</div><div class=commentarea><div class=usertext-body>a reply</div></div>")
    pages = spread(table(spark, sf_dir, "orders").where("o_orderkey % 4 > 0").select("o_orderkey"), "o_orderkey").select(joined("https://old.reddit.com/r/x/", k).alias("url"), html.alias("html"))
    found = platform_pages.attach_author_texts(posts, platform_pages.reddit_post_texts(pages))
    return found.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("o_orderkey"), "page_id", "author_text", "error")


@query("""SELECT conv_id AS page_id, 'c' || turn AS id, CASE WHEN turn > 0 THEN 'c' || (turn - 1) END AS parent, role AS author, 'https://www.reddit.com/r/x/c' || turn || '/' AS comment_url, 'score hidden' AS points, 't' || turn AS comment FROM conversations""")
def g2_reddit_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("turn").cast("string")
    opened = joined("<div class='thing comment' id='thing_t1_c", n, "'><div class='entry unvoted'><a class=author>", F.col("role"), "</a><span class=score-hidden>x</span><a class=bylink href='/r/x/c", n, "/'>link</a><div class=md>t", n, "</div></div><div class=child><div>")
    pages = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("turn", opened.alias("e")))).alias("es"))
    body = joined("<div class=commentarea><div>", F.array_join(F.transform("es", lambda x: x["e"]), ""), F.repeat(F.lit("</div></div></div>"), F.size("es")), "</div></div>")
    return platform_pages.reddit_comments(pages.select("page_id", body.alias("html"))).select("page_id", "id", "parent", "author", "comment_url", "points", "comment")


@query("SELECT c_custkey AS page_id, c_name AS title, '@n' || c_custkey AS name, (c_custkey * 1000)::VARCHAR AS nb_subscribers, '7' AS nb_photos, '0' AS nb_files FROM customer")
def g4_telegram_channel_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    counter = lambda value, kind: joined("<div class=tgme_channel_info_counter><span class=counter_value>", value, f"</span> <span class=counter_type>{kind}</span></div>")
    page = joined("<div class=tgme_channel_info><div class=tgme_channel_info_header><img src=x><span>", F.col("c_name"), "</span><div class=tgme_channel_info_header_username><a href=l>@n", k, "</a></div></div>", counter(joined(k, "K"), "subscribers"), counter("7", "photo"), "</div>")
    return platform_pages.telegram_channel_infos(spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select(F.col("c_custkey").alias("page_id"), page.alias("html"))).select("page_id", "title", "name", "nb_subscribers", "nb_photos", "nb_files")


@query("""SELECT o_custkey AS page_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS place, o_orderpriority AS post_title, 'https://www.reddit.com/r/x/' || o_orderkey AS post_url, CASE WHEN o_orderkey % 3 <> 0 THEN 'a' || o_orderkey END AS post_author,
  'https://www.reddit.com/r/x/' AS post_subreddit, CASE WHEN o_orderkey % 2 = 0 THEN 'deleted' ELSE o_orderkey::VARCHAR END AS points, 'said ' || o_orderkey AS text, 'https://site.org/' || o_orderkey AS link, 'https://www.reddit.com/r/x/c' || o_orderkey AS comment_url FROM orders""")
def g3_reddit_user_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    def comment(c: Callable[[str], Column]) -> Column:
        k = c("o_orderkey").cast("string")
        author = F.when(c("o_orderkey") % 3 == 0, "").otherwise(joined("<a class=author>a", k, "</a>"))
        score = F.when(c("o_orderkey") % 2 == 0, "").otherwise(joined("<span class='score unvoted' title='", k, "'>1 point</span>"))
        return joined(
            "<div class='thing comment' data-type='comment'><p class=parent><a class=title href='https://old.reddit.com/r/x/", k, "'>", c("o_orderpriority"), "</a>", author, "<a class='subreddit hover' href='https://old.reddit.com/r/x/'>x</a></p><div class=entry>", score,
            "<div class=content><div class=md>said <a href='https://site.org/", k, "'>", k, "</a></div></div><a class=bylink href='https://old.reddit.com/r/x/c", k, "'>permalink</a><a class='bylink may-blank' href='https://old.reddit.com/r/x/", k, "'>full</a></div></div>",
        )

    pages = listing(spark, sf_dir, comment, "o_custkey", "o_orderkey")
    return platform_pages.reddit_user_comments(pages).select("page_id", "place", "post_title", "post_url", "post_author", "post_subreddit", "points", "text", "link", "comment_url")


@query("""SELECT o_custkey AS page_id, 'https://t.me/s/c' || o_custkey || '/' || o_orderkey AS link_to_message, o_orderkey % 2 = 0 AS could_be_displayed, 'n' || o_custkey AS user, 'news #a link ' || o_orderkey AS text, 1 AS nb_hashtags, ['a'] AS hashtags, ['https://s.org/' || o_orderkey] AS links,
  CASE WHEN o_orderkey % 3 = 0 THEN 'r' || o_orderkey END AS is_reply_user, CASE WHEN o_orderkey % 3 = 0 THEN 'i.jpg' END AS is_reply_img, (o_orderkey % 3)::INT AS nb_photos, ['p0.jpg', 'p1.jpg'][1:(o_orderkey % 3)::INT] AS photos,
  CASE o_orderkey % 4 WHEN 0 THEN 'v.mp4' WHEN 1 THEN 'media is too big' END AS videos, CASE WHEN o_orderkey % 4 < 2 THEN '0:07' END AS videos_times, (o_orderkey % 5 = 0)::INT AS nb_files, CASE WHEN o_orderkey % 5 = 1 THEN 'Site' END AS link_site, CASE WHEN o_orderkey % 5 = 1 THEN 'l.jpg' END AS link_img,
  CASE WHEN o_orderkey % 2 = 0 THEN '1200' END AS views, '2024-01-01T00:00:00+00:00' AS datetime, o_orderkey % 7 = 0 AS edited FROM orders WHERE o_orderkey % 11 <> 0""")
def g5_telegram_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with hashtags, links, replies, photos, videos, files and previews; every eleventh is a note of the service."""
    def message(c: Callable[[str], Column]) -> Column:
        n, k, c = c("o_orderkey"), c("o_orderkey").cast("string"), c("o_custkey").cast("string")
        picture = lambda tag, classes, url: f"<{tag} class='{classes}' style=\"width:9px;background-image:url('{url}')\"></{tag}>"
        reply = F.when(n % 3 == 0, joined("<a class=tgme_widget_message_reply>", picture("i", "tgme_widget_message_reply_thumb", "i.jpg"), "<div class='tgme_widget_message_author accent_color'>r", k, "</div><div class='tgme_widget_message_metatext js-message_reply_text'>before</div></a>")).otherwise("")
        photo = lambda i: picture("a", "tgme_widget_message_photo_wrap grouped_media_wrap blured js-message_photo", f"p{i}.jpg")
        photos = F.when(n % 3 == 0, "").when(n % 3 == 1, picture("a", "tgme_widget_message_photo_wrap x", "p0.jpg")).otherwise(photo(0) + photo(1))
        video = F.when(n % 4 == 0, "<video class='tgme_widget_message_video js-message_video' src=v.mp4></video>").otherwise("")
        player = F.when(n % 4 < 2, joined("<a class='tgme_widget_message_video_player x'>", video, "<time class='message_video_duration js-message_video_duration'>0:07</time></a>")).otherwise("")
        more = F.when(n % 5 == 0, "<div class=tgme_widget_message_document_icon></div>").when(n % 5 == 1, joined("<a class=tgme_widget_message_link_preview>", picture("i", "link_preview_right_image", "l.jpg"), "<div class='link_preview_site_name accent_color'>Site</div></a>")).otherwise("")
        said = joined("<div class='tgme_widget_message_text js-message_text'>news <a href='?q=%23a'>#a</a> <a href='https://s.org/", k, "'>link ", k, "</a></div>")
        views = F.when(n % 2 == 0, "<span class=tgme_widget_message_views>1.2K</span>").otherwise("")
        meta = joined("<span class=tgme_widget_message_meta>", F.when(n % 7 == 0, "edited ").otherwise(""), "<a class=tgme_widget_message_date href=x><time datetime='2024-01-01T00:00:00+00:00'>00:00</time></a></span>")
        service = F.when(n % 11 == 0, " service_message").otherwise("")
        return joined(
            "<div class='tgme_widget_message_wrap js-widget_message_wrap'><div class='tgme_widget_message text_not_supported_wrap", service, " js-widget_message' data-post='c", c, "/", k, "'><div class=tgme_widget_message_user><a href='https://t.me/n", c, "'><img src=u.jpg></a></div>",
            "<a class=tgme_widget_message_owner_name>n", c, "</a>", reply, photos, player, said, more, views, meta, "</div></div>",
        )

    pages = listing(spark, sf_dir, message, "o_custkey", "o_orderkey")
    pages = pages.select("page_id", joined("<section class='tgme_channel_history js-message_history'>", F.col("html"), "</section>").alias("html"))
    return platform_pages.telegram_messages(pages).select(
        "page_id", "link_to_message", "could_be_displayed", "user", "text", "nb_hashtags", "hashtags", "links", "is_reply_user", "is_reply_img", "nb_photos", "photos", "videos", "videos_times", "nb_files", "link_site", "link_img", "views", "datetime", "edited",
    )


@query("SELECT c_custkey AS page_id, CASE WHEN c_custkey % 2 = 0 THEN 'https://t.me/s/c?before=' || c_custkey END AS next_url FROM customer")
def g5_telegram_next_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    link = F.when(k % 2 == 0, joined("<a data-before=1 href='/s/c?before=", k.cast("string"), "'></a>")).otherwise("<a data-after=1 href=x></a>")
    pages = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(k.alias("page_id"), joined("<section class='tgme_channel_history js-message_history'>", link, "</section>").alias("html"))
    return platform_pages.telegram_next_pages(pages, desc=True)

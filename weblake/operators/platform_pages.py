"""Stored pages of platforms to rows: elements are picked in the task that parses, rules are columns."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblake.functions import text, urls
from weblake.html.tree import Element, Selectors, select, select_one
from weblake.operators.html import map_pages
from weblake.operators.joins import left_join_split

OLD_REDDIT = "https://old.reddit.com"


_WANTED: dict[tuple[str, ...], Selectors] = {}


def _found(e: Element, every: tuple[str, ...]) -> dict[str, list[Element]]:
    """Matches of each selector below ``e``, by one walk."""
    if every not in _WANTED:
        _WANTED[every] = Selectors(every)
    return _WANTED[every].every(e)


def _values(found: dict[str, list[Element]], wanted: dict[str, tuple[str, str]]) -> dict[str, str | None]:
    """For each name the text (or an attribute) of the first match of its selector."""
    return {name: None if css not in found else found[css][0].text() if target == "text" else found[css][0].attrs.get(target) for name, (css, target) in wanted.items()}


def _picked(e: Element, wanted: dict[str, tuple[str, str]]) -> dict[str, str | None]:
    return _values(_found(e, tuple(css for css, _ in wanted.values())), wanted)


def _rows(pages: DataFrame, pick, names: tuple[str, ...], html: str, keep: tuple[str, ...]) -> DataFrame:
    schema = f"items:array<struct<{','.join(f'{n}:string' for n in names)}>>"
    return map_pages(pages, html, lambda root, row: {"items": pick(root)}, schema, keep).select(*keep, F.posexplode("items").alias("place", "i")).select(*keep, "place", "i.*")


def _points(hidden: Column, shown: Column, score: Column) -> Column:
    return F.when(shown.isNull() & hidden.isNull(), "deleted").otherwise(F.coalesce(score, F.lit("score hidden")))


POST = {
    "title": ("a.title", "text"), "link": ("a.title", "href"), "url": ("ul.flat-list.buttons a.bylink.comments", "href"), "raw_number_comments": ("ul.flat-list.buttons a.bylink.comments", "text"),
    "promoted": ("ul.flat-list.buttons span.promoted-span", "text"), "author": ("a.author", "text"), "subreddit": ("a.subreddit", "href"), "shown": (".score.unvoted", "text"), "score": (".score.unvoted", "title"), "hidden": (".score-hidden", "text"),
    "published_date": ("time", "datetime"), "edited_date": ("time.edited-timestamp", "datetime"),
}


def reddit_posts(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",), of_user: bool = False) -> DataFrame:
    """Posts of listing pages in order, without promoted ones; links within the site are no external links."""
    rows = _rows(pages, lambda root: [_picked(p, POST) for p in select(root, "div[id^='thing_t3_']")], tuple(POST), html, keep).where("promoted is null")
    link = urls.url_join(F.lit(OLD_REDDIT), F.col("link"))
    external = F.when(~link.contains("reddit.com/") & (link != F.col("url")), link)
    owner = text.new_reddit_url(F.col("subreddit")).alias("subreddit") if of_user else F.coalesce("author", F.lit("[Deleted]")).alias("author")
    return rows.select(
        *keep, "place", "title", text.new_reddit_url(F.col("url")).alias("url"), owner, _points(F.col("hidden"), F.col("shown"), F.col("score")).alias("points"), "raw_number_comments",
        text.comment_count(F.col("raw_number_comments")).alias("number_comments"), "published_date", "edited_date", external.alias("external_link"),
    )


def reddit_user_posts(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return reddit_posts(pages, html, keep, of_user=True)


def reddit_post_texts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url (as posts have it) and text of stored pages of single posts: what their authors wrote, null for a mere link.

    Of several pages of one post the least text stands; a page without URL is left out.
    """
    css = "div#siteTable div.usertext-body"
    read = lambda root, row: {"author_text": None if (e := select_one(root, css)) is None else e.text()}
    rows = map_pages(pages.select(F.col(url).alias("page url"), html), html, read, "author_text:string", ("page url",))
    known = rows.select(text.new_reddit_url(F.col("page url")).alias("url"), "author_text").where("url is not null")
    return known.groupBy("url").agg(F.min("author_text").alias("author_text"))


def attach_author_texts(posts: DataFrame, texts: DataFrame) -> DataFrame:
    """``posts`` with ``author_text`` and ``error``: ``page-not-found`` where no page of the post is stored. All posts stay."""
    found = left_join_split(posts, texts.select("url", "author_text", F.lit(True).alias("its page")), "url")
    return found.withColumn("error", F.when(F.col("its page").isNull(), "page-not-found")).drop("its page")


COMMENT = {
    "url": ("div.entry a.bylink", "href"), "author": ("div.entry a.author", "text"), "shown": ("div.entry .score.unvoted", "text"), "score": ("div.entry .score.unvoted", "title"), "hidden": ("div.entry .score-hidden", "text"),
    "published_date": ("div.entry time", "datetime"), "edited_date": ("div.entry time.edited-timestamp", "datetime"), "comment": ("div.entry div.md", "text"),
}


def _comment_id(e: Element) -> str:
    return e.attrs["id"].split("_")[-1] if e.attrs.get("id") else e.attrs.get("data-permalink", "/").rstrip("/").split("/")[-1]


def _read_comments(root: Element) -> list[dict[str, Any]]:
    out = []
    for e in select(root, "div.commentarea div.comment"):
        up = e.parent
        while up is not None and "comment" not in up.attrs.get("class", "").split():
            up = up.parent
        deleted = "deleted" in e.attrs.get("class", "").split()
        found = _picked(e, COMMENT) | {"id": _comment_id(e), "parent": _comment_id(up) if up is not None else None, "deleted": "1" if deleted else None}
        if deleted:
            found |= {"url": e.attrs.get("data-permalink"), "author": None}
        out.append(found)
    return out


def reddit_comments(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Comments of a page's tree as flat rows with their parent's id; deleted ones have no points."""
    rows = _rows(pages, _read_comments, (*COMMENT, "id", "parent", "deleted"), html, keep).where("id <> ''")
    points = F.when(F.col("deleted").isNull(), _points(F.col("hidden"), F.col("shown"), F.col("score")))
    link = text.new_reddit_url(urls.url_join(F.lit(OLD_REDDIT), F.col("url")))
    return rows.select(*keep, "place", link.alias("comment_url"), F.coalesce("author", F.lit("[Deleted]")).alias("author"), "id", "parent", points.alias("points"), "published_date", "edited_date", "comment")


COUNTERS = ("subscriber", "photo", "video", "file", "link")


def _read_channel(root: Element) -> list[dict[str, Any]]:
    info = select_one(root, "div.tgme_channel_info")
    if info is None:
        return []
    head = {"title": ("div.tgme_channel_info_header span", "text"), "name": ("div.tgme_channel_info_header_username", "text"), "channel_link": ("div.tgme_channel_info_header_username a", "href"), "img": ("div.tgme_channel_info_header img", "src"), "description": ("div.tgme_channel_info_description", "text")}
    counts = {}
    for c in select(info, "div.tgme_channel_info_counter"):
        parts = _found(c, (".counter_type", ".counter_value"))
        kind, value = (parts[css][0] if css in parts else c for css in (".counter_type", ".counter_value"))
        counts[kind.text().rstrip("s")] = value.text()
    return [_picked(info, head) | {k: counts.get(k) for k in COUNTERS}]


def telegram_channel_infos(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Header and counters of channel pages; a counter that is not shown is 0, pages without a channel give no row."""
    head = ("title", "name", "channel_link", "img", "description")
    rows = _rows(pages, _read_channel, (*head, *COUNTERS), html, keep)
    return rows.select(*keep, *head, *(text.clean_human_number(F.coalesce(c, F.lit("0"))).alias(f"nb_{c}s") for c in COUNTERS))


USER_COMMENT = {
    "post_title": ("a.title", "text"), "post_url": ("a.bylink.may-blank", "href"), "post_author": ("p.parent>a.author", "text"), "post_subreddit": ("a.subreddit", "href"), "shown": (".score.unvoted", "text"),
    "score": (".score.unvoted", "title"), "hidden": (".score-hidden", "text"), "published_date": ("time", "datetime"), "edited_date": ("time.edited-timestamp", "datetime"), "text": ("div.content div.md", "text"),
    "link": ("div.content div.md a", "href"), "comment_url": ("a.bylink", "href"),
}


def reddit_user_comments(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Comments of a user's pages in order, with the post that each is under; a page that is null or empty gives no row."""
    rows = _rows(pages, lambda root: [_picked(c, USER_COMMENT) for c in select(root, "[data-type='comment']")], tuple(USER_COMMENT), html, keep)
    return rows.select(
        *keep, "place", "post_title", text.new_reddit_url(F.col("post_url")).alias("post_url"), "post_author", text.new_reddit_url(F.col("post_subreddit")).alias("post_subreddit"),
        _points(F.col("hidden"), F.col("shown"), F.nullif(F.col("score"), F.lit(""))).alias("points"), "published_date", "edited_date", "text", "link", text.new_reddit_url(F.col("comment_url")).alias("comment_url"),
    )


TELEGRAM = "https://t.me/"
BACKGROUND = re.compile(r"background-image:url\('(.*?)'\)")
# Classes of the parts of a message.
MESSAGE = {
    "post": ("div.tgme_widget_message", "data-post"), "user": ("a.tgme_widget_message_owner_name", "text"), "user_link": ("div.tgme_widget_message_user a", "href"), "user_img": ("div.tgme_widget_message_user img", "src"),
    "reply_img": ("a.tgme_widget_message_reply i.tgme_widget_message_reply_thumb", "style"), "reply_user": ("a.tgme_widget_message_reply div.tgme_widget_message_author", "text"),
    "reply_text": ("a.tgme_widget_message_reply div.tgme_widget_message_metatext", "text"), "animated": ("div.tgme_widget_message_sticker_wrap source[type='application/x-tgsticker']", "srcset"),
    "still": ("div.tgme_widget_message_sticker_wrap i.tgme_widget_message_sticker", "data-webp"), "player": ("a.tgme_widget_message_video_player", "text"), "video": ("a.tgme_widget_message_video_player video.tgme_widget_message_video", "src"),
    "video_time": ("a.tgme_widget_message_video_player time.message_video_duration", "text"), "file": (".tgme_widget_message_document_icon", "text"), "link_img": ("a.tgme_widget_message_link_preview i.link_preview_right_image", "style"),
    "link_site": ("a.tgme_widget_message_link_preview div.link_preview_site_name", "text"), "link_title": ("a.tgme_widget_message_link_preview div.link_preview_title", "text"),
    "link_description": ("a.tgme_widget_message_link_preview div.link_preview_description", "text"), "views": ("span.tgme_widget_message_views", "text"), "datetime": ("a.tgme_widget_message_date time", "datetime"), "meta": ("span.tgme_widget_message_meta", "text"),
}
SERVICE, SAID, PHOTO, GROUPED = "div.service_message", "div.tgme_widget_message_text.js-message_text", "a.tgme_widget_message_photo_wrap", "a.tgme_widget_message_photo_wrap.grouped_media_wrap"
MESSAGE_PARTS = (*(css for css, _ in MESSAGE.values()), SERVICE, SAID, PHOTO, GROUPED)
HISTORY = "section.tgme_channel_history"


def _background(style: str | None) -> str | None:
    found = BACKGROUND.search(style or "")
    return found[1] if found else None


def _read_messages(root: Element, row: dict[str, Any]) -> dict[str, Any]:
    out = []
    for section in select(root, HISTORY)[:1]:
        for m in select(section, "div.tgme_widget_message_wrap"):
            parts = _found(m, MESSAGE_PARTS)
            if SERVICE in parts:
                continue
            found: dict[str, Any] = _values(parts, MESSAGE)
            texts = parts.get(SAID, [])
            grouped = parts.get(GROUPED) or parts.get(PHOTO, [])[:1]
            found |= {"reply_img": _background(found["reply_img"]), "link_img": _background(found["link_img"]), "text": "".join(t.text() for t in texts)}
            found |= {"hrefs": [a.attrs.get("href", "") for t in texts for a in select(t, "a")], "photos": [_background(a.attrs.get("style")) for a in grouped]}
            out.append(found)
    return {"messages": out}


def telegram_messages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Messages of channel pages in order, 27 columns; notes of the service and pages without a channel give no row.

    Links in a message's text are hashtags (searches) or plain; pictures are read from their styles; a
    video that is not on the page is named as too big; views that are not shown are null.
    """
    names = [*MESSAGE, "text"]
    schema = f"messages:array<struct<{','.join(f'{n}:string' for n in names)},hrefs:array<string>,photos:array<string>>>"
    rows = map_pages(pages, html, _read_messages, schema, keep).select(*keep, F.posexplode("messages").alias("place", "m")).select(*keep, "place", "m.*")
    tag = lambda h: F.regexp_extract(h, r"^\?q=%23(.*)", 1)
    is_tag = lambda h: h.startswith("?q=%23")
    hashtags, links = F.transform(F.filter("hrefs", is_tag), tag), F.filter("hrefs", lambda h: ~is_tag(h))
    player = F.col("player").isNotNull()
    return rows.select(
        *keep, "place", F.concat(F.lit(f"{TELEGRAM}s/"), F.col("post")).alias("link_to_message"), F.col("views").isNotNull().alias("could_be_displayed"), "user", "user_link", "user_img", "text",
        F.size(hashtags).alias("nb_hashtags"), hashtags.alias("hashtags"), F.col("reply_img").alias("is_reply_img"), F.col("reply_user").alias("is_reply_user"), F.col("reply_text").alias("is_reply_text"),
        F.coalesce("animated", "still").alias("stickers"), F.size("photos").alias("nb_photos"), "photos", player.cast("int").alias("nb_videos"), F.when(player, F.coalesce("video", F.lit("media is too big"))).alias("videos"),
        F.col("video_time").alias("videos_times"), F.col("file").isNotNull().cast("int").alias("nb_files"), F.size(links).alias("nb_links"), links.alias("links"), "link_img", "link_site", "link_title", "link_description",
        text.clean_human_number(F.col("views")).alias("views"), "datetime", F.coalesce(F.col("meta").contains("edited"), F.lit(False)).alias("edited"),
    )


def telegram_next_pages(pages: DataFrame, desc: bool = False, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """next_url of channel pages: the link to older (``desc``) or newer messages; null on the last page."""
    css = f"{HISTORY} a[data-{'before' if desc else 'after'}]"
    found = map_pages(pages, html, lambda root, row: _picked(root, {"next": (css, "href")}), "next:string", keep)
    return found.select(*keep, urls.url_join(F.lit(TELEGRAM), F.col("next")).alias("next_url"))

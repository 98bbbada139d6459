"""Stored JSON payloads to fixed rows: each document is parsed once to a variant, then read by path."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from html import unescape
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weblake.functions import text, urls
from weblake.operators.storage import stored

# Ids of video categories.
YOUTUBE_CATEGORIES = {
    "1": "Film & Animation ", "2": "Autos & Vehicles", "10": "Music", "15": "Pets & Animals", "17": "Sports", "18": "Short Movies", "19": "Travel & Events",
    "20": "Gaming", "21": "Videoblogging", "22": "People & Blogs", "23": "Comedy", "24": "Entertainment", "25": "News & Politics", "26": "Howto & Style",
    "27": "Education", "28": "Science & Technology", "29": "Nonprofits & Activism",
    "30": "Movies", "31": "Anime/Animation", "32": "Action/Adventure", "33": "Classics", "34": "Comedy", "35": "Documentary", "36": "Drama", "37": "Family",
    "38": "Foreign", "39": "Horror", "40": "Sci-Fi/Fantasy", "41": "Thriller", "42": "Shorts", "43": "Shows", "44": "Trailers",
}


def parsed(df: DataFrame, column: str = "payload") -> DataFrame:
    """The payload as a variant in column ``v``; what is no JSON is null."""
    return df.withColumn("v", F.try_parse_json(column)).drop(column)


def at(path: str, kind: str = "string", of: Column | str = "v") -> Column:
    """The value at a path, null where it is missing or of another kind."""
    return F.try_variant_get(F.col(of) if isinstance(of, str) else of, f"$.{path}", kind)


def items(path: str, of: str = "v") -> Column:
    return F.coalesce(F.try_variant_get(of, f"$.{path}" if path else "$", "array<variant>"), F.array().cast("array<variant>"))


def strings(path: str, of: str = "v") -> Column:
    return F.coalesce(F.try_variant_get(of, f"$.{path}", "array<string>"), F.array().cast("array<string>"))


def fields(table: dict[str, str], kind: str = "string") -> list[Column]:
    """A column per entry: name, and the path it is read from."""
    return [at(path, kind).alias(name) for name, path in table.items()]


def _field(value: Column, path: str) -> Column:
    """The field at a path of nested structs."""
    for name in path.split("."):
        value = value[name]
    return value


def shape(paths: dict[str, str]) -> str:
    """The type of a nested struct with a field at each path: reading it once costs one walk through the document."""
    tree: dict[str, Any] = {}
    for path, kind in paths.items():
        *above, last = path.split(".")
        node = tree
        for name in above:
            node = node.setdefault(name, {})
        node[last] = kind
    write = lambda node: node if isinstance(node, str) else "struct<" + ",".join(f"`{k}`:{write(v)}" for k, v in node.items()) + ">"
    return write(tree)


SNIPPET = {"published_at": "snippet.publishedAt", "channel_id": "snippet.channelId", "title": "snippet.title", "description": "snippet.description", "channel_title": "snippet.channelTitle"}


def _snippet(video_id: str) -> list[Column]:
    language = F.coalesce(at("snippet.defaultLanguage"), at("snippet.defaultAudioLanguage")).alias("default_language")
    return [at(video_id).alias("video_id"), *fields(SNIPPET), language]


def youtube_search_items(df: DataFrame) -> DataFrame:
    return parsed(df).select(*_snippet("id.videoId"))


def youtube_playlist_items(df: DataFrame) -> DataFrame:
    return parsed(df).select(*_snippet("snippet.resourceId.videoId"), at("snippet.position", "int").alias("position"))


def youtube_videos(df: DataFrame) -> DataFrame:
    category = F.try_element_at(F.create_map(*(F.lit(x) for pair in YOUTUBE_CATEGORIES.items() for x in pair)), at("snippet.categoryId"))
    counts = [at(f"statistics.{c}Count").try_cast("long").alias(f"{c}_count") for c in ("view", "like", "comment")]
    return parsed(df).select(
        *_snippet("id"), *counts, at("contentDetails.duration").alias("duration"), (at("contentDetails.caption") == "true").alias("has_captions"),
        at("snippet.categoryId").alias("category_id"), category.alias("category"), strings("topicDetails.topicCategories").alias("topics"), strings("snippet.tags").alias("tags"),
    )


def youtube_comments(df: DataFrame) -> DataFrame:
    """Threads as rows: the parent (place 0), then its replies."""
    shared = {"author_name": "authorDisplayName", "author_channel_id": "authorChannelId.value", "text": "textOriginal", "published_at": "publishedAt", "updated_at": "updatedAt"}
    threads = parsed(df)
    own = threads.select(
        at("snippet.videoId").alias("video_id"), at("id").alias("comment_id"), *fields({k: f"snippet.topLevelComment.snippet.{p}" for k, p in shared.items()}),
        at("snippet.topLevelComment.snippet.likeCount", "int").alias("like_count"), at("snippet.totalReplyCount", "int").alias("reply_count"), F.lit(None).cast("string").alias("parent_comment_id"), F.lit(0).alias("place"),
    )
    replies = threads.select(at("snippet.videoId").alias("video_id"), F.posexplode(items("replies.comments")).alias("n", "v")).select(
        "video_id", at("id").alias("comment_id"), *fields({k: f"snippet.{p}" for k, p in shared.items()}), at("snippet.likeCount", "int").alias("like_count"),
        F.lit(None).cast("int").alias("reply_count"), at("snippet.parentId").alias("parent_comment_id"), (F.col("n") + 1).alias("place"),
    )
    return own.unionByName(replies)


def youtube_channels(df: DataFrame) -> DataFrame:
    names = {
        "channel_id": "id", "title": "snippet.title", "description": "snippet.description", "custom_url": "snippet.customUrl", "published_at": "snippet.publishedAt",
        "thumbnail": "snippet.thumbnails.high.url", "default_language": "snippet.defaultLanguage", "country": "snippet.country", "id_playlists_videos": "contentDetails.relatedPlaylists.uploads",
        "view_count": "statistics.viewCount", "hidden_subscriber_count": "statistics.hiddenSubscriberCount", "subscriber_count": "statistics.subscriberCount", "video_count": "statistics.videoCount",
        "privacy_status": "status.privacyStatus", "made_for_kids": "status.madeForKids", "long_uploads_status": "status.longUploadsStatus", "moderate_comments": "brandingSettings.channel.moderateComments",
        "unsubscribed_trailer": "brandingSettings.channel.unsubscribedTrailer", "banner_external_url": "brandingSettings.image.bannerExternalUrl",
    }
    keywords = F.filter(F.transform(F.split(at("brandingSettings.channel.keywords"), '"'), lambda x: F.trim(x)), lambda x: x != "")
    topics = strings("topicDetails.topicCategories")
    return parsed(df).select(*fields(names), strings("topicDetails.topicIds").alias("topic_ids"), topics.alias("topic_categories"), F.transform(topics, lambda t: F.substring_index(t, "/", -1)).alias("topic_keywords"), keywords.alias("keywords"))


# Columns of a video record, the path of each in the service's document, and its type.
TIKTOK_FIELDS = [
    ("id", "id", "string"), ("description", "desc", "string"), ("timestamp", "createTime", "long"), ("original_item", "originalItem", "boolean"),
    ("video_id", "video.id", "string"), ("video_height", "video.height", "long"), ("video_width", "video.width", "long"), ("video_duration", "video.duration", "long"),
    ("video_ratio", "video.ratio", "string"), ("video_cover", "video.cover", "string"), ("video_origin_cover", "video.originCover", "string"), ("video_dynamic_cover", "video.dynamicCover", "string"),
    ("video_reflow_cover", "video.reflowCover", "string"), ("video_bitrate", "video.bitrate", "long"), ("video_format", "video.format", "string"), ("video_quality", "video.videoQuality", "string"),
    ("author_id", "author.id", "string"), ("author_unique_id", "author.uniqueId", "string"), ("author_nickname", "author.nickname", "string"), ("author_avatar", "author.avatarLarger", "string"),
    ("author_signature", "author.signature", "string"), ("author_verified", "author.verified", "boolean"), ("author_secret", "author.secret", "boolean"),
    ("author_following_count", "authorStats.followingCount", "long"), ("author_follower_count", "authorStats.followerCount", "long"), ("author_heart_count", "authorStats.heartCount", "long"),
    ("author_video_count", "authorStats.videoCount", "long"), ("author_digg_count", "authorStats.diggCount", "long"),
    ("music_id", "music.id", "string"), ("music_title", "music.title", "string"), ("music_author_name", "music.authorName", "string"), ("music_original", "music.original", "boolean"),
    ("music_play_url", "music.playUrl", "string"), ("music_duration", "music.duration", "long"), ("music_album", "music.album", "string"),
    ("digg_count", "stats.diggCount", "long"), ("share_count", "stats.shareCount", "long"), ("comment_count", "stats.commentCount", "long"), ("play_count", "stats.playCount", "long"),
]


def tiktok_videos(df: DataFrame, search: bool = False) -> DataFrame:
    """Videos; items of a search are unwrapped, those that are no video are left out."""
    snake = lambda key: "".join(f"_{c.lower()}" if c.isupper() else c for c in key)
    flags = {snake(key) if key != "isAd" else "is_ad": key for key in ("duetEnabled", "stitchEnabled", "shareEnabled", "isAd")}
    lists = {
        "textExtra": "array<struct<awemeId:string,userId:string,userUniqueId:string,isCommerce:boolean>>", "challenges": "array<struct<title:string,desc:string>>",
        "stickersOnItem": "array<struct<stickerText:array<string>>>", "effectStickers": "array<struct<name:string>>",
    }
    ddl = shape({path: kind for _, path, kind in TIKTOK_FIELDS} | {key: "boolean" for key in flags.values()} | {"duetInfo.duetFromId": "string"} | lists)
    found = parsed(df)
    if search:
        # In a generator, so that the document isn't parsed once more for a filter below.
        found = found.select(F.explode(F.filter(F.array("v"), lambda v: at("type", "int", of=v) == 1)).alias("v")).select(F.try_variant_get("v", "$.item", "variant").alias("v"))
    rows = found.select(F.try_variant_get("v", "$", ddl).alias("r"))
    duet = F.nullif(F.col("r.duetInfo.duetFromId"), F.lit("0"))
    # Of several mentions of the video that is answered, the last says whose it is.
    named = F.try_element_at(F.filter("r.textExtra", lambda x: x["awemeId"] == duet), F.lit(-1))
    each = lambda path, key: F.transform(F.coalesce(f"r.{path}", F.array()), lambda x: x[key])
    columns = {
        **{name: F.col(f"r.{path}") for name, path, _ in TIKTOK_FIELDS},
        "utc_time": text.timestamp_to_iso(F.col("r.createTime")),
        "duet_from_video_id": duet, "duet_from_user_id": named["userId"], "duet_from_user_name": named["userUniqueId"], "duet_from_user_is_commerce": named["isCommerce"],
        "challenges_titles": each("challenges", "title"), "challenges_descriptions": each("challenges", "desc"),
        "stickers_texts": F.transform(each("stickersOnItem", "stickerText"), lambda words: F.array_join(words, " ")), "effect_stickers_names": each("effectStickers", "name"),
        **{name: F.col(f"r.{key}") for name, key in flags.items()},
    }
    order = ["id", "description", "timestamp", "utc_time", *(c for c in columns if c not in ("id", "description", "timestamp", "utc_time"))]
    return rows.select(*(columns[c].alias(c) for c in order))


def instagram_comments(df: DataFrame) -> DataFrame:
    names = {k: k for k in ("pk", "comment_index", "parent_comment_id", "child_comment_index", "text", "comment_like_count", "is_liked_by_media_owner", "child_comment_count", "created_at_utc", "user_id")}
    users = {f"user_{k}": f"user.{k}" for k in ("username", "full_name", "is_private", "is_mentionable", "is_verified", "profile_pic_id", "profile_pic_url", "fbid_v2")}
    said = F.coalesce(at("text"), F.lit(""))
    return parsed(df).select(
        *fields(names), text.extract_hashtags(said).alias("hashtags"), text.extract_handles(said).alias("mentioned_names"), F.coalesce(at("has_translation", "boolean"), F.lit(False)).alias("has_translation"),
        text.timestamp_to_iso(at("created_at_utc").try_cast("long")).alias("utc_time"), *fields(users),
    )


def instagram_location_posts(df: DataFrame, accessibility: bool = False) -> DataFrame:
    names = {"id": "id", "is_video": "is_video", "shortcode": "shortcode", "caption": "edge_media_to_caption.edges[0].node.text", "liked_by_count": "edge_liked_by.count", "comments_disabled": "comments_disabled", "comment_count": "edge_media_to_comment.count", "preview_like_count": "edge_media_preview_like.count", "video_view_count": "video_view_count", "owner_id": "owner.id", "taken_at_timestamp": "taken_at_timestamp"}
    if accessibility:
        names["accessibility_caption"] = "accessibility_caption"
    caption, url = F.coalesce(at(names["caption"]), F.lit("")), text.shortcode_to_url(at("shortcode"))
    return parsed(df).select(
        *fields(names), url.alias("url"), text.extract_hashtags(caption).alias("hashtags"), text.extract_handles(caption).alias("mentioned_names"),
        text.timestamp_to_iso(at("taken_at_timestamp").try_cast("long")).alias("utc_time"), F.concat(url, F.lit("media/?size=l")).alias("display_url"),
    )


def instagram_hashtag_posts(df: DataFrame) -> DataFrame:
    return instagram_location_posts(df, accessibility=True)


def mediacloud_topic_stories(df: DataFrame, next_link_id: str | None = None) -> DataFrame:
    names = {k: k for k in ("guid", "stories_id", "title", "url", "language", "media_id", "media_name", "collect_date", "publish_date", "date_is_reliable", "facebook_share_count", "inlink_count", "outlink_count", "media_inlink_count", "post_count", "snapshots_id", "timespans_id")}
    return parsed(df).select(*fields(names), F.coalesce(at("full_text_rss") .isin("true", "1"), F.lit(False)).alias("full_text_rss"), F.lit(next_link_id).alias("next_link_id"))


def wikipedia_pageviews(df: DataFrame) -> DataFrame:
    """A row per item of each answer; other columns are kept."""
    rest = [c for c in df.columns if c != "payload"]
    names = {k: k for k in ("project", "article", "granularity", "timestamp", "access", "agent")}
    return parsed(df).select(*rest, F.explode(items("items")).alias("v")).select(*rest, *fields(names), at("views", "long").alias("views"))


def tweet_counts(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "payload"]
    return parsed(df).select(*rest, F.explode(items("data")).alias("v")).select(*rest, at("start").alias("start"), at("end").alias("end"), at("tweet_count", "long").alias("tweet_count"))


SEARCH_ROOT = "data.search_by_raw_query.search_timeline.timeline.instructions"
FOLLOWERS_ROOT = "data.user.result.timeline.timeline.instructions"
# Columns of a user and of a tweet, the path of each in the service's ``legacy`` objects, and its type.
TWITTER_USER = [
    ("screen_name", "screen_name", "string"), ("name", "name", "string"), ("description", "description", "string"), ("location", "location", "string"), ("created_at", "created_at", "string"),
    ("followers", "followers_count", "long"), ("friends", "friends_count", "long"), ("tweets", "statuses_count", "long"), ("likes", "favourites_count", "long"), ("lists", "listed_count", "long"), ("verified", "verified", "boolean"),
]
TWITTER_TWEET = [
    ("text", "full_text", "string"), ("lang", "lang", "string"), ("created_at", "created_at", "string"), ("retweet_count", "retweet_count", "long"), ("like_count", "favorite_count", "long"),
    ("reply_count", "reply_count", "long"), ("quote_count", "quote_count", "long"), ("quoted_id", "quoted_status_id_str", "string"), ("retweeted_id", "retweeted_status_id_str", "string"),
    ("to_id", "in_reply_to_status_id_str", "string"), ("to_user_id", "in_reply_to_user_id_str", "string"),
]


# What is shown with a notice stands one level deeper, below ``tweet``, as it may in a quoted tweet.
_SAID = (
    {"source": "string", "legacy.id_str": "string", "legacy.user_id_str": "string", "legacy.promotedMetadata": "variant"} | {f"legacy.{path}": kind for _, path, kind in TWITTER_TWEET}
    | {f"core.user_results.result.legacy.{path}": kind for _, path, kind in TWITTER_USER}
)
_below = lambda name, paths: {f"{name}.{path}": kind for path, kind in paths.items()}
_SAID_AND_QUOTED = _SAID | _below("quoted_status_result.result", {"__typename": "string"} | _SAID | _below("tweet", _SAID))
_RESULT_SHAPE = shape({"__typename": "string"} | _SAID_AND_QUOTED | _below("tweet", _SAID_AND_QUOTED))
_ENTRY_SHAPE = shape({"entryId": "string", "content.itemContent.tweet_results.result": "variant"})
_INSTRUCTION_SHAPE = f"array<{shape({'type': 'string', 'entry': _ENTRY_SHAPE, 'entries': f'array<{_ENTRY_SHAPE}>'})}>"


def _unwrapped(result: Column, names: tuple[str, ...]) -> Column:
    """The tweet in a result, of which the named parts count."""
    part = lambda of: F.struct(*(of[n].alias(n) for n in names))
    return F.when(result["__typename"] == "TweetWithVisibilityResults", part(result["tweet"])).otherwise(part(result))


def twitter_timeline_tweets(df: DataFrame, path: str = SEARCH_ROOT) -> DataFrame:
    """Tweets of timeline pages, and the tweets that they quote: a row each, with their users.

    instruction, n and entry say where on the page a tweet stands; role is ``tweet`` or ``quoted``, and a quoted
    tweet's row follows that of the tweet around it, of which ``around_id`` is the id. Both come out of
    the same document, so what the page holds is resolved without a join; other ids (``quoted_id``,
    ``retweeted_id``) meet their tweets in ``joins.attach_referenced``. Entries are read from instructions that
    add or replace them; empty results, unavailable and promoted tweets (by the tweet's own
    ``promotedMetadata``) are left out, as are quoted ones that are gone. A result that is no tweet has the error
    ``parsing``, one without a user ``no-user``. Other columns are kept.
    """
    rest = [c for c in df.columns if c != "payload"]
    page = parsed(df).select(*rest, F.posexplode(F.try_variant_get("v", f"$.{path}", _INSTRUCTION_SHAPE)).alias("instruction", "i"))
    entries = F.when(F.col("i.type") == "TimelineReplaceEntry", F.array("i.entry")).when(F.col("i.type") == "TimelineAddEntries", F.col("i.entries"))
    rows = page.select(*rest, "instruction", F.posexplode(entries).alias("n", "e")).where(F.col("e.entryId").rlike("^(?:sq-I-t-|tweet-)"))
    rows = rows.select(*rest, "instruction", "n", F.col("e.entryId").alias("entry"), F.col("e.content.itemContent.tweet_results.result").alias("v")).where(F.col("v").isNotNull() & ~F.is_variant_null("v"))
    # Each result is read in one walk, with what it quotes; as an array's only element, since a filter on a mere column would read it again.
    rows = rows.select(*rest, "instruction", "n", "entry", F.explode(F.array(F.try_variant_get("v", "$", _RESULT_SHAPE))).alias("r"))
    promoted = F.when(F.col("r.__typename") == "TweetWithVisibilityResults", F.col("r.tweet.legacy.promotedMetadata")).otherwise(F.col("r.legacy.promotedMetadata"))
    rows = rows.where((F.coalesce("r.__typename", F.lit("")) != "TweetUnavailable") & promoted.isNull())
    parts = ("source", "legacy", "core")
    rows = rows.withColumn("t", _unwrapped(F.col("r"), (*parts, "quoted_status_result")))
    rows = rows.withColumn("q", _unwrapped(F.col("t.quoted_status_result.result"), parts))
    tweet = F.struct(F.lit("tweet").alias("role"), F.lit(None).cast("string").alias("around_id"), F.struct(*(F.col(f"t.{p}").alias(p) for p in parts)).alias("t"))
    quoted = F.struct(F.lit("quoted").alias("role"), F.col("t.legacy.id_str").alias("around_id"), F.col("q").alias("t"))
    both = F.when(F.col("q.legacy.id_str").isNotNull(), F.array(tweet, quoted)).otherwise(F.array(tweet))
    rows = rows.select(*rest, "instruction", "n", "entry", F.explode(both).alias("one")).select(*rest, "instruction", "n", "entry", "one.role", "one.around_id", "one.t")
    user = "t.core.user_results.result.legacy"
    # The user's id is what the tweet says.
    record = [F.col("t.legacy.id_str").alias("id"), *(F.col(f"t.legacy.{path}").alias(name) for name, path, _ in TWITTER_TWEET), F.col("t.source").alias("source"), F.col("t.legacy.user_id_str").alias("user_id")]
    record += [F.col(f"{user}.{path}").alias(f"user_{name}") for name, path, _ in TWITTER_USER]
    error = F.when(F.col("t.legacy.id_str").isNull(), "parsing").when(F.col(user).isNull(), "no-user")
    return rows.select(*rest, "instruction", "n", "entry", "role", "around_id", *record, error.alias("error"))


def twitter_followers_you_know(df: DataFrame, path: str = FOLLOWERS_ROOT) -> DataFrame:
    """Users of the pages' last instructions, a row each with ``cursor``, by which the next page is asked for.

    A page without a bottom cursor, or without entries, has no users. Other columns are kept.
    """
    rest = [c for c in df.columns if c != "payload"]
    last = F.try_element_at(items(path), F.lit(-1))
    page = parsed(df).select(*rest, F.try_variant_get(last, "$.entries", "array<variant>").alias("entries"))
    cursor = F.get(F.filter("entries", lambda e: at("entryId", of=e).startswith("cursor-bottom")), 0)
    users = F.filter("entries", lambda e: at("entryId", of=e).startswith("user-"))
    rows = page.select(*rest, at("content.value", of=cursor).alias("cursor"), F.when(cursor.isNotNull(), users).alias("users")).select(*rest, "cursor", F.posexplode("users").alias("n", "e"))
    v = F.try_variant_get("e", "$.content.itemContent.user_results.result", "variant")
    record = [at(f"legacy.{path}", kind).alias(name) for name, path, kind in TWITTER_USER]
    return rows.select(*rest, "cursor", "n", v.alias("v")).select(*rest, "n", at("rest_id").alias("id"), *record, "cursor")


FACEBOOK_ROOTS = ("data.node.display_comments.edges", "display_comments.edges", "data.feedback.display_comments.edges")
#: Columns of a comment, the path of each, and its type. Of attachments only the number counts.
FACEBOOK_COMMENT = {
    "comment_id": ("id", "string"), "fbid": ("legacy_fbid", "string"), "depth": ("depth", "int"), "reply_parent": ("reply_parent_comment.id", "string"), "comment_parent": ("comment_parent.id", "string"),
    "author_name": ("author.name", "string"), "author_short_name": ("author.short_name", "string"), "author_gender": ("author.gender", "string"), "author_url": ("author.url", "string"),
    "author_is_verified": ("author.is_verified", "boolean"), "created_time": ("created_time", "long"), "text": ("preferred_body.text", "string"), "attachments": ("attachments", "array<boolean>"),
    "reactions": ("feedback.reactors.count", "long"), "replies": ("feedback.total_comment_count", "long"),
}
#: Levels of comments that are read in one walk through a document.
FACEBOOK_LEVELS = 8


def _facebook_shape(levels: int) -> str:
    """The type of a list of comments with so many levels; what is below them stays a variant."""
    if not levels:
        return "array<struct<node:variant>>"
    paths = dict(FACEBOOK_COMMENT.values()) | {"feedback.data": "variant", "feedback.display_comments.edges": _facebook_shape(levels - 1)}
    return f"array<struct<node:{shape(paths)}>>"


def _facebook_edges(of: str, kind: str = "array<variant>") -> Column:
    """The comments' edges at the first of three roots that is there; null if that is no list."""
    raw = [F.try_variant_get(of, f"$.{p}", "variant") for p in FACEBOOK_ROOTS]
    missing = [r.isNull() | F.is_variant_null(r) for r in raw]
    lists = [F.try_variant_get(of, f"$.{p}", kind) for p in FACEBOOK_ROOTS]
    return F.coalesce(lists[0], F.when(missing[0], lists[1]), F.when(missing[0] & missing[1], lists[2]))


def _facebook_odd(edges: Column, levels: int = FACEBOOK_LEVELS) -> Column:
    """Whether a comment's feedback has ``data`` of its own, where its replies may stand."""
    feedback = lambda e: e["node"]["feedback"]
    return F.coalesce(F.exists(edges, lambda e: feedback(e)["data"].isNotNull() | (_facebook_odd(feedback(e)["display_comments"]["edges"], levels - 1) if levels > 1 else F.lit(False))), F.lit(False))


def _facebook_record(get: Callable[[str, str], Column]) -> list[Column]:
    """The columns of a comment, each by the function that reads a path as a type."""
    value = {name: get(path, kind) for name, (path, kind) in FACEBOOK_COMMENT.items()}
    value |= {"depth": F.coalesce(value["depth"], F.lit(0)), "replies": F.coalesce(value["replies"], F.lit(0).cast("long")), "attachments": F.size(F.coalesce(value["attachments"], F.array().cast("array<boolean>")))}
    parent = F.coalesce(value.pop("reply_parent"), value.pop("comment_parent"))
    return [value.pop("comment_id").alias("comment_id"), value.pop("fbid").alias("fbid"), value.pop("depth").alias("depth"), parent.alias("parent_id"), *(c.alias(n) for n, c in value.items())]


def facebook_comments(df: DataFrame) -> DataFrame:
    """Comments of stored pages with all replies below them, however deep; place counts siblings from 0.

    depth and parent_id are what the comment says; post_id is the id of the page's document or node.
    The first levels of a document are read in one walk and laid flat one after the other, in one pass. What is
    deeper, and documents whose comments have replies at an unusual place, go on one step per level, until a level is empty.
    """

    def below(rows: DataFrame) -> DataFrame:
        return stored(rows.select("post_id", F.posexplode(_facebook_edges("v")).alias("place", "edge")).select("post_id", "place", F.try_variant_get("edge", "$.node", "variant").alias("v")))

    def flat(level: DataFrame) -> DataFrame:
        return level.select("post_id", "place", *_facebook_record(lambda path, kind: at(path, kind)))

    def row(place: Column, found: Column | None, v: Column | None) -> Column:
        return F.struct(place.alias("place"), (F.lit(None).cast(kind) if found is None else found).alias("found"), (F.lit(None) if v is None else v).cast("variant").alias("v"))

    def gathered(edges: Column, levels: int) -> Column:
        edges = F.coalesce(edges, F.array().cast(_facebook_shape(levels)))
        if not levels:
            return F.transform(edges, lambda e, i: row(i, None, F.coalesce(e["node"], F.parse_json(F.lit("null")))))
        own = F.transform(edges, lambda e, i: row(i, F.struct(*_facebook_record(lambda path, _: _field(e["node"], path))), None))
        return F.concat(own, F.flatten(F.transform(edges, lambda e: gathered(e["node"]["feedback"]["display_comments"]["edges"], levels - 1))))

    docs = parsed(df).select(F.coalesce(at("id"), at("data.node.id")).alias("post_id"), "v", _facebook_edges("v", _facebook_shape(FACEBOOK_LEVELS)).alias("edges"))
    kind = flat(docs.withColumn("place", F.lit(0))).drop("post_id", "place").schema.simpleString()
    page = F.when(_facebook_odd(F.col("edges")), F.array(row(F.lit(None).cast("int"), None, F.col("v"))))
    rows = docs.select("post_id", F.explode(F.coalesce(page, gathered(F.col("edges"), FACEBOOK_LEVELS))).alias("one")).select("post_id", "one.*")
    rows = stored(rows)
    out = rows.where("found is not null").select("post_id", "place", "found.*")
    deep, odd = rows.where("v is not null and place is not null").select("post_id", "place", "v"), rows.where("place is null").select("post_id", "v")
    level = deep if odd.isEmpty() else deep.unionByName(below(odd))
    while not level.isEmpty():
        out = out.unionByName(flat(level))
        level = below(level.select("post_id", F.try_variant_get("v", "$.feedback", "variant").alias("v")))
    names = ["post_id", "comment_id", "fbid", "depth", "parent_id", "place"]
    return out.select(*names, *(c for c in out.columns if c not in names))


def youtube_caption_tracks(df: DataFrame, video: str = "video_id", html: str = "html") -> DataFrame:
    """lang, url and generated of the caption tracks that a video's page names, in order; escapes of URLs are undone first."""
    plain = F.coalesce(F.try_url_decode(F.replace(html, F.lit("+"), F.lit("%2B"))), F.col(html))
    tracks = df.select(video, F.try_parse_json(F.regexp_extract(plain, r'(?s)"captionTracks":(\[.*?\])', 1)).alias("v"))
    rows = tracks.select(video, F.posexplode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array().cast("array<variant>"))).alias("place", "v"))
    return rows.select(video, "place", at("languageCode").alias("lang"), at("baseUrl").alias("url"), F.coalesce(at("kind") == "asr", F.lit(False)).alias("generated"))


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    """Texts without entities and outer blanks: names and numbers of all kinds, which no built-in undoes."""
    return texts.map(lambda t: None if t is None else unescape(t).strip())


def youtube_caption_lines(df: DataFrame, track: str, xml: str) -> DataFrame:
    """Lines of caption files: start, dur (0 if missing), text without escapes."""
    lines = df.select(track, F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?s)(<text\b.*?</text>)"), F.lit(1))).alias("place", "line"))
    said = F.regexp_replace(F.regexp_extract("line", r"(?s)<text\b[^>]*>(.*)</text>", 1), "<[^>]*>", "")
    return lines.select(track, "place", F.regexp_extract("line", r'start="([^"]*)"', 1).try_cast("double").alias("start"), F.coalesce(F.regexp_extract("line", r'dur="([^"]*)"', 1).try_cast("double"), F.lit(0.0)).alias("dur"), _unescaped(said).alias("text"))


INITIAL_DATA = re.compile(r"(?:const|let|var)\s+ytInitialData\s*=\s*(\{.+\})\s*;</script>")
LINK_TARGET = ("link", "commandRuns", 0, "onTap", "innertubeCommand", "urlEndpoint", "url")


def _channel_links(html: str | None) -> list[dict[str, str | None]]:
    """title and url of each link in a page's data, in order; a mapping that holds one is not searched further."""
    found = INITIAL_DATA.search(html or "")
    try:
        stack = [json.loads(found[1])] if found else []
    except ValueError:
        return []

    def under(value: Any, path: tuple) -> str | None:
        for key in path:
            fits = isinstance(value, list) and len(value) > key if isinstance(key, int) else isinstance(value, dict) and key in value
            value = value[key] if fits else None
        return value if isinstance(value, str) else None

    out = []
    while stack:
        value = stack.pop()
        if isinstance(value, tuple):
            if isinstance(value[1], dict):
                out.append({"title": (under(value[1], ("title", "content")) or "").strip(), "url": under(value[1], LINK_TARGET)})
            continue
        if isinstance(value, dict):
            inner = []
            for k, v in value.items():
                if k == "channelExternalLinkViewModel":
                    inner.append((k, v))
                    break
                inner.append(v)
            stack += reversed(inner)
        elif isinstance(value, list):
            stack += reversed(value)
    return out


def youtube_channel_links(df: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """title and url of the links that the data in a channel's page holds, at any depth; redirections are solved."""
    kind = df.schema[page].dataType.simpleString()
    links = pa.list_(pa.struct([("title", pa.string()), ("url", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_channel_links(t.as_py()) for t in part.column(1)], links)], names=[page, "links"])

    found = df.select(page, html).mapInArrow(run, f"`{page}` {kind}, links array<struct<title:string,url:string>>")
    return found.select(page, F.posexplode("links").alias("place", "l")).select(page, "place", "l.title", urls.infer_redirection(F.col("l.url")).alias("url"))


def webentity_rows(df: DataFrame) -> DataFrame:
    """Web entities of a corpus: prefixes joined by a space, degrees, the time of the last change as ISO text."""
    names = {"name": "name", "status": "status", "homepage": "homepage"}
    degrees = [at(k, "long").alias(k) for k in ("pages_total", "undirected_degree", "indegree", "outdegree")]
    return parsed(df).select(F.coalesce(at("id"), at("_id")).alias("id"), *fields(names), F.array_join(strings("prefixes"), " ").alias("prefixes"), *degrees, (at("indegree", "long") + at("outdegree", "long")).alias("degree"), text.timestamp_to_iso((at("lastModificationDate", "long") / 1000).cast("long")).alias("last_modified"))


def webentity_page_rows(df: DataFrame, bodies: bool = False) -> DataFrame:
    """Pages of web entities; df: webentity, webentity_status and the page's payload. Times are milliseconds, and ISO text.

    ``bodies`` adds ``body``, the page's bytes: the payload has them deflated, in base64. What is broken is null.
    """
    own = {"url": "url", "lru": "lru"}
    more = {"status": "status", "encoding": "encoding", "content_type": "content_type", "crawl_timestamp": "crawl_timestamp", "size": "size", "error": "error"}
    packed = [at("body").alias("packed")] if bodies else []
    rows = parsed(df).select(
        *fields(own), "webentity", "webentity_status", *fields(more), F.coalesce(at("crawled", "boolean"), F.lit(False)).alias("crawled"),
        text.timestamp_to_iso((at("crawl_timestamp").try_cast("long") / 1000).cast("long")).alias("crawl_datetime"), *packed,
    )
    if not bodies:
        return rows

    def inflated(data: str | None) -> bytes | None:
        try:
            return None if data is None else zlib.decompress(base64.b64decode(data))
        except (ValueError, zlib.error):
            return None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                yield part.set_column(part.num_columns - 1, "body", pa.array([inflated(d.as_py()) for d in part.columns[-1]], pa.binary()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, body binary")


# Media kinds and content labels by code.
INSTAGRAM_MEDIA = {"1": "GraphImage", "2": "GraphVideo", "8": "GraphSidecar"}
TIKTOK_LABELS = {"1": "Paid Partnership", "2": "Promotional Content"}


def _named(code: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), code)


def tiktok_commercials(df: DataFrame, collected_via: str | None = None) -> DataFrame:
    """Commercial contents; both spellings of keys that the service has had are read."""
    time = F.coalesce(at("create_timestamp", "long"), at("create_time", "long"), at("posted_time", "long"))
    either = lambda x, a, b: F.coalesce(at(a, of=x), at(b, of=x))
    label = F.when(at("content_label").isNotNull(), _named(at("content_label"), TIKTOK_LABELS)).otherwise(at("label"))
    return parsed(df).select(
        at("id").alias("id"), at("creator.username").alias("creator_username"), strings("brand_names").alias("brand_names"), text.timestamp_to_iso(time).alias("create_date_utc"), time.alias("create_timestamp"), label.alias("label"),
        F.transform(items("videos"), lambda x: either(x, "cover_image_url", "cover_img")).alias("video_cover_image_urls"), F.transform(items("videos"), lambda x: either(x, "url", "video_url")).alias("video_urls"),
        at("audit_status").alias("audit_status"), at("show_mode").alias("show_mode"), at("video_views").alias("video_views"), F.lit(collected_via).alias("collected_via"),
    )


def instagram_posts(df: DataFrame) -> DataFrame:
    """Posts of users: kinds and URLs of their media in one order, everybody tagged in them, co-authors."""
    kind = lambda x: _named(at("media_type", of=x), INSTAGRAM_MEDIA)
    url = lambda x: F.when(kind(x) == "GraphVideo", at("video_versions[0].url", of=x)).otherwise(at("image_versions2.candidates[0].url", of=x))
    tagged = lambda x: F.transform(F.coalesce(F.try_variant_get(x, "$.usertags.in", "array<variant>"), F.array().cast("array<variant>")), lambda u: at("user.username", of=u))
    medias = F.when(kind(F.col("v")) == "GraphSidecar", items("carousel_media")).when(kind(F.col("v")).isNotNull(), F.array("v")).otherwise(F.array().cast("array<variant>"))
    names = lambda c: F.array_sort(F.array_distinct(F.array_compact(c)))
    rows = parsed(df).withColumn("medias", medias)
    caption, link = F.coalesce(at("caption.text"), F.lit("")), text.shortcode_to_url(at("code"))
    plain = {"username": "user.username", "full_name": "user.full_name", "is_verified": "user.is_verified", "id": "pk", "shortcode": "code", "caption": "caption.text", "like_count": "like_count", "comment_count": "comment_count", "taken_at_timestamp": "taken_at"}
    authors = F.transform(F.concat(items("coauthor_producers"), items("invited_coauthor_producers")), lambda u: at("username", of=u))
    return rows.select(
        *fields(plain), F.coalesce(kind(F.col("v")), at("media_type")).alias("media_type"), link.alias("url"), text.extract_hashtags(caption).alias("hashtags"), text.extract_handles(caption).alias("mentioned_names"),
        F.coalesce(at("like_and_view_counts_disabled", "boolean"), F.lit(False)).alias("like_and_view_counts_disabled"), F.concat(link, F.lit("media/?size=l")).alias("main_thumbnail_url"),
        F.transform("medias", lambda x: kind(x)).alias("medias_type"), F.transform("medias", lambda x: url(x)).alias("medias_url"), names(F.flatten(F.transform("medias", lambda x: tagged(x)))).alias("usertags_medias"),
        text.timestamp_to_iso(at("taken_at").try_cast("long")).alias("utc_time"), names(authors).alias("coauthor_usernames"),
    )


def instagram_users(df: DataFrame) -> DataFrame:
    """Users of follower lists."""
    names = {"id": "pk"} | {k: k for k in ("username", "full_name", "profile_pic_url", "profile_pic_id", "similar_user_id", "latest_reel_media")}
    flags = ("is_private", "is_verified", "has_anonymous_profile_picture", "has_highlight_reels", "is_favorite")
    return parsed(df).select(*fields(names), *fields({k: k for k in flags}, "boolean"), F.transform(items("account_badges"), lambda b: b.cast("string")).alias("account_badges"))


def instagram_user_infos(df: DataFrame) -> DataFrame:
    """Profiles: bio links as aligned arrays, names and tags that the biography mentions."""
    names = {k: k for k in ("username", "id", "full_name", "profile_pic_url_hd", "biography", "guardian_id", "business_category_name", "category_name", "connected_fb_page")}
    counts = {"follower_count": "edge_followed_by.count", "follow_count": "edge_follow.count"}
    flags = (
        "is_private", "is_verified", "hide_like_and_view_counts", "has_ar_effects", "has_clips", "has_guides", "has_channel", "is_business_account", "is_professional_account",
        "is_supervision_enabled", "is_guardian_of_viewer", "is_supervised_by_viewer", "is_supervised_user", "is_joined_recently",
    )
    mention = lambda key: F.filter(F.transform(items("biography_with_entities.entities"), lambda e: at(key, of=e)), lambda x: x.isNotNull() & (x != ""))
    return parsed(df).select(
        *fields(names), *fields(counts), *fields({k: k for k in flags}, "boolean"), strings("pronouns").alias("pronouns"),
        F.transform(items("bio_links"), lambda b: at("title", of=b)).alias("bio_links_title"), F.transform(items("bio_links"), lambda b: at("url", of=b)).alias("bio_links_url"),
        mention("user.username").alias("biography_with_username"), mention("user.hashtag").alias("biography_with_hashtag"),
    )


def _reader(key: str):
    return lambda x: at(key, of=x)


MEDIACLOUD_TAG = {"tags": "tag", "tag_sets": "tag_set", "tags_ids": "tags_id", "tag_sets_ids": "tag_sets_id"}


def _tags(path: str) -> list[Column]:
    """Tags as four aligned arrays."""
    return [F.transform(items(path), _reader(k)).alias(n) for n, k in MEDIACLOUD_TAG.items()]


def mediacloud_medias(df: DataFrame) -> DataFrame:
    """Media sources with their tags as four aligned arrays."""
    names = {"media_id": "media_id", "media_name": "name", "media_url": "url", "public_notes": "public_notes", "start_date": "start_date"}
    flags, counts = ("is_healthy", "is_monitored"), ("num_stories_90", "num_sentences_90")
    return parsed(df).select(*fields(names), *fields({k: k for k in flags}, "boolean"), *fields({k: k for k in counts}, "double"), *_tags("media_source_tags"))


def mediacloud_feeds(df: DataFrame) -> DataFrame:
    """Feeds of media sources; times are seconds."""
    names = {k: k for k in ("name", "url", "type", "media_id")}
    times = {k: k for k in ("last_attempted_download_time", "last_new_story_time", "last_successful_download_time")}
    return parsed(df).select(*fields(names), F.coalesce(at("payloads_id"), at("feeds_id")).alias("feeds_id"), at("active", "boolean").alias("active"), *fields(times, "double"))


def mediacloud_stories(df: DataFrame) -> DataFrame:
    """Stories with their tags as four aligned arrays."""
    names = {k: k for k in ("guid", "stories_id", "processed_stories_id", "title", "url", "language", "collect_date", "publish_date", "media_id", "media_name", "media_url")}
    return parsed(df).select(*fields(names), *_tags("payload_tags"))

"""Queries of payload flatteners: documents are made of relational rows, so the rows are the answer."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.jobs.query import query
from weblake.operators import payloads
from weblake.operators.storage import stored
from weblake.sources.tables import spread, table


def s(**named) -> Column:
    """A struct of columns; plain values are literals."""
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in named.items()))


def text_of(c: str) -> Column:
    return F.col(c).cast("string")


def payload(df: DataFrame, c: Column, *keep: str) -> DataFrame:
    return df.select(*keep, F.to_json(c).alias("payload"))


def filled(template: str, values: dict[str, Column | str]) -> Column:
    """A document with a column's value at each mark."""
    parts = re.split("(" + "|".join(map(re.escape, values)) + ")", template)
    return F.concat(*((F.col(v) if isinstance(v := values[p], str) else v).cast("string") if k % 2 else F.lit(p) for k, p in enumerate(parts)))


@query("""SELECT o_orderkey::VARCHAR AS video_id, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'fr' ELSE 'en' END AS default_language, o_custkey AS view_count, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS like_count,
  o_orderkey % 2 = 0 AS has_captions, CASE WHEN o_orderkey % 2 = 0 THEN 'Music' END AS category, [o_orderstatus, o_orderpriority] AS tags, []::VARCHAR[] AS topics FROM orders""")
def n1_youtube_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("o_orderkey") % 2 == 0
    snippet = s(title=F.col("o_orderpriority"), defaultLanguage=F.when(even, "fr"), defaultAudioLanguage="en", categoryId=F.when(even, "10").otherwise("99"), tags=F.array("o_orderstatus", "o_orderpriority"))
    stats = s(viewCount=text_of("o_custkey"), likeCount=F.when(F.col("o_orderkey") % 3 != 0, text_of("o_orderkey")))
    doc = s(id=text_of("o_orderkey"), snippet=snippet, statistics=stats, contentDetails=s(caption=F.when(even, "true").otherwise("false")))
    found = payloads.youtube_videos(payload(table(spark, sf_dir, "orders"), doc))
    return found.select("video_id", "title", "default_language", "view_count", "like_count", "has_captions", "category", "tags", "topics")


@query("""SELECT o_custkey::VARCHAR AS video_id, 'c' || o_orderkey AS comment_id, o_orderpriority AS text, 1 AS like_count, 2 AS reply_count, NULL::VARCHAR AS parent_comment_id, 0 AS place FROM orders
  UNION ALL SELECT o_custkey::VARCHAR, 'r' || o_orderkey || '-' || i, o_orderstatus, i, NULL, 'c' || o_orderkey, i FROM orders, (SELECT unnest([1, 2]) AS i)""")
def n2_youtube_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.concat(F.lit("c"), text_of("o_orderkey"))
    reply = lambda i: s(id=F.concat(F.lit("r"), text_of("o_orderkey"), F.lit(f"-{i}")), snippet=s(textOriginal=F.col("o_orderstatus"), likeCount=i, parentId=id_))
    top = s(snippet=s(textOriginal=F.col("o_orderpriority"), likeCount=1))
    doc = s(id=id_, snippet=s(videoId=text_of("o_custkey"), totalReplyCount=2, topLevelComment=top), replies=s(comments=F.array(reply(1), reply(2))))
    return payloads.youtube_comments(payload(table(spark, sf_dir, "orders"), doc)).select("video_id", "comment_id", "text", "like_count", "reply_count", "parent_comment_id", "place")


@query("SELECT 'UC' || c_custkey AS channel_id, c_name AS title, ['two words', c_mktsegment] AS keywords, ['T' || c_nationkey] AS topic_keywords FROM customer")
def n3_youtube_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.concat(F.lit('"two words" "'), F.col("c_mktsegment"), F.lit('"'))
    doc = s(id=F.concat(F.lit("UC"), text_of("c_custkey")), snippet=s(title=F.col("c_name")), topicDetails=s(topicCategories=F.array(F.concat(F.lit("https://en.wikipedia.org/wiki/T"), text_of("c_nationkey")))), brandingSettings=s(channel=s(keywords=words)))
    return payloads.youtube_channels(payload(table(spark, sf_dir, "customer"), doc)).select("channel_id", "title", "keywords", "topic_keywords")


@query("SELECT conv_id, turn AS place, turn * 1.5::DOUBLE AS start, 0.0::DOUBLE AS dur, coalesce(text, '') AS text FROM conversations")
def n5_youtube_caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    line = F.concat(F.lit('<text start="'), (F.col("turn") * 1.5).cast("string"), F.lit('">'), safe, F.lit("</text>"))
    files = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("xml"))
    return payloads.youtube_caption_lines(files, "conv_id", "xml").withColumn("place", F.col("place").cast("long"))


@query("""SELECT o_orderkey::VARCHAR AS id, o_orderkey AS timestamp, strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%dT%H:%M:%S') AS utc_time, o_orderkey % 4 = 1 AS original_item, 1280 + o_orderkey % 9 AS video_height, 15 AS video_duration,
  '720p' AS video_quality, o_custkey::VARCHAR AS author_unique_id, o_custkey * 3 AS author_follower_count, o_orderkey % 2 = 0 AS author_verified, 'song' AS music_title, 60 AS music_duration, o_orderkey * 2 AS digg_count, o_orderkey + 7 AS play_count,
  CASE WHEN o_orderkey % 2 = 1 THEN 'd' || o_orderkey END AS duet_from_video_id, CASE WHEN o_orderkey % 2 = 1 THEN '2' END AS duet_from_user_id, CASE WHEN o_orderkey % 2 = 1 THEN 'name' || o_custkey END AS duet_from_user_name,
  CASE WHEN o_orderkey % 2 = 1 THEN true END AS duet_from_user_is_commerce, ['a b', ''] AS stickers_texts, [o_orderpriority, NULL] AS challenges_titles, [NULL, 'about'] AS challenges_descriptions, ['glow'] AS effect_stickers_names,
  true AS duet_enabled, false AS stitch_enabled, NULL::BOOLEAN AS share_enabled, false AS is_ad, 52 AS n_columns FROM orders WHERE o_orderkey % 3 <> 0""")
def n6_tiktok_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a search as the service writes them, filled with each order's numbers."""
    item = """{"type": @y, "item": {"id": "@k", "desc": "d", "createTime": @k, "originalItem": @o, "video": {"id": "v", "height": @h, "width": 720, "duration": 15, "ratio": "720p", "cover": "c", "originCover": "o", "dynamicCover": "y",
      "reflowCover": "r", "bitrate": 900, "format": "mp4", "videoQuality": "720p"}, "author": {"id": "1", "uniqueId": "@c", "nickname": "n", "avatarLarger": "a", "signature": "s", "verified": @e, "secret": false},
      "authorStats": {"followingCount": 1, "followerCount": @f, "heartCount": 2, "videoCount": 3, "diggCount": 4}, "music": {"id": "m", "title": "song", "authorName": "an", "original": true, "playUrl": "p", "duration": 60},
      "stats": {"diggCount": @d, "shareCount": 1, "commentCount": 2, "playCount": @p}, "duetInfo": {"duetFromId": "@u"},
      "textExtra": [{"awemeId": "@u", "userId": "1", "userUniqueId": "first", "isCommerce": false}, {"awemeId": "x", "userId": "0", "userUniqueId": "nobody", "isCommerce": false}, {"awemeId": "@u", "userId": "2", "userUniqueId": "name@c", "isCommerce": true}],
      "challenges": [{"title": "@t"}, {"desc": "about"}], "stickersOnItem": [{"stickerText": ["a", "b"]}, {"stickerText": []}], "effectStickers": [{"name": "glow"}], "duetEnabled": true, "stitchEnabled": false, "isAd": false}}"""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    values = {
        "@k": k, "@o": F.when(k % 4 == 1, "true").otherwise("false"), "@h": 1280 + k % 9, "@e": F.when(k % 2 == 0, "true").otherwise("false"), "@f": c * 3, "@d": k * 2, "@p": k + 7,
        "@u": F.when(k % 2 == 1, F.concat(F.lit("d"), k.cast("string"))).otherwise("0"), "@c": c, "@t": F.col("o_orderpriority"),
        "@y": F.when(k % 3 == 0, "4").otherwise("1"),
    }
    found = payloads.tiktok_videos(table(spark, sf_dir, "orders").select(filled(item, values).alias("payload")), search=True)
    names = "id timestamp utc_time original_item video_height video_duration video_quality author_unique_id author_follower_count author_verified music_title music_duration digg_count play_count duet_from_video_id duet_from_user_id"
    names += " duet_from_user_name duet_from_user_is_commerce stickers_texts challenges_titles challenges_descriptions effect_stickers_names duet_enabled stitch_enabled share_enabled is_ad"
    return found.select(*names.split(), F.lit(len(found.columns)).alias("n_columns"))


@query("SELECT doc_id::VARCHAR AS pk, ['tag' || doc_id % 7] AS hashtags, ['some.one'] AS mentioned_names, false AS has_translation, source AS user_username FROM documents")
def n8_instagram_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("x #Tag"), (F.col("doc_id") % 7).cast("string"), F.lit(" @Some.One"))
    doc = s(pk=text_of("doc_id"), text=said, user=s(username=F.col("source")))
    return payloads.instagram_comments(payload(table(spark, sf_dir, "documents"), doc)).select("pk", "hashtags", "mentioned_names", "has_translation", "user_username")


@query("SELECT doc_id::VARCHAR AS id, lang AS caption, n_chars::VARCHAR AS liked_by_count, 'https://www.instagram.com/p/B' || doc_id || '/' AS url FROM documents")
def n9_instagram_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = s(id=text_of("doc_id"), shortcode=F.concat(F.lit("B"), text_of("doc_id")), edge_media_to_caption=s(edges=F.array(s(node=s(text=F.col("lang"))))), edge_liked_by=s(count=F.col("n_chars")))
    return payloads.instagram_hashtag_posts(payload(table(spark, sf_dir, "documents"), doc)).select("id", "caption", "liked_by_count", "url")


@query("""SELECT o_custkey::VARCHAR AS post_id, 'c' || o_orderkey AS comment_id, NULL::VARCHAR AS parent_id, 0 AS depth, o_orderpriority AS text FROM orders
  UNION ALL SELECT o_custkey::VARCHAR, 'd' || o_orderkey, 'c' || o_orderkey, 1, o_orderstatus FROM orders""")
def n12_facebook_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda prefix: F.concat(F.lit(prefix), text_of("o_orderkey"))
    node = lambda prefix, c, **more: s(node=s(id=key(prefix), preferred_body=s(text=F.col(c)), **more))
    reply = s(edges=F.array(node("d", "o_orderstatus", depth=1, comment_parent=s(id=key("c")), feedback=s(total_comment_count=0))))
    comments = s(edges=F.array(node("c", "o_orderpriority", depth=0, feedback=s(display_comments=reply))))
    k = F.col("o_orderkey") % 3
    doc = s(id=text_of("o_custkey"), data=s(node=F.when(k == 0, s(display_comments=comments)), feedback=F.when(k == 2, s(display_comments=comments))), display_comments=F.when(k == 1, comments))
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"), "o_orderkey")
    return payloads.facebook_comments(payload(orders, doc)).select("post_id", "comment_id", "parent_id", "depth", "text")


@query("""SELECT o_custkey::VARCHAR AS post_id, 'c' || o_orderkey || '-' || i AS comment_id, CASE WHEN i > 0 THEN 'c' || o_orderkey || '-' || (i - 1) END AS parent_id, i::INT AS depth, o_orderpriority AS text,
  i AS reactions, CASE WHEN i < 2 + o_orderkey % 5 THEN 1 ELSE 0 END AS replies FROM orders, (SELECT unnest(range(7)) AS i) WHERE i <= 2 + o_orderkey % 5""")
def n12_facebook_comments_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies below replies, down to depth 2 to 6."""
    key = lambda i: F.concat(F.lit("c"), text_of("o_orderkey"), F.lit(f"-{i}"))
    below = None
    for i in range(6, -1, -1):
        more = F.lit(i) < 2 + F.col("o_orderkey") % 5
        feedback = s(reactors=s(count=i), total_comment_count=F.when(more, 1)) if below is None else s(reactors=s(count=i), total_comment_count=F.when(more, 1), display_comments=F.when(more, below))
        node = s(id=key(i), depth=i, preferred_body=s(text=F.col("o_orderpriority")), comment_parent=s(id=key(0) if i else F.lit(None).cast("string")), reply_parent_comment=s(id=key(i - 1) if i else F.lit(None).cast("string")), feedback=feedback)
        below = s(edges=F.array(s(node=node)))
    doc = s(data=s(node=s(id=text_of("o_custkey"), display_comments=below)))
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")
    return payloads.facebook_comments(payload(orders, doc)).select("post_id", "comment_id", "parent_id", "depth", "text", "reactions", "replies")


@query("SELECT o_orderkey::VARCHAR AS stories_id, o_orderpriority AS title, o_orderkey % 2 = 0 AS full_text_rss FROM orders")
def n13_mediacloud_topic_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = s(stories_id=F.col("o_orderkey"), title=F.col("o_orderpriority"), full_text_rss=F.col("o_orderkey") % 2 == 0)
    return payloads.mediacloud_topic_stories(payload(table(spark, sf_dir, "orders"), doc)).select("stories_id", "title", "full_text_rss")


@query("SELECT c_custkey, o_orderpriority AS article, o_orderkey AS views FROM customer JOIN orders ON o_custkey = c_custkey")
def n14_wikipedia_pageviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(s(article=F.col("o_orderpriority"), views=F.col("o_orderkey"))).alias("items"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(items, "c_custkey", "left")
    return payloads.wikipedia_pageviews(payload(rows, s(items=F.col("items")), "c_custkey")).select("c_custkey", "article", "views")


# Pages of a search as the service sends them: the customer's orders as entries, by o_orderkey % 8: 0 unavailable, 1 promoted, 2 shown with a notice, 3 quotes
# a tweet that is shown with a notice, 4 an empty result, 5 no tweet, 6 quotes one that is gone, 7 has no user. A pinned one replaces an entry; a third instruction is none of these.
def twitter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tweet = """{"__typename": "Tweet", "rest_id": "@k", "source": "web", "core": {"user_results": {"result": {"__typename": "User", "legacy": {"screen_name": "u@c", "name": "User @c", "followers_count": @c, "verified": false}}}},
      "legacy": {"id_str": "@k", "user_id_str": "@c", "full_text": "@t", "favorite_count": @k, "created_at": "Mon Jan 01 00:00:00 +0000 2024"@m}@q}"""
    quoted = """{"__typename": "Tweet", "source": "app", "core": {"user_results": {"result": {"legacy": {"screen_name": "q@c", "name": "Q"}}}}, "legacy": {"id_str": "9@k", "user_id_str": "8@c", "full_text": "said before", "quoted_status_id_str": "1"}}"""
    wrapped = lambda t: '{"__typename": "TweetWithVisibilityResults", "tweet": ' + t + "}"
    plain = lambda more="", quote="": tweet.replace("@m", more).replace("@q", quote)
    results = [
        '{"__typename": "TweetUnavailable", "reason": "Suspended"}', plain(', "promotedMetadata": {"x": 1}'), wrapped(plain()),
        plain(', "quoted_status_id_str": "9@k"', ', "quoted_status_result": {"result": ' + wrapped(quoted) + "}"), None, '{"__typename": "Tweet", "rest_id": "@k"}',
        plain(', "quoted_status_id_str": "77"', ', "quoted_status_result": {"result": {"__typename": "TweetUnavailable"}}'), plain().replace('"core"', '"core_is_missing"'),
    ]
    entry = '{"entryId": "tweet-@k", "content": {"itemContent": {"tweet_results": %s}}}'
    entries = [entry % (f'{{"result": {r}}}' if r else "{}") for r in results]
    kinds = [filled(e, {"@k": "o_orderkey", "@c": "o_custkey", "@t": "o_orderpriority"}) for e in entries]
    kind = kinds[7]
    for n, e in enumerate(kinds[:7]):
        kind = F.when(F.col("o_orderkey") % 8 == n, e).otherwise(kind)
    pages = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", kind.alias("e")))), lambda x: x["e"]), ", ").alias("entries"))
    pin = '{"entryId": "sq-I-t-pin", "content": {"itemContent": {"tweet_results": {"result": %s}}}}' % plain().replace("@k", "55").replace("@t", "pinned")
    pinned = filled(pin, {"@c": "o_custkey"})
    cursor = '{"entryId": "sq-cursor-top", "content": {"cursorType": "Top"}}'
    doc = F.concat(
        F.lit('{"data": {"search_by_raw_query": {"search_timeline": {"timeline": {"instructions": [{"type": "TimelineAddEntries", "entries": [' + cursor + ", "), F.col("entries"),
        F.lit(']}, {"type": "TimelineReplaceEntry", "entry": '), pinned, F.lit('}, {"type": "TimelineClearCache"}]}}}}}'),
    )
    return pages.select("o_custkey", doc.alias("payload"))


_TWEETS = """o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
  tweets AS (SELECT o_custkey, 0 AS instruction, n, 'tweet-' || o_orderkey AS entry, 'tweet' AS role, NULL AS around_id, CASE WHEN o_orderkey % 8 <> 5 THEN o_orderkey::VARCHAR END AS id, CASE WHEN o_orderkey % 8 <> 5 THEN o_orderpriority END AS text,
      CASE o_orderkey % 8 WHEN 3 THEN '9' || o_orderkey WHEN 6 THEN '77' END AS quoted_id, CASE WHEN o_orderkey % 8 <> 5 THEN 'web' END AS source, CASE WHEN o_orderkey % 8 <> 5 THEN o_custkey::VARCHAR END AS user_id,
      CASE WHEN o_orderkey % 8 NOT IN (5, 7) THEN 'u' || o_custkey END AS user_screen_name, CASE WHEN o_orderkey % 8 <> 5 THEN o_orderkey END AS like_count, CASE WHEN o_orderkey % 8 NOT IN (5, 7) THEN o_custkey END AS user_followers,
      CASE o_orderkey % 8 WHEN 5 THEN 'parsing' WHEN 7 THEN 'no-user' END AS error FROM o WHERE o_orderkey % 8 NOT IN (0, 1, 4)
    UNION ALL SELECT o_custkey, 0, n, 'tweet-' || o_orderkey, 'quoted', o_orderkey::VARCHAR, '9' || o_orderkey, 'said before', '1', 'app', '8' || o_custkey, 'q' || o_custkey, NULL, NULL, NULL FROM o WHERE o_orderkey % 8 = 3
    UNION ALL SELECT DISTINCT o_custkey, 1, 0, 'sq-I-t-pin', 'tweet', NULL, '55', 'pinned', NULL, 'web', o_custkey::VARCHAR, 'u' || o_custkey, 55, o_custkey, NULL FROM orders)"""


@query(f"WITH {_TWEETS} SELECT * FROM tweets")
def n15_twitter_timeline_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = payloads.twitter_timeline_tweets(twitter_pages(spark, sf_dir))
    return found.select("o_custkey", "instruction", F.col("n").cast("long").alias("n"), "entry", "role", "around_id", "id", "text", "quoted_id", "source", "user_id", "user_screen_name", "like_count", "user_followers", "error")


@query(f"""WITH {_TWEETS}, t AS (SELECT DISTINCT id, user_id, quoted_id, text FROM tweets WHERE error IS NULL AND role = 'tweet'), every AS (SELECT id, min(user_id) AS user_id, arg_min(text, (user_id, text)) AS text FROM tweets WHERE error IS NULL GROUP BY id),
  u AS (SELECT user_id, min(user_screen_name) AS name FROM tweets WHERE error IS NULL GROUP BY 1)
  SELECT t.id, t.user_id, u.name, t.quoted_id, q.text AS quoted_text, qu.name AS quoted_user, CASE WHEN t.quoted_id IS NOT NULL AND q.id IS NULL THEN 'quoted-not-found' END AS error
  FROM t JOIN u USING (user_id) LEFT JOIN every q ON q.id = t.quoted_id LEFT JOIN u qu ON qu.user_id = q.user_id""")
def n15_j7_quotes_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tweets of pages with the tweets they quote, which stand inside them or nowhere."""
    from weblake.operators import joins

    found = stored(payloads.twitter_timeline_tweets(twitter_pages(spark, sf_dir)).where("error is null"))
    users = found.select("user_id", F.col("user_screen_name").alias("name")).distinct()
    tweets = found.where("role = 'tweet'").select("id", "user_id", "quoted_id", "retweeted_id", "text").distinct()
    return joins.attach_referenced(tweets, users, originals=found).select("id", "user_id", "name", "quoted_id", "quoted_text", "quoted_user", "error")


@query("SELECT event_type, count(*) AS tweet_count FROM events GROUP BY 1")
def n17_tweet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    data = table(spark, sf_dir, "events").groupBy("event_type", day.alias("day")).agg(F.count("*").alias("n"))
    pages = data.groupBy("event_type").agg(F.collect_list(s(start=F.col("day"), end=F.col("day"), tweet_count=F.col("n"))).alias("data"))
    return payloads.tweet_counts(payload(pages, s(data=F.col("data")), "event_type")).groupBy("event_type").agg(F.sum("tweet_count").alias("tweet_count"))


@query("SELECT c_custkey::VARCHAR AS id, 'http://a' || c_custkey || ' http://b' AS prefixes, c_custkey + 2 AS degree FROM customer")
def n18_webentity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = s(_id=F.col("c_custkey"), prefixes=F.array(F.concat(F.lit("http://a"), text_of("c_custkey")), F.lit("http://b")), indegree=F.col("c_custkey"), outdegree=2)
    return payloads.webentity_rows(payload(table(spark, sf_dir, "customer"), doc)).select("id", "prefixes", "degree")


@query("SELECT o_orderkey::VARCHAR AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Paid Partnership' WHEN 1 THEN 'Promotional Content' ELSE 'own' END AS label, ['u' || o_orderkey] AS video_urls, strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%dT%H:%M:%S') AS create_date_utc FROM orders")
def n7_tiktok_commercials(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, url = F.col("o_orderkey"), F.concat(F.lit("u"), text_of("o_orderkey"))
    old = k % 2 == 0
    video = s(url=F.when(old, url), video_url=F.when(~old, url))
    doc = s(id=text_of("o_orderkey"), content_label=F.when(k % 3 < 2, (k % 3 + 1).cast("string")), label="own", videos=F.array(video), create_timestamp=F.when(old, k), posted_time=F.when(~old, k))
    return payloads.tiktok_commercials(payload(table(spark, sf_dir, "orders"), doc)).select("id", "label", "video_urls", "create_date_utc")


@query("""SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'GraphSidecar' ELSE 'GraphImage' END AS media_type, CASE WHEN o_orderkey % 2 = 0 THEN ['GraphImage', 'GraphVideo'] ELSE ['GraphImage'] END AS medias_type,
  CASE WHEN o_orderkey % 2 = 0 THEN ['i1', 'v2'] ELSE ['i0'] END AS medias_url, CASE WHEN o_orderkey % 2 = 0 THEN ['u1', 'u2'] ELSE ['u0'] END AS usertags_medias, ['c1', 'c2'] AS coauthor_usernames FROM orders""")
def n10_instagram_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda name: F.struct(F.array(s(user=s(username=name))).alias("in"))
    image = lambda n: s(candidates=F.array(s(url=f"i{n}")))
    side = F.col("o_orderkey") % 2 == 0
    no_video = F.lit(None).cast("array<struct<url:string>>")
    medias = F.array(s(media_type=1, image_versions2=image(1), video_versions=no_video, usertags=tag("u1")), s(media_type=2, image_versions2=image(9), video_versions=F.array(s(url="v2")), usertags=tag("u2")))
    author = lambda n: F.array(s(username=n))
    doc = s(pk=text_of("o_orderkey"), code="B", media_type=F.when(side, 8).otherwise(1), carousel_media=F.when(side, medias), image_versions2=image(0), usertags=tag("u0"), coauthor_producers=author("c2"), invited_coauthor_producers=author("c1"))
    return payloads.instagram_posts(payload(table(spark, sf_dir, "orders"), doc)).select("id", "media_type", "medias_type", "medias_url", "usertags_medias", "coauthor_usernames")


@query("""SELECT c_custkey::VARCHAR AS id, ['t' || c_nationkey] AS bio_links_title, ['friend'] AS biography_with_username, ['tag' || c_nationkey] AS biography_with_hashtag, c_custkey::VARCHAR AS follower_count,
  'they' AS pronoun, c_custkey % 2 = 0 AS is_business_account, c_mktsegment AS category_name FROM customer""")
def n11_instagram_user_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    entities = F.array(s(user=s(username="friend", hashtag=none)), s(user=s(username="", hashtag=F.concat(F.lit("tag"), text_of("c_nationkey")))))
    doc = s(
        id=text_of("c_custkey"), bio_links=F.array(s(title=F.concat(F.lit("t"), text_of("c_nationkey")), url="http://x")), biography_with_entities=s(entities=entities), edge_followed_by=s(count=F.col("c_custkey")),
        pronouns=F.array(F.lit("they")), is_business_account=F.col("c_custkey") % 2 == 0, category_name=F.col("c_mktsegment"),
    )
    found = payloads.instagram_user_infos(payload(table(spark, sf_dir, "customer"), doc))
    return found.select("id", "bio_links_title", "biography_with_username", "biography_with_hashtag", "follower_count", F.get("pronouns", 0).alias("pronoun"), "is_business_account", "category_name")


@query("SELECT c_custkey::VARCHAR AS id, c_name AS username, c_custkey % 3 = 0 AS is_private, 'p' || c_nationkey AS profile_pic_id, ['b'] AS account_badges, c_nationkey::VARCHAR AS latest_reel_media, false AS is_favorite FROM customer")
def n11_instagram_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = s(pk=F.col("c_custkey"), username=F.col("c_name"), is_private=F.col("c_custkey") % 3 == 0, profile_pic_id=F.concat(F.lit("p"), text_of("c_nationkey")), account_badges=F.array(F.lit("b")), latest_reel_media=F.col("c_nationkey"), is_favorite=False)
    return payloads.instagram_users(payload(table(spark, sf_dir, "customer"), doc)).select("id", "username", "is_private", "profile_pic_id", "account_badges", "latest_reel_media", "is_favorite")


@query("SELECT o_orderkey::VARCHAR AS stories_id, [o_orderpriority, 'b'] AS tags, ['s', 's'] AS tag_sets, [o_custkey::VARCHAR, NULL] AS tags_ids FROM orders")
def n13_mediacloud_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(s(tag=F.col("o_orderpriority"), tag_set="s", tags_id=F.col("o_custkey")), s(tag="b", tag_set="s", tags_id=F.lit(None).cast("long")))
    doc = s(stories_id=F.col("o_orderkey"), payload_tags=tags)
    return payloads.mediacloud_stories(payload(table(spark, sf_dir, "orders"), doc)).select("stories_id", "tags", "tag_sets", "tags_ids")


@query("SELECT s_suppkey::VARCHAR AS media_id, s_name AS media_name, s_suppkey % 2 = 0 AS is_healthy, CASE WHEN s_suppkey % 3 = 0 THEN 'n' END AS public_notes, s_suppkey::DOUBLE AS num_stories_90, ['k' || s_nationkey] AS tags FROM supplier")
def n13_mediacloud_medias(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    doc = s(media_id=k, name=F.col("s_name"), is_healthy=k % 2 == 0, public_notes=F.when(k % 3 == 0, "n"), num_stories_90=k, media_source_tags=F.array(s(tag=F.concat(F.lit("k"), text_of("s_nationkey")))))
    return payloads.mediacloud_medias(payload(table(spark, sf_dir, "supplier"), doc)).select("media_id", "media_name", "is_healthy", "public_notes", "num_stories_90", "tags")


@query("SELECT s_suppkey::VARCHAR AS feeds_id, s_name AS name, 'm' || s_nationkey AS media_id, s_suppkey % 2 = 0 AS active, s_suppkey + 0.5::DOUBLE AS last_new_story_time FROM supplier")
def n13_mediacloud_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    doc = s(payloads_id=k, name=F.col("s_name"), media_id=F.concat(F.lit("m"), text_of("s_nationkey")), active=k % 2 == 0, last_new_story_time=k + 0.5)
    return payloads.mediacloud_feeds(payload(table(spark, sf_dir, "supplier"), doc)).select("feeds_id", "name", "media_id", "active", "last_new_story_time")


@query("""SELECT o_orderkey AS page_id, i::INT AS place, CASE i WHEN 0 THEN o_orderpriority ELSE 'T' || o_custkey END AS title, CASE i WHEN 0 THEN 'https://site.org/' || o_orderkey ELSE 'https://other.org/?a=1&b=' || o_custkey END AS url
  FROM orders, (SELECT unnest([0, 1]) AS i) WHERE o_orderkey % 7 <> 0""")
def n4_youtube_channel_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data of the service's shape: the shown text is cut, the target is under the link's command, one of them behind a redirection."""
    link = lambda title, url: s(channelExternalLinkViewModel=s(title=s(content=title), link=s(content="site.org/short\u2026", commandRuns=F.array(s(onTap=s(innertubeCommand=s(urlEndpoint=s(url=url))))))))
    away = F.concat(F.lit("https://www.youtube.com/redirect?event=channel&q=https%3A%2F%2Fother.org%2F%3Fa%3D1%26b%3D"), text_of("o_custkey"))
    links = F.array(link(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")), F.concat(F.lit("https://site.org/"), text_of("o_orderkey"))), link(F.concat(F.lit("T"), text_of("o_custkey")), away))
    data = F.to_json(s(contents=s(tabs=F.array(s(deep=s(links=links))))))
    page = F.concat(F.lit("<html><script>var ytInitialData = "), F.when(F.col("o_orderkey") % 7 == 0, "{broken").otherwise(data), F.lit(";</script></html>"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), page.alias("html"))
    return payloads.youtube_channel_links(pages)


@query("""SELECT o_orderkey AS video_id, i::INT AS place, CASE i WHEN 0 THEN 'en' ELSE 'fr' END AS lang, 'https://www.youtube.com/api/timedtext?v=' || o_orderkey || '&lang=' || i AS url, i = 1 AND o_orderkey % 2 = 0 AS generated
  FROM orders, (SELECT unnest([0, 1]) AS i) WHERE o_orderkey % 5 <> 0""")
def n5_youtube_caption_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = lambda i: F.concat(F.lit("https://www.youtube.com/api/timedtext?v="), text_of("o_orderkey"), F.lit(f"\\u0026lang={i}"))
    track = lambda i, lang, kind: F.concat(F.lit('{"baseUrl":"'), url(i), F.lit(f'","languageCode":"{lang}"'), kind, F.lit("}"))
    tracks = F.concat(F.lit('"captionTracks":['), track(0, "en", F.lit("")), F.lit(","), track(1, "fr", F.when(F.col("o_orderkey") % 2 == 0, ',"kind":"asr"').otherwise("")), F.lit("]"))
    page = F.concat(F.lit("<script>100% + {"), F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 3 == 0, F.replace(tracks, F.lit('"'), F.lit("%22"))).otherwise(tracks), F.lit("}</script>"))
    page = F.when(F.col("o_orderkey") % 3 == 0, F.replace(page, F.lit("100% "), F.lit(""))).otherwise(page)
    return payloads.youtube_caption_tracks(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), page.alias("html")))


@query("""SELECT o_orderkey AS track, i::INT AS place, i * 1.5::DOUBLE AS start, CASE i WHEN 0 THEN 2.25 ELSE 0 END::DOUBLE AS dur, CASE i WHEN 0 THEN 'it''s é & <' || o_orderpriority || '>' ELSE '"à" — ' || o_custkey END AS text FROM orders, (SELECT unnest([0, 1]) AS i)""")
def n5_youtube_caption_lines_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by name, by number and by hexadecimal number."""
    first = F.concat(F.lit('<text start="0.0" dur="2.25">it&#x27;s &#233; &amp; &lt;'), F.col("o_orderpriority"), F.lit("&gt;</text>"))
    second = F.concat(F.lit('<text start="1.5"> &quot;&agrave;&quot; &#8212; '), text_of("o_custkey"), F.lit("</text>"))
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("track"), F.concat(F.lit('<?xml version="1.0"?><transcript>'), first, second, F.lit("</transcript>")).alias("xml"))
    return payloads.youtube_caption_lines(files, "track", "xml")


@query("""SELECT 'http://s.org/' || o_orderkey AS url, 's:http|h:org|h:s|p:' || o_orderkey AS lru, o_custkey AS webentity, 'IN' AS webentity_status, CASE WHEN o_orderkey % 2 = 0 THEN '200' END AS status, o_orderkey % 2 = 0 AS crawled,
  (o_orderkey * 1000)::VARCHAR AS crawl_timestamp, strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%dT%H:%M:%S') AS crawl_datetime, NULL::VARCHAR AS size, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '<p>hello</p>' END AS body FROM orders""")
def n18_webentity_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies deflated, in base64; every third is broken."""
    import base64
    import zlib

    k = text_of("o_orderkey")
    packed = base64.b64encode(zlib.compress(b"<p>hello</p>")).decode()
    even = F.col("o_orderkey") % 2 == 0
    doc = s(
        url=F.concat(F.lit("http://s.org/"), k), lru=F.concat(F.lit("s:http|h:org|h:s|p:"), k), status=F.when(even, 200), crawled=even, crawl_timestamp=F.col("o_orderkey") * 1000,
        body=F.when(F.col("o_orderkey") % 3 == 0, "bm8gemxpYg==").otherwise(packed),
    )
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("webentity"), F.lit("IN").alias("webentity_status"), F.to_json(doc).alias("payload"))
    found = payloads.webentity_page_rows(rows, bodies=True)
    return found.select("url", "lru", "webentity", "webentity_status", "status", "crawled", "crawl_timestamp", "crawl_datetime", "size", F.col("body").cast("string").alias("body"))


@query("""SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS n, o_orderkey::VARCHAR AS id, 'f' || o_orderkey AS screen_name, o_orderpriority AS name, o_orderkey % 2 = 0 AS verified, o_orderkey + 1 AS followers, 'c' || o_custkey AS cursor
  FROM orders WHERE o_custkey % 3 <> 0""")
def n16_twitter_followers_you_know(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the service sends them: the last instruction has the users; every third page has no bottom cursor and so no users."""
    entry = '{"entryId": "user-@k", "content": {"itemContent": {"user_results": {"result": {"rest_id": "@k", "legacy": {"screen_name": "f@k", "name": "@p", "followers_count": @n, "verified": @v}}}}}}'
    one = filled(entry, {"@k": "o_orderkey", "@p": "o_orderpriority", "@n": F.col("o_orderkey") + 1, "@v": F.col("o_orderkey") % 2 == 0})
    pages = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("e")))), lambda x: x["e"]), ", ").alias("users"))
    place = F.when(F.col("o_custkey") % 3 != 0, "bottom").otherwise("top")
    doc = F.concat(
        F.lit('{"data": {"user": {"result": {"timeline": {"timeline": {"instructions": [{"type": "TimelineClearCache"}, {"type": "TimelineAddEntries", "entries": ['), F.col("users"),
        F.lit(', {"entryId": "cursor-'), place, F.lit('-1", "content": {"value": "c'), text_of("o_custkey"), F.lit('"}}]}]}}}}}}'),
    )
    found = payloads.twitter_followers_you_know(pages.select("o_custkey", doc.alias("payload")))
    return found.select("o_custkey", "n", "id", "screen_name", "name", "verified", "followers", "cursor")


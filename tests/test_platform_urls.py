from pyspark.sql import functions as F

from weblake.functions import urls
from weblake.operators import platform_pages


def test_pages_without_ids_and_other_sites_have_no_platform_url(spark):
    given = [
        ("https://www.facebook.com/Some.Page/", "https://www.facebook.com/some.page"), ("https://www.facebook.com/groups/abc/", "https://www.facebook.com/groups/abc"), ("https://www.facebook.com/", None),
        ("https://www.facebook.com/profile.php?id=12&sk=about", "https://www.facebook.com/profile.php?id=12"), ("https://www.youtube.com/@Name/videos", "https://www.youtube.com/c/Name"), ("https://www.youtube.com/feed/trending", None),
        ("https://twitter.com/Name", "https://twitter.com/name"), ("https://site.org/watch?v=abcdefghijk", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(given)], "i int, u string")
    got = dict(df.select("i", urls.platform_url(F.col("u"))).collect())
    assert [got[i] for i in range(len(given))] == [w for _, w in given]


def test_platforms_count_only_where_asked(spark):
    df = spark.createDataFrame([("https://youtu.be/abcdefghijk",)], "u string")
    row = df.select(urls.normalize_url(F.col("u")).alias("plain"), urls.normalize_url(F.col("u"), platform_aware=True).alias("aware"), urls.fingerprint_url(F.col("u"), strip_suffix=True, platform_aware=True).alias("key")).head()
    assert tuple(row) == ("youtu.be/abcdefghijk", "youtube.com/watch?v=abcdefghijk", "youtube/watch?v=abcdefghijk")


def test_author_texts_of_null_repeated_and_missing_pages(spark):
    page = "<div id=siteTable><div class='usertext-body'>{}</div></div>"
    pages = spark.createDataFrame([("https://old.reddit.com/r/x/1", page.format("b")), ("https://www.reddit.com/r/x/1", page.format("a")), ("https://www.reddit.com/r/x/2", None), (None, page.format("c"))], "url string, html string")
    posts = spark.createDataFrame([(f"https://www.reddit.com/r/x/{i}" if i else None, i) for i in (0, 1, 1, 2, 3)], "url string, i int")
    got = platform_pages.attach_author_texts(posts, platform_pages.reddit_post_texts(pages)).select("i", "author_text", "error").collect()
    assert sorted(map(tuple, got)) == [(0, None, "page-not-found"), (1, "a", None), (1, "a", None), (2, None, None), (3, None, "page-not-found")]

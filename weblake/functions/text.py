"""Text, date and number columns, and predicates on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weblake.functions import urls

WORD = r"\p{L}\p{N}_"
# The alphabet of short codes in order of its digits.
BASE64_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
# Fixed value: the millisecond of the first snowflake id.
SNOWFLAKE_EPOCH = 1288834974657


def or_null(c: Column) -> Column:
    return F.when(c != "", c)


def extracted(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if there is no match or the group is empty."""
    return or_null(F.regexp_extract(c, pattern, group))


def yes_no(c: Column) -> Column:
    return F.when(c, "yes").otherwise("no")


def _marked(c: Column, cut: str, mark: str) -> Column:
    found = F.transform(F.filter(F.split(c, cut), lambda x: x.startswith(mark)), lambda x: F.lower(F.regexp_replace(x, f"^{mark}+", "")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))


def extract_hashtags(c: Column) -> Column:
    """Distinct tags of a text, lowered and sorted, without their marks."""
    return _marked(c, rf"[^{WORD}#]+", "#")


def extract_handles(c: Column) -> Column:
    return _marked(c, rf"[^{WORD}.@]+", "@")


def page_filename(url: Column, filename: Column | None = None, ext: Column | None = None, compressed: bool = False) -> Column:
    """File name of a page: the given name or the URL's md5, an extension, ``.gz`` last.

    An extension that the given name has beats ``ext``.
    """
    name = F.lit(None).cast("string") if filename is None else filename
    name = F.regexp_replace(name, r"\.gz$", "")
    suffix = extracted(name, r"[^/](\.[A-Za-z0-9]+)$")
    base = F.coalesce(F.when(suffix.isNotNull(), F.expr("true")), F.lit(False))
    stem = F.when(base, F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")).otherwise(F.coalesce(name, F.md5(url)))
    end = F.coalesce(suffix, ext if ext is not None else F.lit(".html"), F.lit(""))
    return F.concat(stem, end, F.lit(".gz" if compressed else ""))


def folder_path(filename: Column, url: Column, strategy: str = "flat") -> Column:
    """Where a page's file goes: flat, fullpath, prefix-N, hostname, normalized-hostname, fingerprinted-hostname."""
    if strategy == "flat":
        return filename
    if strategy.startswith("prefix-"):
        return F.concat(F.substring(filename, 1, int(strategy.split("-")[1])), F.lit("/"), filename)
    hosts = {"fullpath": urls.get_hostname, "hostname": urls.get_hostname, "normalized-hostname": urls.get_normalized_hostname, "fingerprinted-hostname": urls.get_fingerprinted_hostname}
    host = F.coalesce(hosts[strategy](url), F.lit("unknown-host"))
    if strategy != "fullpath":
        return F.concat(host, F.lit("/"), filename)
    parts = F.filter(F.split(urls.path(urls.ensure_protocol(url)), "/"), lambda x: x != "")
    kept = F.when(F.element_at(F.concat(F.array(F.lit("")), parts), -1).contains("."), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    short = F.transform(kept, lambda x: F.substring(x, 1, 255))
    return F.array_join(F.concat(F.array(host), short, F.array(filename)), "/")


def clean_human_number(c: Column) -> Column:
    """The first number of a text: K and M multiply, else commas and points go; no number: the text."""
    found = F.regexp_extract(c, r"([0-9]+[.,]?[0-9]*[KM]?)", 1)
    plain = F.replace(F.regexp_replace(found, "[KM]", ""), F.lit(","), F.lit("."))
    scaled = plain.cast("decimal(20,6)") * F.when(found.endswith("K"), 1000).otherwise(1000000)
    return F.when(found == "", c).when(found.rlike("[KM]$"), F.floor(scaled).cast("string")).otherwise(F.regexp_replace(found, "[.,]", ""))


def approx_likes(body: Column) -> Column:
    """struct(text, likes): the first number alone between two tags."""
    found = extracted(body, r">([0-9]+\.?[0-9]*[KM]?)<")
    return F.when(found.isNotNull(), F.struct(found.alias("text"), clean_human_number(found).cast("long").alias("likes")))


def parse_partial_iso(c: Column, upper_bound: bool = False) -> Column:
    """Timestamp of an ISO date cut anywhere from the year to the microsecond; bad ones give null.

    The upper bound is the last microsecond of the period named.
    """
    t = F.regexp_replace(c, "Z$", "")
    shapes = [
        (r"^\d{4}$", "-01-01 00:00:00", "1 year"),
        (r"^\d{4}-\d{2}$", "-01 00:00:00", "1 month"),
        (r"^\d{4}-\d{2}-\d{2}$", " 00:00:00", "1 day"),
        (r"^\d{4}-\d{2}-\d{2}T\d{2}$", ":00:00", "1 hour"),
        (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$", ":00", "1 minute"),
        (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "", "1 second"),
        (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}$", "", "1 millisecond"),
        (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}$", "", "1 microsecond"),
    ]
    out = F.lit(None).cast("timestamp")
    for pattern, rest, period in shapes:
        at = F.concat(F.replace(t, F.lit("T"), F.lit(" ")), F.lit(rest)).try_cast("timestamp")
        if upper_bound:
            at = at + F.expr(f"interval {period}") - F.expr("interval 1 microsecond")
        out = F.when(t.rlike(pattern), at).otherwise(out)
    return out


def pad_date(c: Column) -> Column:
    return F.when(F.length(c) == 4, F.concat(c, F.lit("-01-01T00:00:00Z"))).when(F.length(c) == 7, F.concat(c, F.lit("-01T00:00:00Z"))).when(F.length(c) == 10, F.concat(c, F.lit("T00:00:00Z"))).otherwise(c)


def timestamp_to_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")


def tweet_date(c: Column, tz: str = "UTC") -> Column:
    """struct(tweet_id, timestamp_utc, locale_time) of a tweet's id or URL; other values give null."""
    id_ = F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c)).otherwise(urls.parse_twitter_url(c)["tweet_id"])
    at = F.timestamp_millis(F.shiftright(id_.try_cast("long"), 22) + SNOWFLAKE_EPOCH)
    return F.when(id_.isNotNull(), F.struct(id_.alias("tweet_id"), at.alias("timestamp_utc"), F.from_utc_timestamp(at, tz).alias("locale_time")))


def shortcode_to_id(c: Column) -> Column:
    """Number of a short code in base 64, as text (12 characters are 72 bits; up to 10 are a long)."""
    digits = (F.instr(F.lit(BASE64_DIGITS), F.substring(F.lpad(c, 10, BASE64_DIGITS[0]), i + 1, 1)).cast("long") - 1 for i in range(10))
    short = reduce(lambda value, digit: F.shiftleft(value, 6) + digit, digits)
    zero = F.lit(0).cast("decimal(38,0)")
    value = F.aggregate(F.split(c, ""), zero, lambda acc, x: (acc * 64 + F.instr(F.lit(BASE64_DIGITS), x) - 1).cast("decimal(38,0)"))
    return F.when(c.rlike(r"^[A-Za-z0-9_\-]{1,10}\z"), short.cast("string")).when(c.rlike(r"^[A-Za-z0-9_\-]{1,12}$"), value.cast("string"))


def id_to_shortcode(c: Column) -> Column:
    """Short code of a number, without leading zeros: of a long by its bits, of others digit by digit."""
    number = c.try_cast("decimal(38,0)")
    start = F.struct(number.alias("rest"), F.lit("").alias("code"))

    def step(acc: Column, _: Column) -> Column:
        digit = (acc["rest"] % 64).cast("int")
        return F.struct(F.floor(acc["rest"] / 64).cast("decimal(38,0)").alias("rest"), F.concat(F.substring(F.lit(BASE64_DIGITS), digit + 1, F.lit(1)), acc["code"]).alias("code"))

    long = number.try_cast("long")
    by_bits = F.concat(*(F.substring(F.lit(BASE64_DIGITS), F.shiftright(long, 6 * i).bitwiseAND(F.lit(63)).cast("int") + 1, F.lit(1)) for i in range(10, -1, -1)))
    code = F.when(long >= 0, by_bits).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step, lambda acc: acc["code"]))
    return F.regexp_replace(code, "^A+(?=.)", "")


def shortcode_to_url(c: Column) -> Column:
    return F.concat(F.lit("https://www.instagram.com/p/"), c, F.lit("/"))


def fix_ascii_json(c: Column) -> Column:
    r"""Undoes \uXXXX escapes; what cannot be read stays."""
    return F.coalesce(F.from_json(F.concat(F.lit('{"v":"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"}')), "v string")["v"], c)


def ensure_video_id(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^[A-Za-z0-9_\-]{11}$"), F.trim(c)).otherwise(urls.parse_youtube_url(c)["id"])


def ensure_channel_id(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^UC[A-Za-z0-9_\-]{22}$"), F.trim(c)).otherwise(F.when(urls.parse_youtube_url(c)["type"] == "channel", urls.parse_youtube_url(c)["id"]))


def channel_playlist_id(c: Column) -> Column:
    return F.concat(F.lit("UU"), F.substring(ensure_channel_id(c), 3, 100))


def subreddit_url(c: Column) -> Column:
    name = F.coalesce(extracted(F.trim(c), r"(?:^|/)r/([A-Za-z0-9_]+)"), extracted(F.trim(c), r"^([A-Za-z0-9_]+)$"))
    return F.concat(F.lit("https://old.reddit.com/r/"), name, F.lit("/"))


def old_reddit_url(c: Column) -> Column:
    return F.regexp_replace(c, r"^(https?://)(?:www\.|new\.)?reddit\.com", "$1old.reddit.com")


def new_reddit_url(c: Column) -> Column:
    return F.regexp_replace(c, r"^(https?://)(?:www\.|old\.)?reddit\.com", "$1www.reddit.com")


def comment_count(c: Column) -> Column:
    return F.coalesce(F.replace(F.regexp_extract(c, r"([0-9,]+)\s+comments?", 1), F.lit(","), F.lit("")).try_cast("int"), F.lit(0))


def t1_ids(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"t1_([a-z0-9]+)"), F.lit(1))


# Predicates


def relevance(content: Column, pattern: str | None, invert: bool = False) -> Column:
    """struct(relevant, matches) of a text by a pattern, whatever the case; no pattern: relevant."""
    if pattern is None:
        return F.struct(F.lit(True).alias("relevant"), F.lit(None).cast("int").alias("matches"))
    n = F.coalesce(F.regexp_count(content, F.lit(f"(?i){pattern}")), F.lit(0))
    found = F.lit(None).cast("int") if invert else F.when(n > 0, n)
    return F.struct((n == 0 if invert else n > 0).alias("relevant"), found.alias("matches"))


def is_not_user_id(c: Column) -> Column:
    return c.rlike("^[A-Za-z_]")


def is_probably_not_screen_name(c: Column) -> Column:
    return ~c.rlike("^[a-zA-Z0-9_]{1,15}$") | c.rlike("^[0-9]+$")


def looks_like_html(body: Column) -> Column:
    return body.rlike(r"(?i)^\s*<(?:html|head|body|title|meta|link|span|div|img|ul|ol|a|p|!|\?)")


def is_binary_mimetype(c: Column) -> Column:
    kind = F.lower(F.trim(c))
    return F.when(kind.startswith("text/"), False).when(~kind.startswith("application/"), True).otherwise(~kind.rlike("json|html|xml|yaml|yml|x-httpd-php"))

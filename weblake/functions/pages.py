"""Columns of fetched pages: gates, headers, encodings and what their bytes declare."""

from __future__ import annotations

import codecs
import encodings
import encodings.aliases
import mimetypes
import pkgutil
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblake.functions.columns import let
from weblake.functions.text import extracted, is_binary_mimetype, looks_like_html

#: Codecs of Python that are no character sets of texts.
NO_CHARACTER_SETS = ("charmap", "idna", "mbcs", "oem", "punycode", "raw_unicode_escape", "undefined", "unicode_escape")


def _known_encodings() -> list[str]:
    """All names, normalized, under which Python's codec tables know a character set."""
    known = {m.name for m in pkgutil.iter_modules(encodings.__path__)} - {"aliases"}
    named = {*known, *encodings.aliases.aliases, *encodings.aliases.aliases.values()}.difference(NO_CHARACTER_SETS)
    out = set()
    for name in named:
        target = encodings.aliases.aliases.get(name, name)
        if target in known and target not in NO_CHARACTER_SETS and codecs.lookup(target)._is_text_encoding:
            out.add(re.sub(r"[\s_\-]", "", name).lower())
    return sorted(out)


ENCODINGS = _known_encodings()
#: Media types by extension and extensions by media type, as Python's own tables have them.
_MEDIA = mimetypes.MimeTypes(filenames=())
MIMETYPES: dict[str, str] = dict(sorted(_MEDIA.types_map[True].items()))
EXTENSIONS: dict[str, str] = {m: {".htm": ".html", ".jpe": ".jpg"}.get(e, e) for m in sorted(set(MIMETYPES.values())) if (e := _MEDIA.guess_extension(m))}


def normalize_encoding(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s_\-]", ""))


def is_supported_encoding(c: Column) -> Column:
    return normalize_encoding(c).isin(*ENCODINGS)


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def gate_pages(report: DataFrame) -> DataFrame:
    """``report`` and ``gate_error``: the first reason why a row has no page to read, else null.

    A check is left out when its column is absent.
    """
    has = set(report.columns)
    error = F.when(F.lit(False), "")
    if "fetch_error" in has:
        error = error.when(~blank(F.col("fetch_error")), "http-errored")
    if "http_status" in has:
        error = error.when(~F.coalesce(F.col("http_status").try_cast("double") == 200, F.lit(False)), "invalid-status")
    if "mimetype" in has:
        error = error.when(~F.coalesce(F.col("mimetype").contains("/htm"), F.lit(False)), "invalid-mimetype")
    bodies = [c for c in ("path", "body") if c in has]
    if bodies:
        none = F.lit(True)
        for c in bodies:
            none = none & blank(F.col(c).cast("string"))
        error = error.when(none, "no-path-nor-body")
    if "encoding" in has:
        error = error.when(~blank(F.col("encoding")) & ~is_supported_encoding(F.col("encoding")), "encoding-not-supported")
    return report.withColumn("gate_error", error)


def mark_eligible(df: DataFrame, url: str, only_shortened: bool = False, only_html: bool = False) -> DataFrame:
    """``df`` and ``eligible``: whether the row's URL is to be looked at; other rows stay, to pass through.

    Blank URLs are not; nor, as asked, those that are not shortened or cannot be HTML.
    """
    from weblake.functions.urls import could_be_html, is_shortened_url

    trimmed = F.trim(F.coalesce(F.col(url), F.lit("")))
    fine = trimmed != ""
    if only_shortened:
        fine = fine & is_shortened_url(trimmed)
    if only_html:
        fine = fine & could_be_html(trimmed)
    return df.withColumn("eligible", F.coalesce(fine, F.lit(False)))


def filter_time_range(df: DataFrame, ts: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from ``start`` (inclusive) to ``end`` (exclusive), ISO dates that may be cut; rows without a time go where a bound is given."""
    from weblake.functions.text import parse_partial_iso

    at = F.col(ts).cast("timestamp")
    if start is not None:
        df = df.where(at >= parse_partial_iso(F.lit(start)))
    if end is not None:
        df = df.where(at < parse_partial_iso(F.lit(end)))
    return df


def filter_min_date(df: DataFrame, ts: str, least: int | str) -> DataFrame:
    """Rows not older than ``least``, in the column's own terms (seconds, or ISO text)."""
    return df.where(F.col(ts) >= F.lit(least))


def content_type_parts(c: Column) -> Column:
    """struct(mimetype, charset) of a Content-Type header."""
    kind = F.trim(F.regexp_extract(c, r"^([^;,]*)", 1))
    return F.struct(F.when(kind != "", kind).alias("mimetype"), F.lower(extracted(c, r"(?i)charset\s*=\s*[\"']?([^\s;,\"']+)")).alias("charset"))


def guess_mimetype(url: Column, content_type: Column, body: Column) -> Column:
    """struct(mimetype, ext, is_text): by header, else by the URL's extension, else by the look of the body.

    is_text: the media type is none of bytes (``is_binary_mimetype``); null where no media type is known.
    """
    from weblake.functions.urls import extension

    table = lambda pairs: F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
    dotted = F.concat(F.lit("."), extension(url))
    kind = F.coalesce(F.lower(content_type_parts(content_type)["mimetype"]), F.try_element_at(table(MIMETYPES), dotted), F.when(looks_like_html(body), "text/html"))
    return let(kind, lambda k: F.struct(k.alias("mimetype"), F.try_element_at(table(EXTENSIONS), k).alias("ext"), (~is_binary_mimetype(k)).alias("is_text")))


def regex_canonical(body: Column) -> Column:
    """href of the first link tag whose rel is canonical, without quotes; null if empty."""
    tag = F.regexp_extract(body, r"(?is)(<link\s[^>]*\brel\s*=\s*(?:\"canonical\"|'canonical'|canonical\b)[^>]*>)", 1)
    href = F.coalesce(extracted(tag, r"(?is)\bhref\s*=\s*\"([^\"]*)\""), extracted(tag, r"(?is)\bhref\s*=\s*'([^']*)'"), extracted(tag, r"(?is)\bhref\s*=\s*([^\s\"'>]+)"))
    return F.when(F.trim(href) != "", F.trim(href))


def _refresh(value: Column) -> Column:
    seconds = F.regexp_extract(value, r"^\s*([0-9]+)\s*;", 1).try_cast("int")
    url = F.trim(F.regexp_replace(F.regexp_extract(value, r"(?i)^[^;]*;\s*url\s*=\s*(.+)$", 1), r"^['\"]|['\"]$", ""))
    return F.when(seconds.isNotNull() & (url != ""), F.struct(seconds.alias("seconds"), url.alias("url")))


def http_refresh(value: Column) -> Column:
    """struct(seconds, url) of a refresh header."""
    return _refresh(value)


def meta_refresh(body: Column) -> Column:
    """struct(seconds, url) of the first meta tag that refreshes."""
    tag = F.regexp_extract(body, r"(?is)(<meta\s[^>]*http-equiv\s*=\s*[\"']?refresh[\"']?[^>]*>)", 1)
    return _refresh(F.coalesce(extracted(tag, r"(?is)\bcontent\s*=\s*\"([^\"]*)\""), extracted(tag, r"(?is)\bcontent\s*=\s*'([^']*)'")))


def js_location(body: Column) -> Column:
    """The URL that a script sets the location to."""
    found = extracted(body, r"(?is)\blocation(?:\.href)?\s*(?:=|\.replace\s*\()\s*[\"']([^\"']+)[\"']")
    return F.replace(found, F.lit("\\/"), F.lit("/"))


def declared_encodings(pages: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """id, normalized encoding name, its longest spelling and how often the first 1,024 characters declare it."""
    head = F.substring(F.col(body_col), 1, 1024)
    meta = F.regexp_extract_all(head, F.lit(r"(?is)<meta[^>]*?charset\s*=\s*[\"']?([A-Za-z0-9_\-]+)"), F.lit(1))
    xml = F.regexp_extract_all(head, F.lit(r"(?is)<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9_\-]+)"), F.lit(1))
    names = pages.select(id_col, F.explode(F.concat(meta, xml)).alias("name"))
    return names.groupBy(id_col, normalize_encoding(F.col("name")).alias("encoding")).agg(
        F.max_by("name", F.struct(F.length("name"), F.col("name"))).alias("name"), F.count("*").alias("count")
    )

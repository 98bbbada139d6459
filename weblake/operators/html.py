"""HTML pages to rows: each page is parsed once, in a map over batches; what follows are columns."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Callable, Iterable, Iterator
from html import unescape
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblake.functions import urls
from weblake.functions.pages import gate_pages
from weblake.html.scraper import Interpreter, field_names, is_plural, validate
from weblake.html.tree import Element, display_text, parse, select, select_one

#: Pages that are parsed and answered at a time.
PAGES = 64
#: Byte order marks, and the encodings whose decoders take them off; that of UTF-32 begins with that of UTF-16.
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
META_FIELDS = ("name", "property", "http-equiv", "itemprop", "content", "charset")


def map_pages(pages: DataFrame, html: str, read: Callable[[Element, dict[str, Any]], dict[str, Any]], schema: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns and what ``read`` returns for each page: {name of schema: value}.

    The page's text is dropped in the task that parses it. ``read`` gets the tree and the kept values.
    """
    names = [x.split(":")[0].strip() for x in _top_level(schema)]
    rows = pages.select(html, *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    full = f"{kept}, {', '.join(x.replace(':', ' ', 1) for x in _top_level(schema))}" if kept else ", ".join(x.replace(":", " ", 1) for x in _top_level(schema))
    types = pages.sparkSession.createDataFrame([], full).toArrow().schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PAGES):
                part = batch.slice(i, PAGES)
                held = [c.to_pylist() for c in part.columns[1:]]
                found = [read(parse(t), {k: v[j] for k, v in zip(keep, held, strict=True)}) for j, t in enumerate(part.column(0).to_pylist())]
                columns = [*part.columns[1:], *(pa.array([f.get(n) for f in found], types.field(n).type) for n in names)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return rows.mapInArrow(run, full)


def _top_level(schema: str) -> list[str]:
    """Fields of a ``name:type, name:type`` schema: parted by commas outside of angle brackets."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _stripped(e: Element | None, attr: str) -> str | None:
    return (e.attrs.get(attr, "").strip() or None) if e is not None else None


def _read_named(root: Element, row: dict[str, Any]) -> dict[str, Any]:
    title = select_one(root, "title")
    return {
        "title": title.text() if title is not None else None,
        "canonical": _stripped(select_one(root, "link[rel=canonical][href]"), "href"),
        "hrefs": [h for a in select(root, "a[href]") if (h := a.attrs["href"].strip())],
        "srcs": [h for a in select(root, "img[src]") if (h := a.attrs["src"].strip())],
        "metas": [{k.replace("-", "_"): m.attrs.get(k) for k in META_FIELDS} for m in select(root, "meta")],
        "feeds": [h for a in select(root, "link[href]") if a.attrs.get("type", "").lower() in ("application/rss+xml", "application/atom+xml") and (h := a.attrs["href"].strip())],
    }


_NAMED = "title:string, canonical:string, hrefs:array<string>, srcs:array<string>, metas:array<struct<name:string,property:string,http_equiv:string,itemprop:string,content:string,charset:string>>, feeds:array<string>"


def named(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One parse per page for all named scrapers: title, canonical, hrefs, srcs, metas, feeds."""
    return map_pages(pages, html, _read_named, _NAMED, keep)


def scrape_title(found: DataFrame) -> DataFrame:
    """One row per page; null without a title. Input: ``named``."""
    return found.select("page_id", "title")


def scrape_canonical(found: DataFrame) -> DataFrame:
    return found.select("page_id", "canonical")


def _links(found: DataFrame, column: str, base: str | None, name: str) -> DataFrame:
    rows = found.select("page_id", *([base] if base else []), F.posexplode(column).alias("place", "raw"))
    rows = rows.where(urls.should_follow_href(F.col("raw")))
    return rows.select("page_id", "place", (urls.url_join(F.col(base), F.col("raw")) if base else F.col("raw")).alias(name))


def scrape_urls(found: DataFrame, base: str | None = "url") -> DataFrame:
    """Links of pages in order, repeats kept, joined with the page's URL; no row for a page without."""
    return _links(found, "hrefs", base, "link")


def scrape_images(found: DataFrame, base: str | None = "url") -> DataFrame:
    return _links(found, "srcs", base, "src")


def scrape_metas(found: DataFrame) -> DataFrame:
    return found.select("page_id", F.posexplode("metas").alias("place", "meta")).select("page_id", "place", "meta.*")


def scrape_rss(found: DataFrame, base: str = "url") -> DataFrame:
    """Declared feeds, and links whose URL looks like a feed."""
    declared = found.select("page_id", base, F.explode("feeds").alias("raw")).select("page_id", urls.url_join(F.col(base), F.col("raw")).alias("feed"))
    linked = scrape_urls(found, base).where(urls.could_be_rss(F.col("link"))).select("page_id", F.col("link").alias("feed"))
    return declared.unionByName(linked)


def page_links(found: DataFrame, base: str = "url", unique: bool = True, strip_fragment: bool = True, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Links to follow, resolved and canonical, once per page: made distinct within the row, without a shuffle."""
    whole = F.transform(F.filter("hrefs", urls.should_follow_href), lambda h: urls.canonicalize_url(urls.url_join(F.col(base), h), strip_fragment=strip_fragment))
    return found.select(*keep, F.explode(F.array_distinct(whole) if unique else whole).alias("link"))


def scrape(pages: DataFrame, definition: dict, html: str = "html", keep: tuple[str, ...] = ("page_id",), context_cols: tuple[str, ...] = ()) -> DataFrame:
    """Rows by a declarative definition, which is checked, and whose schema is derived, before the job starts.

    A definition with an iterator gives a row per item, else a row per page. Values are text (lists and
    nested fields as JSON); a missing selection is null.
    """
    validate(definition)
    names = field_names(definition)
    if names is None:
        raise ValueError("nested fields have no columns; select them as one field")
    plural = is_plural(definition)

    def text(v: Any) -> str | None:
        return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def read(root: Element, row: dict[str, Any]) -> dict[str, Any]:
        value = Interpreter(root, {c: row[c] for c in context_cols}).run(definition)
        items = value if plural else [value]
        return {"items": [[text(v.get(n)) for n in names] if isinstance(v, dict) else [text(v)] for v in items]}

    every = tuple(dict.fromkeys((*keep, *context_cols)))
    rows = map_pages(pages, html, read, "items:array<array<string>>", every)
    rows = rows.select(*keep, F.posexplode("items").alias("place", "item"))
    return rows.select(*keep, "place", *(F.get("item", i).alias(n) for i, n in enumerate(names)))


def scrape_with(pages: DataFrame, function: Callable, schema: str, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A user function (row, parsed page) -> one mapping, or a generator of them; schema: ``name:type, ...``."""
    names = [x.split(":")[0].strip() for x in _top_level(schema)]
    struct = f"array<struct<{','.join(_top_level(schema))}>>"

    def read(root: Element, row: dict[str, Any]) -> dict[str, Any]:
        value = function(row, root)
        return {"items": [{n: v.get(n) for n in names} for v in ([value] if isinstance(value, dict) else value or [])]}

    return map_pages(pages, html, read, f"items:{struct}", keep).select(*keep, F.explode("items").alias("v")).select(*keep, "v.*")


def _own(table: Element, name: str) -> list[Element]:
    """Elements of a table that are in no table inside it."""
    found = []
    for e in table.walk():
        if e.name == name:
            up = e.parent
            while up is not table and up.name != "table":
                up = up.parent
            if up is table:
                found.append(e)
    return found


def _text_outside_tables(cell: Element) -> str:
    """The cell's text without that of tables inside it."""
    said, left = [], list(reversed(cell.children))
    while left:
        node = left.pop()
        if isinstance(node, str):
            said.append(node)
        elif node.name != "table":
            left += reversed(node.children)
    return "".join(said).strip()


def tabulate(pages: DataFrame, selector: str = "table", headers: list[str] | None = None, headers_inference: str | None = "th", html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Rows of tables: place and a map from header (given, from ``th``, or the cell's number) to text.

    A table in a cell is a table of its own: its rows and text are not those of the one around it. Without
    ``headers`` and ``headers_inference`` all cells go by number.
    """

    def read(root: Element, row: dict[str, Any]) -> dict[str, Any]:
        out = []
        for table in select(root, selector):
            names = headers or ([_text_outside_tables(th) for th in _own(table, "th")] if headers_inference == "th" else [])
            for tr in _own(table, "tr"):
                cells = [_text_outside_tables(td) for td in tr.children if isinstance(td, Element) and td.name == "td"]
                if cells:
                    out.append([(names[i] if i < len(names) else str(i), c) for i, c in enumerate(cells)])
        return {"rows": out}

    return map_pages(pages, html, read, "rows:array<map<string,string>>", keep).select(*keep, F.posexplode("rows").alias("place", "cells"))


def display_texts(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return map_pages(pages, html, lambda root, row: {"text": display_text(root)}, "text:string", keep)


def select_text(pages: DataFrame, css: str, target: str = "text", html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``first`` and ``matches`` of a selector: their text, or the attribute ``target``."""

    def read(root: Element, row: dict[str, Any]) -> dict[str, Any]:
        values = [e.text() if target == "text" else e.attrs.get(target) for e in select(root, css)]
        return {"first": values[0] if values else None, "matches": values}

    return map_pages(pages, html, read, "first:string, matches:array<string>", keep)


_CONTENT = "title:string, canonical_url:string, description:string, content:string, comments:string, author:string, categories:array<string>, tags:array<string>, date:string, sitename:string, image:string, pagetype:string"


def _listed(values: list[Any]) -> list[str]:
    """Names of categories or tags: of mappings their name, numbers as text, commas part them."""
    out: list[str] = []
    for v in values:
        v = v.get("name") if isinstance(v, dict) else v
        out += [x.strip() for x in str(v).split(",") if x.strip()] if v is not None else []
    return list(dict.fromkeys(out))


def read_content(root: Element, row: dict[str, Any] | None = None) -> dict[str, Any]:
    metas: dict[str, list[str]] = {}
    for m in select(root, "meta[content]"):
        key = (m.attrs.get("property") or m.attrs.get("name") or "").lower()
        metas.setdefault(key, []).append(m.attrs["content"].strip())
    linked: dict[str, Any] = {}
    for s in select(root, "script[type='application/ld+json']"):
        try:
            data = json.loads(s.text())
        except ValueError:
            continue
        for d in data if isinstance(data, list) else [data]:
            if isinstance(d, dict):
                linked |= d

    def meta(*keys: str) -> str | None:
        return next((v for k in keys for v in metas.get(k, []) if v), None)

    elements = list(root.walk())
    linked_text = dict.fromkeys(map(id, [root, *elements]), 0)  # of the links below each element, summed from the leaves up
    for e in reversed(elements):
        linked_text[id(e.parent)] += linked_text[id(e)] + (len(e.text()) if e.name == "a" else 0)

    def weight(e: Element) -> int:
        """Text of an element's own paragraphs, less twice what its links hold."""
        paragraphs = sum(len(c.text()) for c in e.children if isinstance(c, Element) and c.name in ("p", "pre", "blockquote", "h1", "h2", "h3", "ul", "ol", "b"))
        return paragraphs - 2 * linked_text[id(e)]

    blocks = [e for e in elements if e.name in ("article", "main", "section", "div", "td", "body") and not any(k in e.attrs.get("class", "").lower().split() for k in ("ad", "nav", "menu", "footer", "sidebar"))]
    # Pages may leave out the body tag: then the root holds the paragraphs.
    main = select_one(root, "article") or max([*blocks, root], key=weight)
    author = linked.get("author")
    title = select_one(root, "title")
    return {
        "title": meta("og:title") or (title.text() if title is not None else None),
        "canonical_url": _stripped(select_one(root, "link[rel=canonical][href]"), "href") or meta("og:url"),
        "description": meta("og:description", "description"),
        "content": display_text(main) or None,
        "comments": None,
        "author": meta("author", "article:author") or (author.get("name") if isinstance(author, dict) else author if isinstance(author, str) else None),
        "categories": _listed(metas.get("article:section", [])),
        "tags": _listed(metas.get("article:tag", []) or metas.get("keywords", []) or (linked["keywords"] if isinstance(linked.get("keywords"), list) else [linked.get("keywords")])),
        "date": meta("article:published_time", "date") or (linked.get("datePublished") if isinstance(linked.get("datePublished"), str) else None),
        "sitename": meta("og:site_name"),
        "image": meta("og:image"),
        "pagetype": meta("og:type"),
    }


def extract_content(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Main text and metadata of pages: extract_error and twelve fields.

    Own heuristic: the article element, else the block whose own paragraphs outweigh its links most;
    metadata from Open Graph, meta tags and JSON-LD. Without content, the error is no-trafilatura-result.
    """
    found = map_pages(pages, html, read_content, _CONTENT, keep)
    return found.withColumn("extract_error", F.when(F.col("content").isNull(), "no-trafilatura-result"))


def extract_report(report: DataFrame, html: str = "body", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``extract_content`` of a report's rows that pass the gate; the others stay, unread, with the gate's reason as ``extract_error``."""
    gated = gate_pages(report).withColumn(html, F.when(F.col("gate_error").isNull(), F.col(html)))
    return extract_content(gated, html, (*keep, "gate_error")).withColumn("extract_error", F.coalesce("gate_error", "extract_error")).drop("gate_error")


def blurb(*fields: str):
    """Fields joined by newline, lists by spaces, without empty ones."""
    return F.concat_ws("\n", *(F.when(F.trim(F.concat_ws(" ", f)) != "", F.concat_ws(" ", f)) for f in fields))


def extract_urls(df: DataFrame, column: str, source: str = "text", base: str | None = None) -> DataFrame:
    """A row per URL in a column of text, or per link in a column of HTML; rows without any disappear."""
    if source == "html":
        kept = tuple(c for c in df.columns if c != column)
        rows = map_pages(df, column, lambda root, row: {"hrefs": [a.attrs["href"].strip() for a in select(root, "a[href]")]}, "hrefs:array<string>", kept)
        rows = rows.select(*kept, F.explode("hrefs").alias("found"))
    else:
        rows = df.withColumn("found", F.explode(F.regexp_extract_all(column, F.lit(r"""(?i)\bhttps?://[^\s<>"'\]\)]+"""), F.lit(0))))
        rows = rows.withColumn("found", F.regexp_replace("found", r"[.,;:!?]+$", ""))
    rows = rows.where("trim(found) <> ''")
    return rows.withColumn("extracted_url", urls.url_join(F.col(base), F.col("found")) if base else F.trim("found")).drop("found")


PRESS_NOTE = "Cet article est paru dans"


def _read_press(root: Element, row: dict[str, Any]) -> dict[str, Any]:
    out = []
    for article in select(root, "article"):
        parts = {name: select_one(article, css) for name, css in (("id", ".publiC-lblNodoc"), ("title", ".titreArticle"), ("media", ".DocPublicationName"), ("content", ".docOcurrContainer"))}
        said = {name: e.text() if e is not None else "" for name, e in parts.items()}
        links = select(parts["content"], "a") if parts["content"] is not None else []
        number = said["id"].split("·")
        day = re.fullmatch(r"(\d{4})(\d{2})(\d{2})", number[1]) if len(number) > 1 else None
        out.append(
            {
                "id": said["id"], "title": said["title"], "content": parse(unescape(said["content"])).text(), "url": next((a.attrs.get("href") for a in links if PRESS_NOTE in a.text()), None),
                "date": "-".join(day.groups()) if day else None, "media": re.split(r",|\n| {16}", said["media"])[0].strip(), "media_id": number[2] if len(number) > 2 else None,
            }
        )
    return {"articles": out}


def scrape_press_articles(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Articles of press-database exports: id, title, content, url, date and media id (from the id), media."""
    fields = ("id", "title", "content", "url", "date", "media", "media_id")
    schema = f"articles:array<struct<{','.join(f'{f}:string' for f in fields)}>>"
    return map_pages(pages, html, _read_press, schema, keep).select(*keep, F.posexplode("articles").alias("place", "a")).select(*keep, "place", "a.*")


def decode_body(df: DataFrame, body: str = "body", encoding: str = "encoding", name: str = "text") -> DataFrame:
    """Text of bodies in bytes: by the given encoding, else the one detected in all bytes, else UTF-8; errors are replaced.

    Spark's own decode fails on unknown names, so this is one map; detection runs only where no name
    is known: a byte order mark decides, and is no part of the text; then strict UTF-8 is asked for first,
    unless nulls or escapes hint at another encoding.
    """
    kept = [c for c in df.columns if c != body]
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from charset_normalizer import from_bytes

        def detected(data: bytes) -> str:
            if marked := next((name for mark, name in MARKS if data.startswith(mark)), None):
                return marked
            if b"\0" not in data and b"\x1b" not in data:
                try:
                    data.decode("utf-8")
                    return "utf-8"
                except UnicodeDecodeError:
                    pass
            best = from_bytes(data).best()
            return best.encoding if best is not None else "utf-8"

        for batch in batches:
            for i in range(0, batch.num_rows, PAGES):
                part = batch.slice(i, PAGES)
                out = []
                for data, enc in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if data is not None and not enc:
                        enc = detected(data)
                    try:
                        out.append(None if data is None else data.decode(enc, errors="replace"))
                    except LookupError:
                        out.append(data.decode("utf-8", errors="replace"))
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(out, pa.string())], names=[*kept, name])

    rows = df.select(body, F.col(encoding).alias("encoding to use"), *kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, f"{schema}, {name} string")

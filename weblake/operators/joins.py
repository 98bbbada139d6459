"""Joins: by URL prefix, by key with nulls for misses, along redirects and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblake.functions import urls
from weblake.operators.storage import dropped, stored

def last_write_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last by ``order``."""
    rows = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("row"))
    return rows.select("row.*")


def one_row_each(df: DataFrame, key: str) -> DataFrame:
    """Of rows with one key, the least by all other columns: the same in every run."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*others)).alias("row")).select(key, *(F.col("row")[c].alias(c) for c in others))


def left_join_known(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``. Rows without one match nothing; a salt spreads them, so that they do not meet in one task.

    The salt of ``right`` is -1, but no literal: Spark would take the salt out of the join's keys, and shuffle by ``key`` alone.
    """
    salt = F.when(F.col(key).isNull(), F.monotonically_increasing_id() % 65536).otherwise(F.lit(-1).cast("long"))
    none = F.least(F.lit(-1).cast("long"), F.monotonically_increasing_id())
    return left.withColumn("null salt", salt).join(right.withColumn("null salt", none), [key, "null salt"], "left").drop("null salt")


#: A key with more rows than this, and more than this part of all rows, is hot.
HOT_ROWS, HOT_PARTS = 1000, 1000


def left_join_split(left: DataFrame, right: DataFrame, key: str, counted: DataFrame | None = None) -> DataFrame:
    """Left join on ``key`` with the one row of each key in ``right``, where some keys may have very many rows in ``left``.

    Keys are counted first. The rows of hot ones, at most HOT_PARTS keys, stay where they are and their
    right rows come to them; all other rows are shuffled by key, those without one spread by a salt.
    counted: a table with the same keys that is cheaper to count than ``left``.
    """
    counts = (left if counted is None else counted).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).head()
    if most <= (least := max(HOT_ROWS, total // HOT_PARTS)):
        return left_join_known(left, right, key)
    hot = F.broadcast(counts.where(F.col("n") > least).select(key))
    near = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, "left")
    return near.unionByName(left_join_known(left.join(hot, key, "left_anti"), right, key))


def _chains(entities: DataFrame) -> DataFrame:
    """``stems`` of each entity and its ``chain``: the entities whose stems are a prefix of its own, itself included, shortest first.

    entities: a row per distinct ``stems``, and ``entity``. As many entries as the stems of one entity are.
    """
    prefixes = entities.select("stems", F.explode(F.sequence(F.lit(1), F.size("stems"))).alias("n")).withColumn("prefix", F.slice("stems", F.lit(1), F.col("n")))
    met = left_join_split(prefixes, entities.select(F.col("stems").alias("prefix"), "entity"), "prefix").where("entity is not null")
    return met.groupBy("stems").agg(F.array_sort(F.collect_list(F.struct("n", "entity"))).alias("chain"))


def longest_prefix(rows: DataFrame, stems: Column, entities: DataFrame, name: str) -> DataFrame:
    """``rows`` and ``name``, the entity whose stems are the longest prefix of the row's; null if there is none.

    entities: a row per distinct ``stems`` (not empty), and ``entity``, a struct. In the order of stems, all
    that begin with an entity's stems follow it without a gap. So of a row only the last entity at or
    before it matters: each entity whose stems are a prefix of the row's is one of that entity's own
    prefixes, which it brings along. Rows and entities are sorted together, in ranges; each range begins with the
    last entity of the ranges before. Rows of equal stems have a salt behind them in the order, so that
    a host, a page or a blank URL that half of all rows have is many even ranges: no key gathers rows.
    """
    held = _chains(entities)
    order = ["its stems", "its kind", "its salt"]
    none = F.lit(None).cast(held.schema["chain"].dataType)
    probes = rows.select(stems.alias("its stems"), F.lit(1).alias("its kind"), F.monotonically_increasing_id().alias("its salt"), F.struct(*rows.columns).alias("its row"), none.alias("its chain"))
    marks = held.select(F.col("stems").alias("its stems"), F.lit(0).alias("its kind"), F.lit(0).cast("long").alias("its salt"), F.lit(None).cast(probes.schema["its row"].dataType).alias("its row"), F.col("chain").alias("its chain"))
    ranges = stored(probes.unionByName(marks).repartitionByRange(*order).withColumn("its range", F.spark_partition_id()))
    mark = F.when(F.col("its kind") == 0, F.struct(F.col("its stems").alias("stems"), F.col("its chain").alias("chain")))
    # One row a range.
    edges = ranges.groupBy("its range").agg(F.max_by(mark, F.when(F.col("its kind") == 0, F.struct("its stems"))).alias("mark"))
    before = Window.partitionBy(F.lit(0)).orderBy("its range").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("its range", F.last("mark", ignorenulls=True).over(before).alias("edge"))
    within = Window.partitionBy("its range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = ranges.withColumn("near", F.last(mark, ignorenulls=True).over(within)).where("`its kind` = 1").join(edges, "its range").withColumn("near", F.coalesce("near", "edge"))
    differs = F.array_position(F.zip_with(F.col("near.stems"), F.col("its stems"), lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    alike = F.when(differs > 0, differs - 1).otherwise(F.size("near.stems"))
    found = F.try_element_at(F.filter("near.chain", lambda c: c["n"] <= alike), F.lit(-1))["entity"]
    return near.select("its row.*", F.when(F.col("its stems").isNotNull(), found).alias(name))


def join_by_url(left: DataFrame, left_url: str, right: DataFrame, right_url: str, order: str, select: list[str] | None = None, prefix: str = "", separator: str | None = None) -> DataFrame:
    """Every row of ``right`` once, with the row of ``left`` whose URL is the longest prefix of its own.

    Normalized stems are compared, top level first, so a site also covers its subdomains and pages.
    A cell of ``left`` may hold several URLs; blanks and non-URLs are skipped; of two rows with one key
    the last by ``order`` wins. No match: nulls.
    """
    columns = [c for c in left.columns if select is None or c in select]
    one = left.withColumn("one url", F.explode(F.split(F.col(left_url), rf"\Q{separator}\E")) if separator else F.col(left_url))
    one = one.where(urls.is_url(F.col("one url"))).withColumn("entity stems", urls.normalized_lru(F.col("one url"))).where(F.size("entity stems") > 0)
    entities = one.groupBy(F.col("entity stems").alias("stems")).agg(F.max_by(F.struct(*columns), order).alias("entity"))
    stems = F.when(urls.is_url(F.col(right_url)), urls.normalized_lru(F.col(right_url)))
    joined = longest_prefix(right, stems, entities, "its entity")
    return joined.select(*right.columns, *(F.col("its entity")[c].alias(prefix + c) for c in columns))


def match_webentities(pages: DataFrame, url: str, corpus: DataFrame) -> DataFrame:
    """``pages`` and webentity, status of the entity whose prefix is the longest of the page's URL.

    corpus: ID, STATUS, PREFIXES (URLs parted by spaces); a blank status is IN. Canonical stems that keep
    public suffixes whole are compared, without fragments.
    """
    stems = lambda c: urls.lru(urls.canonicalize_url(c, strip_fragment=True), suffix_aware=True)
    status = F.when(F.trim(F.coalesce("STATUS", F.lit(""))) == "", "IN").otherwise(F.col("STATUS"))
    prefixes = corpus.select(F.col("ID").alias("webentity"), status.alias("status"), F.explode(F.split("PREFIXES", " ")).alias("prefix")).where("prefix <> ''")
    entities = prefixes.withColumn("stems", stems(F.col("prefix"))).where(F.size("stems") > 0).groupBy("stems").agg(F.max_by(F.struct("webentity", "status"), "webentity").alias("entity"))
    found = longest_prefix(pages, F.when(urls.is_url(F.col(url)), stems(F.col(url))), entities, "its entity")
    return found.select(*pages.columns, F.col("its entity.webentity").alias("webentity"), F.col("its entity.status").alias("status"))


def webentity_links(links: DataFrame, corpus: DataFrame, ignore_internal: bool = False) -> DataFrame:
    """source_webentity, target_webentity, source_url, target_url, follow of links between entities that are IN.

    A target is taken through its inferred redirection and must be possible HTML; follow: same entity.
    Each distinct URL is matched once, whether links start or end there.
    """
    inside = links.withColumn("target_url", urls.infer_redirection(F.col("to_url"))).where(urls.could_be_html(F.col("target_url")))
    inside = inside.select("from_url", "target_url")
    every = inside.select(F.explode(F.array("from_url", "target_url")).alias("u")).distinct()
    known = stored(match_webentities(every, "u", corpus).where("status = 'IN'").select("u", "webentity"))
    both = inside.join(known.select(F.col("u").alias("from_url"), F.col("webentity").alias("source_webentity")), "from_url")
    both = both.join(known.select(F.col("u").alias("target_url"), F.col("webentity").alias("target_webentity")), "target_url")
    out = both.select("source_webentity", "target_webentity", F.col("from_url").alias("source_url"), "target_url")
    out = out.withColumn("follow", F.col("source_webentity") == F.col("target_webentity"))
    return out.where("source_webentity <> target_webentity") if ignore_internal else out


def lookup_enrich(df: DataFrame, key: str, lookup: DataFrame, lookup_keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` and columns of the lookup row that has its key under any of the lookup keys; misses give nulls."""
    keyed = lookup.withColumn("lookup key", F.explode(F.array_distinct(F.array_compact(F.array(*(F.col(k).cast("string") for k in lookup_keys))))))
    keyed = keyed.groupBy("lookup key").agg(F.min(F.struct(*columns)).alias("found"))
    bare = F.regexp_replace(F.col(key).cast("string"), "^@", "")
    return df.withColumn("own key", bare).join(keyed, F.col("own key") == F.col("lookup key"), "left").select(*df.columns, *(F.col(f"found.{c}").alias(c) for c in columns))


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key), key, "left_anti").select(*df.columns)


REDIRECT_STATUS = (301, 302, 303, 307, 308)


def next_hops(hops: DataFrame, follow_refresh: bool = True, follow_meta: bool = True, follow_js: bool = True) -> DataFrame:
    """url, status, next, kind, canonical: where the answer to each URL leads, by status, refresh header, meta tag or script.

    hops: url, status, location, refresh, body. ``kind`` is hit, location-header, refresh-header, meta-refresh or
    js-relocation; a redirect status without a location has the second and no ``next``. ``canonical`` is
    the link of a hit's page, joined with its URL, unless that is the URL.
    """
    from weblake.functions.pages import http_refresh, js_location, meta_refresh, regex_canonical

    moved = F.col("status").isin(*REDIRECT_STATUS)
    fine = ~moved & (F.col("status") < 400)
    none = F.lit(None).cast("string")
    ways = [
        ("refresh-header", F.when(fine, http_refresh(F.col("refresh"))["url"]) if follow_refresh else none),
        ("meta-refresh", F.when(fine, meta_refresh(F.col("body"))["url"]) if follow_meta else none),
        ("js-relocation", F.when(fine, js_location(F.col("body"))) if follow_js else none),
    ]
    way = F.coalesce(F.when(moved, F.struct(F.lit("location-header").alias("kind"), F.when(F.trim("location") != "", F.trim("location")).alias("to"))), *(F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), F.trim(v).alias("to"))) for k, v in ways))
    link = regex_canonical(F.col("body"))
    rows = hops.select("url", "status", way.alias("way"), F.when(link != F.col("url"), urls.url_join(F.col("url"), link)).alias("canonical"))
    kind = F.coalesce("way.kind", F.lit("hit"))
    return rows.select("url", "status", urls.url_join(F.col("url"), F.col("way.to")).alias("next"), kind.alias("kind"), F.when(kind == "hit", F.col("canonical")).alias("canonical"))


def _inferred(url: Column) -> Column:
    """The URL, what it carries as its target, what that carries, and so on, until nothing is carried."""
    step = lambda acc, _: F.concat(acc, F.filter(F.array(urls.infer_redirection(F.element_at(acc, -1), recursive=False)), lambda u: u != F.element_at(acc, -1)))
    return F.array_distinct(F.aggregate(F.sequence(F.lit(1), F.size(F.split(url, "(?i)http"))), F.array(url), step))


def resolve_redirects(
    start: DataFrame, hops: DataFrame, max_redirects: int = 20, infer: bool = True, canonicalize: bool = False, follow_refresh: bool = True, follow_meta: bool = True, follow_js: bool = True
) -> DataFrame:
    """Follows each ``url`` of ``start`` through a table of recorded answers.

    Returns url, resolved_url (the last URL reached), http_status, resolution_error, redirect_count and
    redirect_chain (the kinds of its URLs: see ``next_hops``; also ``infer``, a URL that carries its target and is
    not asked for, and ``canonical``, the link of the page at the end, with ``canonicalize``). At most
    ``max_redirects`` URLs are visited, those inferred included. Errors, whose chain and URL are those
    of what was visited: infinite-redirects (a URL comes up again), self-redirect, invalid-redirect (no location),
    max-redirects, not-recorded. Null URLs are left out; of several answers to a URL the least counts.

    All URLs and what they carry are numbered first; each leads to one other. Paths then double: a
    URL's next 2n URLs are its next n and those of the URL after, so log2(max_redirects) joins do, by number,
    of the URLs whose paths go on. A URL to which very many lead is no single task.
    """
    asked = next_hops(one_row_each(hops.where(F.col("url").isNotNull()), "url"), follow_refresh, follow_meta, follow_js)
    asked = stored(asked)
    said = start.select("url").unionByName(asked.select("url")).unionByName(asked.select(F.col("next").alias("url"))).where("url is not null")
    every = said.select(F.explode(_inferred(F.col("url"))).alias("url")) if infer else said
    target = F.when(F.lit(infer), F.nullif(urls.infer_redirection(F.col("url"), recursive=False), F.col("url")))
    nodes = every.distinct().withColumn("carried", target).join(asked, "url", "left")
    unasked = lambda c: F.when(F.col("carried").isNull(), F.col(c)).alias(c)
    nodes = nodes.select("url", F.coalesce("carried", "next").alias("next"), F.when(F.col("carried").isNotNull(), "infer").otherwise(F.col("kind")).alias("kind"), unasked("status"), unasked("canonical"))
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()))
    self_ = F.col("next") == F.col("url")
    onward = nodes.select("id", "kind", F.when(~self_, F.col("next")).alias("next"))
    onward = left_join_split(onward, nodes.select(F.col("url").alias("next"), F.col("id").alias("onto")), "next")
    paths = stored(onward.select("id", F.array("id").alias("path"), F.array("kind").alias("kinds"), "onto"))
    for _ in range(max(0, max_redirects - 1).bit_length()):
        more = paths.where("onto is not null")
        if more.isEmpty():
            break
        after = paths.select(F.col("id").alias("onto"), F.col("path").alias("more path"), F.col("kinds").alias("more kinds"), F.col("onto").alias("more onto"))
        longer = left_join_split(more, after, "onto").select("id", F.concat("path", "more path").alias("path"), F.concat("kinds", "more kinds").alias("kinds"), F.col("more onto").alias("onto"))
        longer = stored(longer.unionByName(paths.where("onto is null")))
        dropped(paths)
        paths = longer
    visited = F.slice("path", 1, max_redirects)
    # The first number that stands in the path before: all paths are short.
    again = F.array_position(F.transform(visited, lambda x, i: F.array_contains(F.slice(visited, F.lit(1), i), x)), True)
    ends = paths.select("id", "path", "kinds", "onto", again.alias("again"))
    n = F.when(F.col("again") > 0, F.col("again") - 1).otherwise(F.least(F.size("path"), F.lit(max_redirects))).cast("int")
    ends = ends.withColumn("n", n)
    more = (F.col("n") < F.size("path")) | F.col("onto").isNotNull()
    ends = ends.select(
        "id", F.element_at("path", F.col("n")).alias("last"), F.array_compact(F.slice("kinds", F.lit(1), F.col("n"))).alias("chain"),
        F.when(F.col("again") > 0, "infinite-redirects").when(more, "max-redirects").alias("error"),
    )
    at_end = nodes.select(F.col("id").alias("last"), F.col("url").alias("at"), "status", "kind", "next", "canonical")
    known = left_join_split(start.select("url").where("url is not null").distinct().join(nodes.select("url", "id"), "url").join(ends, "id"), at_end, "last")
    broken = F.when(F.col("kind").isNull(), "not-recorded").when(F.col("next") == F.col("at"), "self-redirect").when((F.col("kind") != "hit") & F.col("next").isNull(), "invalid-redirect")
    known = known.withColumn("error", F.coalesce("error", broken))
    canonical = F.when(F.lit(canonicalize) & F.col("error").isNull(), F.col("canonical"))
    chain = F.when(canonical.isNotNull(), F.array_append("chain", F.lit("canonical"))).otherwise(F.col("chain"))
    hits = F.when(F.array_contains("chain", "hit"), 1).otherwise(0)
    return known.select(
        "url", F.coalesce(canonical, "at").alias("resolved_url"), F.col("status").alias("http_status"), F.col("error").alias("resolution_error"), (F.size(chain) - hits).alias("redirect_count"), chain.alias("redirect_chain")
    )


def attach_referenced(tweets: DataFrame, users: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """Tweets with their user's name, their quoted and their retweeted tweet's text and user, and an error if one is missing.

    tweets: id, user_id, quoted_id, retweeted_id, text; users: user_id, name. Referenced tweets come
    from ``originals`` (default: the tweets themselves), one row per id. An id that very many tweets refer to is
    no single task.
    """
    tweets = stored(tweets)
    base = one_row_each((tweets if originals is None else originals).select("id", "user_id", "text"), "id")
    users = one_row_each(users.select("user_id", "name"), "user_id")
    named = stored(left_join_split(base, users, "user_id").select("id", "text", "name"))
    out = left_join_split(tweets, users, "user_id", tweets)
    for kind in ("quoted", "retweeted"):
        other = named.select(F.col("id").alias(f"{kind}_id"), F.col("text").alias(f"{kind}_text"), F.col("name").alias(f"{kind}_user"), F.lit(True).alias(f"{kind} found"))
        out = left_join_split(out, other, f"{kind}_id", tweets)
    error = F.when(F.col("name").isNull(), "user-not-found")
    for kind in ("quoted", "retweeted"):
        error = error.when(F.col(f"{kind}_id").isNotNull() & F.col(f"{kind} found").isNull(), f"{kind}-not-found")
    return out.withColumn("error", error).drop("quoted found", "retweeted found")


def tweet_attrition(tweets: DataFrame, tweet_lookup: DataFrame, user_lookup: DataFrame, retweet_lookup: DataFrame, ids: bool = True) -> DataFrame:
    """``tweets`` and current_tweet_status, by stored replies of the service.

    tweets: tweet_id, user_id, retweeted_id. Lookups: the id and the reply's http status and error code,
    both null if it was found.
    """
    reply = lambda df, key, name: df.select(key, F.struct("status", "code").alias(name))
    replies = left_join_known(left_join_known(tweets, reply(tweet_lookup, "tweet_id", "of tweet"), "tweet_id"), reply(user_lookup, "user_id", "of user"), "user_id")
    replies = left_join_known(replies, reply(retweet_lookup.withColumnRenamed("tweet_id", "retweeted_id"), "retweeted_id", "of original"), "retweeted_id")

    def said(name: str, table: dict[tuple[int, int], str], found: str) -> Column:
        r = F.col(name)
        out = F.when(r.isNotNull() & r["code"].isNull() & r["status"].isNull(), found)
        for (status, code), word in table.items():
            out = out.when((r["status"] == status) & (r["code"] == code), word)
        return out

    own = {(403, 63): "suspended_user", (403, 179): "protected_user", (404, 144): "user_or_tweet_deleted", (404, 34): "user_or_tweet_deleted", (404, 421): "censored_tweet", (404, 422): "censored_tweet", (401, 136): "blocked_by_tweet_author"}
    original = {(403, 63): "suspended_retweeted_user", (403, 179): "protected_retweeted_user", (404, 144): "unavailable_retweeted_tweet", (404, 34): "unavailable_retweeted_tweet", (404, 421): "censored_retweeted_tweet", (404, 422): "censored_retweeted_tweet", (401, 136): "blocked_by_original_tweet_author"}
    # The tweet's own reply decides, unless it is missing or says deleted: then the user's, then the original's.
    first = said("of tweet", own, "available_tweet")
    user = F.when((F.col("of user.status") == 404) & (F.col("of user.code") == 50), "deactivated_user" if ids else "deactivated_or_renamed_user").otherwise("unavailable_tweet")
    second = F.when((first.isNull() | (first == "user_or_tweet_deleted")) & F.col("user_id").isNotNull(), user).otherwise(first)
    third = F.when((second.isNull() | (second == "unavailable_tweet")) & F.col("retweeted_id").isNotNull(), F.coalesce(said("of original", original, "unavailable_retweet"), second)).otherwise(second)
    return replies.withColumn("current_tweet_status", F.coalesce(third, F.lit("unavailable_tweet"))).select(*tweets.columns, "current_tweet_status")

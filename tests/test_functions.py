import datetime
import os

import pytest
from pyspark.sql import functions as F

from weblake.functions import pages, text, urls
from weblake.operators import frontier, tables
from weblake.operators.tables import numbered_by
from weblake.streaming import streams


def value(spark, given, function):
    rows = [(i, g) for i, g in enumerate(given if isinstance(given, list) else [given])]
    out = [r[0] for r in spark.createDataFrame(rows, "i int, c string").orderBy("i").select(function(F.col("c"))).collect()]
    return out if isinstance(given, list) else out[0]


def test_equal_urls(spark):
    same = ["lemonde.fr", "www.lemonde.fr", "https://www.lemonde.fr/index.html", "http://m.lemonde.fr/?utm_source=x#top", " https://lemonde.fr:443/ "]
    assert set(value(spark, same, urls.normalize_url)) == {"lemonde.fr"}
    assert value(spark, "https://www.lemonde.fr/articles/one.html", urls.normalize_url) == "lemonde.fr/articles/one.html"
    assert value(spark, "http://a.org/x/?b=2&a=1&xtor=3#/r/1", urls.normalize_url) == "a.org/x?a=1&b=2#/r/1"
    assert value(spark, "http://u:p@A.org./b/../c/./d?url=1", lambda c: urls.canonicalize_url(c)) == "http://u:p@a.org/c/d?url=1"
    assert value(spark, "http://a.org/%7Eme/%2Fx", urls.canonicalize_url) == "http://a.org/~me/%2Fx"
    once = value(spark, same + ["http://a.org/%2541", "a.org/b/?q=%26"], urls.normalize_url)
    assert value(spark, once, urls.normalize_url) == once


def test_hosts(spark):
    given = ["http://www.co.bbc.co.uk/x", "fr.wikipedia.org", "http://127.0.0.1/", "localhost", None, ""]
    assert value(spark, given, urls.get_domain_name) == ["bbc.co.uk", "wikipedia.org", None, None, None, None]
    assert value(spark, given[:2], lambda c: urls.get_fingerprinted_hostname(c, True)) == ["co.bbc", "wikipedia"]


@pytest.mark.parametrize(("ref", "joined"), [("http://x.y/z", "http://x.y/z"), ("//x.y", "http://x.y"), ("/p?q", "http://a.b/p?q"), ("?q", "http://a.b/c/d?q"), ("#f", "http://a.b/c/d?e#f"), ("g/../h", "http://a.b/c/h"), ("../../h", "http://a.b/h"), ("", "http://a.b/c/d?e"), ("mailto:x", "mailto:x")])
def test_url_join(spark, ref, joined):
    assert value(spark, ref, lambda c: urls.url_join(F.lit("http://a.b/c/d?e#o"), c)) == joined


def test_platform_urls(spark):
    assert value(spark, "https://www.facebook.com/groups/12/permalink/34/", lambda c: urls.parse_facebook_url(c)["full_id"]) == "12_34"
    assert value(spark, "https://www.youtube.com/shorts/abcdefghijk", lambda c: urls.parse_youtube_url(c)["type"]) == "short"
    assert value(spark, ["https://x.com/Jack", "https://x.com/search", "https://a.org/b"], lambda c: urls.parse_twitter_url(c)["screen_name"]) == ["jack", None, None]
    assert value(spark, ["https://t.me/s/some_chan", "some_chan", "https://t.me/joinchat/x"], urls.telegram_public_url) == ["https://t.me/s/some_chan"] * 2 + [None]
    assert value(spark, "abcdef", lambda c: urls.apply_template("x/{value:1:3}/{value}", c)) == "x/bc/abcdef"


def test_lru(spark):
    assert value(spark, "http://www.a.co.uk:80/b/c?q=1#f", lambda c: urls.lru(c, suffix_aware=True)) == ["s:http", "h:co.uk", "h:a", "h:www", "t:80", "p:b", "p:c", "q:q=1", "f:f"]


@pytest.mark.parametrize(("given", "low", "high"), [("2020", "2020-01-01T00:00:00", "2020-12-31T23:59:59.999999"), ("2020-02", "2020-02-01T00:00:00", "2020-02-29T23:59:59.999999"), ("2021-02-28T10", "2021-02-28T10:00:00", "2021-02-28T10:59:59.999999"), ("2021-01-01T10:11:12Z", "2021-01-01T10:11:12", "2021-01-01T10:11:12.999999"), ("2021-01-01T10:11:12.345678", "2021-01-01T10:11:12.345678", "2021-01-01T10:11:12.345678")])
def test_partial_dates(spark, given, low, high):
    ntz = lambda upper: lambda c: text.parse_partial_iso(c, upper).cast("timestamp_ntz")
    assert value(spark, given, ntz(False)) == datetime.datetime.fromisoformat(low)
    assert value(spark, given, ntz(True)) == datetime.datetime.fromisoformat(high)
    assert value(spark, ["2021-13", "20", "x", None], ntz(False)) == [None] * 4


def test_numbers_and_codes(spark):
    assert value(spark, ["1.2K", "3M likes", "1,234", "none", "5,5K"], text.clean_human_number) == ["1200", "3000000", "1234", "none", "5500"]
    assert value(spark, ["BAQ", "A", "CD_-"], lambda c: text.id_to_shortcode(text.shortcode_to_id(c))) == ["BAQ", "A", "CD_-"]
    assert value(spark, ["5 comments", "comment", "1 comment"], text.comment_count) == [5, 0, 1]
    assert value(spark, ["\\u00e9", 'a"b', "x"], text.fix_ascii_json) == ["é", 'a"b', "x"]


def test_bytes_and_headers(spark):
    canonical = ['<link rel="canonical" href="x">', "<LINK href=y rel=canonical>", "<link rel=canonical href=''>", "<link rel=other href=x>", "<link rel='canonical' href='a b'/>"]
    assert value(spark, canonical, pages.regex_canonical) == ["x", "y", None, None, "a b"]
    assert value(spark, ["5; url=http://x", "0;URL='http://y'", "5", "x; url=z"], lambda c: pages.http_refresh(c)["url"]) == ["http://x", "http://y", None, None]
    assert value(spark, ["utf-8", "ISO-8859-1", "what", "Latin 1"], pages.is_supported_encoding) == [True, True, False, True]
    assert value(spark, ["text/html", "image/png", "application/json"], text.is_binary_mimetype) == [False, True, False]


def test_file_names(spark):
    assert value(spark, ["name.pdf", "name", None], lambda c: text.page_filename(F.lit("u"), c, F.lit(".html"), True)) == ["name.pdf.gz", "name.html.gz", "7b774effe4a349c6dd82ad4f4f21d34c.html.gz"]
    assert value(spark, "http://a.org/b/c.html", lambda c: text.folder_path(F.lit("f.html"), c, "fullpath")) == "a.org/b/f.html"
    assert value(spark, "x:", lambda c: text.folder_path(F.lit("f"), F.lit(None).cast("string"), "hostname")) == "unknown-host/f"


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None), (2, [], "x\0y")], "id int, tags array<string>, t string")
    tables.write_table(df, f"{tmp_path}/csv")
    back = sorted(map(tuple, tables.read_table(spark, f"{tmp_path}/csv").collect()))
    assert back == [("1", "a|b", None), ("2", None, "xy")]
    (tmp_path / "p").mkdir()
    import gzip

    (tmp_path / "p/a.html").write_bytes(b"<p>")
    (tmp_path / "p/b.html.gz").write_bytes(gzip.compress(b"<b>"))
    assert {bytes(r.body) for r in tables.read_page_files(spark, f"{tmp_path}/p").collect()} == {b"<p>", b"<b>"}


def test_throttled_stream_equals_a_loop(spark, tmp_path):
    from weblake.jobs.stream_jobs import drained

    rows = [(i, None if i % 9 == 0 else f"g{i % 3}", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i // 4)) for i in range(120)]
    df = spark.createDataFrame(rows, "index long, g string, ts timestamp")
    got = {r["index"]: r.release for r in drained(df, lambda s: streams.stream_throttled_frontier(s, "g", "index", "ts", 2.0, 2)).collect()}
    free = {}
    for i, g, ts in rows:
        at = ts.replace(tzinfo=datetime.timezone.utc).timestamp()
        if g is None:
            assert got[i] == at
            continue
        slots = free.setdefault(g, [0.0, 0.0])
        k = slots.index(min(slots))
        start = max(at, slots[k])
        slots[k] = start + 2.0
        assert got[i] == start


def test_throttled_stream_with_a_watermark_ends_states(spark, tmp_path):
    # Three batches, each an hour later: the second's watermark has passed every slot of the first, whose state ends.
    hours = [[(1, "a", 10), (2, "a", 11), (3, "a", 11), (4, None, 11)], [(5, "b", 3600), (6, "b", 3600), (7, "b", 3600)], [(8, "a", 7200), (9, "a", 7200), (10, "a", 7200)]]
    schema = "index long, g string, ts timestamp"
    for n, rows in enumerate(hours):
        df = spark.createDataFrame([(i, g, datetime.datetime.fromtimestamp(t, datetime.timezone.utc)) for i, g, t in rows], schema)
        df.coalesce(1).write.parquet(f"{tmp_path}/raw{n}")
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        part = next((tmp_path / f"raw{n}").glob("*.parquet"))
        part.rename(folder / f"{n}.parquet")
        os.utime(folder / f"{n}.parquet", (1_000_000 + n, 1_000_000 + n))
    stream = streams.read_stream(spark, str(tmp_path / "in"), schema, 1)
    released = streams.stream_throttled_frontier(stream, "g", "index", "ts", 2.0, 2, watermark="10 minutes")
    run = released.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["index"]: r.release for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 10.0, 2: 11.0, 3: 12.0, 4: 11.0, 5: 3600.0, 6: 3600.0, 7: 3602.0, 8: 7200.0, 9: 7200.0, 10: 7202.0}
    removed = sum(s["numRowsRemoved"] for p in run.recentProgress for s in p["stateOperators"])
    assert removed >= 1


def test_hot_and_null_keys_of_dedupe_and_places(spark):
    rows = [(None, 1, "x"), (None, 0, "y"), ("k", None, "first"), ("k", 1, "z"), ("k", 1, "z")]
    df = spark.createDataFrame(rows, "nth string, n int, word string")
    assert sorted((r.nth or "", r.word) for r in frontier.dedupe_by_id(df, "nth", "n").collect()) == [("", "y"), ("k", "first")]
    spread = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 50)) AS g", "id % 7 AS p", "id")
    places = numbered_by(spread, ["p", "id"], "place", start=1, within=("g",)).collect()
    by_group = {}
    for r in sorted(places, key=lambda r: (r.p, r.id)):
        by_group.setdefault(r.g, []).append(r.place)
    assert len(places) == 3000 and all(v == list(range(1, len(v) + 1)) for v in by_group.values())

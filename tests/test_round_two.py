import pytest
from pyspark.sql import functions as F
from weblake.functions import pages, urls
from weblake.html import scraper
from weblake.html.tree import parse, select
from weblake.operators import frontier, html, joins, storage


def test_implied_ends_reach_past_deep_nesting():
    deep = "<ul><li>one" + "<b>" * 600 + "x" + "<li>two</ul><p>a" + "<i>" * 500 + "<p>b"
    root = parse(deep)
    assert len(select(root, "ul > li")) == 2 and [len(select(p, "p")) for p in select(root, "p")] == [0, 0]


def test_positions_among_siblings():
    root = parse("<ul>" + "".join(f"<li id=l{i}>{i}</li> text " for i in range(2000)) + "</ul>")
    assert [e.attrs["id"] for e in select(root, "li:nth-child(1000n)")] == ["l999", "l1999"]
    assert [e.attrs["id"] for e in select(root, "li:first-child, li:last-child")] == ["l0", "l1999"]
    assert [e.attrs["id"] for e in select(root, "#l4 + li")] == ["l5"] and len(select(root, "#l4 ~ li")) == 1995


PEOPLE = "<table><thead><tr><th>Town</th><th>River</th></tr></thead><tbody><tr><td>Lyon</td><td>Saône</td></tr><tr><td>Bonn</td><td>Rhein</td><td>more</td></tr></tbody></table>"


def test_tables_in_definitions(spark):
    run = lambda d: scraper.Interpreter(parse(PEOPLE)).run(d)
    assert run({"sel": "table", "tabulate": True}) == [{"Town": "Lyon", "River": "Saône"}, {"Town": "Bonn", "River": "Rhein", "2": "more"}]
    assert run({"sel": "table", "tabulate": {"headers": ["a", "b"]}})[0] == {"a": "Lyon", "b": "Saône"}
    assert run({"sel": "table", "tabulate": {"headers_inference": None}}) == [["Lyon", "Saône"], ["Bonn", "Rhein", "more"]]
    assert run({"sel": "tr", "tabulate": True}) is None
    for bad in ({"tabulate": {"x": 1}}, {"tabulate": True, "attr": "id"}, {"tabulate": "yes"}):
        with pytest.raises(scraper.InvalidDefinition):
            scraper.validate(bad)
    page = spark.createDataFrame([(1, PEOPLE)], "page_id int, html string")
    assert html.scrape(page, {"sel": "table", "tabulate": True}).first().value.startswith('[{"Town": "Lyon"')


def test_encodings():
    """Every name is one that Python decodes by, however it is parted; made-up ones are none."""
    import codecs

    assert {"utf8", "l1", "latin1", "cp1252", "windows1252", "shiftjis", "sjis2004", "koi8r", "big5hkscs", "usascii", "utf8sig", "iso885915", "mackintosh".replace("k", "", 1), "ujis", "646"} <= set(pages.ENCODINGS)
    assert not {"utf88591", "nope", "base64", "rot13", "idna", "punycode", "unicodeescape", ""} & set(pages.ENCODINGS)
    assert all(n == n.lower() and not set(n) & set(" -_") for n in pages.ENCODINGS) and codecs.lookup("l1").name == "iso8859-1"


def test_redirections_of_any_depth(spark):
    from urllib.parse import quote

    target = "https://end.org/x"
    nested = target
    for i in range(7):
        nested = f"https://s{i}.org/?url=" + quote(nested, safe="")
    df = spark.createDataFrame([(nested,), (target,), (None,), ("https://www.youtube.com/redirect?v=1&q=" + quote(target, safe=""),)], "u string")
    assert [r.t for r in df.select(urls.infer_redirection(F.col("u")).alias("t")).collect()] == [target, target, None, target]


def test_threads_of_forty_levels_keep_all_rows(spark):
    rows = [("p", i, i - 1 if i else None, i) for i in range(40)] + [("p", 100, 99, 1), ("q", 1, 2, 1), ("q", 2, 1, 1)]
    got = frontier.thread_order(spark.createDataFrame(rows, "post string, id int, up int, at int"), "post", "id", "up", "at").collect()
    assert len(got) == len(rows) and [r.depth for r in sorted(got, key=lambda r: r.position or 0) if r.error is None] == list(range(40))


def test_politeness_counts_on_over_ranges(spark):
    rows = [(i, "todo", i % 3, "hot" if i % 4 else "g%d" % i) for i in range(3000)] + [(9999, "done", 0, "hot"), (9998, "todo", 0, None)]
    got = frontier.politeness_plan(spark.createDataFrame(rows, "index int, status string, priority int, group string"), parallelism=2).collect()
    hot = sorted((r.priority, r["index"], r.batch) for r in got if r.group == "hot")
    assert [b for *_, b in hot] == [i // 2 for i in range(len(hot))] and len(got) == 3001


def test_rows_without_keys_stay(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("z", 3)] + [(None, i) for i in range(10, 60)], "k string, n int")
    right = spark.createDataFrame([("a", "A"), (None, "never")], "k string, v string")
    got = joins.left_join_known(left, right, "k").collect()
    assert len(got) == 53 and [r.v for r in got if r.v] == ["A"]


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        getConf = Conf

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        storage.shared_folder(Session())

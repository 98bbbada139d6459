import pytest

from weblake.html.scraper import Interpreter, InvalidDefinition, field_names, is_plural, validate
from weblake.html.tree import SelectorError, compiled, display_text, parse, select, select_one
from weblake.operators.html import extract_report

LIST = "<ol><li id=li1>Oslo<li id=li2 class='x y'>Lima <b>south</ol><ol><li>Quito</ol>"


def run(definition, html, **context):
    validate(definition)
    return Interpreter(parse(html), context).run(definition)


@pytest.mark.parametrize(
    ("selector", "texts"),
    [
        ("li", ["Oslo", "Lima south", "Quito"]), ("#li2", ["Lima south"]), ("li.x", ["Lima south"]), ("[id='li1']", ["Oslo"]), ("[id^=li]", ["Oslo", "Lima south"]), ("[id$='2'], b", ["Lima south", "south"]),
        ("ol > li:nth-child(1)", ["Oslo", "Quito"]), ("li:nth-child(2n)", ["Lima south"]), ("li:has(b)", ["Lima south"]), ("li:not([id])", ["Quito"]), ("li:contains('Qui')", ["Quito"]), ("#li1 + li b", ["south"]), ("*[id*=i1]", ["Oslo"]),
    ],
)
def test_selectors(selector, texts):
    assert [e.text() for e in select(parse(LIST), selector)] == texts


@pytest.mark.parametrize("selector", ["", "li >", ":wrong", "[", "li:nth-child(x)", "a:not(b"])
def test_bad_selectors(selector):
    with pytest.raises(SelectorError):
        compiled(selector)


def test_scraper_values():
    assert run({"iterator": "li"}, LIST) == ["Oslo", "Lima south", "Quito"]
    assert run({"$$": "li", "attr": "id"}, LIST) == ["li1", "li2", None]
    assert run({"iterator": "li", "item": "id", "filter": True}, LIST) == ["li1", "li2"]
    assert run({"iterator": "li", "fields": {"id": "id", "text": "text"}, "uniq": "id", "filter": "id"}, LIST) == [{"id": "li1", "text": "Oslo"}, {"id": "li2", "text": "Lima south"}]
    assert run({"sel": "#none"}, LIST) is None and run({"sel": "#none", "iterator": "li"}, LIST) == []
    assert run({"sel": "li", "attr": "no", "default": "d"}, LIST) == "d"
    assert run({"$": "#li2", "extract": "inner_html"}, LIST) == "Lima <b>south</b>"
    assert run({"iterator": "ol", "item": {"iterator": "li", "item": "text"}}, LIST) == [["Oslo", "Lima south"], ["Quito"]]


def test_scraper_context_and_hooks():
    inner = {"iterator": "li", "fields": {"t": "text", "f": {"get_context": "first"}}}
    assert run({"iterator": "ul", "set_context": {"first": {"sel": "li"}}, "item": inner}, "<ul><li>a<li>b</ul><ul><li>c</ul>") == [[{"t": "a", "f": "a"}, {"t": "b", "f": "a"}], [{"t": "c", "f": "c"}]]
    assert run({"sel": "li", "eval": lambda element, value, context, root: value.upper() + context["c"]}, LIST, c="!") == "OSLO!"
    assert run({"iterator_eval": lambda element, value, context, root: "b", "item": "text"}, LIST) == ["south"]
    assert run({"iterator": "li", "filter_eval": lambda element, value, context, root: len(value) > 4}, LIST) == ["Lima south", "Quito"]


@pytest.mark.parametrize(
    "definition",
    [{"what": 1}, {"sel": "a", "$": "b"}, {"item": "text", "fields": {}}, {"extract": "nothing"}, {"sel": "li >"}, {"sel": "li", "uniq": True}, {"eval": "1 + 1"}, {"fields": {"a": {"wrong": 1}}}, 3],
)
def test_bad_definitions(definition):
    with pytest.raises(InvalidDefinition):
        validate(definition)


def test_derived_columns():
    assert field_names({"iterator": "li"}) == ["value"] and field_names({"fields": {"a": "text", "b": "id"}}) == ["a", "b"]
    assert field_names({"iterator": "li", "item": {"fields": {"a": "text"}}}) == ["a"] and field_names({"fields": {"a": {"fields": {}}}}) is None
    assert is_plural({"$$": "li"}) and not is_plural({"sel": "li"})


def test_display_text():
    html = "<section>Rain over\n  the harbour<section>Boats <i>left</i>, none <u>came</u> back.<h3>Tides</h3><p> High <br>water </p><p>Low</p><pre>  kept\n as is</pre><ol><li>north</li><li>south</li></ol><style>no</style></section></section>"
    assert display_text(parse(html)) == "Rain over the harbour\nBoats left, none came back.\n\nTides\n\nHigh\nwater\n\nLow\n\n  kept\n as is\n\nnorth\nsouth"
    assert display_text(parse("")) == ""


def test_damaged_pages():
    assert select_one(parse("<p>a<p>b<td>c"), "p").text() == "a"
    assert parse("<div><b>x</div></span>").text() == "x" and parse(None).text() == "" and parse("<![CDATA[x]]>").text() in ("x", "")
    deep = "<div>" * 30_000 + "x"
    assert parse(deep).text() == "x" and display_text(parse(deep)) == "x"


def test_report_rows_that_the_gate_turns_away_stay(spark):
    rows = [(1, "200", "<p>said</p>"), (2, "404", "<p>not read</p>"), (3, "200", None), (4, "200", "<i></i>")]
    got = extract_report(spark.createDataFrame(rows, "page_id long, http_status string, body string")).select("page_id", "content", "extract_error").collect()
    assert sorted(map(tuple, got)) == [(1, "said", None), (2, None, "invalid-status"), (3, None, "no-path-nor-body"), (4, None, "no-trafilatura-result")]

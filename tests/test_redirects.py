import random

from weblake.operators import joins

HOPS = "url string, status int, location string, refresh string, body string"


def walked(url, table, limit, carried):
    """One URL after another, as a client asks for them."""
    seen, chain = [], []
    for _ in range(limit):
        if url in seen:
            return seen[-1], "infinite-redirects", chain
        seen.append(url)
        if url in carried:
            chain.append("infer")
            url = carried[url]
            continue
        if url not in table:
            return url, "not-recorded", chain
        target = table[url]
        if target is None:
            return url, None, [*chain, "hit"]
        chain.append("location-header")
        if target == "":
            return url, "invalid-redirect", chain
        if target == url:
            return url, "self-redirect", chain
        url = target
    return seen[-1], "max-redirects", chain


def test_paths_equal_walks(spark):
    random.seed(11)
    names = [f"https://n{k}.example.org/" for k in range(120)]
    carried = {f"https://go.example.org/?n={k}&url=https%3A%2F%2Fn{k * 7 % 120}.example.org%2F": names[k * 7 % 120] for k in range(40)}
    table = {u: random.choice([None, "", u, *random.choices(names, k=6), *random.choices(list(carried), k=3)]) for u in names[:100]}
    for k in range(30):
        table[f"https://chain{k}.example.org/"] = f"https://chain{k + 1}.example.org/" if k < 29 else None
    rows = [(u, 200 if t is None else 302, t, None, "") for u, t in table.items()]
    hops = spark.createDataFrame(rows, HOPS)
    start = spark.createDataFrame([(u,) for u in [*table, *carried, "https://nowhere.example.org/", None, names[0]]], "url string")
    for limit in (1, 2, 5, 7, 20):
        got = {r["url"]: (r["resolved_url"], r["resolution_error"], r["redirect_chain"]) for r in joins.resolve_redirects(start, hops, limit).collect()}
        assert len(got) == len(table) + len(carried) + 1
        assert got == {u: walked(u, table, limit, carried) for u in got}


def test_as_many_urls_as_allowed(spark):
    hops = spark.createDataFrame([(f"https://a{k}.org/", 301 if k < 5 else 200, f"https://a{k + 1}.org/" if k < 5 else None, None, "") for k in range(6)], HOPS)
    start = spark.createDataFrame([("https://a0.org/",)], "url string")
    assert joins.resolve_redirects(start, hops, 5).first()["resolution_error"] == "max-redirects"
    found = joins.resolve_redirects(start, hops, 6).first()
    assert (found["resolution_error"], found["redirect_count"], found["http_status"], found["redirect_chain"]) == (None, 5, 200, ["location-header"] * 5 + ["hit"])


def test_switches_and_kinds(spark):
    rows = [
        ("https://r.org/", 200, None, "1; url=/next", ""), ("https://r.org/next", 200, None, None, '<link rel="canonical" href="https://r.org/main">'), ("https://m.org/", 200, None, None, '<meta http-equiv="refresh" content="0; url=https://r.org/next">'),
        ("https://j.org/", 200, None, None, '<script>location.href = "https://r.org/next"</script>'), ("https://e.org/", 404, None, "0; url=https://r.org/", ""),
    ]
    hops = spark.createDataFrame(rows, HOPS)
    run = lambda **k: {r["url"]: (r["resolved_url"], r["redirect_chain"]) for r in joins.resolve_redirects(hops.select("url"), hops, **k).collect()}
    on = run(canonicalize=True)
    assert on["https://r.org/"] == ("https://r.org/main", ["refresh-header", "hit", "canonical"]) and on["https://m.org/"][1][0] == "meta-refresh" and on["https://j.org/"][1][0] == "js-relocation"
    assert on["https://e.org/"] == ("https://e.org/", ["hit"])
    off = run(follow_refresh=False, follow_meta=False, follow_js=False)
    assert all(v == (u, ["hit"]) for u, v in off.items())


def test_a_target_of_very_many(spark):
    rows = [(f"https://p{k}.org/", 302, "https://login.org/", None, "") for k in range(3000)] + [("https://login.org/", 200, None, None, "")]
    hops = spark.createDataFrame(rows, HOPS)
    found = joins.resolve_redirects(hops.select("url"), hops)
    assert found.where("resolved_url = 'https://login.org/' and resolution_error is null").count() == 3001


def test_left_join_of_hot_keys(spark):
    left = spark.createDataFrame([(None if k % 7 == 0 else "hot" if k % 3 else f"k{k}", k) for k in range(6000)], "k string, n int")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), (None, 3), ("other", 4)], "k string, v int")
    got = {r["n"]: r["v"] for r in joins.left_join_split(left, right, "k").collect()}
    assert got == {k: None if k % 7 == 0 else 1 if k % 3 else 2 if k == 3 else None for k in range(6000)}

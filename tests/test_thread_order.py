import random

from weblake.operators import frontier

SCHEMA = "post string, id long, up long, at long, note string"


def walked(rows):
    """Depth and position of each id of each post, by a walk on a stack."""
    posts = {}
    for post, i, up, at, _ in rows:
        if post is None or i is None:
            continue
        nodes = posts.setdefault(post, {})
        new = (up is not None, up or 0, at is not None, at or 0)
        nodes[i] = min(nodes.get(i, new), new)
    out = {}
    for post, nodes in posts.items():
        below = {}
        for i, (has, up, *at) in nodes.items():
            below.setdefault(up if has else None, []).append((at, i))
        stack, place = [(i, 0) for _, i in sorted(below.get(None, []), reverse=True)], 0
        while stack:
            i, depth = stack.pop()
            place += 1
            out[post, i] = depth, place
            stack += [(k, depth + 1) for _, k in sorted(below.get(i, []), reverse=True)]
    return out


def check(spark, rows):
    found = frontier.thread_order(spark.createDataFrame(rows, SCHEMA), "post", "id", "up", "at").collect()
    expected = walked(rows)
    assert len(found) == len(rows)
    for r in found:
        place = expected.get((r["post"], r["id"]))
        assert ((r["depth"], r["position"]) if place else None) == place and (r["error"] is None) == (place is not None), r


def test_random_forests(spark):
    random.seed(5)
    rows = []
    for p in range(12):
        n = random.choice((1, 2, 30, 200))
        for i in range(n):
            up = None if i == 0 or random.random() < 0.1 else random.randint(max(0, i - 4), i - 1) if random.random() < 0.9 else random.choice((i, 9999, random.randint(0, n - 1)))
            rows.append((f"p{p}", i, up, random.choice((None, *range(5))), "x"))
    rows += [("p1", 0, None, 3, "again"), (None, 1, None, 1, "no post"), ("p1", None, None, 1, "no id"), ("loop", 1, 2, 0, ""), ("loop", 2, 1, 0, ""), ("loop", 3, None, 0, ""), ("lone", 4, 4, 0, "")]
    random.shuffle(rows)
    check(spark, rows)


def test_a_chain_of_ten_thousand_and_a_post_of_many_roots(spark):
    rows = [("deep", k, k - 1 if k else None, -k, "") for k in range(10_000)] + [("wide", k, None, k % 7, "") for k in range(3000)] + [("star", k, 0 if k else None, k % 5, "") for k in range(3000)]
    check(spark, rows)


def test_no_comments(spark):
    assert frontier.thread_order(spark.createDataFrame([], SCHEMA), "post", "id", "up", "at").count() == 0

def test_deep_threads_orphans_and_long_arrivals(spark):
    chain = [(1, i, i - 1 if i else None, 1_700_000_000_000 - i) for i in range(16)]
    flat = [(2, 1, None, 5), (2, 4, 1, 1_700_000_000_009), (2, 3, 1, 1_700_000_000_001), (2, 5, 3, -1), (2, 6, 77, 1), (2, 7, 8, 1), (2, 8, 7, 1), (2, 4, 1, 1_700_000_000_009), (2, None, 77, 1)]
    rows = frontier.thread_order(spark.createDataFrame(chain + flat, "post int, id int, up int, at long"), "post", "id", "up", "at").collect()
    assert len(rows) == len(chain) + len(flat)
    got = {(r.post, r.id): (r.depth, r.position, r.error) for r in rows}
    assert all(got[1, i] == (i, i + 1, None) for i in range(16))
    assert [got[2, i] for i in (1, 3, 5, 4)] == [(0, 1, None), (1, 2, None), (2, 3, None), (1, 4, None)]
    assert all(got[2, i] == (None, None, "no-root") for i in (6, 7, 8, None))

import json

from weblake.operators import payloads


def node(i, *replies, **more):
    return {"node": {"id": f"c{i}", "legacy_fbid": str(i), "author": {"name": "A", "is_verified": True}, "preferred_body": {"text": f"t{i}"}, "attachments": [{}, {}], "feedback": {"reactors": {"count": i}, "display_comments": {"edges": list(replies)}}, **more}}


def test_all_roots_and_any_depth(spark):
    deep = node(9, depth=9, comment_parent={"id": "c8"})
    for i in range(8, -1, -1):
        deep = node(i, deep, depth=i, comment_parent={"id": f"c{i - 1}"} if i else None)
    docs = [
        {"data": {"node": {"id": "p1", "display_comments": {"edges": [deep]}}}},
        {"id": "p2", "data": {"node": None}, "display_comments": {"edges": [node(20), node(21)]}},
        {"id": "p3", "data": {"feedback": {"display_comments": {"edges": [node(30, reply_parent_comment={"id": "x"}, comment_parent={"id": "y"})]}}}},
        {"id": "p4", "data": {"node": {"display_comments": {"edges": "none"}}}},
    ]
    rows = payloads.facebook_comments(spark.createDataFrame([(json.dumps(d),) for d in docs] + [("no JSON",), (None,)], "payload string")).collect()
    got = {(r.post_id, r.comment_id): r for r in rows}
    assert sorted(got) == sorted([("p1", f"c{i}") for i in range(10)] + [("p2", "c20"), ("p2", "c21"), ("p3", "c30")]) and len(rows) == len(got)
    assert all(got["p1", f"c{i}"].depth == i and got["p1", f"c{i}"].parent_id == (f"c{i - 1}" if i else None) for i in range(10))
    last = got["p3", "c30"]
    assert (last.parent_id, last.fbid, last.text, last.attachments, last.reactions, last.replies, last.author_is_verified) == ("x", "30", "t30", 2, 30, 0, True)
    assert got["p2", "c21"].place == 1

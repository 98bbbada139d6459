import random

from weblake.operators.visited import VisitedSet


def test_batches_equal_one_and_read_little(spark, tmp_path):
    random.seed(2)
    known, visited = set(), VisitedSet(spark, f"{tmp_path}/set", buckets=8)
    urls = lambda ks: spark.createDataFrame([(f"https://site{k % 13}.org/page/{k}",) for k in ks] + [(None,)], "url string")
    opened = []
    for n in range(5):
        ks = [random.randrange(4000) for _ in range(400)]
        new = {r["key"] for r in visited.add(urls(ks), "url").collect()}
        expected = {f"https://site{k % 13}.org/page/{k}" for k in ks} - known
        assert new == expected
        known |= expected
        opened.append(len(visited.last_read))
    assert opened[0] == 0 and {r["key"] for r in visited.keys().collect()} == known
    one = VisitedSet(spark, f"{tmp_path}/one", buckets=8)
    one.add(spark.createDataFrame([(u,) for u in known], "url string"), "url")
    assert {r["key"] for r in one.keys().collect()} == known
    # A single known key opens one bucket of one part; new keys hardly any.
    again = visited.add(spark.createDataFrame([(sorted(known)[0],)], "url string"), "url")
    assert again.count() == 0 and len(visited.last_read) <= 2
    assert visited.add(urls(range(10_000, 10_040)), "url").count() == 40 and len(visited.last_read) <= 4
    whole = visited.compact(f"{tmp_path}/whole")
    assert whole.keys().count() == len(known) + 40 and whole.add(urls(range(10_000, 10_040)), "url").count() == 0

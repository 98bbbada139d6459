import random

from pyspark.sql import functions as F

from weblake.operators import joins


def found_by_loops(rows, entities):
    known = {tuple(s): e for s, e in entities}
    return {k: next((known[tuple(s[:n])] for n in range(len(s), 0, -1) if tuple(s[:n]) in known), None) if s is not None else None for k, s in rows}


def run(spark, rows, entities):
    probes = spark.createDataFrame(rows, "k long, s array<string>")
    marks = spark.createDataFrame(entities, "stems array<string>, e long").select("stems", F.struct("e").alias("entity"))
    return joins.longest_prefix(probes, F.col("s"), marks, "found").select("k", "s", "found.e")


def test_random_stems_equal_loops(spark):
    random.seed(9)
    word = lambda: random.choice(("a", "b", "ab", "c.d", "é", "z"))
    entities = {tuple(word() for _ in range(random.randint(1, 5))): k for k in range(150)}
    rows = [(k, [word() for _ in range(random.randint(0, 7))]) for k in range(1500)] + [(2000 + k, None) for k in range(300)] + [(3000 + k, list(s)) for k, s in enumerate(entities)]
    entities = [(list(s), e) for s, e in entities.items()]
    got = run(spark, rows, entities).collect()
    assert len(got) == len(rows) and {r["k"]: r["e"] for r in got} == found_by_loops(rows, entities)


def test_a_host_of_half_of_all_urls_and_deep_entities(spark):
    """One page stands for a quarter of all rows, one host for three quarters; ranges begin inside entities."""
    rows = [(k, ["org", "hot"] + (["page"] if k % 3 == 0 else ["p", str(k % 700), "x"])) for k in range(6000)] + [(9000 + k, ["com", f"h{k}"]) for k in range(2000)]
    entities = [(["org"], 1), (["org", "hot"], 2), (["org", "hot", "p", "7"], 3), (["org", "hot", "p", "69", "x"], 4), (["com"], 5)]
    got = run(spark, rows, entities)
    assert {r["k"]: r["e"] for r in got.collect()} == found_by_loops(rows, entities)


def test_no_entities_and_no_rows(spark):
    assert [r["e"] for r in run(spark, [(1, ["a"])], []).collect()] == [None]
    assert run(spark, [], [(["a"], 1)]).count() == 0


def test_ranges_are_even(spark, monkeypatch):
    seen = []
    plain = joins.stored

    def kept(df):
        out = plain(df)
        if "its range" in out.columns:
            seen.extend(r["count"] for r in out.groupBy("its range").count().collect())
        return out

    monkeypatch.setattr(joins, "stored", kept)
    rows = [(k, ["org", "hot"] + (["page"] if k % 2 else ["p", str(k)])) for k in range(20000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        run(spark, rows, [(["org"], 1)]).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(seen) == 8 and max(seen) < 1.5 * sum(seen) / len(seen)

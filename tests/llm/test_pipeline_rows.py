import corpus_pipeline
from pyspark.sql import functions as F
from weblake.llm import mixing


def test_run_returns_places_in_the_mix(spark, sf_dir):
    got = {r.doc_id: (r.position, r.offset) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id").isin(list(got)))
    assert got == {r.doc_id: (r.position, r.offset) for r in mixing.mix_order(docs).collect()}
    assert len(set(got.values())) == len(got)


def test_places_do_not_depend_on_files(spark, sf_dir):
    docs = spark.createDataFrame([(i, f"w{i}", "ab"[i % 5 == 0]) for i in range(400)], "doc_id long, text string, source string")
    one, other = (corpus_pipeline.token_ids(spark, docs.repartition(n), sf_dir) for n in (1, 7))
    assert one.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "position", "offset"]
    one, other = ([r.doc_id for r in df.orderBy("position", "offset").collect()] for df in (one, other))
    assert one == other and sorted(one) == list(range(400))
    assert one == [r.doc_id for r in mixing.mixed(docs).collect()]


def test_null_and_repeated_ids_in_all_stages(spark, sf_dir):
    said = {k: f"the {k} cat sat on the {k} mat and so it was on that day with the {k} dog" for k in ("red", "old", "big", "wet", "tin")}
    rows = [(1, said["red"], "a")] * 40 + [(2, said["old"], "a"), (2, said["big"], "b"), (None, said["wet"], "a"), (None, said["wet"], "b"), (None, said["tin"], None), (None, said["red"], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.lit("en").alias("lang"))
    one = corpus_pipeline.known_language(spark, docs, sf_dir)
    assert sorted(one.collect(), key=repr) == sorted(docs.collect(), key=repr)
    two = [corpus_pipeline.one_of_each(spark, docs.repartition(n), sf_dir) for n in (1, 5)]
    texts, again = (sorted(((r.doc_id, r.text) for r in df.collect()), key=repr) for df in two)
    assert texts == again and texts[0] == (1, said["red"]) and texts[2:] == [(None, said["tin"]), (None, said["wet"])]
    assert texts[1] in [(2, said["old"]), (2, said["big"])] and len(texts) == 4
    for stage in (corpus_pipeline.without_secrets, corpus_pipeline.in_mix_order):
        assert sorted(stage(spark, docs, sf_dir).collect(), key=repr) == sorted(docs.collect(), key=repr)
    last = [corpus_pipeline.token_ids(spark, docs.repartition(n), sf_dir).orderBy("position", "offset").collect() for n in (1, 5)]
    assert last[0] == last[1] and sorted((r.doc_id for r in last[0]), key=repr) == sorted((r[0] for r in rows), key=repr)
    assert len({(r.position, r.offset) for r in last[0]}) == len(rows)
    assert mixing.mix_order(docs).count() == len(rows)

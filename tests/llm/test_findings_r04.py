"""What the review of round 4 found, one case each."""

import corpus_pipeline
import pyarrow.parquet as pq
from weblake.llm import mixing
from weblake.llm.storage import stored

WORKING = ["rank", "bucket", "within", "before", "block_rows", "n", "k", "a.b", "mix id", "mix salt", "position", "offset", *mixing.PLACE]


def test_columns_named_as_in_the_mix_keep_their_values(spark, sf_dir):
    """values of a column ``rank`` or ``mix source`` were lost, ``bucket``, ``within``, ``before`` and ``block_rows`` ended in an error."""
    columns = ", ".join(f"`{c}` string" for c in WORKING)
    rows = [(i if i % 7 else None, f"w{i % 50}", "ab"[i % 5 == 0], *(f"{c} {i}" for c in WORKING)) for i in range(200)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {columns}")
    out = corpus_pipeline.in_mix_order(spark, docs, sf_dir)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    ids = corpus_pipeline.token_ids(spark, docs, sf_dir)
    assert [r.doc_id for r in ids.orderBy("position", "offset").collect()] == [r[0] for r in got]
    places = mixing.placed(docs)
    assert places.columns == [*(c for c in docs.columns if c not in mixing.PLACE), *mixing.PLACE]


def test_files_of_the_mix_hold_the_order_that_the_last_stage_returns(spark, sf_dir):
    """a reader of several files loses their order, and the places given by the last stage are those of the files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so small a table is one file
    try:
        mix = stored(corpus_pipeline.in_mix_order(spark, docs, sf_dir))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    files = sorted(f.removeprefix("file://") for f in mix.inputFiles())
    held = [i for f in files for i in pq.ParquetFile(f).read(["doc_id"]).column(0).to_pylist()]
    assert len(files) > 3 and len(held) == docs.count()
    assert held == [r.doc_id for r in corpus_pipeline.token_ids(spark, mix, sf_dir).orderBy("position", "offset").collect()]

import corpus_pipeline
from tests.llm.test_near_duplicates import brute_classes
from tokenizers import Tokenizer
from weblake.llm import language, secrets
from weblake.llm.queries_models import BYTE_RANKS, RANKS_PATTERN, WORD_BPE
from weblake.llm.storage import stored


def test_run_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    filters = language.learn_languages(docs)
    ids = list(texts)
    langs, scores = filters.predict([texts[i] or "" for i in ids])
    known = {i: texts[i] for i, lang, s in zip(ids, langs, scores, strict=True) if lang != "und" and s >= corpus_pipeline.LEAST_SCORE}
    classes = brute_classes(known)
    enc, library = secrets.encoding(BYTE_RANKS, RANKS_PATTERN), Tokenizer.from_file(WORD_BPE)
    expected = {}
    for i, t in known.items():
        if classes[i] == i:
            masked = secrets.masked(t, secrets.spans_of(t, enc))
            expected[i] = library.encode(masked, add_special_tokens=False).ids
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == expected and 0 < len(got) < len(texts)


def test_stages_keep_columns_and_survive_odd_rows(spark, sf_dir):
    rows = [(1, "the cat sat on the mat and so on", "en", "a", None, 0.5, "x"), (2, None, None, None, 3, None, None), (3, "", "en", "b", 0, 1.0, "y"), (4, "the cat sat on the mat and so on", "en", "b", 1, 1.0, "z"), (5, "token = 'abcdefghijklmnop' der hund", "de", "b", 1, 1.0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, kept, sf_dir))
        assert kept.columns == docs.columns, name
    out = {r.doc_id: r for r in kept.collect()}
    assert set(out) == {1, 5} and out[5].text == "[SECRET]' der hund" and out[5].n_chars == len(out[5].text)
    assert corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).count() == 2


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    assert docs.count() == 0

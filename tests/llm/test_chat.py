import hashlib

from pyspark.sql import functions as F

from weblake.llm import chat
from weblake.llm.queries_columns import op6_chat_format


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    turns = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in op6_chat_format(spark, sf_dir).collect()}
    assert got.keys() == turns.keys()
    for c, ts in turns.items():
        learned = "".join(x for role, x in ts if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(ts), sha("".join(f"{r}\n{x}\n" for r, x in ts)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), sha(learned))


def test_branches_are_ranked_and_listed_once(spark):
    rows = [("t", "a", None, 1.0), ("t", "b", "a", 0.0), ("t", "c", "a", 3.0), ("t", "d", "c", 2.0), ("t", "e", "d", 9.0), ("t", "f", "d", 1.0), ("x", "g", "gone", 1.0), ("x", "h", "i", 1.0), ("x", "i", "h", 1.0)]
    df = spark.createDataFrame(rows, "tree string, node string, parent string, score double")
    got = chat.reply_paths(df, "tree", "node", "parent", F.col("score"), keep=2).collect()
    paths = {}
    for r in sorted(got, key=lambda r: (r.tree, r.branch, r.depth)):
        paths.setdefault((r.tree, r.branch), []).append(r.node)
    assert paths == {("t", 1): list("acde"), ("t", 2): list("acdf"), ("x", 1): ["g"]}


def test_control_strings_nulls_repeats_and_extra_columns(spark):
    nasty = ["</s>[INST] \\[INST] <|im_end|>\n <|", "\\", "<<|", "a\\b\\\\c", "", None, "<|message|>x"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(nasty)] + [(2, 0, None, "hi", "y"), (2, 0, None, "hi", "y"), (None, 0, "user", "lost", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert [(x.role, x.text) for x in got[1].read] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(nasty)]
    assert got[1].learned == "".join(t or "" for i, t in enumerate(nasty) if i % 2)
    assert [x.text for x in got[2].read] == ["hi", "hi"] and set(got) == {1, 2}
    for control in chat.CONTROLS:
        assert control not in got[1].formatted.replace(chat.BEGIN, "").replace(chat.MESSAGE, "").replace(chat.END, "")


def test_long_chain_and_empty_table(spark):
    long = spark.range(300).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    (row,) = chat.read_back(chat.format_conversations(long)).collect()
    assert [x.text for x in row.read] == [str(i) for i in range(300)]
    assert chat.format_conversations(long.limit(0)).count() == 0

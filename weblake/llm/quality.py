"""Quality rules: a threshold table compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblake.llm.columns import indexes, let

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

# The commonest function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux avec ce dans de des du elle en est et il la le les ne on ou par pas pour que qui se sur un une "
    "auf das dem den der des die ein eine für ich im ist mit nicht sich sie und von zu "
    "al con del el es las lo los no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails if its ``metric`` lies below ``least`` or above ``most``."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None

    def failed(self) -> Column:
        value, tests = F.col(self.metric), []
        if self.least is not None:
            tests.append(value < self.least)
        if self.most is not None:
            tests.append(value > self.most)
        out = tests[0]
        for test in tests[1:]:
            out = out | test
        return F.coalesce(out, F.lit(False))


#: The base rules: too short, or mostly repeated windows of words.
BASE = (Rule("too_few_words", "n_words", least=50), Rule("repetition", "repeat_pct", most=50))
#: The method's own table. A ratio of a text without words is null and fails no rule.
RULES = (
    Rule("word_length", "chars_per_word", least=1.5, most=20),
    Rule("symbols", "symbols_per_word", most=0.5),
    Rule("stop_words", "stop_ratio", least=0.01),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = F.size(words)
    hashes = let(words, lambda w: F.transform(indexes(F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def positions(s: Column) -> Column:
        at = lambda j: F.get(s, j)["h"]
        twice = F.filter(indexes(F.size(s)), lambda j: at(j).eqNullSafe(at(j - 1)) | at(j).eqNullSafe(at(j + 1)))
        return F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))

    def covered(p: Column) -> Column:
        step = lambda k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(3)))
        return F.aggregate(indexes(F.size(p)), F.lit(0), lambda acc, k: acc + step(k))

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(pairs, positions), covered))

    return F.when(n < 4, F.lit(0)).otherwise(let(hashes, counted))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Judges each text by length, symbol, stop-word and line ratios.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    failed_rules (names of all rules that the text fails, in the table's order); no other input
    columns. A null text counts as no words, so it fails ``base``; equal texts get equal verdicts;
    every row is returned, in a narrow projection without shuffle or user functions. Windows of
    words are compared by 64-bit hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    read = read.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    stop = F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))
    counts = read.select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size(stop).cast("long").alias("n_stop"),
    )
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    ratios = counts.select(
        "*",
        (100 * F.col("n_repeat_words") / words).alias("repeat_pct"),
        (F.col("word_chars") / words).alias("chars_per_word"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_stop") / words).alias("stop_ratio"),
        (F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines"))).alias("dup_line_ratio"),
    )
    names = F.array(*(F.when(r.failed(), F.lit(r.name)) for r in (*base, *rules)))
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | r.failed()
    return ratios.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), F.array_compact(names).alias("failed_rules"),
    ).select("*", (F.size("failed_rules") == 0).alias("kept"))

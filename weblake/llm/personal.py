"""Personal data: patterns propose, checksums confirm, context words adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblake.llm.columns import let, running_sums

#: Characters before and after a span in which context words count.
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.35
#: An added span needs this score; base spans stay whatever their score is.
LEAST_SCORE = 0.6


@dataclass(frozen=True)
class Kind:
    """``needs`` is a character that every match holds: a quick test before the pattern."""

    name: str
    pattern: str
    score: float
    context: str
    base: bool
    needs: str


# Possessive forms of the contract's patterns: they match the same spans, in linear time and without
# recursion. A match starts where a run of its first class starts, or where the last match ended.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, r"mail|contact|courriel|correo", True, "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|address|host|server|login", True, "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.8, r"card|visa|credit|karte|carte|tarjeta", True, ""),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, r"phone|tel|call|fax|mobil", True, "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.8, r"iban|bank|konto|compte|cuenta", False, ""),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"ssn|social security", False, "-"),
    Kind("tel", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", 0.3, r"phone|tel|call|fax|mobil", False, ""),
)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    def passes(d: Column) -> Column:
        def term(i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
            return F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, F.lit(9)).otherwise(F.lit(0)))

        total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda acc, i: acc + term(i))
        return F.when(F.length(d).between(14, 19), total % 10 == 0).otherwise(F.lit(False))

    return let(_digits(match), passes)


def _mod97(match: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def value(acc: Column, c: Column) -> Column:
        letter = F.instr(F.lit(letters), c)
        return F.when(letter > 0, (acc * 100 + letter + 9) % 97).otherwise((acc * 10 + F.when(letter == 0, c).cast("int")) % 97)

    def passes(m: Column) -> Column:
        moved = F.concat(F.substring(m, F.lit(5), F.length(m)), F.substring(m, 1, 4))
        return F.length(m).between(15, 34) & (F.aggregate(F.split(moved, ""), F.lit(0), value) == 1)

    return let(F.regexp_replace(match, " ", ""), passes)


def _small_parts(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(F.lit(False)))


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return _small_parts(match)
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return _mod97(match)
    return F.lit(True)


SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _spans(text: Column, rank: int, kind: Kind) -> Column:
    """Confirmed spans of one kind. What lies between the matches gives their places."""

    def placed(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            ends = running_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m)))

            def one(m: Column, i: Column, e: Column) -> Column:
                near = F.concat_ws(" ", F.right(F.get(gaps, i), F.lit(CONTEXT_CHARS)), F.left(F.get(gaps, i + 1), F.lit(CONTEXT_CHARS)))
                score = kind.score + F.when(F.lower(near).rlike(kind.context), CONTEXT_GAIN).otherwise(0.0)
                end = F.get(e, i)
                return F.struct(
                    (end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"),
                    F.when(_confirmed(kind.name, m), F.least(score, F.lit(1.0))).otherwise(F.lit(-1.0)).alias("score"),
                )

            return let(ends, lambda e: F.transform(found, lambda m, i: one(m, i, e)))

        least = 0.0 if kind.base else LEAST_SCORE
        return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(
            F.filter(let(F.split(text, kind.pattern, -1), with_gaps), lambda s: s["score"] >= least).cast(SPAN)
        )

    found = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), placed)
    if kind.needs:
        found = F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(F.array().cast(SPAN))
    return found


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Finds personal data in each text.

    Returns id and ``spans``: array of struct(start, rank, end, kind, score), sorted by start, then
    by the order of ``kinds``; places are code points, end exclusive; other input columns are left
    out. Base kinds keep all confirmed matches. Added kinds keep matches that their checksum
    confirms or context words support, unless they overlap a base span. Spans of different kinds may
    overlap, and equal starts are in the order of the kinds. A null or empty text has an
    empty array; rows of repeated ids each have their spans. A narrow projection of built-in functions: no shuffle, equal texts get equal spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col), text.alias("text"))
    found = found.select(id_col, *(_spans(F.col("text"), i, k).alias(f"spans_{k.name}") for i, k in enumerate(kinds)))
    base = [F.col(f"spans_{k.name}") for k in kinds if k.base]
    added = [F.col(f"spans_{k.name}") for k in kinds if not k.base]
    clear = F.concat(*added) if added else F.array().cast(SPAN)
    for spans in base:
        clear = _clear_of(clear, spans)
    return found.select(id_col, F.sort_array(F.concat(*base, clear)).alias("spans"))


def _clear_of(added: Column, spans: Column) -> Column:
    return F.filter(added, lambda a: ~_overlaps(a, spans))


def _overlaps(a: Column, spans: Column) -> Column:
    """Whether a span overlaps one of the sorted, disjoint ``spans``: the last that starts before its end does or none.

    A binary search: it halves the places between ``low`` (starts before a's end, or -1) and ``high``.
    """
    state = F.struct(F.lit(-1).alias("low"), F.size(spans).alias("high"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        before = (s["high"] - s["low"] > 1) & (F.get(spans, middle)["start"] < a["end"])
        done = s["high"] - s["low"] <= 1
        return F.struct(F.when(before, middle).otherwise(s["low"]).alias("low"), F.when(done | before, s["high"]).otherwise(middle).alias("high"))

    last = F.aggregate(rounds, state, halve, lambda s: F.get(spans, s["low"]))
    return F.coalesce(last["end"] > a["start"], F.lit(False))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

"""Document fingerprints: Merkle trees over sections, paragraphs and pieces of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblake.llm.columns import let
from weblake.llm.storage import stored

#: A piece of a paragraph: up to a sentence's end, at most 12 words (of 64 letters each), with the white space after it.
PIECE = r"(?:\S{1,64}+\s*+(?<![.!?]\s)){0,11}\S{1,64}+\s*+|\s++"
#: Hexadecimal digits that a piece keeps in the fingerprint, before its length.
KEPT = 8
#: A section ends after a blank line, and after a paragraph whose digest begins with one of these.
SECTION_ENDS = "01"


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text: its root, a colon, and the pieces of its tree.

    Leaves are pieces of paragraphs, which are lines with their line feed; a paragraph's digest is that of
    its pieces' digests, a section's that of its paragraphs', the root that of its sections'. A section
    ends after a blank line, or where a paragraph's own digest says so: such places move with the text,
    so an edit leaves all other sections as they were. No character is left out, so texts are equal if
    and only if their roots are. Written after the root: pieces as the first digits of their
    digest and their code points, pieces of a paragraph joined by commas, a paragraph ended by a
    semicolon, or by ``|`` where its section ends. Null counts as empty: no pieces.
    """

    def paragraph(p: Column, k: Column, last: Column) -> Column:
        def of(pieces: Column) -> Column:
            def tied(digests: Column) -> Column:
                whole = _digest(F.array_join(digests, ""))
                short = F.zip_with(digests, pieces, lambda d, x: F.concat(F.substring(d, 1, KEPT), F.length(x).cast("string")))
                ends = (k == last) | whole.rlike(f"^[{SECTION_ENDS}]") | ~p.rlike(r"\S")
                return F.struct(whole.alias("digest"), F.array_join(short, ",").alias("pieces"), F.when(ends, "|").otherwise(";").alias("end"))

            return let(F.transform(pieces, _digest), tied)

        return let(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), of)

    def tree(paragraphs: Column) -> Column:
        found = F.transform(paragraphs, lambda p, k: paragraph(p, k, F.size(paragraphs) - 1))

        def root(ps: Column) -> Column:
            joined = F.array_join(F.transform(ps, lambda p: F.concat(p["digest"], p["end"])), "")
            sections = F.regexp_extract_all(joined, F.lit(r"[^|]+\|"), F.lit(0))
            written = F.array_join(F.transform(ps, lambda p: F.concat(p["pieces"], p["end"])), "")
            return F.concat(_digest(F.array_join(F.transform(sections, _digest), "")), F.lit(":"), written)

        return let(found, root)

    return let(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=\n)"), lambda p: p != ""), tree)


def _tree(print_: Column) -> Column:
    return F.substring_index(print_, ":", -1)


def _pieces(tree: Column) -> Column:
    return F.filter(F.split(tree, "[,;|]"), lambda x: x != "")


def _chars(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda acc, x: acc + F.substring(x, KEPT + 1, 12).cast("long"))


def likeness(one: Column, other: Column) -> Column:
    """How much of two fingerprinted texts is the same, from 0 to 1, by their fingerprints alone.

    Equal roots: 1. Else twice the code points in pieces that both hold, by those in pieces of either;
    a piece that repeats counts once, wherever it stands; a root counts as one code point, so that only
    equal texts reach 1.
    """
    pieces = lambda p: F.array_distinct(_pieces(_tree(p)))

    def of(a: Column, b: Column) -> Column:
        return 2.0 * _chars(F.array_intersect(a, b)) / (_chars(a) + _chars(b) + 2)

    return F.when(one == other, F.lit(1.0)).otherwise(let(pieces(one), lambda a: let(pieces(other), lambda b: of(a, b))))


def _same_before(a: Column, b: Column, mark: str) -> Column:
    """The parts, each ended by ``mark``, with which two branches begin alike: descends where they differ.

    Leaves of the last level are pieces; ``mark`` goes from sections to paragraphs to pieces.
    """
    cut = {"|": r"(?<=\|)", ";": r"(?<=[;|])", ",": r"(?<=[,;|])"}[mark]

    def of(xs: Column, ys: Column) -> Column:
        alike = F.zip_with(xs, ys, lambda x, y: F.coalesce(x == y, F.lit(False)))

        def count(n: Column) -> Column:
            same = _chars(_pieces(F.array_join(F.slice(xs, F.lit(1), n), "")))
            if mark == ",":
                return same
            deeper = _same_before(F.coalesce(F.get(xs, n), F.lit("")), F.coalesce(F.get(ys, n), F.lit("")), {"|": ";", ";": ","}[mark])
            return same + deeper

        first = F.array_position(alike, False)
        return let(F.when(first == 0, F.size(alike)).otherwise(first - 1).cast("int"), count)

    # A last piece is followed by its paragraph's end, which says nothing of the piece.
    parts = lambda t: F.transform(F.split(t, cut), lambda x: F.regexp_replace(x, "[,;|]$", ",")) if mark == "," else F.split(t, cut)
    return let(parts(a), lambda xs: let(parts(b), lambda ys: of(xs, ys)))


def first_edit(one: Column, other: Column) -> Column:
    """The code point of ``one`` at which the first piece begins that ``other`` doesn't hold there; null for equal texts.

    Walks down from the root: equal sections are passed over whole, then equal paragraphs of the first
    section that differs, then equal pieces of the first paragraph that differs.
    """
    return F.when(one == other, F.lit(None)).otherwise(_same_before(_tree(one), _tree(other), "|"))


def neighbours(keys: DataFrame) -> DataFrame:
    """``keys`` (key, n) with those of the row before in ascending order, the first row's being the last's.

    Sorted in ranges; each range's first row takes the last of the range before, from one row a range.
    """
    ranges = stored(keys.repartitionByRange("key").withColumn("range", F.spark_partition_id()))
    row = F.struct("key", "n")
    last = ranges.groupBy("range").agg(F.max_by(row, "key").alias("last"))
    one = Window.partitionBy(F.lit(0)).orderBy("range")
    before = F.coalesce(F.lag("last").over(one), F.last("last").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    edges = last.select("range", before.alias("edge"))
    found = ranges.withColumn("before", F.lag(row).over(Window.partitionBy("range").orderBy("key"))).join(edges, "range")
    return found.select("key", "n", F.coalesce("before", "edge").alias("before"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 4) -> DataFrame:
    """Fingerprints of all texts, of edits of them, and of their next documents, and how alike these are.

    In the edited text the last ``n_chars // part`` code points give way to the first as many (or all) of
    the next document by ascending id; after the last comes the first. Returns id, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next`` (see
    ``likeness``) and ``edit_start`` (see ``first_edit``); other columns are left out. A null text counts as
    empty. Null ids come first; texts of one id follow in the order of a hash of theirs; rows equal in id
    and text are one document in that order, and all get its result. A table of one document is its
    own next; an empty table gives none.

    Columns alone. Texts are shuffled once, with their fingerprints; of the next documents, the
    beginnings that edits need are sent to the document before them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # One column, so that joins and aggregation share a partitioning; in a struct nulls are equal and come first.
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash")).alias("key")
    before = neighbours(docs.select(key, F.length(text).cast("long").alias("n")).groupBy("key").agg(F.max("n").alias("n")))
    rows = docs.select(key.alias("row key"), text.alias("text"), fingerprint(text).alias("print"))
    # Grouped and joined by the stored key alone: the rows' own differs in what may be null, and a cast would hide its partitioning.
    held = rows.join(before, F.col("row key") == F.col("key")).drop("row key")
    # Rows equal in id and text stand next to each other here: one of them speaks for all.
    sent = held.groupBy("key").agg(
        F.first("before").alias("before"), F.first("print").alias("next_print"),
        F.first(F.expr(f"left(text, cast(before.n div {int(part)} as int))")).alias("begin"),
    )
    whole = held.join(sent.select(F.col("before.key").alias("key"), "begin", "next_print"), "key").withColumn("id", F.col("key.id"))
    changed = F.concat(F.expr(f"left(text, cast(n - n div {int(part)} as int))"), F.col("begin"))
    edited = whole.select("id", "n", "print", "next_print", changed.alias("edited"))
    done = edited.select("id", "n", "print", "next_print", _digest(F.col("edited")).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_print"))
    return done.select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), "edited_sha256", F.col("print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        first_edit(F.col("print"), F.col("edited_print")).alias("edit_start"),
    )

import hashlib
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from weblake.llm import fingerprints, manifest, queries_trees

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, tree string, digest string, hash long, before string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", "z", 7, "w") for r in rows], SCHEMA)


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def fold_up(nodes):
    """Root of a list of digests, and each leaf's siblings, level by level, as (left, right)."""
    paths = [[] for _ in nodes]
    held = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, below = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for k in range(len(run)):
                for leaf in held[at + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            below.append([leaf for part in held[at : at + 16] for leaf in part])
        nodes, held = above, below
    return nodes[0], paths


def by_hand(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[3]].append((r[0] is not None, r[0] or 0, sha("".join(map(field, (r[0], r[3], r[2], r[4], r[1])))), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: (sorted(trees[s], key=lambda x: x[:3]), *fold_up([x[2] for x in sorted(trees[s], key=lambda x: x[:3])])) for s in order}
    root, above = fold_up([built[s][1] for s in order]) if order else (None, [])
    out = []
    for s, high in zip(order, above, strict=True):
        leaves, subroot, paths = built[s]
        for (_, _, leaf, r), path in zip(leaves, paths, strict=True):
            steps = path + high
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = r[1] if r[1] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[1])
                now = sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))
            for a, b in steps:
                now = sha(a + now + b)
            out.append((r[0], leaf, subroot, root, sha("".join(a + b for a, b in steps)), now, now == root))
    return sorted(out, key=repr)


def rows_of_many_sizes():
    rows = []
    for source, n in (("b", 300), (None, 17), ("", 1), ("ä", 16), ("a", 33)):
        rows += [(len(rows) + k, f"Text {k} of É {source}", "en" if k % 3 else None, source, k) for k in range(n)]
    rows += [(None, None, None, "a", None), (None, "Q", None, "a", 1), (5, "Again", "en", "b", 2), (5, "Again", "en", "b", 2), (6, "", None, "b", 0), (7, "X y" * 50_000, "de", "b", 3)]
    return rows


def test_manifest_equals_trees_by_hand(spark, tmp_path):
    for k, rows in enumerate((rows_of_many_sizes(), [(1, "One", None, None, 3)], [])):
        docs_of(spark, rows).repartition(5).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        found = queries_trees.op12_merkle_manifest(spark, f"{tmp_path}/{k}")
        assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted(map(tuple, found.collect()), key=repr) == by_hand(rows)


def test_proofs_of_other_columns(spark):
    rows = spark.createDataFrame([("p", k, sha(str(k)), k * 2) for k in range(40)], "at string, n long, leaf string, slot long")
    found = manifest.with_proofs(rows, id_col="n", tree_col="at", carry=("slot",)).orderBy("n").collect()
    root, paths = fold_up([sha(str(k)) for k in range(40)])
    assert [(r["n"], r["slot"], [tuple(p) for p in r["path"]], r["root"], r["subroot"]) for r in found] == [(k, 2 * k, paths[k], root, root) for k in range(40)]


def pieces(text):
    """Pieces by paragraph, cut by hand: a word and its white space at a time."""
    out = []
    for paragraph in re.findall(r"[^\n]*\n|[^\n]+", text):
        words = re.findall(r"[^ \t\n\x0b\f\r]{1,64}[ \t\n\x0b\f\r]*|[ \t\n\x0b\f\r]+", paragraph)
        made, held = [], []
        for w in words:
            if w[0] in " \t\n\x0b\f\r":
                made.append(w)
                continue
            held.append(w)
            if len(held) == 12 or re.search(r"[.!?][ \t\n\x0b\f\r]$", w):
                made.append("".join(held))
                held = []
        out.append(made + ["".join(held)] * bool(held))
    return out


def tree(text):
    paragraphs = pieces(text or "")
    sections, held, written = [], [], ""
    for k, ps in enumerate(paragraphs):
        digest = sha("".join(map(sha, ps)))
        held.append(digest)
        end = k == len(paragraphs) - 1 or digest[0] in "01" or not "".join(ps).strip(" \t\n\x0b\f\r")
        written += ",".join(sha(p)[:8] + str(len(p)) for p in ps) + ("|" if end else ";")
        if end:
            sections.append(held)
            held = []
    joined = ["".join(d + (";" if k < len(s) - 1 else "|") for k, d in enumerate(s)) for s in sections]
    return sha("".join(map(sha, joined))) + ":" + written


def near(a, b):
    if tree(a) == tree(b):
        return 1.0
    x, y = ({(sha(p)[:8], len(p)) for ps in pieces(t or "") for p in ps} for t in (a, b))
    size = lambda s: sum(n for _, n in s)
    return 2 * size(x & y) / (size(x) + size(y) + 2)


def edit_at(a, b):
    if tree(a) == tree(b):
        return None
    at = 0
    x, y = pieces(a), pieces(b)
    for p, q in zip(x, y):
        for u, v in zip(p, q):
            if u != v:
                return at
            at += len(u)
        if len(p) != len(q):
            return at
    return at


def test_fingerprints_equal_trees_by_hand(spark):
    lines = "One two. Three four! Five\n\nSix seven? " + "word " * 40 + "\n  indented\t\n" + "é" * 200 + "\nend"
    texts = [lines, None, "", "a", "abc", "  ", "\n\n", lines, lines.replace("Six", "Sex"), "x" * 70_000, "One two. " * 3000, "".join(f"Line {k} of it.\n" for k in range(500)), "\U0001f600\U0001f601 z. " * 9]
    rows = [(k * 3, t, None, None, None) for k, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs_of(spark, rows).repartition(4)).collect()}
    assert len(found) == len(rows)
    for k, t in enumerate(texts):
        t = t or ""
        after = texts[(k + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = found[k * 3]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), sha(edited), tree(t), tree(edited))
        assert abs(r["near_edited"] - near(t, edited)) < 1e-12 and abs(r["near_next"] - near(t, after)) < 1e-12
        assert (r["near_edited"] == 1) == (edited == t) and (r["near_next"] == 1) == (after == t)
        assert r["edit_start"] == edit_at(t, edited)
    assert found[0]["fingerprint"] == found[21]["fingerprint"]


def test_fingerprints_of_repeated_null_and_single_ids(spark):
    rows = [(None, "p q", None, None, None), (None, "r s", None, None, None), (1, "same", None, None, None), (1, "same", None, None, None), (2, "last one", None, None, None)]
    found = fingerprints.fingerprint_edits(docs_of(spark, rows)).collect()
    assert len(found) == 5 and len({tuple(r) for r in found if r["doc_id"] == 1}) == 1
    one = next(r for r in found if r["doc_id"] == 1)
    assert one["edited_sha256"] == sha("saml")
    alone = fingerprints.fingerprint_edits(docs_of(spark, rows[-1:])).collect()
    assert [(r["edited_sha256"], r["near_next"], r["n_chars"]) for r in alone] == [(sha("last ola"), 1.0, 8)]
    assert fingerprints.fingerprint_edits(docs_of(spark, [])).count() == 0


def test_next_documents_over_many_ranges(spark):
    rows = [(k * 7 % 2003, f"text {k}. " * 5, None, None, None) for k in range(2003)]
    by_id = sorted(rows)
    found = fingerprints.fingerprint_edits(docs_of(spark, rows).repartition(11))
    got = {r["doc_id"]: r["edited_sha256"] for r in found.select("doc_id", "edited_sha256").collect()}
    for r, s in zip(by_id, by_id[1:] + by_id[:1], strict=True):
        q = len(r[1]) // 4
        assert got[r[0]] == sha(r[1][: len(r[1]) - q] + s[1][:q])


def test_edits_leave_other_sections_alone(spark):
    text = "".join(f"Paragraph {k} says this. And that.\n" for k in range(200))
    changed = text.replace("Paragraph 90 says", "Paragraph 90 said")
    one = spark.createDataFrame([(text, changed)], "a string, b string")
    a, b = one.select(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).head()
    x, y = (p.split(":")[1].split("|") for p in (a, b))
    assert len(x) > 10 and sum(s not in y for s in x) <= 2
    assert one.select(fingerprints.first_edit(F.lit(a), F.lit(b))).head()[0] == text.index("Paragraph 90")

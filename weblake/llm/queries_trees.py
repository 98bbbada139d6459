"""Registered queries of the operators on Merkle trees (11, 12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.llm import fingerprints, manifest

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under one root; every fifth one by the checksum of its id is read with a changed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(changed, manifest.leaf([*fields, F.translate("text", UPPER, LOWER)]))
    rows = docs.select("doc_id", "source", manifest.leaf([*fields, F.col("text")]).alias("leaf"), tampered.alias("tampered"))
    proven = manifest.with_proofs(rows, carry=("tampered",))
    read = proven.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return read.select("doc_id", "leaf", "subroot", "root", manifest.digest(manifest.proof_text(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (op11_merkle_fingerprints, op12_merkle_manifest)}

_H = "list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))"
_FIELD = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", "n_chars", text))) + ")"
ORACLES = {
    "op12_merkle_manifest": f"""
    WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    d AS (SELECT row_number() OVER (ORDER BY doc_id, source) AS r, doc_id, coalesce('=' || source, '-') AS tree, {_LEAF("text")} AS leaf,
                 CASE WHEN xor({_H}, 4294967295) % 5 = 0 THEN {_LEAF(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered FROM documents, crc),
    l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
    up AS (SELECT tree, 0 AS level, pos, n, leaf AS h FROM l
           UNION ALL SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, level, pos // 16, n),
    tops AS (SELECT tree, level, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
    high AS (SELECT 0 AS level, pos, n, h FROM tops
             UNION ALL SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 16, n),
    kin AS (SELECT tree, level, pos // 16 AS parent, list(h ORDER BY pos) AS hs FROM up WHERE n > 1 GROUP BY ALL
            UNION ALL SELECT '', level, pos // 16, list(h ORDER BY pos) FROM high WHERE n > 1 GROUP BY ALL),
    steps AS (SELECT tree, level, parent, list_transform(range(1, len(hs) + 1), lambda i: [array_to_string(hs[1:i - 1], ''), array_to_string(hs[i + 1:], '')]) AS sides FROM kin),
    low AS (SELECT r, tree, 0 AS level, pos, coalesce(tampered, leaf) AS h, '' AS proof FROM l
            UNION ALL SELECT r, tree, level + 1, pos // 16, sha256(sides[pos % 16 + 1][1] || h || sides[pos % 16 + 1][2]), proof || sides[pos % 16 + 1][1] || sides[pos % 16 + 1][2]
            FROM low JOIN steps USING (tree, level) WHERE parent = pos // 16),
    sub AS (SELECT r, low.tree, low.h, proof, tops.h AS subroot, tops.pos FROM low JOIN tops USING (tree, level)),
    rest AS (SELECT r, 0 AS level, pos, h, proof FROM sub
             UNION ALL SELECT r, rest.level + 1, pos // 16, sha256(sides[pos % 16 + 1][1] || h || sides[pos % 16 + 1][2]), proof || sides[pos % 16 + 1][1] || sides[pos % 16 + 1][2]
             FROM rest JOIN steps ON steps.tree = '' AND steps.level = rest.level AND parent = pos // 16),
    root AS (SELECT level, h AS root FROM high WHERE n = 1)
    SELECT l.doc_id, l.leaf, sub.subroot, root.root, sha256(rest.proof) AS proof_sha256, rest.h AS folded_root, rest.h = root.root AS verified
    FROM l JOIN sub USING (r) JOIN rest USING (r) JOIN root ON rest.level = root.level
    """,
}

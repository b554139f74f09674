"""op12: Merkle manifest of all documents, one tree per language, and the proof of every row."""

from hashlib import sha256

from pyspark.sql import functions as F

from strainshift.llm.merkle import fold, leaf_digest, place, prove
from strainshift.llm.registry import query, table
from strainshift.llm.textnorm import ascii_lower

FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"
LEAF = "sha256(" + " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
# DuckDB has no crc32: the remainder is taken bit by bit over the decimal id.
CRC = ("list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: "
       "CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS BIGINT), 1)) AS BIGINT))), lambda c, b: "
       "list_reduce(list_prepend(xor(c, b), CAST(range(0, 8) AS BIGINT[])), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))")
LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, {LEAF.replace('{text}', 'text')} AS leaf, xor({CRC}, 4294967295) % 3 = 0 AS hit,
         {LEAF.replace('{text}', LOW)} AS low FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, coalesce('+' || lang, '') AS tree FROM d),
up AS (SELECT tree, 0 AS lvl, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM l
       UNION ALL
       SELECT tree, lvl + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8
       FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 8, n),
tops AS (SELECT tree, lvl AS height, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS nth FROM up WHERE n = 1),
forest AS (SELECT 0 AS lvl, nth AS pos, subroot AS digest, count(*) OVER () AS n FROM tops
           UNION ALL
           SELECT lvl + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM forest WHERE n > 1 GROUP BY lvl, pos // 8, n),
top AS (SELECT lvl AS height, digest AS root FROM forest WHERE n = 1),
runs AS (SELECT l.r, 0 AS part, u.lvl, u.pos, u.digest, l.pos // CAST(pow(8, u.lvl) AS BIGINT) = u.pos AS own
         FROM l JOIN up u ON u.tree = l.tree AND u.n > 1 AND u.pos // 8 = l.pos // CAST(pow(8, u.lvl + 1) AS BIGINT)
         UNION ALL
         SELECT l.r, 1, f.lvl, f.pos, f.digest, t.nth // CAST(pow(8, f.lvl) AS BIGINT) = f.pos
         FROM l JOIN tops t USING (tree) JOIN forest f ON f.n > 1 AND f.pos // 8 = t.nth // CAST(pow(8, f.lvl + 1) AS BIGINT)),
proof AS (SELECT r, sha256(coalesce(string_agg(digest, '' ORDER BY part, lvl, pos) FILTER (WHERE NOT own), '')) AS proof_sha256 FROM runs GROUP BY r),
steps AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY part, lvl) AS step,
                 coalesce(string_agg(digest, '' ORDER BY pos) FILTER (WHERE pos < mine), '') AS lft,
                 coalesce(string_agg(digest, '' ORDER BY pos) FILTER (WHERE pos > mine), '') AS rgt
          FROM (SELECT *, max(CASE WHEN own THEN pos END) OVER (PARTITION BY r, part, lvl) AS mine FROM runs) GROUP BY r, part, lvl),
walk AS (SELECT r, 0 AS step, CASE WHEN hit THEN low ELSE leaf END AS digest FROM d
         UNION ALL SELECT walk.r, walk.step + 1, sha256(lft || digest || rgt) FROM walk JOIN steps ON steps.r = walk.r AND steps.step = walk.step + 1),
ends AS (SELECT r, arg_max(digest, step) AS folded_root FROM walk GROUP BY r)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN tops USING (tree) JOIN ends USING (r) LEFT JOIN proof USING (r), top
"""
SCHEMA = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest_row(row, steps, subroot, root):
    proof = sha256("".join(others.hex() for _, others in steps).encode()).hexdigest()
    folded = fold(row["tampered"] or row["digest"], steps)
    return row["id"], row["digest"].hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root


@query("op12_merkle_manifest", SQL)
def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select("doc_id", "lang", leaf_digest(*rest, F.col("text")).alias("digest"),
                         F.when(chosen, leaf_digest(*rest, ascii_lower(F.col("text")))).alias("tampered"))
    return prove(place(leaves, "lang", "doc_id", "digest", ("tampered",)), digest_row, SCHEMA)

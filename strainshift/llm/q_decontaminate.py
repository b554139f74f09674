"""op1: benchmark decontamination over all documents."""

from strainshift.llm.decontaminate import contamination
from strainshift.llm.registry import query, table

SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
win AS (
  SELECT item_id, least(len(words), 13) AS width,
         array_to_string(words[s + 1 : s + 13], ' ') AS win
  FROM (SELECT *, unnest(range(0, greatest(len(words) - 13, 0) + 1)) AS s FROM b WHERE len(words) > 0)),
widths AS (SELECT DISTINCT width FROM win),
grams AS (
  SELECT doc_id, width, s, array_to_string(words[s + 1 : s + width], ' ') AS win
  FROM (SELECT *, unnest(range(0, len(words) - width + 1)) AS s
        FROM w JOIN widths ON len(words) >= width)),
hits AS (SELECT doc_id, item_id, s, g.width FROM grams g JOIN win USING (win, width)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
           FROM (SELECT doc_id, unnest(range(s, s + width)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op1_decontamination", SQL)
def op1_decontamination(spark, sf_dir):
    report = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.drop("text_hash", "spans")

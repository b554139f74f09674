"""op5: components of similar documents."""

from strainshift.llm.registry import query, table
from strainshift.llm.set_join import jaccard_components

SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(words[s + 1 : s + 5], ' ') AS gram
  FROM (SELECT *, unnest(range(0, greatest(len(words) - 5, 0) + 1)) AS s FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
often AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
shared AS (SELECT g.* FROM g SEMI JOIN often USING (gram)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shared a JOIN shared b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.size, y.size) >= 80 * greatest(x.size, y.size)
  GROUP BY a.doc_id, b.doc_id, x.size, y.size HAVING 100 * count(*) >= 80 * (x.size + y.size - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(size, 0) AS BIGINT) AS n_shingles, coalesce(least_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a) USING (doc_id)
"""


@query("op5_set_join", SQL)
def op5_set_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("component", "component_id")

"""op11: the rule ledger of all documents, and the verdict of a policy on it."""

from pyspark.sql import functions as F

from strainshift.llm.registry import query, table
from strainshift.llm.rule_ledger import fails, ledger
from strainshift.session import materialise

POLICY = "prose-1"
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
blank AS (SELECT chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS b),
w AS (SELECT doc_id, row_number() OVER () AS r, text, translate(text, b, '') AS solid,
             list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: translate(x, b, '') <> '') AS lines FROM t, blank),
g AS (SELECT r, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] AS gram
      FROM (SELECT r, words, unnest(range(0, len(words) - 2)) AS i FROM w WHERE len(words) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(solid) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_capitals,
             CAST(length(text) - length(translate(text, '0123456789', '')) AS BIGINT) AS n_digits,
             CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN covered USING (r)),
f AS (SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 100 * n_dup_lines > 50 * n_lines,
                 word_chars < 2 * n_words, word_chars > 15 * n_words, 100 * n_capitals > 50 * word_chars, 100 * n_digits > 50 * word_chars] AS bad FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad[1] OR bad[2] AS base_failed,
       NOT list_bool_or(bad) AS kept,
       CAST(list_sum(list_transform(bad, lambda x, i: CASE WHEN x THEN CAST(pow(2, i - 1) AS BIGINT) ELSE 0 END)) AS BIGINT) AS fail_bits
FROM f
"""


@query("op11_rule_ledger", SQL)
def op11_rule_ledger(spark, sf_dir):
    stored = materialise(ledger(table(spark, sf_dir, "documents")))
    return stored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         fails("base-1").alias("base_failed"), (~fails(POLICY)).alias("kept"), "fail_bits")

"""op6: all pages through the content-addressed archive and back."""

from pyspark.sql import functions as F

from strainshift.llm.registry import query, table
from strainshift.llm.warc_store import new_archive, read_archive, write_archive

SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
             CAST(unhex(sha1(body)) AS BIT) :: VARCHAR AS bits FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY bits) AS head FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS INT)
           * CAST(pow(2, 4 - j) AS INT))) AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM g
"""


@query("op6_warc_store", SQL)
def op6_warc_store(spark, sf_dir):
    path = new_archive(spark)
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select(
        F.col("page").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to")

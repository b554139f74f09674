"""op4: secrets in all documents."""

from pyspark.sql import functions as F

from strainshift.llm.registry import query, table
from strainshift.llm.secrets_scan import BASE_RULES, scan_secrets


@query("op4_secrets")
def op4_secrets(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("found")).alias("spans"))

"""op8: quality scores of all documents."""

from pyspark.sql import functions as F

from strainshift.llm.factor_machine import held_out, score_documents, train
from strainshift.llm.registry import query, table

THRESHOLD = 0.3


@query("op8_factor_machine")
def op8_factor_machine(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

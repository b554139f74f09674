"""From raw documents to sampled token ids, in five stages over the whole table.

1. quality: a factorisation machine scores every text; what it rejects goes.
2. near_copies: of each group that the Jaccard join links, the smallest doc_id stays.
3. decontaminate: documents contaminated by benchmark passages go.
4. secrets: secrets are cut out of the texts; texts without any stay as they are.
5. pieces: sampled SentencePiece segmentations of every text, with their ids.

All but the last return the columns of documents. Each stage's result is written to the
shared folder and read again. Rows without a doc_id take part and are the last of their
group; of rows that repeat a doc_id and its text, one stays at stage 2.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainshift.llm.decontaminate import contamination, drop_contaminated
from strainshift.llm.factor_machine import score_documents, train
from strainshift.llm.piece_sampling import sample_segmentations
from strainshift.llm.q_quality import THRESHOLD
from strainshift.llm.registry import table
from strainshift.llm.secrets_scan import redact_secrets
from strainshift.llm.set_join import jaccard_components
from strainshift.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model, column="quality_score")
    return scored.where(F.col("quality_score") >= THRESHOLD).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go by a hash of id and text, so rows that share an id are judged by their own texts.

    Of equal ids and texts the row with the least other columns stays. Rows are told apart by
    the id and a 128-bit digest of the text besides, so a clash of hashes loses none.
    """
    key = ["doc_id", "text"]
    keyed = docs.withColumn("copy_key", F.xxhash64(*key, *[F.col(c).isNull() for c in key]))
    groups = jaccard_components(keyed, doc="copy_key").join(keyed.select("copy_key", "doc_id").distinct(), "copy_key")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "copy_key"))
    stay = groups.groupBy("component").agg(least.alias("first")).select("first.copy_key")
    rows = keyed.join(stay, "copy_key", "left_semi").groupBy("copy_key", "doc_id", F.md5("text").alias("copy_text"))
    rows = rows.agg(F.min(F.struct(*docs.columns)).alias("row"))
    return rows.select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, contamination(docs, table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontaminate", decontaminate), ("secrets", secrets), ("pieces", pieces)]
#: Scores, components over whole tables and sampled paths are no SQL; tests hold a brute-force version against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs

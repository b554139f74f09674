"""op13: tokens of two public tokenizers aligned over all documents."""

import public_tokenizers

from strainshift.llm.registry import query, table
from strainshift.llm.token_alignment import align_documents


@query("op13_token_alignment")
def op13_token_alignment(spark, sf_dir):
    rows, _ = align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                              public_tokenizers.path("piece_bpe_32k.model"))
    return rows.withColumnRenamed("doc", "doc_id")

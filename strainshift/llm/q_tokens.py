"""op7: all documents as token ids, through the file and back."""

import public_tokenizers

from strainshift.llm.registry import query, table
from strainshift.llm.token_file import digest_row, new_file, read_tokens, write_tokens


@query("op7_token_file")
def op7_token_file(spark, sf_dir):
    path = new_file(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path, digest_row, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

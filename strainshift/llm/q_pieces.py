"""op9: sampled segmentations of all documents."""

import public_tokenizers

from strainshift.llm.piece_sampling import sample_segmentations
from strainshift.llm.registry import query, table


@query("op9_piece_sampling")
def op9_piece_sampling(spark, sf_dir):
    return sample_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)

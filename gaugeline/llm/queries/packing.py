"""Query of packed token rows."""

import public_tokenizers

from gaugeline.llm.packing import pack
from gaugeline.llm.registry import query, table


@query("op2_packed_rows")
def op2_packed_rows(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

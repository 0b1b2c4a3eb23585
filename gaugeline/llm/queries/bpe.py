"""Query of BPE encoding and decoding."""

import public_tokenizers
from pyspark.sql import functions as F

from gaugeline.llm.bpe import decode, encode
from gaugeline.llm.registry import query, table


@query("op4_bpe_round_trip")
def op4_bpe_round_trip(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    digests = encoded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"))
    return decode(digests, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

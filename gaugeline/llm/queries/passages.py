"""Query of the removal of repeated passages."""

from pyspark.sql import functions as F

from gaugeline.llm.passages import RUN_WORDS, without_repeats
from gaugeline.llm.registry import query, table


@query("op7_repeated_passages")
def op7_repeated_passages(spark, sf_dir):
    kept = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), run_words=RUN_WORDS)
    words = F.aggregate(F.transform("removed", lambda r: r["words"]), F.lit(0), lambda a, b: a + b)
    return kept.select("doc_id", (F.size("removed") > 0).alias("has_repeats"), words.cast("bigint").alias("n_removed_words"), "removed", "text")

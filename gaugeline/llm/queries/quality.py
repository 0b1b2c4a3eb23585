"""Query of the quality classifier."""

from gaugeline.llm.quality import quality
from gaugeline.llm.registry import query, table


@query("op3_quality_classifier")
def op3_quality_classifier(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

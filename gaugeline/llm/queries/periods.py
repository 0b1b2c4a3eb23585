"""Query of the periodic runs."""

from pyspark.sql import functions as F

from gaugeline.llm.periods import periodic_runs
from gaugeline.llm.registry import query, table
from gaugeline.llm.rules import words_of


def with_planted(docs):
    """The contract's texts: a tenth of the documents, by a hash of their id, repeat a stretch of words."""
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary"))
    docs = docs.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, words_of(F.col("text"))))
    docs = docs.withColumns({"g": F.floor(F.col("h") / 10), "n": F.size("w").cast("bigint")})
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    # the words are bound once by the outer transform, so that they are not split again for each place
    place = lambda i: (F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")) + 1).cast("int")
    own = F.transform(F.array("w"), lambda w: F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.element_at(w, place(i))))[0]
    return docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(own, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs(with_planted(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")
    # greatest exact length / period; runs come by start and period, so an equal one later does not win
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))

"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

``base_statistics`` counts words, symbols, repeated lines and repeated word windows of whole texts
inside one row, so the texts are neither exploded nor shuffled. ``certify`` takes the labelled good
documents as holdout: for a rule and a stratum it counts how many of them each cutoff of a fixed
grid would reject, tests "more than ``alpha`` of the good documents are rejected" with the exact
binomial distribution from lax to strict until one fails, corrects the level for all rules and strata, and keeps
the strictest certified cutoff. Strata too small for any cutoff are tested together. A rule without one is off.

Defined results: a null or blank text has zero counts and fails the base rule; a null stratum is a
stratum of its own; a stratum without labels has no thresholds, so only the base rule speaks there;
label rows that occur more than once count once; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.session import cut_lineage

#: Fixed values of the contract: white space between words, and symbols.
SPACES = " \t\n\u000b\u000c\r"
SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")


@dataclass(frozen=True)
class Rule:
    """Reject where ``value`` exceeds a cutoff; ``grid`` holds the cutoffs from lax to strict."""

    name: str
    value: str
    grid: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / nullif(n_words, 0)", (2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1)),
    Rule("shouting", "n_shouts / nullif(n_words, 0)", (1.8, 1.5, 1.2, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1)),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15)),
    Rule("repeats", "n_repeat_words / nullif(n_words, 0)", (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    Rule("long_words", "word_chars / nullif(n_words, 0)", (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0)),
)


def words_of(text: Column) -> Column:
    """Words of a text as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def windows_of(words: Column) -> Column:
    """64-bit hash of every three-word window; null with fewer words."""
    return F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    )


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in a three-word
    window found at least twice), and with n_lines and n_shouts, which the thresholds use besides.

    Equal windows become neighbours by one sort of (hash, place); texts whose windows are all
    different skip it. Columns of ``docs`` that have the name of a result are replaced, all others kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in STATISTICS]
    row = docs.select(F.struct(*kept).alias("_row"), text.alias("_text"))
    marks = F.when(F.col("_text").rlike(f"[{SYMBOLS}!]"), F.regexp_replace("_text", f"[^{SYMBOLS}!]+", "")).otherwise("")
    out = row.withColumns({
        "_words": words_of(F.col("_text")),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0),
        "_marks": marks,
    })
    out = out.withColumn("_at", windows_of(F.col("_words")))
    found = F.size(F.array_distinct("_at")) < F.size("_at")
    out = out.withColumn("_at", F.when(found, F.array_sort(F.transform("_at", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = F.zip_with(
        F.slice("_at", F.lit(2), F.size("_at") - 1), F.slice("_at", F.lit(1), F.size("_at") - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)),
    )
    covered = F.array_distinct(F.flatten(F.filter(near, lambda x: x.isNotNull())))
    return out.select(
        "_row.*",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.length(F.replace("_marks", F.lit("!"), F.lit(""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("_at").isNotNull(), F.size(covered)).otherwise(0).cast("bigint").alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.length("_marks") - F.length(F.replace("_marks", F.lit("!"), F.lit("")))).cast("bigint").alias("n_shouts"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k). The term at k comes from a sum of logarithms, the others from the ratio of
    neighbours, so nothing underflows for large n. Meant for k <= n p."""
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    log_term = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.log((n - i + 1) / i)) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def down(s: Column, i: Column) -> Column:
        j = k - i + 1
        term = s["term"] * (j / (n - j + 1)) * F.lit((1 - p) / p)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    return F.exp(log_term) * F.aggregate(steps, start, down)["total"]


def certify(holdout: DataFrame, stratum: str, rules: tuple[Rule, ...] = RULES, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Cutoffs per stratum from good documents: columns ``stratum``, ``n_good``, ``pooled`` and ``cut_<rule>``
    (null: off). With probability 1 - ``delta`` at least, no stratum loses more than ``alpha`` of its
    good documents: every rule gets an equal part of ``alpha``, and the level is divided by rules and strata.

    The cutoffs of a rule are tested from lax to strict up to the first failure, which costs no more
    than one test; as a stricter cutoff never rejects fewer, those that pass are always the first ones. Strata
    too small to certify any cutoff are tested together, and the bound holds for them together."""
    share = alpha / len(rules)
    over = [F.count_if(F.expr(r.value) > F.lit(c)).alias(f"{i}_{j}") for i, r in enumerate(rules) for j, c in enumerate(r.grid)]
    counted = holdout.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n_good"), *over)
    every = counted.agg((F.lit(delta) / F.greatest(F.count(F.lit(1)) * len(rules), F.lit(1))).alias("level"))
    counted = cut_lineage(counted.join(F.broadcast(every)).withColumn("pooled", F.col("n_good") < F.ceil(F.log("level") / F.log1p(F.lit(-share)))))  # one row
    group = ["pooled", F.when(~F.col("pooled"), F.col("stratum")).alias("own")]
    pools = counted.groupBy(*group).agg(F.sum("n_good").alias("n"), F.max("level").alias("level"), *[F.sum(f"{i}_{j}").alias(f"{i}_{j}") for i, r in enumerate(rules) for j in range(len(r.grid))])
    cells = F.array(*[
        F.struct(F.lit(i).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{i}_{j}").alias("k"))
        for i, r in enumerate(rules) for j, c in enumerate(r.grid)
    ])
    tests = pools.select("pooled", "own", "n", "level", F.explode(cells).alias("t")).select("pooled", "own", "n", "level", "t.*")
    p_value = F.when(F.col("k") <= F.col("n") * F.lit(share), binomial_cdf(F.col("k"), F.col("n"), share)).otherwise(1.0)
    cuts = tests.withColumn("p_value", p_value).groupBy(F.col("pooled").alias("_pooled"), "own").agg(*[
        F.min(F.when((F.col("rule") == i) & (F.col("p_value") <= F.col("level")), F.col("cutoff"))).alias(f"cut_{r.name}") for i, r in enumerate(rules)
    ])
    same = (F.col("pooled") == F.col("_pooled")) & (F.col("pooled") | F.col("stratum").eqNullSafe(F.col("own")))
    return counted.select("stratum", "n_good", "pooled").join(F.broadcast(cuts), same).drop("_pooled", "own")  # one row per stratum


def judge(statistics: DataFrame, labels: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Rows of :func:`base_statistics` with ``base_failed``, ``broken`` (names of the rules that
    reject) and ``kept``. Good documents are those labelled quality 1 and never 0 that pass the
    base rule. ``statistics`` is read twice, so store it first."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_q")).where("_q = 1").select(F.col("doc_id").alias("_good"))
    holdout = statistics.where(~base_failed()).join(good, F.col("doc_id") == F.col("_good"), "left_semi")
    cuts = cut_lineage(certify(holdout, stratum, rules, alpha, delta)).withColumnRenamed("stratum", "_stratum").drop("n_good", "pooled")
    joined = statistics.join(cuts, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    broken = F.filter(F.array(*[F.when(F.expr(r.value) > F.col(f"cut_{r.name}"), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    out = joined.withColumns({"base_failed": base_failed(), "broken": broken})
    return out.select(*statistics.columns, "base_failed", "broken", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))

"""Query of the quality rules."""

from gaugeline.llm.registry import query, table
from gaugeline.llm.rules import RULES, base_statistics, judge
from gaugeline.session import cut_lineage

VALUES = ", ".join(f"({i}, {c}::DOUBLE)" for i, r in enumerate(RULES) for c in r.grid)
RATIOS = ", ".join(f"({r.value})::DOUBLE" for r in RULES)
BROKEN = " OR ".join(f"coalesce(v[{i + 1}] > c{i}, false)" for i in range(len(RULES)))
CUTS = ", ".join(f"min(cutoff) FILTER (WHERE rule = {i} AND p <= 0.05 / (m * {len(RULES)})) AS c{i}" for i in range(len(RULES)))
SHARE = 0.02 / len(RULES)

SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, [x for x in string_split_regex(t, '[\x20\x09-\x0D]+') if x <> ''] AS w,
        [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
g AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM n WHERE n > 1) GROUP BY r),
s AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^!]', '', 'g')) AS n_shouts
      FROM d JOIN w USING (r) LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{RATIOS}] AS v FROM s),
h AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
z AS (SELECT lang, count(*) AS n, count(*) OVER () AS m FROM h GROUP BY lang),
y AS (SELECT lang, m, n < ceil(ln(0.05 / (m * {len(RULES)})) / ln(1 - {SHARE})) AS pooled FROM z),
k AS (SELECT pooled, CASE WHEN NOT pooled THEN h.lang END AS own, any_value(m) AS m, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE v[rule + 1] > cutoff) AS k
      FROM h JOIN y ON y.lang IS NOT DISTINCT FROM h.lang, (VALUES {VALUES}) AS q(rule, cutoff) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k <= n * {SHARE} THEN list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
        + i * ln({SHARE}) + (n - i) * ln(1 - {SHARE})) for i in range(0, k + 1)]) ELSE 1 END AS p FROM k),
c2 AS (SELECT pooled, own, {CUTS} FROM p GROUP BY pooled, own),
e AS (SELECT y.lang, c2.* FROM y JOIN c2 ON c2.pooled = y.pooled AND (y.pooled OR c2.own IS NOT DISTINCT FROM y.lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({BROKEN}) AS kept
FROM b LEFT JOIN e ON b.lang IS NOT DISTINCT FROM e.lang
"""


@query("op5_quality_rules", SQL)
def op5_quality_rules(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    statistics = cut_lineage(base_statistics(documents).drop("text"))
    judged = judge(statistics, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

"""Query of the ranked lexical search."""

from gaugeline.llm.ranking import ranked
from gaugeline.llm.registry import query, table

SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
d AS (SELECT r, doc_id, t, len(t)::BIGINT AS n FROM t WHERE len(t) > 0),
z AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM d),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*)::BIGINT AS c FROM i GROUP BY ALL),
f AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY term), z),
s AS (SELECT item_id, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN d USING (r), z GROUP BY ALL),
k AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""


@query("op13_ranked_search", SQL)
def op13_ranked_search(spark, sf_dir):
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

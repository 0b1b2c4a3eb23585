"""Query of the exact top-k search."""

from pyspark.sql import functions as F

from gaugeline.llm.registry import query, table
from gaugeline.llm.topk import search

SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS x, row_number() OVER () AS r FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
k AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""


@query("op8_exact_topk", SQL)
def op8_exact_topk(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)

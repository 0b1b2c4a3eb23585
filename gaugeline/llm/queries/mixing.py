"""Query of the source mix."""

from pyspark.sql import functions as F

from gaugeline.llm.mixing import document_size, draw_mix, with_targets
from gaugeline.llm.registry import query, table
from gaugeline.session import cut_lineage

SQL = r"""
WITH d AS (SELECT doc_id, source, len([x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''])::BIGINT AS size FROM documents),
s AS (SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_id FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][source_id % 3 + 1] AS w, source_size * 3 AS full_size FROM s),
r AS (SELECT *, full_size / w AS ratio FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(full_size) OVER (ORDER BY ratio, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(w) OVER (ORDER BY ratio, source_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY ratio, source_id) AS k FROM r),
t AS (SELECT source, source_id, source_size, ceil(n_docs / 256)::BIGINT AS n_blocks,
        least(w * (SELECT level FROM l WHERE level <= ratio ORDER BY k LIMIT 1), full_size::DOUBLE) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
k AS (SELECT d.*, p.*, ('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
a AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source_id ORDER BY key % n_blocks, key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM k)
SELECT doc_id, size, source_size, target, (size * (passes + (2 * ahead + size <= 2 * (target - passes * source_size))::INT))::BIGINT AS taken FROM a
"""


@query("op10_source_mix", SQL)
def op10_source_mix(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    sized = cut_lineage(documents.select("doc_id", "source", document_size(F.col("text")).alias("size")))
    drawn = draw_mix(sized, with_targets(sized))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("drawn")).cast("bigint").alias("taken"))

"""Query of the replica audit: pages as WARC records against a replica with planted damage."""

from pyspark.sql import functions as F

from gaugeline.llm.registry import query, table
from gaugeline.llm.warc import audit, catalogue, damaged, records_of

SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, md5(page_id::VARCHAR || chr(10) || coalesce(url, '') || chr(10) || coalesce(html, '')) AS m FROM pages),
r AS (SELECT page_id, printf('pages-%013d.warc', page_id // 4096) AS file, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS record_id,
       url, html FROM p),
t AS (SELECT page_id, file, record_id, 'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:uuid:' || record_id || '>' || e || 'WARC-Date: 2024-01-01T00:00:00Z' || e || 'WARC-Target-URI: ' || url || e
       || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(html) || e || e || html || e || e AS record FROM r, (SELECT chr(13) || chr(10) AS e)),
b AS (SELECT *, CASE WHEN page_id % 53 = 1 THEN left(record, length(record) - 9) WHEN page_id % 47 = 2 THEN left(record, length(record) - 5) || '~' || right(record, 4) ELSE record END AS other,
       CASE page_id % 97 WHEN 3 THEN page_id + 1 WHEN 4 THEN page_id - 1 ELSE page_id END AS place, unnest(CASE WHEN page_id % 89 = 5 THEN [1, 2] ELSE [1] END) AS copy FROM t),
a AS (SELECT file, record_id, page_id, 1 AS copy, strlen(record)::BIGINT AS length, sha256(record) AS digest, coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM t),
x AS (SELECT file, record_id, page_id, copy, strlen(other)::BIGINT AS length, sha256(other) AS digest, coalesce(sum(strlen(other)) OVER (PARTITION BY file ORDER BY place, record_id, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM b WHERE page_id % 61 <> 0),
m AS (SELECT a.file, a.page_id, a."offset", a.length, x."offset" AS replica_offset, x.length AS replica_length, a.digest, x.digest AS replica_digest,
       row_number() OVER (PARTITION BY a.file ORDER BY a."offset") AS pa, row_number() OVER (PARTITION BY a.file ORDER BY x."offset") AS pr FROM a JOIN x USING (file, record_id, copy)),
v AS (SELECT *, CASE WHEN digest <> replica_digest THEN 'changed' WHEN pa <> pr THEN 'moved' WHEN "offset" <> replica_offset THEN 'shifted' END AS verdict FROM m),
s AS (SELECT *, pa - row_number() OVER (PARTITION BY file, replica_offset - "offset" ORDER BY pa) AS run FROM v WHERE verdict = 'shifted')
SELECT file, page_id, "offset", length, replica_offset, replica_length, digest, replica_digest, verdict, 1::BIGINT AS n_records FROM v WHERE verdict IN ('changed', 'moved')
UNION ALL SELECT file, arg_min(page_id, "offset"), min("offset"), sum(length)::BIGINT, min(replica_offset), sum(replica_length)::BIGINT, NULL, NULL, 'shifted', count(*)::BIGINT FROM s GROUP BY file, replica_offset - "offset", run
UNION ALL SELECT file, page_id, "offset", length, NULL, NULL, digest, NULL, 'missing', 1 FROM a ANTI JOIN x USING (file, record_id, copy)
UNION ALL SELECT file, page_id, NULL, NULL, "offset", length, NULL, digest, 'duplicate', 1 FROM x ANTI JOIN a USING (file, record_id, copy)
"""


@query("op9_warc_audit", SQL)
def op9_warc_audit(spark, sf_dir):
    records = records_of(table(spark, sf_dir, "pages"))
    return audit(catalogue(records), catalogue(damaged(records, F.col("page_id"))))

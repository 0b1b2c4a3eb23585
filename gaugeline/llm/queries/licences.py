"""Query of the licence scan. The table has no paths, so documents are filed by source, language and
number, at one to four levels; a document that opens with a licence statement is a licence file."""

from pyspark.sql import functions as F

from gaugeline.llm.licences import PARAGRAPH_ENDS, RESERVED, TEMPLATES, UNIT_ENDS, WINDOW, headers, licensed, terms_of, vocabulary
from gaugeline.llm.registry import query, table
from gaugeline.session import cut_lineage

OPENS = r"^[^\n]*(?i:licen[cs]e|rights reserved)"
WORDS = ", ".join(f"({i}, '{name}', '{t}', {terms_of(text).count(t)}, {int(t in naming.split())})" for i, (name, naming, text) in enumerate(TEMPLATES) for t in sorted(set(terms_of(text))))
KNOWN = ", ".join(f"'{t}'" for t in vocabulary(TEMPLATES))

SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, CASE WHEN doc_id % 4 > 0 THEN lang END, CASE WHEN doc_id % 4 > 1 THEN (doc_id // 1000)::VARCHAR END,
    CASE WHEN doc_id % 4 > 2 THEN (doc_id // 100)::VARCHAR END, CASE WHEN regexp_matches(text, '{OPENS}') THEN 'LICENSE-' ELSE 'doc-' END || doc_id || '.txt') AS path FROM documents),
t AS (SELECT * FROM (VALUES {WORDS}) AS t(id, licence, term, tf, naming)),
n AS (SELECT count(*) AS n FROM d),
f AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM d) WHERE term IN ({KNOWN}) GROUP BY term),
w AS (SELECT DISTINCT t.term, ln((1 + n) / (1 + coalesce(df, 0))::DOUBLE) + 1 AS w FROM t CROSS JOIN n LEFT JOIN f ON f.term = t.term),
v AS (SELECT id, licence, term, tf * w / sqrt(sum(tf * w * tf * w) OVER (PARTITION BY id)) AS v, w, naming, sum(naming) OVER (PARTITION BY id) AS names FROM t JOIN w USING (term)),
u AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '{UNIT_ENDS}', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_matches(lower(x), '[a-z0-9]')) AS us FROM d),
x AS (SELECT doc_id, i AS spot, k AS units, array_to_string(us[i : i + k - 1], ' ') AS x FROM (SELECT doc_id, us, unnest(range(1, len(us) + 1)) AS i FROM u) CROSS JOIN (SELECT unnest(range(1, {WINDOW + 1})) AS k) WHERE i + k - 1 <= len(us)
  UNION ALL SELECT doc_id, unnest(range(0, len(ps))), 0, unnest(ps) FROM (SELECT doc_id, string_split_regex(text, '{PARAGRAPH_ENDS}') AS ps FROM d)
  UNION ALL SELECT doc_id, 0, -1, text FROM d WHERE path LIKE '%LICENSE-%'),
k AS (SELECT doc_id, spot, units, term, count(*) AS tf FROM (SELECT doc_id, spot, units, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS term FROM x) GROUP BY ALL),
m AS (SELECT doc_id, spot, units, sum(tf)::DOUBLE AS words FROM k GROUP BY ALL),
c AS (SELECT k.doc_id, k.spot, k.units, id, licence, round(sum(k.tf * v * w) / sqrt(any_value(words) + sum(pow(k.tf * w, 2) - k.tf)), 9) AS cosine FROM k JOIN v USING (term)
  JOIN m ON m.doc_id = k.doc_id AND m.spot = k.spot AND m.units = k.units GROUP BY ALL HAVING sum(naming) = any_value(names)),
h AS (SELECT doc_id, licence, cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY licence = '{RESERVED}', cosine DESC, licence) AS r FROM c WHERE cosine >= 0.7) WHERE r = 1),
p AS (SELECT d.doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, licence, cosine FROM d LEFT JOIN h USING (doc_id)),
g AS (SELECT folder, licence, path FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY cosine DESC, path, licence) AS r FROM p WHERE licence IS NOT NULL AND path LIKE '%LICENSE-%') WHERE r = 1),
a AS (SELECT p.doc_id, g.licence, g.path, row_number() OVER (PARTITION BY p.doc_id ORDER BY length(g.folder) DESC) AS r FROM p JOIN g ON p.folder = g.folder OR g.folder = '' OR starts_with(p.folder, g.folder || '/'))
SELECT p.doc_id, p.path, coalesce(p.licence, a.licence) AS licence, CASE WHEN p.licence IS NOT NULL THEN 'header' WHEN a.licence IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN p.licence IS NULL THEN a.path END AS inherited_from, round(p.cosine, 6) AS cosine
FROM p LEFT JOIN a ON a.doc_id = p.doc_id AND a.r = 1
"""


@query("op6_licence_scan", SQL)
def op6_licence_scan(spark, sf_dir):
    level = lambda n, value: F.when(F.col("doc_id") % 4 > n, value)
    number = lambda per: F.floor(F.col("doc_id") / per).cast("string")
    name = F.concat(F.when(F.col("text").rlike(OPENS), "LICENSE-").otherwise("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.concat_ws("/", "source", level(0, F.col("lang")), level(1, number(1000)), level(2, number(100)), name)
    files = table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    found = cut_lineage(headers(files, path="path").drop("text"))
    return licensed(found).select("doc_id", "path", "licence", "origin", "inherited_from", F.round("header.cosine", 6).alias("cosine"))

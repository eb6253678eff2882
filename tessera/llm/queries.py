"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm import encoding, leaks, packing, pairs, residue, terms, truncation, vectors

QUERIES = {
    "p1_found": vectors.p1_found,
    "p2_found": pairs.p2_found,
    "p3_found": truncation.p3_found,
    "p3_sources": truncation.p3_sources,
    "p4_found": encoding.p4_found,
    "p4_restored": encoding.p4_restored,
    "p5_found": terms.p5_found,
    "p6_packed": packing.p6_packed,
    "p6_unused": packing.p6_unused,
    "p7_found": leaks.p7_found,
    "p8_found": residue.p8_found,
}

_IMAGES = r"""
rows0 AS (SELECT lower(replace(image_path, '\', '/')) AS image, unnest(CASE WHEN len(classes) > 0 THEN classes ELSE [NULL] END) AS label
          FROM graph_records WHERE image_path IS NOT NULL),
shown AS (SELECT DISTINCT image, lower(regexp_replace(label, '^\s+|\s+$', '', 'g')) AS label FROM rows0 WHERE regexp_replace(label, '^\s+|\s+$', '', 'g') <> ''),
images AS (SELECT count(DISTINCT image) AS n FROM rows0)"""

SQL = {
    "p1_found": """
WITH usable AS (SELECT representative_image AS id, arg_max(embedding, indexed_at)::DOUBLE[64] AS v FROM store_rows
                WHERE representative_image IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
                  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
                GROUP BY 1),
near AS (SELECT a.id AS a, b.id AS b, array_cosine_similarity(a.v, b.v) AS s FROM usable a JOIN usable b ON a.id <> b.id WHERE array_cosine_similarity(a.v, b.v) >= 0.92),
ranked AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM near)
SELECT DISTINCT least(a, b) AS image_a, greatest(a, b) AS image_b FROM ranked WHERE r <= 10""",
    "p2_found": f"""
WITH {_IMAGES},
single AS (SELECT label, count(*) AS n FROM shown GROUP BY 1),
pair AS (SELECT a.label AS class_a, b.label AS class_b, count(*) AS n FROM shown a JOIN shown b ON a.image = b.image AND a.label < b.label GROUP BY 1, 2)
SELECT class_a, class_b FROM pair JOIN single ca ON ca.label = class_a JOIN single cb ON cb.label = class_b, images
WHERE pair.n >= 10 AND pair.n * images.n >= 4 * ca.n * cb.n""",
    "p5_found": f"""
WITH {_IMAGES},
labels AS (SELECT label AS term, count(*) AS n FROM shown GROUP BY 1),
hits AS (SELECT DISTINCT hit_id, caption FROM folder_hits WHERE hit_id IS NOT NULL),
words AS (SELECT lower(t) AS term, count(DISTINCT hit_id) AS n FROM (SELECT hit_id, unnest(regexp_extract_all(caption, '[0-9A-Za-z가-힣]+')) AS t FROM hits) GROUP BY 1),
total AS (SELECT count(DISTINCT hit_id) AS n FROM hits)
SELECT 'classes' AS field, term, CASE WHEN labels.n < 3 THEN 'rare' ELSE 'common' END AS mark FROM labels, images WHERE labels.n < 3 OR 5 * labels.n > images.n
UNION ALL
SELECT 'caption', term, CASE WHEN words.n < 3 THEN 'rare' ELSE 'common' END FROM words, total WHERE words.n < 3 OR 5 * words.n > total.n""",
}

"""DuckDB SQL for those training-data queries that SQL can express on whole tables."""

from __future__ import annotations

_CURRENT_PAGES = "SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY book_id, page_num ORDER BY updated_at DESC) = 1"

_COLUMNS = ("filename", "title", "source_relpath", "extractor", "quality_expected_language", "quality_detected_script")
_FILLED = ", ".join(f"coalesce(trim({c}), '') <> '' AS h_{c}" for c in _COLUMNS)

ORACLES = {
    "p1_found": rf"""
        WITH cur AS ({_CURRENT_PAGES})
        SELECT book_id, page_num,
               CASE WHEN regexp_matches(content, '[^ \t\r\n]{{1000}}[^ \t\r\n]') THEN 'hard' ELSE 'soft' END AS cut
        FROM cur WHERE length(trim(content, E' \t\r\n')) > 1000""",
    "p4_found": f"""
        WITH b0 AS (SELECT * FROM books QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY updated_at DESC) = 1),
        f AS (SELECT * FROM book_families QUALIFY row_number() OVER (PARTITION BY family_key ORDER BY updated_at DESC) = 1),
        b AS (SELECT *, {_FILLED},
            CASE lower(trim(review_status)) WHEN 'approved' THEN 3 WHEN 'approved_auto' THEN 3 WHEN 'approved_manual' THEN 3 WHEN 'approved_lease' THEN 3
                 WHEN 'pending_review' THEN 2 WHEN 'rejected' THEN 1 ELSE 0 END AS r1,
            CASE lower(trim(quality_status)) WHEN 'ok' THEN 3 WHEN 'warn' THEN 2 WHEN 'quarantine' THEN 1 ELSE 0 END AS r2,
            CASE WHEN lower(trim(source_type)) IN ('txt','html','docx','epub') THEN 3 WHEN lower(trim(source_type)) IN ('pdf','doc','ibooks') THEN 2 ELSE 0 END AS r3
            FROM b0),
        m AS (SELECT family_key, b.*, {" + ".join(f"h_{c}::int" for c in _COLUMNS)} AS r4
              FROM f JOIN b ON nullif(trim(b.content_hash), '') = f.content_hash OR nullif(trim(b.text_hash), '') = f.text_hash),
        s AS (SELECT * FROM m WHERE EXISTS (SELECT 1 FROM m o WHERE o.family_key = m.family_key AND o.book_id <> m.book_id)
              AND NOT EXISTS (SELECT 1 FROM m o WHERE o.family_key = m.family_key AND o.book_id <> m.book_id AND
                (o.r1 > m.r1 OR o.r2 > m.r2 OR o.r3 > m.r3 OR o.r4 > m.r4 OR o.updated_at > m.updated_at
                 OR NOT (m.r1 > o.r1 OR m.r2 > o.r2 OR m.r3 > o.r3 OR m.r4 > o.r4 OR m.updated_at > o.updated_at))))
        SELECT family_key, 'record' AS field_name, book_id FROM s
        {" ".join(f"UNION ALL SELECT s.family_key, '{c}', m.book_id FROM s JOIN m USING (family_key) WHERE NOT s.h_{c} AND m.h_{c}" for c in _COLUMNS)}""",
    "p3_found": rf"""
        WITH t AS (SELECT book_id, lower(string_agg(coalesce(content, ''), chr(10) ORDER BY page_num)) AS t FROM ({_CURRENT_PAGES}) GROUP BY 1),
        w AS (SELECT book_id, regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM t),
        s AS (SELECT DISTINCT book_id, unnest(list_transform(range(1, len(w) - 2), lambda i: list_aggregate(w[i:i + 3], 'string_agg', ' '))) AS s FROM w WHERE len(w) >= 50),
        n AS (SELECT book_id, count(*) AS n FROM s GROUP BY 1),
        o AS (SELECT x.book_id AS a, y.book_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.book_id < y.book_id GROUP BY 1, 2)
        SELECT a AS book_id_a, b AS book_id_b FROM o JOIN n x ON x.book_id = a JOIN n y ON y.book_id = b WHERE 2 * c >= x.n + y.n - c""",
}

"""Parts of DuckDB SQL that several queries share."""

from __future__ import annotations

SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
FOLD = """WITH RECURSIVE s AS (SELECT doc_id, s, list_transform(s, lambda x: length(x)) AS n FROM (SELECT doc_id, {sentences} AS s FROM documents)),
r(doc_id, i, b, size, cb, ce) AS (SELECT doc_id, 0, 0, 0, -1, -1 FROM s UNION ALL
SELECT r.doc_id, r.i + 1, CASE WHEN r.size + s.n[r.i + 1] > 600 AND r.i > r.b THEN greatest(r.i - 1, r.b) ELSE r.b END,
CASE WHEN r.size + s.n[r.i + 1] > 600 AND r.i > r.b THEN s.n[r.i] + s.n[r.i + 1] ELSE r.size + s.n[r.i + 1] END,
CASE WHEN r.size + s.n[r.i + 1] > 600 AND r.i > r.b THEN r.b ELSE -1 END, r.i FROM r JOIN s USING (doc_id) WHERE r.i < len(s.s))"""
BITS = " | ".join(f"(CASE WHEN sum(CASE WHEN (h >> {b}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN {'(1::UBIGINT << 63)' if b == 63 else f'{1 << b}::UBIGINT'} ELSE 0::UBIGINT END)" for b in range(64))
PRINTS = f"""f0 AS (SELECT doc_id AS id, ('0x' || substring(md5(w), 17, 16))::UBIGINT AS h FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents)),
f AS (SELECT d.doc_id AS id, coalesce(x.fp, 0::UBIGINT) AS fp FROM documents d LEFT JOIN (SELECT id, {BITS} AS fp FROM f0 GROUP BY id) x ON d.doc_id = x.id)"""

"""SQL that must give the same rows, where SQL can."""

_LINKS = r"""
WITH RECURSIVE rec AS (SELECT DISTINCT idx, file_name, duplicate_of, dup_group_id FROM dedup_record),
named AS (SELECT lower(trim(regexp_extract(trim(file_name), '[^/\\]*$'))) AS k, idx FROM rec),
e0 AS (
  SELECT r.idx AS a, n.idx AS b FROM rec r JOIN named n ON lower(trim(regexp_extract(trim(r.duplicate_of), '[^/\\]*$'))) = n.k WHERE n.k <> ''
  UNION SELECT r.idx, min(s.idx) FROM rec r JOIN rec s USING (dup_group_id) WHERE r.dup_group_id > 0 GROUP BY r.idx),
e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b),
reach(idx, other) AS (SELECT a, a FROM e UNION SELECT r.idx, e.b FROM reach r JOIN e ON r.other = e.a),
g AS (SELECT idx, min(other) AS group_idx FROM reach GROUP BY idx)
"""

_RANKED = _LINKS + r""",
m AS (SELECT DISTINCT g.group_idx, r.idx, r.mtime,
  coalesce(list_position(['failed', 'ocr', 'pdfplumber', 'native_fitz'], lower(trim(r.extraction_method))), 0) AS m,
  CASE WHEN r.text_len >= 0 THEN r.text_len ELSE -1 END AS t, CASE WHEN r.size_bytes >= 0 THEN r.size_bytes ELSE -1 END AS s
  FROM g JOIN dedup_record r USING (idx)),
b AS (SELECT group_idx, max(m) AS m, max(t) AS t, max(s) AS s FROM m GROUP BY group_idx)
"""

ORACLES: dict[str, str] = {
    "p2_found": _LINKS + "SELECT idx, group_idx FROM g",
    "p1_found": _RANKED
    + """SELECT group_idx, idx FROM (SELECT m.*, row_number() OVER (PARTITION BY group_idx ORDER BY mtime DESC NULLS LAST, idx) AS n
    FROM m JOIN b USING (group_idx, m, t, s)) WHERE n = 1""",
}


ORACLES["p5_found"] = """
WITH d AS (SELECT DISTINCT idx, doc_type, text_norm FROM dedup_record WHERE doc_type IS NOT NULL AND length(text_norm) >= 80),
w AS (SELECT DISTINCT idx, doc_type, unnest(string_split(text_norm, ' ')) AS word FROM d),
x AS (SELECT * FROM w WHERE word <> ''),
n AS (SELECT idx, count(*) AS n FROM x GROUP BY idx),
c AS (SELECT a.idx AS idx_a, b.idx AS idx_b, count(*) AS common FROM x a JOIN x b ON a.doc_type = b.doc_type AND a.word = b.word AND a.idx < b.idx GROUP BY ALL)
SELECT idx_a, idx_b FROM c JOIN n p ON p.idx = idx_a JOIN n q ON q.idx = idx_b WHERE common * 5 >= (p.n + q.n - common) * 4"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

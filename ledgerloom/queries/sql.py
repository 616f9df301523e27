"""Pieces of SQL that several oracles share."""

HOLDERS = "(contains(p, '주주에 관한 사항') OR contains(p, 'Holders'))"
HOLDER_ITEMS = "('자산총계', '부채총계', '자본총계', '매출액', '영업이익', '당기순이익')"


def day(c: str) -> str:
    return f"""CASE WHEN regexp_matches({c}, '^\\s*[0-9]{{8}}\\s*$') THEN trim({c})
      WHEN regexp_matches({c}, '^\\s*[0-9]{{4}}[^0-9]+[0-9]{{1,2}}[^0-9]+[0-9]{{1,2}}[^0-9]*$') THEN
        regexp_extract({c}, '([0-9]{{4}})', 1) || lpad(regexp_extract({c}, '[0-9]{{4}}[^0-9]+([0-9]{{1,2}})', 1), 2, '0') || lpad(regexp_extract({c}, '[0-9]{{4}}[^0-9]+[0-9]{{1,2}}[^0-9]+([0-9]{{1,2}})', 1), 2, '0') END"""


#: facts with day and third (value of another party, null where unknown).
FACTS = f"""f AS (SELECT *, {day("filing_date")} AS day,
  (value_owner IS NOT NULL AND value_owner <> company) OR (list_bool_or(list_transform(section_path, lambda p: {HOLDERS})) AND key_norm IN {HOLDER_ITEMS}) AS third FROM facts)"""

#: Documents of the catalogue with their place in a correction chain, one row each.
DOCS = f"""docs AS (
  SELECT m.doc_id AS report_id, m.corp_name AS company, m.doc_group, m.doc_subtype, m.report_nm, m.is_correction, m.rcept_dt AS day,
    CASE WHEN m.base_year IS NOT NULL AND m.base_month IS NOT NULL THEN printf('%04d-%02d', m.base_year, m.base_month) END AS period,
    c.correction_group_id, c.correction_order, c.is_latest
  FROM (SELECT DISTINCT ON (doc_id) * FROM manifest ORDER BY doc_id, corp_name) m LEFT JOIN corrections c ON m.doc_id = c.doc_id)"""

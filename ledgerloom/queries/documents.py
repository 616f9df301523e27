"""Queries from markup to chunks. The test tables hold no raw filings, so filings are written from facts first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import chunking, extraction
from ledgerloom.operators import facts as fact_gates
from ledgerloom.queries.calculations import ORACLES as CALCULATIONS
from ledgerloom.sources import markup
from ledgerloom.session import keep, table


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def filings(spark, d):
    """doc_id, doc_group, text: every filing's facts as sections of key-value tables."""
    f = table(spark, d, "facts").where("key IS NOT NULL AND value_text IS NOT NULL")
    code = F.coalesce(F.concat(F.lit(' acode="'), F.col("field_code"), F.lit('"')), F.lit(""))
    row = F.concat(F.lit("<tr><td>"), _escaped(F.col("key")), F.lit("</td><te"), code, F.lit(">"), _escaped(F.col("value_text")), F.lit("</te></tr>"))
    s = f.groupBy("doc_id", "doc_group", F.array_join("section_path", " > ").alias("section")).agg(F.array_sort(F.collect_list(F.struct("fact_id", row.alias("r")))).alias("rows"))
    part = F.concat(F.lit("<section-1><title>"), _escaped(F.col("section")), F.lit("</title><table>"), F.array_join(F.transform("rows", lambda x: x["r"]), ""), F.lit("</table></section-1>"))
    return s.groupBy("doc_id", "doc_group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", part.alias("p")))), lambda x: x["p"]), "").alias("text"))


def damaged_filings(spark, d):
    """doc_id, text: every filing's own facts as markup with row and column spans and with bare ampersands, stray less-than signs and quotes left as they are.

    A filing's facts of other parties follow in tables of their own, headed by the party's name.
    """
    f = table(spark, d, "facts").where("key IS NOT NULL AND value_text IS NOT NULL AND NOT contains(key, '<') AND NOT contains(value_text, '<')")
    code = F.concat(F.when(F.col("field_code").isNotNull(), F.concat(F.lit(' acode="'), F.col("field_code"), F.lit('"'))).otherwise(""), F.when(F.col("unit_value").isNotNull(), F.concat(F.lit(' aunitvalue="'), F.col("unit_value"), F.lit('"'))).otherwise(""))
    cells = F.concat(F.lit("<td>"), F.col("key"), F.lit("</td><te"), code, F.lit(">"), F.col("value_text"), F.lit("</te>"))
    s = f.groupBy("doc_id", F.coalesce("value_owner", F.lit("")).alias("owner"), F.col("section_path")[0].alias("section")).agg(F.array_sort(F.collect_list(F.struct("fact_id", cells.alias("r")))).alias("rows"))
    # Every third row is labelled by a cell that spans it; a note with damage stands before every table.
    first = F.concat(F.lit('<tr><td rowspan="'), F.size("rows").cast("string"), F.lit('">group</td>'), F.get("rows", F.lit(0))["r"], F.lit("</tr>"))
    others = F.transform(F.slice("rows", 2, F.size("rows")), lambda x: F.concat(F.lit("<tr>"), x["r"], F.lit("</tr>")))
    name = F.when(F.col("owner") != "", F.concat(F.lit("<table><tr><td>법인 또는 단체의 명칭</td><td>"), F.col("owner"), F.lit("</td></tr></table>"))).otherwise("")
    part = F.concat(F.lit("<p>R&D cost < 5 % of \"sales\" & more</p>"), name, F.lit("<table>"), first, F.array_join(others, ""), F.lit("</table>"))
    titled = F.concat(F.lit("<section-1><title>"), _escaped(F.coalesce("section", F.lit(""))), F.lit(" / "), _escaped(F.col("owner")), F.lit("</title>"), part, F.lit("</section-1>"))
    return s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("owner", "section", titled.alias("p")))), lambda x: x["p"]), "").alias("text"))


def _catalogue(spark, d):
    m = table(spark, d, "manifest").groupBy("doc_id").agg(F.min_by(F.struct("corp_name", "corp_code", "doc_group", "doc_subtype", "report_nm", "rcept_dt", "base_year", "base_month", "is_correction"), "corp_name").alias("m"))
    return m.select("doc_id", "m.*").join(table(spark, d, "corrections").groupBy("doc_id").agg(F.max("is_latest").alias("is_latest"), F.max("correction_group_id").alias("correction_group_id")), "doc_id", "left")


def facts_extracted(spark, d):
    """Facts read from damaged markup with spans: keys, values and owners."""
    rows = extraction.extracted(keep(markup.parsed(damaged_filings(spark, d)), "nodes"), _catalogue(spark, d))
    # A table that names its party is a fact of it too.
    rows = rows.where(~F.col("key").isin(extraction.OWNER_KEYS))
    return rows.groupBy("doc_id", "company", "period", "key", "key_norm", "value_text", "value_num", "value_date", "field_code", "value_owner").agg(F.count("*").alias("n"))


def owners_of_facts(spark, d):
    """Whose every fact is, where it isn't stored by what its section and chunk tell."""
    return extraction.owners_stated(table(spark, d, "facts")).select("fact_id", "value_owner", "value_owner_is_company")


def _nodes(spark, d):
    return markup.parsed(filings(spark, d))


def parse_pages(spark, d):
    """Key-value pairs read back from the markup."""
    n = _nodes(spark, d).where("kind = 'pairs'").select("doc_id", F.element_at("section_path", 1).alias("section"), F.explode("pairs").alias("p"))
    return n.select("doc_id", "section", "p.key", "p.value", "p.field_code").groupBy("doc_id", "section", "key", "value", "field_code").agg(F.count("*").alias("n"))


def chunk_filings(spark, d):
    return chunking.chunk_markup(filings(spark, d)).select("chunk_id", "report_id", "parent_chunk_id", "content_type", F.length("text").alias("n_chars"))


def chunk_nodes(spark, d):
    """The same from a table of nodes."""
    f = keep(filings(spark, d), "filings")
    return chunking.chunks(markup.parsed(f), f.select("doc_id", "doc_group")).select("chunk_id", "report_id", "parent_chunk_id", "content_type", F.length("text").alias("n_chars"))


def leaf_rows(spark, d):
    rows = keep(chunking.chunk_markup(filings(spark, d)), "chunks")
    return chunking.leaves(rows).groupBy("report_id").agg(F.count("*").alias("n_leaves"), F.sum(chunking.tokens_column(F.col("text"))).alias("n_tokens"))


def field_code_refs(spark, d):
    return chunking.field_refs(_nodes(spark, d)).groupBy("ref.field_code").agg(F.count("*").alias("n"))


def fixed_window_chunks(spark, d):
    w = chunking.fixed_windows(table(spark, d, "documents"), "doc_id", "text")
    return w.select("doc_id", "window", F.md5("text").alias("digest"))


def split_long_texts(spark, d):
    """Every chunk text in pieces; most are one."""
    e = table(spark, d, "examples").where("text IS NOT NULL").select("chunk_id", "text").distinct()
    return chunking.split_texts(e, "chunk_id", "text").select("id", "piece", F.length("text").alias("n_chars"))


QUERIES = {f.__name__: f for f in (parse_pages, facts_extracted, owners_of_facts, chunk_filings, chunk_nodes, leaf_rows, field_code_refs, fixed_window_chunks, split_long_texts)}
_BLANKS = r"[ \t\r\f\v\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+"
def _squeezed(column: str) -> str:
    return f"trim(regexp_replace({column}, '{_BLANKS}', ' ', 'g'))"


_NORM = CALCULATIONS["normalised_keys"].partition("SELECT key, ")[2].partition(" AS norm")[0]
#: Written out apart from the operators' lists.
_ITEM = r"(length({0}) BETWEEN 2 AND 40 AND NOT regexp_matches({0}, '^[0-9,.\-/()%\s]+$') AND length(regexp_replace({0}, '[^가-힣A-Za-z0-9]', '', 'g')) >= 2 AND NOT regexp_matches({0}, '" + fact_gates.FORM_HEADER + "'))"
_FINANCIAL = "['자산총계', '부채총계', '자본총계', '매출액', '영업이익', '당기순이익', '유동자산', '비유동자산', '유동부채', '비유동부채', '자본금', '이익잉여금', '부채와자본총계', '영업수익']"
_NO_VALUE = "('', '-', '–', '해당사항 없음', '해당사항없음', '해당없음', 'N/A', '없음', '미해당')"
ORACLES = {
    "facts_extracted": f"""WITH k AS (SELECT fact_id, doc_id, {_squeezed("key")} AS key, {_squeezed("value_text")} AS value_text, field_code, unit_value, coalesce(value_owner, '') AS owner, section_path[1] AS section
  FROM facts WHERE key IS NOT NULL AND value_text IS NOT NULL AND NOT contains(key, '<') AND NOT contains(value_text, '<')),
parsed AS ({CALCULATIONS["parse_values"].replace("FROM facts)", "FROM k)")}),
marks AS (SELECT doc_id, owner, section, count(DISTINCT list_filter({_FINANCIAL}, lambda m: contains(regexp_replace(regexp_replace(key, '\\s+', '', 'g'), '^\\[|\\]$', '', 'g'), m))[1]) AS n FROM k GROUP BY ALL),
m AS (SELECT DISTINCT ON (doc_id) doc_id, corp_name, doc_group, base_year, base_month FROM manifest ORDER BY doc_id, corp_name),
j AS (SELECT k.*, {_NORM} AS key_norm, num, date, corp_name, doc_group, CASE WHEN base_year IS NOT NULL AND base_month IS NOT NULL THEN printf('%04d-%02d', base_year, base_month) END AS period,
  CASE WHEN k.owner <> '' AND n >= 2 AND k.owner <> corp_name THEN k.owner END AS value_owner
  FROM k JOIN parsed USING (fact_id) JOIN m USING (doc_id) JOIN marks ON marks.doc_id = k.doc_id AND marks.owner = k.owner AND marks.section IS NOT DISTINCT FROM k.section)
SELECT doc_id, corp_name AS company, period, key, key_norm, value_text, num AS value_num, date AS value_date, field_code, value_owner, count(*) AS n FROM j
WHERE key <> '' AND value_text NOT IN {_NO_VALUE} AND {_ITEM.format("key_norm")} AND {_ITEM.format("substr(key, 1, 40)")} AND (num IS NOT NULL OR date IS NOT NULL OR length(value_text) >= 2)
  AND NOT (doc_group = 'periodic' AND (regexp_matches(key_norm, '^[0-9,.\\-/()%\\s]+$|^[△▲▽]\\s*[+-]?[0-9,]+(?:\\.[0-9]+)?\\s*(?:원|천원|백만원|억원|조원|%|주)?$') OR (num IS NULL AND date IS NULL AND regexp_matches(key_norm, '{fact_gates.TABLE_HEADER}'))))
GROUP BY ALL""",
    "owners_of_facts": """WITH c AS (SELECT chunk_id, arg_min(value_owner, fact_id) AS owner FROM facts WHERE chunk_id IS NOT NULL AND value_owner IS NOT NULL GROUP BY 1),
t AS (SELECT f.*, c.owner, coalesce(list_bool_or(list_transform(section_path, lambda p: contains(p, '주주에 관한 사항') OR contains(p, 'Holders'))), false) AND coalesce(key IN ('자산총계', '부채총계', '자본총계', '매출액', '영업이익', '당기순이익'), false) AS third FROM facts f LEFT JOIN c USING (chunk_id))
SELECT fact_id, CASE WHEN value_owner IS NOT NULL THEN value_owner WHEN third THEN coalesce(owner, '최대주주') ELSE company END AS value_owner, CASE WHEN value_owner IS NOT NULL THEN coalesce(value_owner = company, false) ELSE NOT third END AS value_owner_is_company FROM t""",
    "parse_pages": f"""SELECT doc_id, nullif(array_to_string(section_path, ' > '), '') AS section, trim(regexp_replace(key, '{_BLANKS}', ' ', 'g')) AS key, trim(regexp_replace(value_text, '{_BLANKS}', ' ', 'g')) AS value, field_code, count(*) AS n
FROM facts WHERE key IS NOT NULL AND value_text IS NOT NULL GROUP BY ALL""",
    "field_code_refs": "SELECT field_code, count(*) AS n FROM facts WHERE key IS NOT NULL AND value_text IS NOT NULL AND field_code IS NOT NULL GROUP BY 1",
    "fixed_window_chunks": """SELECT doc_id, w::INTEGER AS "window", md5(substr(text, w * 1000 + 1, 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 1000)::BIGINT)) AS w FROM documents WHERE length(text) > 0)""",
}

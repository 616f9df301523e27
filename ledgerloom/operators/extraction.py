"""Fact rows from the nodes of parsed filings: owners, keys, values and gates as column expressions.

A node's owner is named in its own table, or carried on within the section to an unnamed table of financial items. Pairs
become facts if their key is an item's name and they state something; ambiguous values keep their text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import EMPTY_VALUES, parse_value, won_unit
from ledgerloom.functions.text import normalise_key
from ledgerloom.operators.derive import carry_owner
from ledgerloom.operators.facts import HOLDER_ITEMS, HOLDER_SECTIONS, is_meaningful_key, noise_reason

# Keys that name the party a table is about, titles of tables that do so in a column, and that column's headers.
OWNER_KEYS = ["법인 또는 단체의 명칭", "법인또는단체의명칭"]
OWNER_TITLES = ["최대주주", "법인 기본정보", "법인기본정보"]
OWNER_COLUMNS = ["명칭", "법인명", "상호", "회사명", "단체명"]
# Items by two of which a table is known to be a financial statement.
FINANCIAL_ITEMS = ["자산총계", "부채총계", "자본총계", "매출액", "영업이익", "당기순이익", "유동자산", "비유동자산", "유동부채", "비유동부채", "자본금", "이익잉여금", "부채와자본총계", "영업수익"]
# Units behind an item's name that are no amounts of money.
KEY_UNITS = ["%", "%p", "주", "명", "건", "개", "배", "년", "월", "일", "회", "기", "구좌", "좌", "포인트"]
#: What a largest holder is called where its name isn't given.
UNNAMED_HOLDER = "최대주주"
#: Rows of a table that may hold its headers.
HEADER_ROWS = 3


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def _states(c: Column) -> Column:
    return ~F.coalesce(F.trim(c), F.lit("")).isin(EMPTY_VALUES)


def key_unit(key: Column) -> Column:
    """The unit in brackets at the end of an item's name; null for any other bracket."""
    unit = F.trim(F.regexp_extract(key, r"[(（]\s*([^)）]{1,12})\s*[)）]\s*$", 1))
    return F.when((won_unit(unit) != "") | unit.isin(KEY_UNITS), unit)


def named_owner(pairs: Column) -> Column:
    """The party that a table of pairs names as its subject."""
    hit = F.filter(pairs, lambda p: F.exists(F.array(*map(F.lit, OWNER_KEYS)), lambda k: F.contains(p["key"], k)) & _states(p["value"]))
    return F.trim(F.get(hit, F.lit(0))["value"])


def financial_markers(pairs: Column) -> Column:
    """How many different financial items a table of pairs has; of an item's name the first marker counts."""
    items = F.array(*map(F.lit, FINANCIAL_ITEMS))
    first = lambda p: F.get(F.filter(items, lambda m: F.contains(F.regexp_replace(_bare(p["key"]), r"^\[|\]$", ""), m)), F.lit(0))
    return F.size(F.array_distinct(F.array_compact(F.transform(pairs, first))))


def listed_owner(grid: Column, title: Column) -> Column:
    """The name in the name column of a regular table whose title says that it is about the largest holder."""
    heads = F.slice(grid, 1, HEADER_ROWS)
    is_head = lambda c: _bare(c).isin(OWNER_COLUMNS)
    at = F.array_max(F.transform(heads, lambda r: F.array_position(F.transform(r, lambda c: F.when(is_head(c), F.lit("x")).otherwise("")), "x")))
    names = F.filter(F.transform(grid, lambda r: F.get(r, (at - 1).cast("int"))), lambda v: _states(v) & ~is_head(v))
    about = F.exists(F.array(*map(F.lit, OWNER_TITLES)), lambda t: F.contains(title, t))
    return F.when(F.coalesce(about, F.lit(False)) & (at > 0), F.trim(F.get(names, F.lit(0))))


def node_owners(nodes: DataFrame) -> DataFrame:
    """nodes with owner: the party their figures belong to, null for the filer. nodes: markup.NODE_SCHEMA."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    section = F.array_join("section_path", "\u0001")
    titled = nodes.withColumns({"ll_section": section, "ll_title": F.when(F.lag("kind").over(w) == "text", F.lag("text").over(w))})
    own = F.when(F.col("kind") == "pairs", named_owner(F.col("pairs"))).when(F.col("kind") == "table", listed_owner(F.col("grid"), F.col("ll_title")))
    marked = titled.select("doc_id", "seq", F.col("ll_section").alias("section"), own.alias("owner"), F.when(F.col("kind") == "pairs", financial_markers(F.col("pairs"))).otherwise(0).alias("n_markers"))
    carried = carry_owner(marked).select("doc_id", "seq", F.col("carried").alias("owner"))
    return nodes.join(carried, ["doc_id", "seq"])


def extracted(nodes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Facts of parsed filings in the columns of the fact table but for fact_id and chunk_id, with seq and pos, their place in the filing.

    catalogue: one row per doc_id with corp_name, corp_code, doc_group, doc_subtype, report_nm, rcept_dt, base_year,
    base_month, is_correction, is_latest, correction_group_id.
    """
    pairs = node_owners(nodes.where("kind IN ('pairs', 'table', 'text')")).where("kind = 'pairs'")
    one = pairs.select("doc_id", "seq", "section_path", F.col("label").alias("group_label"), "owner", F.posexplode("pairs").alias("pos", "p"))
    raw = one.select("*", F.trim("p.key").alias("key"), F.trim("p.value").alias("value_text"), "p.field_code", "p.unit_code", "p.unit_value").drop("p")
    raw = raw.where((F.col("key") != "") & _states(F.col("value_text")))
    raw = raw.withColumns({"key_norm": normalise_key(F.col("key")), "v": parse_value(F.col("value_text"), F.col("unit_value")), "ll_unit": key_unit(F.col("key"))})
    raw = raw.where(is_meaningful_key(F.col("key_norm")) & is_meaningful_key(F.substring("key", 1, 40)))
    rows = raw.join(catalogue, "doc_id")
    noise = F.when(F.col("doc_group") == "periodic", noise_reason(F.col("key_norm"), F.col("v.num"), F.col("v.date")))
    rows = rows.where(noise.isNull()).where("v.num IS NOT NULL OR v.date IS NOT NULL OR length(value_text) >= 2")
    unit = F.when(F.col("v.unit") == "%p", F.col("v.unit")).otherwise(F.coalesce("ll_unit", "v.unit"))
    period = F.when(F.col("base_year").isNotNull() & F.col("base_month").isNotNull(), F.format_string("%04d-%02d", "base_year", "base_month"))
    return rows.select(
        "doc_id", "seq", "pos", F.col("corp_name").alias("company"), "corp_code", "doc_group", "doc_subtype", F.col("report_nm").alias("report_name"), F.col("rcept_dt").alias("filing_date"), period.alias("period"),
        "is_correction", "is_latest", "correction_group_id", "group_label", "key", "key_norm", "value_text", F.col("v.num").alias("value_num"), unit.alias("value_unit"), F.col("v.date").alias("value_date"),
        "field_code", "unit_code", "unit_value", "section_path", F.when(F.col("owner") != F.col("corp_name"), F.col("owner")).alias("value_owner"),
    )


def with_chunks(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """facts with chunk_id: of their filing's chunks (chunk_id, report_id, text) the first, by id, that holds key and value."""
    facts = facts.drop("chunk_id")
    j = facts.join(chunks.select("chunk_id", F.col("report_id").alias("doc_id"), "text"), "doc_id").where(F.contains("text", "key") & F.contains("text", "value_text"))
    first = j.groupBy("doc_id", "seq", "pos").agg(F.min("chunk_id").alias("chunk_id"))
    return facts.join(first, ["doc_id", "seq", "pos"], "left")


def owners_stated(facts: DataFrame) -> DataFrame:
    """facts with value_owner always set and value_owner_is_company.

    A fact without a stored owner is the holder's if a holders' section states a financial item of it: then the owner that
    its chunk names first, else the unnamed holder; any other fact is the company's.
    """
    by_chunk = facts.where("chunk_id IS NOT NULL AND value_owner IS NOT NULL").groupBy("chunk_id").agg(F.min_by("value_owner", "fact_id").alias("ll_owner"))
    sections = F.array(*map(F.lit, HOLDER_SECTIONS))
    third = F.coalesce(F.exists("section_path", lambda p: F.exists(sections, lambda s: F.contains(p, s))), F.lit(False)) & F.coalesce(F.col("key").isin(HOLDER_ITEMS), F.lit(False))
    # Only facts that need an owner meet the chunks.
    need = facts.where(F.col("value_owner").isNull() & third).join(by_chunk, "chunk_id", "left")
    need = need.withColumns({"value_owner": F.coalesce("ll_owner", F.lit(UNNAMED_HOLDER)), "value_owner_is_company": F.lit(False)}).drop("ll_owner").select(*facts.columns, "value_owner_is_company")
    rest = facts.where(F.col("value_owner").isNotNull() | ~third)
    rest = rest.withColumn("value_owner_is_company", F.coalesce(F.col("value_owner") == F.col("company"), F.col("value_owner").isNull())).withColumn("value_owner", F.coalesce("value_owner", "company"))
    return rest.unionByName(need)

"""Queries of the operators for training text, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.llm import group_split, leak_search, link_names, map_values, mix_sources, residue, split_items, survivor, unify_text
from ledgerloom.session import keep, table

SPLITS = {"train": 0.70, "validation": 0.15, "test": 0.15}
LINKS = ["query_id", "company", "report_id"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify_text.disguised(table(spark, sf_dir, "facts"), "fact_id", ["company", "key"])


def p1_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts with one consistent company and key text."""
    return unify_text.unified(table(spark, sf_dir, "facts").select("fact_id", "company", "key"), ["company", "key"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_split.groups(table(spark, sf_dir, "examples"), "example_id", LINKS)


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_split.splits(p2_found(spark, sf_dir), "example_id", SPLITS)


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups and share of every split."""
    by = p2_splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("group_id").alias("n_groups"))
    total = by.agg(F.sum("n_rows").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("split", "n_rows", "n_groups", F.expr("round(n_rows / total, 4)").alias("share"))


def p2_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups, and groups that lie in more than one split."""
    by = p2_splits(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"))
    return by.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.count_if(F.col("splits") > 1).alias("n_torn"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names of companies and persons, without companies in disguised characters."""
    facts, plans = table(spark, sf_dir, "facts"), table(spark, sf_dir, "query_plans")
    odd = unify_text.canonical_values(facts, ["company"]).select(F.col("ll_value").alias("name"))
    companies = facts.select(F.col("company").alias("name")).distinct().join(odd, "name", "left_anti")
    owners = facts.select(F.col("value_owner").alias("name")).distinct()
    return companies.union(owners).union(plans.select(F.explode("company_mentions").alias("name"))).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_names.variant_pairs(_names(spark, sf_dir))


def p4_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_names.variants(_names(spark, sf_dir))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.explode(F.array("item_name", "item_name_ko")).alias("name")
    return table(spark, sf_dir, "field_items").select(F.col("field_code").alias("code"), names, F.col("doc_groups").alias("scopes"))


def p5_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "facts").where("field_code IS NULL").select("fact_id", "key", "key_norm", "doc_group")
    return map_values.mapped(facts, "fact_id", F.coalesce("key", "key_norm"), F.col("doc_group"), _items(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_mapped(spark, sf_dir).select("fact_id", F.col("code").alias("field_code"))


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed keys that stand for no listed item, with their facts."""
    facts = table(spark, sf_dir, "facts").where("field_code IS NULL").select("fact_id", "key")
    rest = p5_found(spark, sf_dir).where(F.col("field_code") == map_values.NONE)
    return facts.join(rest, "fact_id").groupBy("key").agg(F.count("*").alias("facts"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.latest_statements(table(spark, sf_dir, "facts"), table(spark, sf_dir, "manifest"))


def p6_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.merged_records(table(spark, sf_dir, "facts"), table(spark, sf_dir, "manifest"))


def p6_trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p6_merged, but filings that carry the register's company code are trusted before those keyed in by hand."""
    return survivor.merged_records(table(spark, sf_dir, "facts"), table(spark, sf_dir, "manifest"), F.col("corp_code").isNotNull())


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = split_items.pieces(table(spark, sf_dir, "examples"), "chunk_id", "text", short=False)
    return made.where("piece = 1 AND chunk_id IS NOT NULL").select("chunk_id").distinct()


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items.pieces(table(spark, sf_dir, "examples"), "chunk_id", "text", short=False)


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per chunk what its pieces hold: characters without the overlaps, the longest piece, overlaps that aren't 100 characters or don't match, and whether all text is there."""
    made = p7_pieces(spark, sf_dir).withColumn("last", F.substring("text", -split_items.OVERLAP, split_items.OVERLAP))
    # Pieces of one text follow each other by their places; a chunk may have several texts.
    nxt = made.select("chunk_id", (F.col("piece") + 1).alias("piece"), "last", F.col("end").alias("before"))
    fits = made.join(nxt.withColumnsRenamed({"last": "l", "before": "b"}), ["chunk_id", "piece"], "left").where("piece = 0 OR (b = start + 100 AND substring(text, 1, 100) = l)")
    kept = fits.select("chunk_id", "piece", "start", "end", "text").distinct()
    by = kept.groupBy("chunk_id").agg((F.sum(F.col("end") - F.col("start")) - 100 * F.count_if(F.col("piece") > 0)).alias("n_chars"), (F.max(F.length("text")) <= split_items.LIMIT).alias("short_enough"))
    return by.where("chunk_id IS NOT NULL").join(made.groupBy("chunk_id").agg(F.count("*").alias("n")), "chunk_id").join(kept.groupBy("chunk_id").agg(F.count("*").alias("m")), "chunk_id").select("chunk_id", "n_chars", "short_enough", (F.col("n") == F.col("m")).alias("overlapping"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_search.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "passage_id")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mix reaches."""
    targets = table(spark, sf_dir, "source_targets")
    return mix_sources.shares(keep(p9_mix(spark, sf_dir), "mix"), targets)


def p9_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every source of the mix meets its target, and within its repeats."""
    return mix_sources.reached(keep(p9_mix(spark, sf_dir), "mix"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.flagged(table(spark, sf_dir, "documents")).select("doc_id")


def p10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.flagged(table(spark, sf_dir, "documents"))


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.cleaned(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "n_chars", "company", "report_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_unified": p1_unified,
    "p2_found": p2_found,
    "p2_splits": p2_splits,
    "p2_shares": p2_shares,
    "p2_whole": p2_whole,
    "p4_found": p4_found,
    "p4_variants": p4_variants,
    "p5_found": p5_found,
    "p5_mapped": p5_mapped,
    "p5_unmatched": p5_unmatched,
    "p6_found": p6_found,
    "p6_merged": p6_merged,
    "p6_trusted": p6_trusted,
    "p7_found": p7_found,
    "p7_pieces": p7_pieces,
    "p7_check": p7_check,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_reached": p9_reached,
    "p10_found": p10_found,
    "p10_kinds": p10_kinds,
    "p10_clean": p10_clean,
}

_STATES = """coalesce(regexp_replace(regexp_replace(lower({0}), '^[\\s(\\[]+|[\\s)\\].]+$', '', 'g'), '\\s+', '', 'g') NOT IN ('', %s), false)""" % ", ".join(f"'{n.replace(' ', '')}'" for n in survivor.NOTHING)
_DATED = """
WITH known AS (SELECT doc_id, max(rcept_dt) AS dt FROM manifest GROUP BY doc_id),
rows AS (
  SELECT f.*, regexp_extract(f.doc_id, '_([^_]*)$', 1) AS no, k.dt,
    CASE WHEN regexp_matches(filing_date, '^\\s*[0-9]{8}\\s*$') THEN trim(filing_date)
      WHEN regexp_matches(filing_date, '^\\s*[0-9]{4}[^0-9]+[0-9]{1,2}[^0-9]+[0-9]{1,2}[^0-9]*$') THEN
        regexp_extract(filing_date, '([0-9]{4})', 1) || lpad(regexp_extract(filing_date, '[0-9]{4}[^0-9]+([0-9]{1,2})', 1), 2, '0') || lpad(regexp_extract(filing_date, '[0-9]{4}[^0-9]+[0-9]{1,2}[^0-9]+([0-9]{1,2})', 1), 2, '0') END AS own_day
  FROM facts f LEFT JOIN known k USING (doc_id)
  WHERE value_owner IS NULL AND correction_group_id IS NOT NULL AND field_code IS NOT NULL),
d AS (SELECT *, coalesce(own_day, dt, substr(no, 1, 8)) AS day FROM rows)
"""


def _best(name: str, states: str, first: str = "") -> str:
    return f"arg_max({name}, {{{first}'d': day, 'n': no, 'i': -fact_id}}) FILTER (WHERE {states}) AS {name}"


_NARROW = text.NARROW.replace("'", "''")
_FOLDED = f"trim(regexp_replace(translate(nfc_normalize(value), '{text.WIDE}{text.SPACES}', '{_NARROW}{' ' * len(text.SPACES)}'), '[\\p{{Cf}}\\x{{180E}}]', '', 'g'))"
for _from, _to in text.LIGATURES.items():
    _FOLDED = f"replace({_FOLDED}, '{_from}', '{_to}')"
_BACK = dict(reversed(list(zip(text.CYRILLIC_AS, text.CYRILLIC, strict=True))))
_BACK |= {g: _BACK[a] for g, a in zip(text.GREEK, text.GREEK_AS, strict=True) if a in _BACK}
#: Disguised values with their plain spelling. Letters of one other script that all have Latin twins are plain unless their Latin spelling occurs.
_PLAIN = f"""
WITH rows AS (SELECT fact_id, 'company' AS field, company AS value FROM facts WHERE company IS NOT NULL UNION ALL SELECT fact_id, 'key', key FROM facts WHERE key IS NOT NULL),
v AS (SELECT DISTINCT field, value FROM rows), f AS (SELECT *, {_FOLDED} AS fold FROM v),
g AS (SELECT *, regexp_matches(translate(fold, '{text.LOOKALIKE}', ''), '[\\x{{0370}}-\\x{{052F}}]') AS strange FROM f),
m AS (SELECT *, nfc_normalize(CASE WHEN strange THEN translate(fold, '{"".join(_BACK)}', '{"".join(_BACK.values())}') ELSE translate(fold, '{text.LOOKALIKE}', '{text.LATIN}') END) AS canonical,
  fold = value AND NOT strange AND NOT regexp_matches(value, '[A-Za-zÀ-ɏ가-힣]') AND (regexp_matches(value, '\\p{{Greek}}') <> regexp_matches(value, '\\p{{Cyrillic}}')) AS twin FROM g),
cases AS (SELECT field, value, canonical FROM m WHERE value <> canonical AND (NOT twin OR (field, canonical) IN (SELECT (field, value) FROM v)))
"""
_LINKED = """
WITH RECURSIVE k AS (SELECT example_id AS id, 'q' || query_id AS v FROM examples WHERE query_id IS NOT NULL UNION ALL SELECT example_id, 'c' || company FROM examples WHERE company IS NOT NULL UNION ALL SELECT example_id, 'r' || report_id FROM examples WHERE report_id IS NOT NULL),
cc(id, g) USING KEY (id) AS (
  SELECT example_id, example_id FROM examples
  UNION
  SELECT k.id, min(low) FROM k JOIN (SELECT v, min(g) AS low FROM k JOIN recurring.cc USING (id) GROUP BY v) USING (v) JOIN recurring.cc r ON r.id = k.id WHERE low < r.g GROUP BY k.id)
"""
_TEXTS, _REST = ["company", "period", "key", "value_text", "value_unit", "value_date", "unit_code", "unit_value"], ["value_num"]
_CODED = "'c': (corp_code IS NOT NULL)::INT, "
ORACLES: dict[str, str] = {
    "p6_found": _DATED
    + f"SELECT correction_group_id, field_code, {_best('fact_id', _STATES.format('value_text'))} FROM d GROUP BY ALL HAVING count(*) > 1 AND bool_or({_STATES.format('value_text')})",
    "p6_merged": _DATED
    + f"SELECT correction_group_id, field_code, count(*) AS n_records, {', '.join([*(_best(n, _STATES.format(n)) for n in _TEXTS), *(_best(n, n + ' IS NOT NULL') for n in _REST)])} FROM d GROUP BY ALL HAVING count(*) > 1",
    "p6_trusted": _DATED
    + f"SELECT correction_group_id, field_code, count(*) AS n_records, {', '.join([*(_best(n, _STATES.format(n), _CODED) for n in _TEXTS), *(_best(n, n + ' IS NOT NULL', _CODED) for n in _REST)])} FROM d GROUP BY ALL HAVING count(*) > 1",
    "p1_found": _PLAIN + "SELECT fact_id, field FROM rows JOIN cases USING (field, value)",
    "p1_unified": _PLAIN + """SELECT f.fact_id, coalesce(a.canonical, f.company) AS company, coalesce(b.canonical, f.key) AS key FROM facts f
LEFT JOIN cases a ON a.field = 'company' AND a.value = f.company LEFT JOIN cases b ON b.field = 'key' AND b.value = f.key""",
    "p2_found": _LINKED + "SELECT id AS example_id, g AS group_id FROM cc",
    # What must hold of the mix: every source that has a text is there, at its target and within its repeats.
    "p9_reached": "SELECT source, max_repeats, true AS meets, true AS within FROM source_targets t WHERE target_share > 0 AND max_repeats > 0 AND EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND length(d.text) > 0)",
    "p2_whole": _LINKED + "SELECT count(*) AS n_rows, count(DISTINCT g) AS n_groups, 0 AS n_torn FROM cc",
    # What must hold of the pieces: all characters once, none too long, every overlap in place.
    "p7_check": "SELECT chunk_id, sum(length(text))::BIGINT AS n_chars, true AS short_enough, true AS overlapping FROM (SELECT DISTINCT chunk_id, text FROM examples WHERE length(text) > 1500 AND chunk_id IS NOT NULL) GROUP BY 1",
    "p7_found": "SELECT DISTINCT chunk_id FROM examples WHERE length(text) > 1500 AND chunk_id IS NOT NULL",
}

"""Queries over correction chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.numbers import name_key
from ledgerloom.operators import versions as ops
from ledgerloom.queries.facts import documents, facts
from ledgerloom.queries.sql import DOCS
from ledgerloom.session import table


def _manifest(spark, d):
    return table(spark, d, "manifest").groupBy("doc_id").agg(F.min_by(F.struct("corp_code", "corp_name", "doc_group", "doc_subtype", "report_nm", "is_correction", "rcept_no", "rcept_dt", "base_year", "base_month", "flr_nm"), F.coalesce("corp_code", F.lit("~"))).alias("m")).select("doc_id", "m.*")


def chain_order(spark, d):
    """Chains of periodic filings: named after the earliest, numbered, the last one latest."""
    m = _manifest(spark, d).where("doc_group = 'periodic' AND corp_code IS NOT NULL AND doc_subtype IS NOT NULL AND base_year IS NOT NULL AND base_month IS NOT NULL")
    return ops.periodic_groups(m).select("doc_id", "group_id", "correction_order", "is_latest")


def _targets(spark, d):
    """What a correction corrects: the filing before it in its chain, named by date and title only."""
    c = table(spark, d, "corrections").where("correction_group_id IS NOT NULL AND doc_id <> correction_group_id")
    return c.select("doc_id", F.substring(F.regexp_extract("correction_group_id", "_([0-9]+)$", 1), 1, 8).alias("target_date")).join(_manifest(spark, d), "doc_id").select("doc_id", "target_date", F.replace("report_nm", F.lit("[Correction] "), F.lit("")).alias("target_title"))


def chains_built(spark, d):
    """Chains of corrections, found again from dates and titles; a filer without a code goes by the key of its name."""
    filer = F.coalesce("corp_code", F.concat(F.lit("name:"), name_key(F.col("corp_name"))), F.concat(F.lit("doc:"), "doc_id"))
    m = _manifest(spark, d).select("doc_id", filer.alias("company"), "rcept_dt", "report_nm")
    return ops.build_chains(m, _targets(spark, d))


def chain_roots(spark, d):
    """The root of every correction by following parents, one version at a time."""
    c = table(spark, d, "corrections").where("correction_group_id IS NOT NULL AND correction_order IS NOT NULL").select("correction_group_id", "correction_order", "doc_id").distinct()
    up = c.select("correction_group_id", (F.col("correction_order") + 1).alias("correction_order"), F.col("doc_id").alias("parent"))
    links = c.join(up, ["correction_group_id", "correction_order"]).groupBy("doc_id").agg(F.min("parent").alias("parent"))
    return ops.roots(links)


def _hits(spark, d):
    e = table(spark, d, "examples").where("query_id IS NOT NULL AND report_id IS NOT NULL").select("query_id", F.col("report_id").alias("doc_id")).distinct()
    q = table(spark, d, "query_plans").select("query_id", "latest_policy", "periods")
    return e.join(documents(spark, d).withColumnRenamed("report_id", "doc_id"), "doc_id").join(q, "query_id")


def versions_by(policy: str | None):
    def run(spark, d):
        p = F.col("latest_policy") if policy is None else F.lit(policy)
        return ops.apply_policy(_hits(spark, d), p, F.col("periods"), ["query_id"]).select("query_id", "doc_id", "correction_group_id")

    return run


def version_pairs_changed(spark, d):
    f = facts(spark, d).where("correction_group_id IS NOT NULL AND field_code IS NOT NULL AND value_owner IS NULL")
    chains = documents(spark, d).withColumnRenamed("report_id", "doc_id")
    return ops.version_pairs(f, chains)


def correction_history(spark, d):
    return ops.history(documents(spark, d).withColumnRenamed("report_id", "doc_id"))


def chain_evidence_match(spark, d):
    """Retrieved documents that hold a gold document of their question or another trusted version of it."""
    e = table(spark, d, "examples").where("query_id IS NOT NULL AND report_id IS NOT NULL")
    found, gold = e.where("label = 0"), e.where("label = 1")
    pick = lambda x: x.select("query_id", F.col("report_id").alias("doc_id")).distinct()
    return ops.same_evidence(pick(found), pick(gold), table(spark, d, "corrections"))


QUERIES = {
    "chain_order": chain_order,
    "chains_built": chains_built,
    "chain_roots": chain_roots,
    "version_latest": versions_by("latest_only"),
    "version_window": versions_by("latest_in_window"),
    "version_first_final": versions_by("first_and_final"),
    "version_all": versions_by("all_versions"),
    "version_by_plan": versions_by(None),
    "version_pairs_changed": version_pairs_changed,
    "correction_history": correction_history,
    "chain_evidence_match": chain_evidence_match,
}

_M = "m AS (SELECT DISTINCT ON (doc_id) * FROM manifest ORDER BY doc_id, coalesce(corp_code, '~'))"
_KEY = "{'h': (correction_order IS NOT NULL)::INTEGER, 'v': coalesce(correction_order::BIGINT, try_cast(day AS BIGINT), 0), 'd': doc_id}"
_KEEP = {
    "all_versions": "true",
    "first_and_final": "k = first OR k = last",
    "latest_in_window": "k = coalesce(inside, last)",
    "latest_only": "k = coalesce(latest, last)",
}


def _policy(case: str) -> str:
    return f"""WITH {DOCS}, h AS (SELECT e.query_id, e.doc_id, x.* EXCLUDE (report_id), latest_policy, periods FROM (SELECT DISTINCT query_id, report_id AS doc_id FROM examples WHERE query_id IS NOT NULL AND report_id IS NOT NULL) e
  JOIN docs x ON e.doc_id = x.report_id JOIN query_plans USING (query_id)),
k AS (SELECT *, {_KEY} AS k, coalesce(list_bool_or(list_transform(periods, lambda t: coalesce(starts_with(day, replace(t, '-', '')), false) OR coalesce(starts_with(period, t), false))), false) AS i FROM h WHERE correction_group_id IS NOT NULL),
g AS (SELECT *, min(k) OVER w AS first, max(k) OVER w AS last, max(CASE WHEN is_latest THEN k END) OVER w AS latest, max(CASE WHEN i THEN k END) OVER w AS inside FROM k WINDOW w AS (PARTITION BY query_id, correction_group_id))
SELECT query_id, doc_id, correction_group_id FROM h WHERE correction_group_id IS NULL UNION ALL SELECT query_id, doc_id, correction_group_id FROM g WHERE {case}"""


ORACLES = {
    "chain_order": f"""WITH {_M}, p AS (SELECT *, first_value(doc_id) OVER w AS group_id, (row_number() OVER w - 1)::INTEGER AS correction_order, row_number() OVER w = count(*) OVER (PARTITION BY corp_code, doc_subtype, base_year, base_month) AS is_latest
  FROM m WHERE doc_group = 'periodic' AND corp_code IS NOT NULL AND doc_subtype IS NOT NULL AND base_year IS NOT NULL AND base_month IS NOT NULL WINDOW w AS (PARTITION BY corp_code, doc_subtype, base_year, base_month ORDER BY rcept_dt, rcept_no))
SELECT doc_id, group_id, correction_order, is_latest FROM p""",
    "chain_roots": """WITH RECURSIVE c AS (SELECT DISTINCT correction_group_id, correction_order, doc_id FROM corrections WHERE correction_group_id IS NOT NULL AND correction_order IS NOT NULL),
l AS (SELECT a.doc_id, min(b.doc_id) AS parent FROM c a JOIN c b ON a.correction_group_id = b.correction_group_id AND a.correction_order = b.correction_order + 1 GROUP BY 1),
chain(doc_id, top, depth) AS (SELECT doc_id, parent, 1 FROM l UNION ALL SELECT chain.doc_id, l.parent, depth + 1 FROM chain JOIN l ON top = l.doc_id)
SELECT doc_id, arg_max(top, depth) AS root, max(depth) AS depth FROM chain GROUP BY 1""",
    "version_latest": _policy(_KEEP["latest_only"]),
    "version_window": _policy(_KEEP["latest_in_window"]),
    "version_first_final": _policy(_KEEP["first_and_final"]),
    "version_all": _policy("true"),
    "version_by_plan": _policy("CASE latest_policy " + " ".join(f"WHEN '{p}' THEN {c}" for p, c in _KEEP.items() if p != "latest_only") + f" ELSE {_KEEP['latest_only']} END"),
    "version_pairs_changed": f"""WITH {DOCS}, r AS (SELECT f.doc_id, f.correction_group_id, field_code, value_text, {_KEY.replace("doc_id", "f.doc_id").replace("day", "x.day").replace("correction_order", "x.correction_order")} AS k
  FROM facts f JOIN docs x ON f.doc_id = x.report_id WHERE value_text IS NOT NULL AND f.correction_group_id IS NOT NULL AND field_code IS NOT NULL AND value_owner IS NULL),
p AS (SELECT correction_group_id, field_code, doc_id, min(value_text) AS v, max(k) AS k FROM r GROUP BY ALL HAVING count(DISTINCT value_text) = 1),
o AS (SELECT correction_group_id, field_code, arg_min(v, k) AS before, arg_max(v, k) AS after, count(*) AS n_versions FROM p GROUP BY ALL)
SELECT *, n_versions > 1 AS complete, n_versions > 1 AND regexp_replace(before, '\\s+', '', 'g') <> regexp_replace(after, '\\s+', '', 'g') AS changed FROM o""",
    "correction_history": f"""WITH {DOCS} SELECT correction_group_id, report_id AS doc_id, day, report_nm, row_number() OVER (PARTITION BY correction_group_id ORDER BY day, report_id) AS position,
  row_number() OVER (PARTITION BY correction_group_id ORDER BY day, report_id) = count(*) OVER (PARTITION BY correction_group_id) AS is_last FROM docs WHERE correction_group_id IS NOT NULL""",
    "chain_evidence_match": """WITH t AS (SELECT DISTINCT doc_id, correction_group_id AS g FROM corrections WHERE resolution_source NOT IN ('fuzzy_tiebreak', 'unresolved') AND correction_group_id IS NOT NULL),
e AS (SELECT DISTINCT query_id, report_id AS doc_id, label, coalesce(g, report_id) AS unit FROM examples LEFT JOIN t ON report_id = t.doc_id WHERE query_id IS NOT NULL AND report_id IS NOT NULL)
SELECT DISTINCT query_id, doc_id FROM e WHERE label = 0 AND (query_id, unit) IN (SELECT (query_id, unit) FROM e WHERE label = 1)""",
}

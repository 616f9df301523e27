"""Correction chains: building them, choosing versions of documents, and comparing versions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ranking import ranks
from ledgerloom.session import keep

#: A fuzzy title match below this is no match.
TITLE_SCORE = 40.0
#: How a document came into its chain, where that is not trusted.
UNTRUSTED = ["fuzzy_tiebreak", "unresolved"]
#: How the target of a correction is stated in a filing's text, for general and for exchange forms.
_DATE = r"([0-9]{4})\s*[-.년]\s*([0-9]{1,2})\s*[-.월]\s*([0-9]{1,2})"
TARGET_DATE = {"general": r"정정대상\s*공시서류의\s*최초제출일\s*[:：]?\s*" + _DATE, "exchange": r"정정관련\s*공시서류제출일\s*[:：]?\s*" + _DATE}
TARGET_TITLE = {"general": r"정정대상\s*공시서류\s*[:：]?\s*(.+?)\s*(?=[0-9]\s*\.\s*정정)", "exchange": r"정정관련\s*공시서류\s*[:：]?\s*(.+?)\s*(?=[0-9]\s*\.\s*정정)"}


def correction_targets(docs: DataFrame, text: Column, group: Column) -> DataFrame:
    """docs with target_date and target_title as their text states them: the group's own form first, then the other."""
    flat = F.regexp_replace(text, r"(?U)\s+", " ")

    def date(form: str) -> Column:
        y, m, d = (F.regexp_extract(flat, "(?U)" + TARGET_DATE[form], i) for i in (1, 2, 3))
        return F.when(y != "", F.concat(y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))

    title = lambda form: F.nullif(F.trim(F.regexp_extract(flat, "(?U)" + TARGET_TITLE[form], 1)), F.lit(""))
    exchange = group == "exchange"
    pick = lambda f: F.when(exchange, F.coalesce(f("exchange"), f("general"))).otherwise(F.coalesce(f("general"), f("exchange")))
    return docs.withColumns({"target_date": pick(date), "target_title": pick(title)})


def sorted_token_ratio(a: str, b: str) -> float:
    """Similarity of two titles in percent: twice the longest common subsequence of their sorted words over both lengths."""
    x, y = (" ".join(sorted(s.split())) for s in (a or "", b or ""))
    if not x and not y:
        return 100.0
    row = [0] * (len(y) + 1)
    for ch in x:
        diagonal = 0
        for j, other in enumerate(y, 1):
            diagonal, row[j] = row[j], diagonal + 1 if ch == other else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(x) + len(y))


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(score=[sorted_token_ratio(a, b) for a, b in zip(pdf["target_title"], pdf["report_nm"], strict=True)])[["doc_id", "parent", "score"]]


def parents(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, parent, source: the corrected filing of every correction, by company and date, several candidates by title.

    manifest: doc_id, company, rcept_dt, report_nm (one row per document); targets: doc_id, target_date, target_title.
    """
    own = targets.join(manifest.select("doc_id", "company"), "doc_id")
    cand = manifest.select(F.col("doc_id").alias("parent"), F.col("company").alias("c"), F.col("rcept_dt").alias("d"), "report_nm")
    pairs = own.join(cand, (F.col("company") == F.col("c")) & (F.col("target_date") == F.col("d")) & (F.col("doc_id") != F.col("parent"))).select("doc_id", "parent", "target_title", "report_nm")
    n = pairs.groupBy("doc_id").agg(F.count("*").alias("n"))
    counted = pairs.join(n, "doc_id")
    sure = counted.where("n = 1").select("doc_id", "parent", F.lit("rule").alias("source"))
    scored = counted.where("n > 1").select("doc_id", "parent", F.coalesce("target_title", F.lit("")).alias("target_title"), F.coalesce("report_nm", F.lit("")).alias("report_nm"))
    scored = scored.mapInPandas(_scored, "doc_id string, parent string, score double")
    best = scored.groupBy("doc_id").agg(F.max_by("parent", F.struct("score", "parent")).alias("parent"), F.max("score").alias("score")).where(F.col("score") >= TITLE_SCORE)
    return sure.unionByName(best.select("doc_id", "parent", F.lit("fuzzy_tiebreak").alias("source")))


def roots(links: DataFrame) -> DataFrame:
    """doc_id, root, depth: the end of every chain of parents (doc_id, parent). Members of a cycle have no end and are left out.

    Pointers are doubled until none moves, so a chain of n links takes about log2(n) joins whatever the number of documents.
    """
    first = keep(links.where("doc_id <> parent").groupBy("doc_id").agg(F.min("parent").alias("root")).withColumn("depth", F.lit(1).cast("long")), "roots")
    at, n = first, first.count()
    while True:
        up = at.select(F.col("doc_id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moved = at.join(up, "root", "left")
        if moved.where("next IS NOT NULL").isEmpty():
            break
        at = moved.select("doc_id", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        # A way of more links than there are goes round in a cycle.
        at = keep(at.where(F.col("depth") <= n), "roots")
    return at.join(first.select(F.col("doc_id").alias("root")), "root", "left_anti").select("doc_id", "root", F.col("depth").cast("int").alias("depth"))


def numbered(docs: DataFrame, group: str = "group_id") -> DataFrame:
    """docs with correction_order (0-based by date and number) and is_latest within their group."""
    # A chain of any size: filings are range-sorted over all tasks, and only counts meet per chain.
    placed = ranks(docs, [group], [F.col("rcept_dt"), F.col("doc_id")], "ll_place")
    sizes = placed.groupBy(group).agg(F.count("*").alias("ll_n"))
    out = placed.join(sizes.withColumnRenamed(group, "ll_g"), F.col(group).eqNullSafe(F.col("ll_g")))
    return out.withColumns({"correction_order": (F.col("ll_place") - 1).cast("int"), "is_latest": F.col("ll_place") == F.col("ll_n")}).drop("ll_place", "ll_n", "ll_g")


def periodic_groups(manifest: DataFrame) -> DataFrame:
    """Periodic filings of one company, kind and base period form a chain named after its earliest document."""
    key = ["corp_code", "doc_subtype", "base_year", "base_month"]
    first = manifest.groupBy(*key).agg(F.min_by("doc_id", F.struct("rcept_dt", "rcept_no", "doc_id")).alias("group_id"))
    return numbered(manifest.join(first, key))


def build_chains(manifest: DataFrame, targets: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """doc_id, group_id, correction_order, is_latest, resolution_source for event filings.

    overrides: doc_id, parent set by hand; they come before rules.
    """
    links = parents(manifest, targets)
    if overrides is not None:
        by_hand = overrides.select("doc_id", "parent", F.lit("manual_override").alias("source"))
        links = by_hand.unionByName(links.join(overrides.select("doc_id"), "doc_id", "left_anti"))
    top = roots(links.select("doc_id", "parent"))
    wanted = targets.select("doc_id", F.lit(True).alias("is_target"))
    df = manifest.join(top, "doc_id", "left").join(links.select("doc_id", "source"), "doc_id", "left").join(wanted, "doc_id", "left")
    source = F.coalesce("source", F.when(F.col("is_target"), "unresolved").otherwise("original"))
    return numbered(df.withColumns({"group_id": F.coalesce("root", "doc_id"), "resolution_source": source})).select("doc_id", "group_id", "correction_order", "is_latest", "resolution_source")


def order_key() -> Column:
    """Chain orders and filing dates never compare as one number: a known order beats any date."""
    has = F.col("correction_order").isNotNull()
    return F.struct(has.cast("int"), F.coalesce(F.col("correction_order").cast("long"), F.col("day").try_cast("long"), F.lit(0)), F.col("doc_id"))


def in_window(tokens: Column) -> Column:
    """Whether day or period falls in one of the periods asked for."""
    hit = F.exists(tokens, lambda t: F.coalesce(F.col("day").startswith(F.replace(t, F.lit("-"))), F.lit(False)) | F.coalesce(F.col("period").startswith(t), F.lit(False)))
    return F.coalesce(hit, F.lit(False))


def apply_policy(hits: DataFrame, policy: Column, tokens: Column, by: list[str]) -> DataFrame:
    """The rows of hits whose document survives its query's version policy; the decision is made per document.

    hits: by columns, doc_id, correction_group_id, correction_order, is_latest, day, period. Documents without a chain,
    or alone in theirs, always stay.
    """
    cols = [*by, "correction_group_id", "doc_id"]
    docs = hits.withColumns({"ll_policy": policy, "ll_in": in_window(tokens), "ll_key": order_key()}).where("correction_group_id IS NOT NULL")
    one = docs.groupBy(*cols).agg(F.max("ll_key").alias("k"), F.max("ll_policy").alias("p"), F.max("ll_in").alias("i"), F.max(F.coalesce("is_latest", F.lit(False))).alias("l"))
    group = one.groupBy(*by, "correction_group_id").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.max(F.when(F.col("l"), F.col("k"))).alias("latest"), F.max(F.when(F.col("i"), F.col("k"))).alias("inside"))
    both = one.join(group, [*by, "correction_group_id"])
    keep = (
        F.when(F.col("p") == "all_versions", True)
        .when(F.col("p") == "first_and_final", (F.col("k") == F.col("first")) | (F.col("k") == F.col("last")))
        .when(F.col("p") == "latest_in_window", F.col("k") == F.coalesce("inside", "last"))
        .otherwise(F.col("k") == F.coalesce("latest", "last"))
    )
    drop = both.where(~keep).select(*by, "doc_id")
    return hits.join(drop, [*by, "doc_id"], "left_anti")


def version_pairs(facts: DataFrame, chains: DataFrame) -> DataFrame:
    """First and last stated value of every item of a chain; a single version is incomplete; changed compares text without spaces.

    facts: doc_id, correction_group_id, field_code, value_text; chains: doc_id, correction_order, day.
    """
    key = order_key()
    rows = facts.where("value_text IS NOT NULL").join(chains.select("doc_id", "correction_order", "day"), "doc_id")
    per_doc = rows.groupBy("correction_group_id", "field_code", "doc_id").agg(F.min("value_text").alias("v"), F.count_distinct("value_text").alias("n"), F.max(key).alias("k")).where("n = 1")
    out = per_doc.groupBy("correction_group_id", "field_code").agg(F.min_by("v", "k").alias("before"), F.max_by("v", "k").alias("after"), F.count("*").alias("n_versions"))
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return out.withColumns({"complete": F.col("n_versions") > 1, "changed": (F.col("n_versions") > 1) & (bare("before") != bare("after"))})


def history(docs: DataFrame) -> DataFrame:
    """correction_group_id, position, doc_id, day, report_nm, is_last: the listing of every chain, oldest first."""
    listed = ranks(docs.where("correction_group_id IS NOT NULL").select("correction_group_id", "doc_id", "day", "report_nm"), ["correction_group_id"], [F.col("day"), F.col("doc_id")], "position")
    last = docs.where("correction_group_id IS NOT NULL").groupBy("correction_group_id").agg(F.count("*").alias("n"))
    return listed.join(last, "correction_group_id").withColumn("is_last", F.col("position") == F.col("n")).drop("n")


def same_evidence(found: DataFrame, gold: DataFrame, chains: DataFrame) -> DataFrame:
    """Rows of found (query_id, doc_id) that hold a gold document of the query or another version of it in a trusted chain."""
    trusted = chains.where(~F.col("resolution_source").isin(UNTRUSTED) & F.col("correction_group_id").isNotNull()).select("doc_id", F.col("correction_group_id").alias("g")).distinct()
    own = lambda df: df.join(trusted, "doc_id", "left").withColumn("unit", F.coalesce("g", "doc_id")).drop("g")
    return own(found).join(own(gold).select("query_id", "unit").distinct(), ["query_id", "unit"], "left_semi").drop("unit")

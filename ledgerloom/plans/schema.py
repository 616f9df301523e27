"""Filing kinds and their items: which of them a question names, what it must be answered with, and repair of plans against them.

kinds is a short table of the catalogue (kind, terms, core_terms, action_terms, required, items: arrays of names); it is
folded into one row that every task gets, and its size is checked first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import name_key
from ledgerloom.functions.text import compose

#: Kinds of filings a schema may have.
MOST_KINDS = 10_000
#: Kinds a question may name and still be held to their required items.
MOST_NAMED = 2
# The values a plan's fields may take, with those that others are replaced by.
ALLOWED = {
    "answer_mode": (["closed", "open", "mixed", "unknown"], "unknown"),
    "task": (["lookup", "compare", "calculate", "count", "timeline", "summarize", "correction_diff", "unknown"], "unknown"),
    "latest_policy": (["latest_only", "all_versions", "first_and_final", "latest_in_window"], "latest_only"),
    "aggregation": (["none", "sum", "avg", "max", "min", "count"], "none"),
}


def kind_key(c: Column) -> Column:
    """A kind's or item's name for comparison: composed, in lower case, without a leading bracket, white space and middle dots."""
    return F.regexp_replace(F.regexp_replace(F.lower(compose(F.trim(c))), r"^\[[^\]]*\]", ""), r"(?U)[\s·ㆍ・:∙]", "")


def _keys(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), kind_key), lambda x: x != "")


def _one_row(kinds: DataFrame) -> DataFrame:
    n = kinds.limit(MOST_KINDS + 1).count()
    if n > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds")
    arrays = [_keys(c).alias(c) for c in ("terms", "core_terms", "action_terms", "required", "items")]
    return kinds.select("kind", *arrays).agg(F.array_sort(F.collect_list(F.struct("kind", "terms", "core_terms", "action_terms", "required", "items"))).alias("ll_kinds"))


def longest_first(text: Column, terms: Column) -> Column:
    """Of the terms (structs with a text t) that a text holds those that don't lie within a longer one, the longest first."""
    hits = F.filter(F.transform(terms, lambda x: F.struct((-F.length(x["t"])).alias("n"), F.instr(text, x["t"]).alias("at"), x.alias("x"))), lambda h: h["at"] > 0)
    within = lambda a, b: (a["at"] >= b["at"]) & (a["at"] - a["n"] <= b["at"] - b["n"]) & (a["n"] > b["n"])
    kept = F.filter(hits, lambda a: ~F.exists(hits, lambda b: within(a, b)))
    return F.transform(F.array_sort(kept), lambda h: h["x"])


def match_kinds(questions: DataFrame, kinds: DataFrame) -> DataFrame:
    """questions (query_id, query) with kinds: those named as a whole, the longest name first, then by their core and action terms.

    Of the kinds that share a core term in the question those with an action term in it are taken, or all if there is none.
    """
    j = questions.select("query_id", kind_key(F.col("query")).alias("q")).crossJoin(F.broadcast(_one_row(kinds)))
    q, k = F.col("q"), F.col("ll_kinds")
    terms = F.flatten(F.transform(k, lambda x: F.transform(x["terms"], lambda t: F.struct(t.alias("t"), x["kind"].alias("kind")))))
    whole = F.transform(longest_first(q, terms), lambda x: x["kind"])
    cores = F.array_distinct(F.flatten(F.transform(k, lambda x: x["core_terms"])))
    named = F.filter(cores, lambda c: F.contains(q, c))

    def siblings(core: Column) -> Column:
        own = F.filter(k, lambda x: F.array_contains(x["core_terms"], core))
        acting = F.filter(own, lambda x: F.exists(x["action_terms"], lambda t: F.contains(q, t)))
        return F.transform(F.when(F.size(acting) > 0, acting).otherwise(own), lambda x: x["kind"])

    ordered = F.array_sort(F.transform(named, lambda c: F.struct((-F.length(c)).alias("n"), c.alias("c"))))
    parts = F.flatten(F.transform(ordered, lambda c: siblings(c["c"])))
    out = j.select("query_id", F.array_distinct(F.concat(whole, parts)).alias("kinds"))
    return questions.join(out, "query_id")


def expected_items(matched: DataFrame, kinds: DataFrame) -> DataFrame:
    """matched (query_id, kinds) with required: the items of the one kind, those that two kinds share, none for more or none."""
    j = matched.crossJoin(F.broadcast(_one_row(kinds)))
    lists = F.transform(F.filter("ll_kinds", lambda x: F.array_contains(F.col("kinds"), x["kind"]) & (F.size(x["required"]) > 0)), lambda x: x["required"])
    shared = F.aggregate(F.slice(lists, 2, MOST_NAMED), F.get(lists, F.lit(0)), lambda a, b: F.array_intersect(a, b))
    few = (F.size("kinds") > 0) & (F.size("kinds") <= MOST_NAMED) & (F.size(lists) > 0)
    return j.withColumn("required", F.when(few, F.array_sort(shared)).otherwise(F.array().cast("array<string>"))).drop("ll_kinds")


def items_mentioned(matched: DataFrame, kinds: DataFrame) -> DataFrame:
    """matched (query_id, query, kinds) with mentioned: items of these kinds (of all, if there are none) in the question, without names of kinds, the longest first."""
    j = matched.crossJoin(F.broadcast(_one_row(kinds)))
    own = F.filter("ll_kinds", lambda x: (F.size("kinds") == 0) | F.array_contains(F.col("kinds"), x["kind"]))
    names = F.array_distinct(F.flatten(F.transform(own, lambda x: F.array_union(x["items"], x["required"]))))
    taken = F.flatten(F.transform("ll_kinds", lambda x: F.flatten(F.array(x["terms"], x["core_terms"], x["action_terms"]))))
    free = F.filter(F.array_except(names, taken), lambda x: F.length(x) >= 2)
    hits = longest_first(kind_key(F.col("query")), F.transform(free, lambda x: F.struct(x.alias("t"))))
    return j.withColumn("mentioned", F.transform(hits, lambda x: x["t"])).drop("ll_kinds")


def repaired(planned: DataFrame, names: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Plans with what can be mended mended, and issues: an array of (field, severity).

    planned: query_id, answer_mode, task, latest_policy, aggregation, companies, periods, expected_fields, and kinds (of
    filings) if the items are to be checked; names: name of everybody who occurs in the catalogue. Warnings were mended;
    errors (an unknown company, one target to compare, nothing to calculate with) can't be.
    """
    issues = []
    df = planned
    for name, (allowed, other) in ALLOWED.items():
        wrong = ~F.coalesce(F.col(name).isin(allowed), F.lit(False))
        issues.append(F.when(wrong, F.struct(F.lit(name).alias("field"), F.lit("warning").alias("severity"))))
        df = df.withColumn(f"ll_{name}", F.when(wrong, F.lit(other)).otherwise(F.col(name)))
    known = names.select(name_key(F.col("name")).alias("k")).where("k <> ''").distinct()
    asked = planned.select("query_id", F.explode("companies").alias("c")).select("query_id", name_key(F.col("c")).alias("k"))
    unknown = asked.join(known, "k", "left_anti").select("query_id", F.lit(True).alias("ll_unknown")).distinct()
    df = df.join(unknown, "query_id", "left")
    said = lambda cond, field, severity: F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity")))
    issues.append(said(F.col("ll_unknown"), "companies", "error"))
    good = F.filter(F.coalesce("periods", F.array().cast("array<string>")), lambda p: p.rlike(r"^[0-9]{4}(-[0-9]{2})?$"))
    issues.append(said(F.size(good) < F.size("periods"), "periods", "warning"))
    one = (F.size("companies") < 2) & (F.size(good) < 2)
    issues.append(said((F.col("ll_task") == "compare") & one, "task", "error"))
    lost = (F.col("ll_task") == "correction_diff") & (F.col("ll_latest_policy") == "latest_only")
    issues.append(said(lost, "latest_policy", "warning"))
    issues.append(said((F.col("ll_task") == "calculate") & (F.size(F.coalesce("expected_fields", F.array().cast("array<string>"))) == 0), "expected_fields", "error"))
    fields = F.col("expected_fields")
    if kinds is not None:
        df = df.crossJoin(F.broadcast(_one_row(kinds)))
        own = F.flatten(F.transform(F.filter("ll_kinds", lambda x: F.array_contains(F.col("kinds"), x["kind"])), lambda x: F.array_union(x["items"], x["required"])))
        fields = F.when(F.size("kinds") > 0, F.filter("expected_fields", lambda f: F.array_contains(own, kind_key(f)))).otherwise(F.col("expected_fields"))
        issues.append(said(F.size(fields) < F.size("expected_fields"), "expected_fields", "warning"))
    out = df.withColumns({"issues": F.array_compact(F.array(*issues)), "ll_fields": fields, "ll_periods": good, "ll_latest_policy": F.when(lost, "first_and_final").otherwise(F.col("ll_latest_policy"))})
    mended = {**{n: F.col(f"ll_{n}") for n in ALLOWED}, "periods": F.col("ll_periods"), "expected_fields": F.col("ll_fields")}
    return out.withColumns(mended).drop("ll_unknown", "ll_fields", "ll_periods", "ll_kinds", *[f"ll_{n}" for n in ALLOWED])

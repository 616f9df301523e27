"""Arithmetic derived from facts, and checks of derived figures. Ambiguity gives no row, not a guess."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ledgerloom.functions.numbers import cagr, growth, ratio, won_factor, won_unit

# Words of a question that ask for a calculation, and phrases that only contain such a word.
OPERATIONS = {
    "sum": ("합계", "총액", "모두 합", "총합", "다 더하면", "합치면"),
    "avg": ("평균", "산술평균"),
    "diff": ("차이", "차액", "얼마나 많", "얼마나 적", "격차"),
    "count": ("몇 건", "몇건", "건수", "개수", "몇 개", "몇개", "몇 차례", "몇 번", "총 몇"),
    "rank": ("순서대로", "순위", "큰 순", "작은 순", "나열"),
}
MASKED = ("연평균성장률", "연평균 성장률", "평균성장률", "가중평균", "이동평균", "평균잔존만기")
CONSOLIDATED, SEPARATE = ("연결", "consolidated"), ("별도", "개별", "separate")
#: Pools of up to so many figures are searched pair by pair inside the JVM, larger ones sorted, by Arrow batches.
FEW_FIGURES = 200


def wanted_operations(question: str) -> list[str]:
    for p in MASKED:
        question = question.replace(p, " ")
    return [op for op, words in OPERATIONS.items() if any(w in question for w in words)]


def wanted_column(question: Column) -> Column:
    """The same for a column of questions: an array of operations."""
    q = question
    for p in MASKED:
        q = F.replace(q, F.lit(p), F.lit(" "))
    hit = lambda words: q.rlike("|".join(words))
    return F.array_compact(F.array(*[F.when(hit(w), F.lit(op)) for op, w in OPERATIONS.items()]))


def statement_kind(path: Column) -> Column:
    """consolidated, separate or empty, read from a section path; consolidated comes first."""
    s = F.lower(F.regexp_replace(F.array_join(path, ""), r"(?U)\s+", ""))
    return F.when(s.rlike("|".join(CONSOLIDATED)), "consolidated").when(s.rlike("|".join(SEPARATE)), "separate").otherwise("")


GROUP = ["item", "unit", "kind"]


def one_per_subject(rows: DataFrame) -> DataFrame:
    """One row per item, unit, kind, company and period: that of the newest filing. A group with conflicting newest values is left out as a whole.

    rows: item, unit, kind, company, period, day, doc_id, value.
    """
    subject = [*GROUP, "company", "period"]
    w = Window.partitionBy(*subject)
    newest = rows.withColumn("new", F.max("day").over(w)).where("day = new")
    one = newest.groupBy(*subject).agg(F.count_distinct("value").alias("n"), F.max("value").alias("value"), F.min("doc_id").alias("doc_id"))
    bad = one.where("n > 1").select(*GROUP).distinct()
    null_safe = F.lit(True)
    for g in GROUP:
        null_safe = null_safe & one[g].eqNullSafe(bad[g])
    return one.join(bad, null_safe, "left_anti").drop("n")


def derive(rows: DataFrame) -> DataFrame:
    """item, unit, kind, n_subjects, n_docs, total, mean, spread for groups of two or more subjects."""
    one = one_per_subject(rows)
    # Sums in decimals don't depend on the order of the rows.
    v = F.col("value").cast("decimal(28,9)")
    total = F.sum(v)
    return one.groupBy(*GROUP).agg(F.count("*").alias("n_subjects"), F.count_distinct("doc_id").alias("n_docs"), total.alias("total"), (total.cast("double") / F.count("*")).alias("mean"), (F.max("value") - F.min("value")).alias("spread")).where("n_subjects >= 2")


def series(rows: DataFrame) -> DataFrame:
    """Growth and yearly growth from the first to the last filing of a company's item; ends must be on different days and unambiguous."""
    key = ["company", *GROUP]
    ends = rows.groupBy(*key).agg(F.min("day").alias("d0"), F.max("day").alias("d1")).where("d0 < d1")
    j = rows.join(ends, key)
    at = lambda d: F.collect_set(F.when(F.col("day") == F.col(d), F.col("value")))
    both = j.where("day = d0 OR day = d1").groupBy(*key, "d0", "d1").agg(at("d0").alias("a"), at("d1").alias("b")).where("size(a) = 1 AND size(b) = 1")
    a, b = F.col("a")[0], F.col("b")[0]
    years = F.substring("d1", 1, 4).cast("int") - F.substring("d0", 1, 4).cast("int")
    return both.select(*key, "d0", "d1", a.alias("first"), b.alias("last"), growth(a, b).alias("growth"), cagr(a, b, years).alias("cagr"))


def item_ratio(rows: DataFrame, part: str, whole: str) -> DataFrame:
    """part in percent of whole for the same company, period, unit and kind."""
    one = one_per_subject(rows)
    key = ["company", "period", "unit", "kind"]
    a = one.where(F.col("item") == part).select(*key, F.col("value").alias("part"))
    b = one.where(F.col("item") == whole).select(*key, F.col("value").alias("whole"))
    return a.join(b, key).select(*key, "part", "whole", ratio(F.col("part"), F.col("whole")).alias("percent"))


def winners(rows: DataFrame) -> DataFrame:
    """item, winner, best, gap, n_tied: the company of the largest value among two or more; different units count only if all are won.

    rows: item, company, value, unit (text).
    """
    unit = F.coalesce(F.col("unit"), F.lit(""))
    same = F.count_distinct(unit).alias("n_units")
    convertible = F.bool_and(won_unit(unit) != "").alias("all_won")
    units = rows.groupBy("item").agg(same, convertible)
    j = rows.join(units, "item").where("n_units = 1 OR all_won")
    v = F.when(F.col("n_units") > 1, F.col("value") * won_factor(won_unit(unit))).otherwise(F.col("value"))
    best = j.groupBy("item", "company").agg(F.max(v).alias("v"))
    w = Window.partitionBy("item").orderBy(F.desc("v"), "company")
    r = best.withColumns({"rk": F.dense_rank().over(Window.partitionBy("item").orderBy(F.desc("v"))), "rn": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("item"))}).where("n >= 2")
    top = r.groupBy("item").agg(F.min_by("company", "rn").alias("winner"), F.max("v").alias("best"), F.max(F.when(F.col("rk") == 2, F.col("v"))).alias("second"), F.count_if(F.col("rk") == 1).alias("n_tied"))
    return top.select("item", "winner", "best", (F.col("best") - F.col("second")).alias("gap"), "n_tied")


def figures(text: Column) -> Column:
    """The distinct figures of a text as doubles, without years."""
    raw = F.regexp_extract_all(text, F.lit(r"(?<![0-9.,])-?[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0))
    numbers = F.array_distinct(F.array_compact(F.transform(raw, lambda x: F.replace(x, F.lit(",")).try_cast("double"))))
    year = lambda x: x.between(1900, 2100) & (x == F.floor(x))
    return F.filter(numbers, lambda x: ~year(x))


def _hits(t: float, half: float, percent: bool, pool: np.ndarray) -> bool:
    """Whether two different figures of a sorted pool give t: for every one, the partners in reach are looked up."""
    tol = half + abs(t) * 1e-9
    if percent:
        b = pool[pool != 0]
        near = [(b, b * t / 100, tol * np.abs(b) / 100), (b, b + np.abs(b) * t / 100, tol * np.abs(b) / 100)]
    else:
        near = [(pool, pool + t, np.full(len(pool), tol)), (pool, t - pool, np.full(len(pool), tol))]
    for own, want, reach in near:
        slack = reach * (1 + 1e-9) + np.abs(want) * 1e-12
        low, high = np.searchsorted(pool, want - slack, "left"), np.searchsorted(pool, want + slack, "right")
        for i in np.flatnonzero(high > low):
            b, a = own[i], pool[low[i] : high[i]]
            if percent:
                ok = (np.abs(a / b * 100 - t) <= tol) | (np.abs((a - b) / np.abs(b) * 100 - t) <= tol)
            else:
                ok = (np.abs(a - b - t) <= tol) | (np.abs(a + b - t) <= tol)
            if (ok & (a != b)).any():
                return True
    return False


@F.pandas_udf(BooleanType())
def _derivable_sorted(target: pd.Series, half: pd.Series, percent: pd.Series, pool: pd.Series) -> pd.Series:
    sorted_ = [np.unique(np.asarray(p, dtype=np.float64)) for p in pool]
    return pd.Series([False if pd.isna(t) else _hits(t, h, bool(c), p) for t, h, c, p in zip(target, half, percent, sorted_, strict=True)])


def derivable(checks: DataFrame) -> DataFrame:
    """Whether a target figure follows from two figures of the pool: a ratio or change in percent if percent is true, else a sum or difference.

    checks: id, target, places (digits shown), percent, pool (array of doubles). Pools of up to FEW_FIGURES are tried pair by
    pair inside their row; larger ones are sorted and every figure's partners looked up, with the same result.
    """
    half = 0.5 * F.pow(F.lit(10.0), -F.col("places"))
    tol = half + F.abs("target") * 1e-9
    t = F.col("target")

    def hit(a: Column, b: Column) -> Column:
        share = (b != 0) & ((F.abs(a / b * 100 - t) <= tol) | (F.abs((a - b) / F.abs(b) * 100 - t) <= tol))
        plain = (F.abs(a - b - t) <= tol) | (F.abs(a + b - t) <= tol)
        return F.coalesce(F.when(F.col("percent"), share).otherwise(plain), F.lit(False))

    found = F.exists("pool", lambda a: F.exists("pool", lambda b: (a != b) & hit(a, b)))
    large = F.size("pool") > FEW_FIGURES
    few = checks.where(~F.coalesce(large, F.lit(False))).withColumn("derived", found)
    return few.unionByName(checks.where(large).withColumn("derived", _derivable_sorted("target", half, F.coalesce("percent", F.lit(False)), "pool")))


def rescaled(checks: DataFrame) -> DataFrame:
    """Power of ten, not zero, between -12 and 12 that turns a pool figure into the target; null where there is none."""
    powers = F.array(*[F.lit(float(e)) for e in range(-12, 13) if e])
    same = lambda a, e: F.abs(a * F.pow(F.lit(10.0), e) - F.col("target")) <= F.abs("target") * 1e-6
    fits = F.filter(powers, lambda e: F.exists("pool", lambda a: (F.col("target") != 0) & same(a, e)))
    return checks.withColumn("power", F.get(fits, F.lit(0)).cast("int"))


def validate_answers(answers: DataFrame) -> DataFrame:
    """Figures of three digits or more in an answer that its evidence doesn't hold: grounded, derived, rescaled or ungrounded, with counts.

    answers: id, answer, evidence, percent.
    """
    df = answers.withColumns({"own": F.filter(figures(F.col("answer")), lambda x: F.abs(x) >= 100), "pool": figures(F.col("evidence"))})
    each = df.select("id", "percent", "pool", F.explode_outer("own").alias("target")).withColumn("places", F.lit(0))
    checked = rescaled(derivable(each))
    state = F.when(F.col("target").isNull(), "none").when(F.array_contains("pool", F.col("target")), "grounded").when(F.col("derived"), "derived").when(F.col("power").isNotNull(), "rescaled").otherwise("ungrounded")
    s = checked.select("id", state.alias("s"))
    n = lambda v: F.count_if(F.col("s") == v).alias(v)
    return s.groupBy("id").agg(n("grounded"), n("derived"), n("rescaled"), n("ungrounded")).withColumn("ok", (F.col("rescaled") + F.col("ungrounded")) == 0)


def carry_owner(nodes: DataFrame) -> DataFrame:
    """Owner of every node: its own, else that carried on within the section from the last named one to nodes with two or more financial markers.

    nodes: doc_id, section, seq, owner, n_markers. A section is a run of equal names, so a name that returns begins anew.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("seq")
    start = F.when(F.lag("section").over(by_doc).eqNullSafe(F.col("section")), 0).otherwise(1)
    run = nodes.withColumn("start", start).withColumn("run", F.sum("start").over(by_doc))
    inside = Window.partitionBy("doc_id", "run").orderBy("seq")
    carried = F.last("owner", ignorenulls=True).over(inside)
    return run.withColumn("carried", F.coalesce("owner", F.when(F.col("n_markers") >= 2, carried))).drop("start")

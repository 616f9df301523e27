"""Facts: predicates, tiered lookup, discovery, aggregates and existence checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import filing_day, matches_period
from ledgerloom.functions.numbers import name_key, symbol_key

# Financial items that a holders' section states for the largest holder, not for the filer.
HOLDER_SECTIONS = ["주주에 관한 사항", "Holders"]
HOLDER_ITEMS = ["자산총계", "부채총계", "자본총계", "매출액", "영업이익", "당기순이익"]

ORDERS = {
    "date": lambda: [F.desc_nulls_last("day"), F.asc("fact_id")],
    "value_desc": lambda: [F.desc_nulls_last("value_num"), F.desc_nulls_last("day"), F.asc("fact_id")],
    "value_asc": lambda: [F.asc_nulls_last("value_num"), F.desc_nulls_last("day"), F.asc("fact_id")],
}


def with_day(facts: DataFrame) -> DataFrame:
    """facts with day: the filing date as yyyyMMdd, however it is spelled."""
    return facts.withColumn("day", filing_day(F.col("filing_date")))


def third_party() -> Column:
    """Whether a fact states a value of another party; null where a listed item has no section."""
    owner = F.col("value_owner").isNotNull() & (F.col("value_owner") != F.col("company"))
    inside = F.exists("section_path", lambda p: F.lit(False) if not HOLDER_SECTIONS else _any(p))
    return owner | (inside & F.col("key_norm").isin(HOLDER_ITEMS))


def _any(p: Column) -> Column:
    out = F.lit(False)
    for s in HOLDER_SECTIONS:
        out = out | F.contains(p, F.lit(s))
    return out


def owner_predicate(which: str) -> Column:
    if which == "any":
        return F.lit(True)
    if which not in ("self", "other"):
        raise ValueError(which)
    return ~third_party() if which == "self" else third_party()


def period_predicate(period: str, wide: bool) -> Column:
    """A year takes its months and, for facts without a period, filings of the year; a month takes itself and filings of the month or, wide, of the year."""
    none = F.coalesce(F.length("period") == 0, F.lit(True))
    year = period[:4]
    if len(period) == 4:
        return F.coalesce(F.col("period").startswith(year + "-"), F.lit(False)) | (none & F.col("day").startswith(year))
    near = year if wide else period.replace("-", "")
    return F.coalesce(F.col("period") == period, F.lit(False)) | (none & F.col("day").startswith(near))


def key_predicate(key: str, exact: bool) -> Column:
    if exact:
        return F.col("key_norm") == key
    like = "%" + key.lower() + "%"
    return F.lower("key_norm").like(like) | F.lower("key").like(like)


@dataclass(frozen=True)
class Lookup:
    """What to look up; the defaults are those of a plain question about a company's own latest figures."""

    company: str | None = None
    companies: tuple[str, ...] = ()
    key: str | None = None
    doc_group: str | None = None
    doc_id: str | None = None
    period: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    min_value: float | None = None
    max_value: float | None = None
    latest_only: bool = True
    corrections_only: bool = False
    numeric_only: bool = False
    value_owner: str = "self"
    exact_only: bool = False
    order_by: str = "date"
    limit: int | None = 20

    def conditions(self) -> list[Column]:
        c: list[Column] = []
        if self.company is not None:
            c.append(F.col("company") == self.company)
        if self.companies:
            c.append(F.col("company").isin(list(self.companies)))
        for name in ("doc_group", "doc_id"):
            if getattr(self, name) is not None:
                c.append(F.col(name) == getattr(self, name))
        if self.date_from:
            c.append(F.col("day") >= self.date_from)
        if self.date_to:
            c.append(F.col("day") <= self.date_to)
        if self.min_value is not None:
            c.append(F.col("value_num") >= self.min_value)
        if self.max_value is not None:
            c.append(F.col("value_num") <= self.max_value)
        if self.numeric_only:
            c.append(F.col("value_num").isNotNull())
        if self.latest_only:
            c.append(F.col("is_latest").isNull() | F.col("is_latest"))
        if self.corrections_only:
            c.append(F.col("is_correction"))
        c.append(owner_predicate(self.value_owner))
        return c


def first_tier(df: DataFrame, tiers: list[tuple[int, Column]], by: list[str] | None = None) -> DataFrame:
    """Rows of the first tier that has any, tagged tier: an ordered fallback without running one query after another.

    tiers: (number, predicate); a row takes its smallest tier. With `by`, every group falls back on its own.
    """
    tier = F.when(F.lit(False), F.lit(None).cast("int"))
    for n, p in sorted(tiers, key=lambda t: t[0]):
        tier = tier.when(p, F.lit(n))
    tagged = df.withColumn("tier", tier).where("tier IS NOT NULL")
    if by:
        low = tagged.groupBy(*by).agg(F.min("tier").alias("low"))
        return tagged.join(low, by).where("tier = low").drop("low")
    low = tagged.agg(F.min("tier").alias("low"))
    return tagged.crossJoin(F.broadcast(low)).where("tier = low").drop("low")


def lookup(facts: DataFrame, spec: Lookup) -> DataFrame:
    """Facts that fit, of the first non-empty tier (exact narrow, exact wide, partial narrow, partial wide), in order."""
    if spec.order_by not in ORDERS:
        raise ValueError(spec.order_by)
    df = with_day(facts)
    for c in spec.conditions():
        df = df.where(c)
    exacts = [True] if spec.exact_only or spec.key is None else [True, False]
    tiers = []
    for i, exact in enumerate(exacts):
        for wide in (False, True):
            p = F.lit(True)
            if spec.key is not None:
                p = p & key_predicate(spec.key, exact)
            if spec.period is not None:
                p = p & period_predicate(spec.period, wide)
            tiers.append((2 * i + int(wide), p))
    out = first_tier(df, tiers).orderBy(*ORDERS[spec.order_by]())
    return out.limit(spec.limit) if spec.limit is not None else out


#: Options of a row of specs, with the values that hold where a row or the whole column has none.
SPEC = {"doc_group": (None, "string"), "latest_only": (True, "boolean"), "corrections_only": (False, "boolean"), "value_owner": ("self", "string"), "order_by": ("date", "string"), "most": (None, "int")}


def lookup_many(facts: DataFrame, specs: DataFrame, limit: int = 10) -> DataFrame:
    """Many lookups in one plan: specs (query_id, company, key, period) meet the facts by company; tiers and limit hold per query.

    specs may also carry doc_group, latest_only, corrections_only, value_owner, order_by and most (rows instead of limit), as in Lookup.
    """
    option = {n: F.coalesce(F.col(n), F.lit(v)).cast(t) if n in specs.columns else F.lit(v).cast(t) for n, (v, t) in SPEC.items()}
    s = specs.select("query_id", F.col("company").alias("q_company"), F.col("key").alias("q_key"), F.col("period").alias("q_period"), *[c.alias(f"q_{n}") for n, c in option.items()])
    day = with_day(facts)

    def admitted(rows: DataFrame) -> DataFrame:
        rows = rows.where(~F.col("q_latest_only") | F.col("is_latest").isNull() | F.col("is_latest"))
        rows = rows.where(~F.col("q_corrections_only") | F.col("is_correction")).where(F.col("q_doc_group").isNull() | (F.col("doc_group") == F.col("q_doc_group")))
        return rows.where(F.when(F.col("q_value_owner") == "any", True).when(F.col("q_value_owner") == "other", third_party()).when(F.col("q_value_owner") == "self", ~third_party()))

    none, q = F.coalesce(F.length("period") == 0, F.lit(True)), F.col("q_period")
    of_year = F.coalesce(F.col("period").startswith(F.concat(q, F.lit("-"))), F.lit(False)) | (none & F.col("day").startswith(q))
    month = lambda near: F.coalesce(F.col("period") == q, F.lit(False)) | (none & F.col("day").startswith(near))
    narrow = q.isNull() | F.when(F.length(q) == 4, of_year).otherwise(month(F.replace(q, F.lit("-"))))
    wide = q.isNull() | F.when(F.length(q) == 4, of_year).otherwise(month(F.substring(q, 1, 4)))

    # An item is looked for within the distinct spellings of the company's items, not within its facts; then company and
    # spelling are the join key, so a large filer's facts don't all meet its questions.
    spelled = day.select(F.col("company").alias("s_company"), F.col("key_norm").alias("s_norm"), F.col("key").alias("s_key")).distinct()
    inside = F.contains(F.lower("s_norm"), F.lower("q_key")) | F.contains(F.lower("s_key"), F.lower("q_key"))
    of = s.join(spelled, F.col("s_company") == F.col("q_company")).where(inside).drop("s_company")
    same = (F.col("company") == F.col("q_company")) & F.col("key_norm").eqNullSafe(F.col("s_norm")) & F.col("key").eqNullSafe(F.col("s_key"))
    rows = admitted(day.join(of, same)).withColumn("ll_exact", F.coalesce(F.col("key_norm") == F.col("q_key"), F.lit(False))).drop("s_norm", "s_key")
    tier = F.when(F.col("ll_exact") & narrow, 0).when(F.col("ll_exact") & wide, 1).when(narrow, 2).when(wide, 3)
    tagged = rows.withColumn("tier", tier).where("tier IS NOT NULL").drop("ll_exact")
    hits = tagged.withColumn("ll_low", F.min("tier").over(Window.partitionBy("query_id"))).where("tier = ll_low").drop("ll_low")
    by_value = lambda name: F.when(F.col("q_order_by") == name, F.col("value_num"))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(by_value("value_desc")), F.asc_nulls_last(by_value("value_asc")), F.desc_nulls_last("day"), "fact_id")
    out = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.coalesce("q_most", F.lit(limit)))
    return out.drop(*[f"q_{n}" for n in SPEC])


def merge_stores(stores: list[DataFrame], spec: Lookup) -> DataFrame:
    """One lookup over several stores: exact in any store beats partial in every store; equal facts (document, chunk, key, text) count once."""
    both = None
    for i, s in enumerate(stores):
        s = s.withColumn("store", F.lit(i))
        both = s if both is None else both.unionByName(s, allowMissingColumns=True)
    all_ = lookup(both, Lookup(**{**spec.__dict__, "limit": None}))
    w = Window.partitionBy("doc_id", "chunk_id", "key_norm", "value_text").orderBy("store", "fact_id")
    out = all_.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").orderBy(*ORDERS[spec.order_by]())
    return out.limit(spec.limit) if spec.limit is not None else out


def distinct_keys(facts: DataFrame, company: str | None = None, doc_group: str | None = None, limit: int = 100) -> DataFrame:
    for name, v in (("company", company), ("doc_group", doc_group)):
        facts = facts.where(F.col(name) == v) if v is not None else facts
    return facts.groupBy("key_norm").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key_norm").limit(limit)


def stats(facts: DataFrame) -> DataFrame:
    """Counts of a store: rows, stated figures and dates, linked chunks, distinct companies, documents and keys."""
    return facts.agg(
        F.count("*").alias("n_facts"), F.count("value_num").alias("n_numeric"), F.count("value_date").alias("n_dated"), F.count("chunk_id").alias("n_linked"),
        F.count_distinct("company").alias("n_companies"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("key_norm").alias("n_keys"),
    )


def check_existence(manifest: DataFrame, company: Column, kind: str, event: str, year: str | None = None) -> DataFrame:
    """company, n_kind, n_matched, n_corrections, verdict: whether filings of a kind with an event exist.

    exists if a report name holds both; absent if only the kind occurs; not_applicable if neither does.
    """
    name = symbol_key(F.lower("report_nm"))
    df = manifest if year is None else manifest.where(F.col("rcept_dt").startswith(year))
    of_kind = F.contains(name, symbol_key(F.lower(F.lit(kind))))
    hit = of_kind & F.contains(name, symbol_key(F.lower(F.lit(event))))
    by = df.groupBy(company.alias("company")).agg(F.count_if(of_kind).alias("n_kind"), F.count_if(hit).alias("n_matched"), F.count_if(hit & F.col("is_correction")).alias("n_corrections"))
    verdict = F.when(F.col("n_matched") > 0, "exists").when(F.col("n_kind") > 0, "absent").otherwise("not_applicable")
    return by.withColumn("verdict", verdict)


@dataclass(frozen=True)
class RetrievalFilter:
    """Conditions on documents or chunks; every field is optional and all must hold."""

    report_ids: tuple[str, ...] = ()
    companies: tuple[str, ...] = ()
    doc_groups: tuple[str, ...] = ()
    doc_subtypes: tuple[str, ...] = ()
    periods: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    latest_only: bool = False
    include_corrections: bool = True
    corrections_only: bool = False

    def is_selective(self) -> bool:
        return bool(self.report_ids or self.companies)

    def to_column(self) -> Column:
        """Over report_id, company, doc_group, doc_subtype, period, day, is_latest, is_correction. An unknown latest flag passes."""
        c = F.lit(True)
        for values, name in ((self.report_ids, "report_id"), (self.companies, "company"), (self.doc_groups, "doc_group"), (self.doc_subtypes, "doc_subtype")):
            if values:
                c = c & F.col(name).isin(list(values))
        if self.periods:
            c = c & matches_period(F.col("period"), F.col("day"), F.array(*[F.lit(p) for p in self.periods]))
        if self.date_from:
            c = c & (F.col("day") >= self.date_from)
        if self.date_to:
            c = c & (F.col("day") <= self.date_to)
        if self.latest_only:
            c = c & ~F.col("is_latest").eqNullSafe(False)
        if self.corrections_only:
            c = c & F.coalesce(F.col("is_correction"), F.lit(False))
        elif not self.include_corrections:
            c = c & ~F.coalesce(F.col("is_correction"), F.lit(False))
        return c

    def relaxed(self) -> list[RetrievalFilter]:
        """This filter, then without period, then without latest, then without document kind."""
        out = [self]
        for change in ({"periods": ()}, {"latest_only": False}, {"doc_groups": (), "doc_subtypes": ()}):
            out.append(RetrievalFilter(**{**out[-1].__dict__, **change}))
        return out


def relax(df: DataFrame, flt: RetrievalFilter) -> DataFrame:
    """Rows of the first relaxation of the filter that has any; column tier says which."""
    return first_tier(df, [(i, f.to_column()) for i, f in enumerate(flt.relaxed())])


# --- gates on keys and values -------------------------------------------------

# Form headers and signature fields that are no facts, and table headers of periodic reports.
FORM_HEADER = r"귀\s*중|금융위원회|한국거래소|^회\s*사\s*명|^대\s*표\s*이\s*사|^본\s*점\s*소\s*재\s*지|^\(?\s*직\s*책|전화번호|작성책임자|담당자|^성\s*명|^주\s*소|^전\s*자\s*우\s*편|^홈페이지|^결\s*재|^문서번호|^제\s*출\s*인"
TABLE_HEADER = r"^(?:구분|항목|내역|내용|분류|단위|비고|주석|합계|소계|계|기타|기초|기말|누적|제?[0-9]+기|(?:당|전)?(?:3|6|9|12)개월|(?:당|전|전전|직전|금)(?:기|분기|반기|연도|사업연도|회계연도)(?:초|말|누적)?)$"


def is_meaningful_key(key: Column) -> Column:
    """A key of 2 to 40 characters with two letters or digits that is neither a figure nor a form header."""
    letters = F.length(F.regexp_replace(key, r"[^가-힣A-Za-z0-9]", ""))
    return F.length(key).between(2, 40) & ~key.rlike(r"^[0-9,.\-/()%\s]+$") & (letters >= 2) & ~key.rlike(FORM_HEADER)


def noise_reason(key: Column, num: Column, date: Column) -> Column:
    """Why a (key, value) pair of a periodic table is noise: a figure as key, or a header with a value that is neither number nor date."""
    figure = key.rlike(r"^[0-9,.\-/()%\s]+$|^[△▲▽]\s*[+-]?[0-9,]+(?:\.[0-9]+)?\s*(?:원|천원|백만원|억원|조원|%|주)?$")
    header = F.regexp_replace(key, r"(?U)\s+", "").rlike(TABLE_HEADER) & num.isNull() & date.isNull()
    return F.when(figure, "numeric_key").when(header, "header_without_value")


def is_bad_key(key: Column) -> Column:
    """Keys unfit for questions: too short or long, figures, form headers, sentences."""
    return ~F.coalesce(is_meaningful_key(key), F.lit(False)) | key.rlike(r"[?!。]|다\.$") | (F.length(key) > 30)


def company_keys(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows (key) whose key is the name of a company (name): pieces of values as well."""
    names = companies.select(name_key(F.col("name")).alias("ll_name")).where("ll_name <> ''").distinct()
    return rows.join(names, name_key(F.col("key")) == F.col("ll_name"), "left_semi")


def is_parse_artifact(key: Column) -> Column:
    """Keys that are pieces of values: overlong, long digit runs, legal forms, report labels; see also company_keys()."""
    return (F.length(key) > 60) | key.rlike(r"[0-9]{3}") | key.rlike(r"(?i)주식회사|\(주\)|㈜|\b(?:inc|ltd|corp|plc)\b") | key.rlike(r"보고서$|(?i)report$")

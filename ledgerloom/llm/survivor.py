"""Problem 6: the best representative of each group of duplicate records.

One aggregation takes, for every attribute, the maximum of a struct of (stated, source priority, date, filing number,
smallest id, value): a map-side combined reduction, so a group of any size never sits in one task. Where no priority is
given, sources are equal and the date decides.

Defined cases: records whose group column is null form no group; a value that is null, empty or only says that nothing
is given isn't stated; a null priority is the lowest; a missing date is taken from the catalogue, else from the filing number; ties go to the
smallest id; repeated rows change nothing; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import filing_day as day

# Texts that say that no value is given here.
NOTHING = ["-", "--", "---", "–", "—", "n/a", "na", "nil", "none", "null", "not applicable", "see attachment", "to be stated later", "omitted", "해당없음", "해당사항없음", "기재생략", "추후기재", "별첨참조", "미정", "없음"]


def states(c: Column) -> Column:
    """Whether a text states a value."""
    bare = F.regexp_replace(F.lower(c), r"(?U)^[\s(\[]+|[\s)\].]+$", "")
    said = F.regexp_replace(bare, r"(?U)\s+", "").isin([n.replace(" ", "") for n in NOTHING])
    return F.coalesce((bare != "") & ~said, F.lit(False))


def survivors(df: DataFrame, group: list[str], attributes: dict[str, Column], order: list[Column], stated: Column | None = None) -> DataFrame:
    """One row per group: group columns, n_records and for every attribute the value of its best record.

    An attribute's best record states it (by default: is non-null; for strings: states()) and is the greatest by `order`.
    """
    best = []
    for name, value in attributes.items():
        has = stated if stated is not None else value.isNotNull()
        best.append(F.max(F.struct(has.alias("has"), *[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("value"))).alias(name))
    some = df.where(" AND ".join(f"`{g}` IS NOT NULL" for g in group)).groupBy(*group).agg(F.count("*").alias("n_records"), *best)
    return some.select(*group, "n_records", *[F.when(F.col(f"{a}.has"), F.col(f"{a}.value")).alias(a) for a in attributes])


def dated(facts: DataFrame, manifest: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of facts with ll_day and ll_no: filing date (else the catalogue's, else the number's) and filing number."""
    no = F.regexp_extract("doc_id", r"_([^_]*)$", 1)
    with_day = facts.select(*columns, day(F.col("filing_date")).alias("ll_day"), no.alias("ll_no"), F.col("doc_id").alias("ll_doc"))
    # Only the few undated records meet the catalogue.
    known = manifest.groupBy(F.col("doc_id").alias("ll_doc")).agg(F.max("rcept_dt").alias("ll_dt"))
    undated = with_day.where("ll_day IS NULL").join(known, "ll_doc", "left")
    undated = undated.withColumn("ll_day", F.coalesce(day(F.col("ll_dt")), F.substring("ll_no", 1, 8))).drop("ll_dt")
    return with_day.where("ll_day IS NOT NULL").unionByName(undated).drop("ll_doc")


def latest_statements(facts: DataFrame, manifest: DataFrame) -> DataFrame:
    """correction_group_id, field_code, fact_id: the value-stating record of the latest filing of every repeated item."""
    group = ["correction_group_id", "field_code"]
    own = facts.where("value_owner IS NULL AND correction_group_id IS NOT NULL AND field_code IS NOT NULL")
    rows = dated(own, manifest, [*group, "fact_id", "value_text"])
    out = survivors(rows, group, {"fact_id": F.col("fact_id")}, [F.col("ll_day"), F.col("ll_no"), -F.col("fact_id")], stated=states(F.col("value_text")))
    return out.where("n_records > 1 AND fact_id IS NOT NULL").select(*group, "fact_id")


def merged_records(facts: DataFrame, manifest: DataFrame, priority: Column | None = None) -> DataFrame:
    """One built record per repeated item: each field from the filing that states it with the highest priority, and of these the latest.

    priority: an expression over the columns of facts, the greater the more trusted.
    """
    group = ["correction_group_id", "field_code"]
    names = ["company", "period", "key", "value_text", "value_num", "value_unit", "value_date", "unit_code", "unit_value"]
    own = facts.where("value_owner IS NULL AND correction_group_id IS NOT NULL AND field_code IS NOT NULL")
    trust = F.lit(0) if priority is None else F.coalesce(priority.cast("int"), F.lit(-(1 << 31)))
    rows = dated(own.withColumn("ll_trust", trust), manifest, [*group, "fact_id", "ll_trust", *names])
    kinds = dict(rows.dtypes)
    values = {n: F.when(states(F.col(n)), F.col(n)) if kinds[n] == "string" else F.col(n) for n in names}
    return survivors(rows, group, values, [F.col("ll_trust"), F.col("ll_day"), F.col("ll_no"), -F.col("fact_id")]).where("n_records > 1")

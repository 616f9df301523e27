"""Problem 3: the same quantity recorded in different units. Built-in expressions and joins only.

Number and unit are extracted from the text, the unit alias is normalised by a join with the fixed alias table, the
recorded unit is the first one given by mixed scale words, unit field, unit code (times a numeric unit value), unit
value, text or key, else the filing's usual unit of the item's kind, and factor and offset are applied.

Defined cases: a fact without a number, or with a date, has null amounts and stays; an unknown unit leaves
`amount_common` null; repeated rows stay; an empty table gives an empty result; added columns start with `amount` or
`unit_`, and a column of that name in the input is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import compose_hangul, fold_width, lookalikes_to_latin
from ledgerloom.functions.units import NUMBER, alias_key, alias_pattern, mixed_words, negative, shown_number, stated_unit, unit_table, words_to_won
from ledgerloom.session import keep

ADDED = ["amount", "amount_unit", "amount_factor", "amount_common", "unit_from"]
#: Relative difference within which two amounts agree.
TOLERANCE = 1e-3


def is_date(text: Column) -> Column:
    return text.rlike(r"^\s*[0-9]{4}\s*[-./년]\s*[0-9]{1,2}\s*[-./월]\s*[0-9]{1,2}\s*일?\s*$")


def _recorded(facts: DataFrame) -> DataFrame:
    """Adds ll_amount, ll_alias, ll_scale and ll_from: the number and unit as recorded."""
    unit, text = alias_pattern(), F.col("value_text")
    sign = r"^\s*[△▲▽▼−(-]*\s*"
    shape = sign + "(?:" + unit + r"\s*)?" + NUMBER + r"\s*(?:(?i:in\s+)?" + unit + r")?\s*\)?\s*$"
    mixed = mixed_words(text)
    date = is_date(text) | F.col("unit_code").eqNullSafe("PERIODYMD") | F.col("value_date").isNotNull()
    number = F.when(date, None).when(mixed, words_to_won(text)).when(text.rlike(shape), shown_number(text))
    signed = F.when(negative(text), -number).otherwise(number)
    amount = F.when(text.isNull() & ~F.coalesce(date, F.lit(False)), F.col("value_num")).otherwise(signed)

    has_key_unit = F.col("key").rlike(r"[(\[（［]")
    key = F.when(has_key_unit, lookalikes_to_latin(fold_width(compose_hangul(F.col("key")))))
    in_key = F.regexp_extract(key, r"[(\[](?:[^()\[\]:]*:)?\s*(?i:in\s+)?(" + unit + r")\s*[)\]]", 1)
    in_text = F.regexp_extract(text, "(" + unit + ")", 1)
    clean = lambda c: F.nullif(alias_key(stated_unit(c)), F.lit(""))
    numeric_value = F.col("unit_value").rlike(r"^[0-9]+(\.[0-9]+)?$")
    code = F.when(F.col("unit_code") != "PERIODYMD", F.lower(F.trim("unit_code")))
    found = F.coalesce(
        F.when(mixed, F.struct(F.lit("원").alias("alias"), F.lit("words").alias("at"))),
        *[
            F.when(a.isNotNull(), F.struct(a.alias("alias"), F.lit(at).alias("at")))
            for a, at in (
                (clean(F.col("value_unit")), "value_unit"),
                (F.nullif(code, F.lit("")), "unit_code"),
                (F.when(~numeric_value, clean(F.col("unit_value"))), "unit_value"),
                (F.nullif(alias_key(in_text), F.lit("")), "value_text"),
                (F.nullif(alias_key(in_key), F.lit("")), "key"),
            )
        ],
    )
    scale = F.when((found["at"] == "unit_code") & numeric_value, F.col("unit_value").try_cast("double")).otherwise(1.0)
    clash = [c for c in ADDED if c in facts.columns]
    return facts.drop(*clash).withColumns({"ll_amount": amount, "ll_found": found, "ll_scale": scale})


def recorded(facts: DataFrame) -> DataFrame:
    """facts with the amount, unit kind, factor and place as recorded; null unit where none is shown."""
    units = F.broadcast(unit_table(facts.sparkSession).select(F.col("alias").alias("ll_alias"), F.col("unit").alias("ll_unit"), F.col("factor").alias("ll_factor"), F.col("offset").alias("ll_offset")))
    df = _recorded(facts)
    df = df.join(units, F.col("ll_found.alias") == F.col("ll_alias"), "left")
    return df.withColumns({"ll_factor": F.col("ll_factor") * F.col("ll_scale"), "ll_from": F.when(F.col("ll_unit").isNotNull(), F.col("ll_found.at"))}).drop("ll_found", "ll_scale", "ll_alias")


def convert(facts: DataFrame) -> DataFrame:
    """facts with amount, amount_unit, amount_factor, amount_common (in won, shares, ratio, m2 or kg) and unit_from.

    A fact that shows no unit takes the unit its filing shows most often for quantities of the same kind, else the common unit.
    """
    df = recorded(facts)
    shown = df.where("ll_unit IS NOT NULL AND ll_amount IS NOT NULL")
    item = F.coalesce("field_code", "key_norm")
    kinds = shown.groupBy(item.alias("ll_item"), "ll_unit").count().groupBy("ll_item").agg(F.max_by("ll_unit", F.struct("count", "ll_unit")).alias("ll_kind"))
    usual = shown.groupBy("doc_id", "ll_unit", "ll_factor").count().groupBy(F.col("doc_id").alias("ll_doc"), F.col("ll_unit").alias("ll_du")).agg(F.max_by("ll_factor", F.struct("count", "ll_factor")).alias("ll_usual"))
    need = "ll_unit IS NULL AND ll_amount IS NOT NULL"
    # Only facts without a unit take part in the joins for a default; each side of the join is one row per item or filing and kind.
    without = df.where(need).join(kinds, item == F.col("ll_item"), "left").join(usual, (F.col("doc_id") == F.col("ll_doc")) & (F.col("ll_kind") == F.col("ll_du")), "left")
    without = without.withColumns({"ll_unit": F.col("ll_kind"), "ll_factor": F.when(F.col("ll_kind").isNotNull(), F.coalesce("ll_usual", F.lit(1.0))), "ll_offset": F.lit(0.0), "ll_from": F.when(F.col("ll_usual").isNotNull(), "filing").when(F.col("ll_kind").isNotNull(), "item")})
    both = df.where(f"NOT ({need})").unionByName(without.drop("ll_item", "ll_kind", "ll_doc", "ll_du", "ll_usual"))
    has = F.col("ll_amount").isNotNull()
    return both.withColumns(
        {
            "amount": F.col("ll_amount"),
            "amount_unit": F.when(has, F.col("ll_unit")),
            "amount_factor": F.when(has, F.col("ll_factor")),
            "amount_common": F.col("ll_amount") * F.col("ll_factor") + F.col("ll_offset"),
            "unit_from": F.when(has, F.col("ll_from")),
        }
    ).drop("ll_amount", "ll_unit", "ll_factor", "ll_offset", "ll_from")


#: What makes two records equal: chain, item, unit, factor and amount.
RECORD = ["g", "f", "u", "k", "v"]


def _classes(facts: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Facts with their record (fact_id and RECORD), and pairs of records that agree (RECORD, k2, v2), the smaller unit first.

    Equal records are one class, so repeated rows never meet each other; classes meet by a logarithmic bucket, so a large
    chain isn't compared all against all.
    """
    own = facts.where("value_owner IS NULL AND correction_group_id IS NOT NULL AND field_code IS NOT NULL")
    cols = ["fact_id", "correction_group_id", "field_code", "value_text", "value_num", "value_unit", "value_date", "unit_code", "unit_value", "key"]
    rows = recorded(own.select(*cols)).where("ll_unit IS NOT NULL AND ll_amount IS NOT NULL")
    rows = keep(rows.select("fact_id", F.col("correction_group_id").alias("g"), F.col("field_code").alias("f"), F.col("ll_unit").alias("u"), F.col("ll_factor").alias("k"), (F.col("ll_amount") * F.col("ll_factor") + F.col("ll_offset")).alias("v")), "amounts")
    width = 2.5 * tolerance
    place = F.when(F.col("v") == 0, F.lit(-1e9)).otherwise(F.log(F.abs("v")) / width)
    classes = rows.select(*RECORD).distinct().withColumn("p", place)
    left = classes.withColumn("b", F.floor("p"))
    near = F.floor("p") + F.when(F.col("p") - F.floor("p") >= 0.5, 1).otherwise(-1)
    right = classes.withColumn("b", F.explode(F.array(F.floor("p"), near))).drop("p")
    right = right.select(*[F.col(c).alias(c + "2") for c in right.columns])
    close = F.abs(F.col("v") - F.col("v2")) <= F.lit(tolerance) * F.greatest(F.abs("v"), F.abs("v2"))
    pairs = left.join(right, (F.col("g") == F.col("g2")) & (F.col("f") == F.col("f2")) & (F.col("b") == F.col("b2")) & (F.col("u") == F.col("u2")) & (F.col("k") < F.col("k2")) & close)
    return rows, pairs.select(*RECORD, "k2", "v2")


def same_amounts(facts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """fact_id_a, fact_id_b: facts of one chain and item whose amounts agree in the common unit though their recorded units differ in size."""
    rows, pairs = _classes(facts, tolerance)
    a = rows.withColumnRenamed("fact_id", "a")
    b = rows.select(F.col("fact_id").alias("b"), "g", "f", "u", F.col("k").alias("k2"), F.col("v").alias("v2"))
    out = pairs.join(a, RECORD).join(b, ["g", "f", "u", "k2", "v2"])
    return out.select(F.least("a", "b").alias("fact_id_a"), F.greatest("a", "b").alias("fact_id_b"))


def amount_links(facts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """fact_id, class_id, n_links: every fact with an amount, the smallest fact_id of its equal records, and the number of facts that agree with it in another unit."""
    rows, pairs = _classes(facts, tolerance)
    pairs, sizes = keep(pairs, "agreeing"), keep(rows.groupBy(*RECORD).agg(F.min("fact_id").alias("class_id"), F.count("*").alias("n")), "classes")
    both = pairs.union(pairs.select("g", "f", "u", "k2", "v2", "k", "v"))
    links = both.join(sizes.select("g", "f", "u", F.col("k").alias("k2"), F.col("v").alias("v2"), "n"), ["g", "f", "u", "k2", "v2"]).groupBy(*RECORD).agg(F.sum("n").alias("n_links"))
    named = sizes.drop("n").join(links, RECORD, "left")
    return rows.join(named, RECORD).select("fact_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))

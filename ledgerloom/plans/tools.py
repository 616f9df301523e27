"""The tools a question-answering agent calls, by name; each returns a table, and errors are data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import cagr, growth, ratio
from ledgerloom.operators import facts, retrieval, versions


class Tools:
    """Bound to the tables of a store: facts, documents (with chains) and chunks (id, text, and filter columns)."""

    def __init__(self, fact_rows: DataFrame, documents: DataFrame, chunks: DataFrame | None = None):
        self.facts, self.documents, self.chunks = fact_rows, documents, chunks
        self.spark = fact_rows.sparkSession

    def search_filings(self, query: str, k: int = 8, flt: facts.RetrievalFilter | None = None) -> DataFrame:
        corpus = self.chunks if flt is None else facts.relax(self.chunks, flt).drop("tier")
        return retrieval.bm25(corpus.select("id", "text"), self.spark.createDataFrame([(0, query)], "query_id int, text string"), k)

    def get_correction_history(self, company: str) -> DataFrame:
        d = self.documents.where(F.col("company") == company)
        return versions.history(d.withColumnRenamed("report_id", "doc_id"))

    def get_latest_report(self, company: str, doc_group: str | None = None) -> DataFrame:
        d = self.documents.where((F.col("company") == company) & ~F.col("is_latest").eqNullSafe(False))
        d = d if doc_group is None else d.where(F.col("doc_group") == doc_group)
        return d.orderBy(F.desc("day"), F.desc("report_id")).limit(1)

    def _one(self, c) -> DataFrame:
        return self.spark.range(1).select(c.alias("value"))

    def calculate_growth_rate(self, before: float, after: float) -> DataFrame:
        return self._one(growth(F.lit(float(before)), F.lit(float(after))))

    def calculate_ratio(self, part: float, whole: float) -> DataFrame:
        return self._one(ratio(F.lit(float(part)), F.lit(float(whole))))

    def calculate_cagr(self, first: float, last: float, years: float) -> DataFrame:
        return self._one(cagr(F.lit(float(first)), F.lit(float(last)), F.lit(float(years))))

    def lookup_fact(self, **spec) -> DataFrame:
        return facts.lookup(self.facts, facts.Lookup(**spec))

    def list_fact_items(self, company: str, doc_group: str | None = None) -> DataFrame:
        return facts.distinct_keys(self.facts, company, doc_group)

    def compare_facts(self, companies: list[str], key: str, period: str | None = None) -> DataFrame:
        """The newest own value of an item per company, largest first."""
        rows = facts.lookup(self.facts, facts.Lookup(companies=tuple(companies), key=key, period=period, numeric_only=True, limit=None))
        best = rows.groupBy("company").agg(F.max_by(F.struct("value_num", "value_unit", "day", "fact_id"), F.struct("day", -F.col("fact_id"))).alias("f"))
        return best.select("company", "f.*").orderBy(F.desc("value_num"), "company")

    def call(self, name: str, /, **arguments) -> DataFrame:
        """Runs a tool by name; a wrong name or argument comes back as a row with the error. A failure while the rows are computed is the caller's."""
        tool: Callable | None = None if name.startswith("_") or name == "call" else getattr(self, name, None)
        try:
            if tool is None:
                raise ValueError(f"unknown tool {name!r}")
            return tool(**arguments)
        except Exception as e:  # noqa: BLE001  errors are data for the caller
            return self.spark.createDataFrame([(type(e).__name__, str(e)[:500])], "error string, message string")

"""Readers: the catalogue, the filer list, raw files, chunk and index tables, with checks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import compose

MANIFEST = (
    "doc_id string, corp_code string, corp_name string, listed_name string, stock_code string, industry string, sector string, doc_group string, doc_subtype string, report_nm string, "
    "is_correction boolean, rcept_no string, rcept_dt string, flr_nm string, base_year int, base_month int, file_path string, file_format string, n_files int"
)
#: Share of documents whose file must be found in a healthy corpus.
HEALTHY = 0.99
NAMES = ["corp_name", "listed_name", "report_nm", "flr_nm"]


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue from JSON lines: declared schema, blank lines skipped, names composed, defaults for format and file count."""
    df = spark.read.schema(MANIFEST).json(path).where("doc_id IS NOT NULL")
    df = df.withColumns({c: compose(F.col(c)) for c in NAMES})
    return df.withColumns({"file_format": F.coalesce("file_format", F.lit("xml")), "n_files": F.coalesce("n_files", F.lit(1)), "is_correction": F.coalesce("is_correction", F.lit(False))})


def load_universe(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """The filer list from CSV, with or without a byte order mark: every column stays a string, so codes keep their zeros."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.withColumns({c: compose(F.col(c)) for c in names or [] if c in df.columns})


def path_key(c: Column) -> Column:
    """A path for comparison: composed, one kind of slash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(compose(c), r"[\\/]+", "/"), r"^(?:file:)?/+|/+$", "")


def resolve_paths(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest with resolved and n_matches: its file_path found among files (column path), whatever the composition of the names; the first by code points wins."""
    f = files.select(path_key(F.col("path")).alias("pk"), "path").groupBy("pk").agg(F.min("path").alias("resolved"), F.count("*").alias("n_matches"))
    return manifest.join(f, path_key(F.col("file_path")) == F.col("pk"), "left").drop("pk").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def validate_corpus(resolved: DataFrame) -> DataFrame:
    """doc_group, n_docs, n_resolved, rate, healthy: per group and in total (doc_group 'all')."""
    r = resolved.rollup("doc_group").agg(F.count("*").alias("n_docs"), F.count("resolved").alias("n_resolved"))
    rate = F.round(F.when(F.col("n_docs") > 0, F.col("n_resolved") / F.col("n_docs")).otherwise(0.0), 6)
    return r.select(F.coalesce("doc_group", F.lit("all")).alias("doc_group"), "n_docs", "n_resolved", rate.alias("rate"), ((rate >= HEALTHY) & (F.col("n_docs") > 0)).alias("healthy"))


def read_files(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """path, text of raw files; bytes that don't decode are replaced by U+FFFD, so one bad file stops nothing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if encoding.upper().replace("-", "") == "UTF8":
        return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else x.decode(encoding, "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["path", "text"])

    return files.select("path", "content").mapInArrow(decoded, "path string, text string")


def route(manifest: DataFrame) -> Column:
    """How a document is read: by its group, never by its extension; mixed pdf and html is marked as unsupported."""
    return F.when(F.col("file_format") == "pdf+html", "unsupported_pdf_html").when(F.col("doc_group") == "exchange", "html").when(F.col("doc_group").isin("periodic", "major", "holding"), "xml").otherwise("unknown")


def load_chunks(spark: SparkSession, path: str, with_codes: bool = True, leaves_only: bool = False) -> DataFrame:
    """Chunk rows; field codes are dropped before the scan if not wanted, parents by an anti-join."""
    df = spark.read.parquet(path)
    if not with_codes and "field_codes" in df.columns:
        df = df.drop("field_codes")
    if leaves_only:
        parents = df.where("parent_chunk_id IS NOT NULL").select(F.col("parent_chunk_id").alias("chunk_id")).distinct()
        df = df.join(parents, "chunk_id", "left_anti")
    return df


def load_sparse(spark: SparkSession, path: str, chunks: DataFrame) -> DataFrame:
    """Token weights from JSON lines (id, w); corrupt files are skipped, unknown ids dropped."""
    w = spark.read.schema("id string, w map<string,float>").option("ignoreCorruptFiles", True).json(path).where("id IS NOT NULL")
    return w.join(chunks.select(F.col("chunk_id").alias("id")), "id", "left_semi")


def known_ids_only(index: DataFrame, chunks: DataFrame, id_: str = "id") -> DataFrame:
    """An index without rows of unknown chunks."""
    return index.join(chunks.select(F.col("chunk_id").alias(id_)), id_, "left_semi")


class Bundle:
    """Optional tables of a search service by name; a missing one means one channel less, not an error."""

    def __init__(self, spark: SparkSession, paths: dict[str, str]):
        self.tables: dict[str, DataFrame] = {}
        self.missing: list[str] = []
        for name, path in paths.items():
            try:
                self.tables[name] = spark.read.parquet(path)
            except Exception:  # noqa: BLE001  any unreadable table is a missing channel
                self.missing.append(name)

    def __getitem__(self, name: str) -> DataFrame | None:
        return self.tables.get(name)

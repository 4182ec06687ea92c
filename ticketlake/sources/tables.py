"""Scans of the driver tables and of ticket files (CSV / JSON lines / whole text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- S1: ticket CSV scan ----------------------------------------------------------

TICKET_CSV_SCHEMA = T.StructType([
    T.StructField("Ticket ID", T.StringType()),
    T.StructField("Ticket Subject", T.StringType()),
    T.StructField("Ticket Description", T.StringType()),
    T.StructField("Resolution", T.StringType()),
    T.StructField("Customer Name", T.StringType()),
    T.StructField("Customer Email", T.StringType()),
    T.StructField("Customer Age", T.StringType()),
])


def scan_ticket_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header row; multi-line quoted cells allowed; explicit schema (no inference)."""
    reader = (spark.read.option("header", True).option("multiLine", True)
              .option("escape", '"').option("mode", "PERMISSIVE"))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


# --- S4: KB chunk scan (JSON lines) -------------------------------------------------

CHUNK_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("chunk_id", T.LongType()),
    T.StructField("text", T.StringType()),
])


def scan_chunks(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of ``{source, chunk_id, text}``; blank lines are skipped by the reader."""
    return (spark.read.schema(CHUNK_SCHEMA).json(path)
            .where(F.col("chunk_id").isNotNull() | F.col("text").isNotNull()))


# --- S5: KB document scan (whole file is one text) -------------------------------

def scan_kb_docs(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``(source, text)``; the file path is the chunk source.  A final line end closes
    the file and is no part of the text."""
    return (spark.read.text(path, wholetext=True)
            .select(F.input_file_name().alias("source"), F.regexp_replace("value", r"\n\z", "").alias("text")))


# Stands between documents where many share a file.
DOC_SEPARATOR = "\n\x1e\n"


def write_kb_pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Documents in as many text files as ``docs`` has partitions: a line with the id, then the text."""
    docs.select(F.concat_ws("\n", F.col(id_col).cast("string"), F.col(text_col)).alias("value")).write.option(
        "lineSep", DOC_SEPARATOR).text(path)


def scan_kb_pack(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, source, text)`` of files that hold many documents each; large files are split between tasks."""
    value = F.col("value")
    end = F.instr(value, "\n")
    head = F.when(end > 0, F.substring(value, F.lit(1), end - 1)).otherwise(value)
    return (spark.read.option("lineSep", DOC_SEPARATOR).text(path)
            .select(head.try_cast("long").alias("doc_id"), F.input_file_name().alias("source"),
                    F.when(end > 0, F.substring(value, end + 1, F.length(value))).alias("text")))

"""Scans of bid folders and of the engine's JSON files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import document_id, relative_path
from ..functions.text import col

#: What the first 4 KB of an HTML file hold at least one of, lower-cased.
HTML_MARKERS = ("<!doctype html", "<html", "<head", "<body")

REPORT_CHUNKS = (
    "chunk_id string, bid_id string, document_id string, page_id string, chunk_index int, section_title string, text string, content_kind string, "
    "source_file string, file_name string, page_number int, source_locator string, diagnostic_ids array<string>, doc_type string, addendum_number int, document_date string"
)
CASES = (
    "case_id string, query string, bid_id string, category string, expected_record_ids array<string>, "
    "expected_passages array<struct<record_id:string,excerpt:string,bid_id:string,source_file:string,page_number:int>>"
)


def detected_format(path) -> Column:
    low = F.lower(col(path))
    return F.when(low.rlike(r"\.html?$"), "html").when(low.endswith(".pdf"), "pdf").otherwise("unknown")


def has_format_mismatch(fmt, content) -> Column:
    """Whether the first 4 KB contradict the suffix; unknown formats never do."""
    head = F.lower(F.decode(F.substring(col(content), 1, 4096), "ISO-8859-1"))
    html = F.lit(False)
    for marker in HTML_MARKERS:
        html = html | F.contains(head, F.lit(marker))
    return F.when(col(fmt) == "html", ~html).when(col(fmt) == "pdf", ~F.startswith(F.ltrim(head), F.lit("%pdf"))).otherwise(False)


def scan_folder(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """All files below the bid folders of ``root``: one row per file, each bid a direct child folder.
    A missing root gives an empty table with the same schema."""
    schema = "bid_id string, relative_path string, file_name string, detected_format string, document_id string, length long, content binary"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inner = F.regexp_replace(F.element_at(F.split("path", "\\Q" + root.rstrip("/").split("/")[-1] + "/\\E", 2), 2), "%20", " ")
    files = files.withColumn("inner", inner).withColumns({
        "bid_id": F.substring_index("inner", "/", 1), "relative_path": relative_path(F.regexp_replace("inner", "^[^/]*/", "")),
    })
    out = files.select(
        "bid_id", "relative_path", F.element_at(F.split("relative_path", "/"), -1).alias("file_name"), detected_format("relative_path").alias("detected_format"),
        document_id("bid_id", "relative_path").alias("document_id"), "length", "content",
    )
    return out if with_content else out.drop("content")


def read_report_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=f"chunks array<struct<{_nested(REPORT_CHUNKS)}>>", multiLine=True).select(F.inline("chunks"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=CASES, multiLine=True)


def read_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """Structured records; a row that does not fit the schema fails the read."""
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")


def _nested(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ", 1) for x in ddl.split(",")))

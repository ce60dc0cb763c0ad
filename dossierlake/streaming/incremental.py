"""Incremental ingestion with Structured Streaming: new files of a bid folder flow into the corpus."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import document_id
from ..operators.corpus import Index, index_records
from ..operators.ingest import chunks, html_sections
from ..sources.folders import detected_format

FILE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """Files below ``root`` as they appear, a bounded number in each batch."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(root)
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -2).alias("bid_id"), F.element_at(parts, -1).alias("file_name"), detected_format("path").alias("detected_format"), "content", "modificationTime")


def html_chunks(files: DataFrame) -> DataFrame:
    """Chunks of HTML files: each file's section texts joined by lines, cut into word windows."""
    pages = files.where("detected_format = 'html'").select(
        "bid_id", F.col("file_name").alias("source_file"), F.xxhash64("bid_id", "file_name").alias("page_id"), F.decode("content", "UTF-8").alias("html"))
    s = html_sections(pages).where("kind <> 'table' and text <> ''")
    texts = s.groupBy(F.col("page_id").alias("document_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("text"))
    cut = chunks(texts).withColumnRenamed("document_id", "page_id")
    named = cut.join(pages.select("page_id", "bid_id", "source_file"), "page_id")
    return named.select("bid_id", "source_file", document_id("bid_id", "source_file").alias("document_id"), F.concat_ws("-", "page_id", "chunk_index").alias("chunk_id"),
                        "text", F.lit(None).cast("string").alias("section_title"), F.lit(1).alias("page_number"), F.lit("html").alias("content_kind"))


def ingest(spark: SparkSession, root: str, index: Index, checkpoint: str, on_batch: Callable[[int, dict], None] | None = None, max_files: int = 1000):
    """Start the stream; each batch replaces the scopes of its files and keeps all others. Returns the running query."""

    def merge(batch: DataFrame, number: int) -> None:
        fresh = index_records(html_chunks(batch))
        counts = index.update(fresh, scopes=fresh.select("scope_id").distinct())
        if on_batch:
            on_batch(number, counts)

    return file_stream(spark, root, max_files).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): events by tumbling window under a watermark; the same plan runs on a
    table and on a stream, where events later than the watermark are dropped."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total")

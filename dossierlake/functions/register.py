"""SQL names for what the engine's operators do in Python: table functions and vectorized scalar functions."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import ship

SECTIONS = "ordinal int, kind string, text string, heading_level int, heading_path array<string>, table_no int"
TABLES = "table_no int, has_header boolean, cells array<array<string>>"
RANGES = "array<struct<start_word:int,end_word:int>>"


class ParseHtml:
    """parse_html(html): a row for each section of a page, in page order; none for null."""

    def eval(self, html: str) -> Iterator[tuple]:
        from dossierlake.operators.ingest import sections

        for i, row in enumerate(sections(html) if html is not None else []):
            yield (i, *row)


class ParseTables:
    """parse_tables(html): a row for each table of a page."""

    def eval(self, html: str) -> Iterator[tuple]:
        from dossierlake.operators.ingest import tables

        yield from tables(html) if html is not None else []


def _ranges(texts: pd.Series) -> pd.Series:
    from dossierlake.operators.ingest import word_ranges

    return pd.Series([[{"start_word": a, "end_word": b} for a, b in word_ranges(t or "")] for t in texts], dtype=object)


def register(spark: SparkSession) -> list[str]:
    """Register parse_html, parse_tables (table functions) and chunk_words (word ranges of a text's chunks)."""
    ship(spark)
    spark.udtf.register("parse_html", F.udtf(ParseHtml, returnType=SECTIONS))
    spark.udtf.register("parse_tables", F.udtf(ParseTables, returnType=TABLES))
    spark.udf.register("chunk_words", F.pandas_udf(_ranges, RANGES))
    return ["parse_html", "parse_tables", "chunk_words"]

"""Projections for readers: citation rows, field views, counts, reports and exports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, excerpt
from ..sources.store import export_json


def location(page, section, locator) -> Column:
    """page 3, section Dates or the locator as text; the parts that there are, joined by commas."""
    return F.concat_ws(", ", F.concat(F.lit("page "), col(page).cast("string")), F.concat(F.lit("section "), col(section)), col(locator))


def citation_rows(evidence: DataFrame) -> DataFrame:
    """(query_id, n, file, location, authority, excerpt), each distinct citation once, in rank order."""
    rows = evidence.select(
        "query_id", "rank", F.col("source_file").alias("file"), location("page_number", F.lit(None).cast("string"), F.lit(None).cast("string")).alias("location"),
        F.col("authority_status").alias("authority"), excerpt("text").alias("excerpt"))
    once = rows.groupBy("query_id", "file", "location", "authority", "excerpt").agg(F.min("rank").alias("rank"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "file", "excerpt"))).drop("rank")


def field_views(fields: DataFrame) -> DataFrame:
    """(bid_id, ordinal, field, shown, status, n_citations): values as text, items joined by commas."""
    shown = F.coalesce(F.when(F.col("value") == "true", "required").when(F.col("value") == "false", "not required").otherwise(F.col("value")), F.array_join(F.transform("items", lambda x: x["value"]), ", "))
    return fields.select("bid_id", "ordinal", "field", shown.alias("shown"), "status", F.greatest(F.coalesce(F.size("citations"), F.lit(0)), F.lit(0)).alias("n_citations"))


def validation_counts(results: DataFrame) -> DataFrame:
    """(status, n) over fields (bid_id, field, status) of several results; results that disagree count as review_required."""
    one = results.groupBy("bid_id", "field").agg(F.count_distinct("status").alias("k"), F.min("status").alias("s"))
    return one.groupBy(F.when(F.col("k") > 1, "review_required").otherwise(F.col("s")).alias("status")).agg(F.count("*").alias("n"))


def merged_fields(canonical: DataFrame, agent: DataFrame) -> DataFrame:
    """Canonical fields, and the agent's only where the canonical record has none of that name."""
    extra = agent.join(canonical.select("bid_id", "field"), ["bid_id", "field"], "left_anti")
    return canonical.unionByName(extra, allowMissingColumns=True)


def report_lines(cases: DataFrame) -> DataFrame:
    """(category, line): one line of text for each category of cases (category, case_id, recall, rr), by name."""
    g = cases.groupBy("category").agg(F.count("*").alias("n"), F.avg("recall").alias("r"), F.avg("rr").alias("m"))
    return g.select("category", F.format_string("%-14s %4d cases  recall %.4f  mrr %.4f", "category", "n", "r", "m").alias("line"))


def report_text(cases: DataFrame) -> str:
    """The lines of all categories; there are few, whatever the number of cases."""
    return "\n".join(r.line for r in report_lines(cases).orderBy("category").collect())


def gates(coverage: float, n_answers: int, least_coverage: float = 0.95, least_answers: int = 10) -> dict[str, bool]:
    return {"citation_coverage": coverage >= least_coverage, "cited_answers": n_answers >= least_answers}


def export_records(fields: DataFrame, changes: DataFrame, path: str) -> None:
    """One folder for each bid with its fields, and one with its changes."""
    export_json(field_views(fields), f"{path}/records")
    export_json(changes, f"{path}/changes")

"""Retrieval quality and evaluation cases."""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, same_text_key


def recall_at_k(expected, returned, k: int) -> Column:
    """Share of expected ids among the first k; with none expected, 1 only if nothing was returned."""
    e, r = F.array_distinct(col(expected)), col(returned)
    hit = F.size(F.array_intersect(e, F.slice(r, F.lit(1), F.lit(k)))) / F.size(e)
    return F.when(F.size(e) == 0, F.when(F.size(r) == 0, 1.0).otherwise(0.0)).otherwise(hit)


def reciprocal_rank(expected, returned) -> Column:
    e, r = col(expected), col(returned)
    at = F.array_min(F.filter(F.transform(e, lambda x: F.array_position(r, x)), lambda p: p > 0))
    return F.when(F.size(e) == 0, F.when(F.size(r) == 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(1.0 / at, F.lit(0.0)))


def report(cases: DataFrame, k: int = 5) -> DataFrame:
    """One row of averages over cases (expected, returned, seconds)."""
    return summarize(cases.select(recall_at_k("expected", "returned", k).alias("recall"), reciprocal_rank("expected", "returned").alias("rr"), "seconds"))


def summarize(cases: DataFrame) -> DataFrame:
    """The same over cases whose recall and reciprocal rank are known: (recall, rr, seconds)."""
    return cases.agg(
        F.count("*").alias("n_cases"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"),
        F.round(100 * F.avg((F.col("recall") > 0).cast("double")), 2).alias("relevant_pct"), F.round(100 * F.avg((F.col("seconds") < 5).cast("double")), 2).alias("under_5s_pct"))


def invalid_cases(cases: DataFrame, records: DataFrame) -> DataFrame:
    """(case_id, problem): repeated ids, excerpts that are too long or stand in no record of their source."""
    repeated = cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("repeated").alias("problem"))
    long = cases.where(F.length("excerpt") > 240).select("case_id", F.lit("long_excerpt").alias("problem"))
    r = records.select(F.col("record_id").alias("rid"), F.col("bid_id").alias("rb"), F.col("text").alias("rt"))
    c = cases.where("record_id is not null")
    absent = c.join(r, (F.col("record_id") == F.col("rid")) & (F.col("bid_id") == F.col("rb")) & F.contains("rt", "excerpt"), "left_anti").select("case_id", F.lit("not_in_source").alias("problem"))
    return repeated.unionAll(long).unionAll(absent).distinct()


def refresh_cases(cases: DataFrame, records: DataFrame) -> DataFrame:
    """(case_id, record_id): the shortest current record of the same source that holds the labelled excerpt, white space aside."""
    r = records.select("record_id", "bid_id", "source_file", F.col("page_number").alias("pn"), same_text_key("text").alias("t"), F.length("text").alias("len"))
    c = cases.select("case_id", "bid_id", "source_file", "page_number", same_text_key("excerpt").alias("x"))
    both = c.join(r, ["bid_id", "source_file"]).where(F.col("pn").eqNullSafe(F.col("page_number")) & F.contains("t", "x"))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("case_id").orderBy("len", "record_id"))).where("n = 1").select("case_id", "record_id")


def case_set_hash(cases: DataFrame) -> DataFrame:
    """One hash of the case set, whatever the order: the sum of row hashes and their number."""
    return cases.agg(F.sha2(F.concat_ws(":", F.sum(F.xxhash64(*[F.col(c) for c in cases.columns]).cast("decimal(20,0)")).cast("string"), F.count("*").cast("string")), 256).alias("fixture_hash"))


def citation_coverage(fields: DataFrame) -> DataFrame:
    """(bid_id, coverage): share of fields with a value that have citations; 1 if there are none."""
    has = F.col("value").isNotNull()
    share = F.count_if(has & (F.col("n_citations") > 0)) / F.nullif(F.count_if(has), F.lit(0))
    return fields.groupBy("bid_id").agg(F.round(F.coalesce(share, F.lit(1.0)), 6).alias("coverage"))


def workflow_status(fields: DataFrame) -> DataFrame:
    """(run_id, status): failed before review_required before partial before completed."""
    s = F.col("status")
    return fields.groupBy("run_id").agg(
        F.when(F.every(s == "failed"), "failed").when(F.bool_or(s == "review_required"), "review_required").when(F.bool_or(s.isin("not_found", "failed")), "partial")
        .otherwise("completed").alias("status"))


class ObservedVectors:
    """A vector search (queries to a table of candidates, or a failure) whose diagnostics are kept. With any, a
    configuration that needs vectors is not what was measured."""

    def __init__(self, search: Callable[[DataFrame], DataFrame]):
        self.search, self.diagnostics = search, []

    def __call__(self, queries: DataFrame) -> DataFrame | None:
        try:
            found = self.search(queries)
            found.limit(1).count()  # a backend that fails does so when it is read
        except Exception as e:
            self.diagnostics.append(f"{type(e).__name__}: {e}")
            return None
        return found


class ObservedReranker:
    """A pair model whose calls, short or non-finite scores and failures are noted; its output is passed on. The
    notes are of this process: where the model runs on executors, ``valid_scores`` marks the same on its rows."""

    def __init__(self, predict: Callable[[list[tuple[str, str]]], list[float]]):
        self.predict, self.calls, self.diagnostic = predict, 0, None

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        self.calls += 1
        try:
            scores = list(self.predict(pairs))
        except Exception as e:
            self.diagnostic = str(e)
            raise
        if len(scores) != len(pairs) or not all(math.isfinite(float(s)) for s in scores):
            self.diagnostic = "the reranker returned invalid scores"
        return scores


def valid_scores(reranked: DataFrame) -> DataFrame:
    """(query_id, valid): whether all scores of a query are finite numbers."""
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    return reranked.groupBy("query_id").agg(F.every(~bad).alias("valid"))


def configuration_status(configuration: str, vectors: ObservedVectors | None) -> str:
    """available, or lexical-fallback where the configuration asks for vectors and their search failed."""
    asks = configuration in ("semantic-only", "hybrid")
    return "lexical-fallback" if asks and vectors is not None and vectors.diagnostics else "available"

"""Cited answers from ranked evidence: intents, excerpts around terms, change sentences, disputes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, question_terms
from .extract import change_log

# fixed values: wordings of the intents, and how far an excerpt reaches before and after its term
INTENTS = (("addendum", r"addend|amend|changed|revised"), ("affidavit", "affidavit"), ("warranty", "warrant"), ("bond", "bid bond|bid security"))
BEFORE, AFTER = 50, 260
EXPLICIT_CHANGE = r"(?i)([A-Za-z][A-Za-z ]{2,60}?)\s+(?:is|was|has been|is hereby|are)\s+(?:revised|changed|extended|amended)\s+from\s+([^.;\n]{1,120}?)\s+to\s+([^.;\n]{1,120})"
POLARITY = {"required": r"(?:must|shall|required|mandatory)", "not_required": r"(?:not required|not necessary|no [a-z ]{0,20}required|waived)"}


def intent(question) -> Column:
    low, out = F.lower(col(question)), None
    for name, pattern in INTENTS:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("field")


def relevant(evidence: DataFrame) -> DataFrame:
    """Evidence rows (query_id, query, text, ...) that share most terms with their question; all of them, if none shares any."""
    score = F.size(F.array_intersect(question_terms("query"), question_terms("text")))
    w = Window.partitionBy("query_id")
    return evidence.withColumn("overlap", score).withColumn("most", F.max("overlap").over(w)).where("overlap = most").drop("most")


def relevant_by_bid(evidence: DataFrame) -> DataFrame:
    """The same within each bid of a question."""
    score = F.size(F.array_intersect(question_terms("query"), question_terms("text")))
    w = Window.partitionBy("query_id", "bid_id")
    return evidence.withColumn("overlap", score).withColumn("most", F.max("overlap").over(w)).where("overlap = most").drop("most", "overlap")


def unique(evidence: DataFrame) -> DataFrame:
    """Of repeated records the last, in the order in which each first came: rows (query_id, record_id, seq, ...)."""
    w = Window.partitionBy("query_id", "record_id")
    n = F.row_number().over(w.orderBy(F.desc("seq")))
    return evidence.withColumns({"first_seq": F.min("seq").over(w), "n": n}).where("n = 1").drop("n")


def by_bid(evidence: DataFrame, per_bid: int | None = None) -> DataFrame:
    """(query_id, bid_id, n, records): evidence grouped by bid in rank order, at most ``per_bid`` records each."""
    ranked = evidence.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "bid_id").orderBy("rank", "record_id")))
    if per_bid is not None:
        ranked = ranked.where(F.col("n") <= per_bid)
    return ranked.groupBy("query_id", "bid_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("n", "record_id"))), lambda x: x["record_id"]).alias("records"))


def top_answer(evidence: DataFrame, compare: bool = False) -> DataFrame:
    """(query_id, answer, n_cited): the first passage, or the first three for a comparison."""
    some = evidence.where(F.col("rank") <= (3 if compare else 1))
    parts = some.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("p"))
    return parts.select("query_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("answer"), F.size("p").cast("long").alias("n_cited"))


def islands(spans: DataFrame, by: str = "record_id") -> DataFrame:
    """Overlapping or touching (start, end) spans of each ``by`` merged: (by, start, end, merged)."""
    w = Window.partitionBy(by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("merged")).drop("island")


def excerpt_spans(records: DataFrame, pattern: str) -> DataFrame:
    """(record_id, start, end) around every match of a pattern, cut to the text."""
    zipped = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int>>))")
    folded = F.aggregate(zipped, start, lambda s, m: F.named_struct(
        F.lit("at"), s["at"] + F.length(m["gap"]) + F.coalesce(F.length(m["hit"]), F.lit(0)),
        F.lit("out"), F.when(m["hit"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(
            (s["at"] + F.length(m["gap"])).alias("s"), (s["at"] + F.length(m["gap"]) + F.length(m["hit"])).alias("e"))))),
    ))["out"]
    found = records.where(F.col("text").rlike(pattern)).select("record_id", F.length("text").alias("n"), F.explode(folded).alias("m"))
    return found.select("record_id", F.greatest(F.col("m.s") - BEFORE, F.lit(0)).alias("start"), F.least(F.col("m.e") + AFTER, F.col("n")).alias("end"))


def excerpts(records: DataFrame, pattern: str) -> DataFrame:
    merged = islands(excerpt_spans(records, pattern))
    return merged.join(records.select("record_id", "text"), "record_id").select(
        "record_id", "start", "end", F.trim(F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))).alias("excerpt"))


def explicit_changes(records: DataFrame) -> DataFrame:
    """(record_id, subject, before, after) of sentences like: X is revised from A to B."""
    parts = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(EXPLICIT_CHANGE), F.lit(i)).alias(n) for i, n in ((1, "subject"), (2, "before"), (3, "after"))])
    return records.where(F.col("text").rlike(EXPLICIT_CHANGE)).select("record_id", F.inline(parts)).select("record_id", *[F.trim(c).alias(c) for c in ("subject", "before", "after")])


def prior_values(changes: DataFrame, base: DataFrame) -> DataFrame:
    """For changes (change_id, bid_id, field_terms, previous) the first base record of the bid that holds the
    previous value and all terms of the field."""
    b = base.select(F.col("bid_id").alias("b"), F.col("record_id").alias("base_record"), F.lower("text").alias("t"))
    on = (F.col("bid_id") == F.col("b")) & F.contains("t", F.lower("previous")) & F.forall("field_terms", lambda x: F.contains(F.col("t"), F.lower(x)))
    return changes.join(b, on, "left").groupBy("change_id").agg(F.min("base_record").alias("base_record"))


def requirement_polarity(text, term: str) -> Column:
    """required, not_required or unstated, from the words within 100 before and 180 after a term."""
    low = F.lower(col(text))
    at = F.instr(low, term)
    window = F.substr(low, F.greatest(at - 100, F.lit(1)), F.least(at, F.lit(101)) + len(term) + 180)
    return F.when(at == 0, F.lit(None).cast("string")).when(window.rlike(POLARITY["not_required"]), "not_required").when(window.rlike(POLARITY["required"]), "required").otherwise("unstated")


def disputed(values: DataFrame) -> DataFrame:
    """(query_id, bid_id, status, value) from rows (query_id, bid_id, value, authority_status): superseded
    values are left out; more than one value of a bid is a dispute."""
    live = values.where(F.coalesce("authority_status", F.lit("")) != "superseded").where("value is not null")
    out = live.groupBy("query_id", "bid_id").agg(F.count_distinct("value").alias("n"), F.min("value").alias("v"))
    return out.select("query_id", "bid_id", F.when(F.col("n") > 1, "disputed").otherwise("answered").alias("status"), F.when(F.col("n") == 1, F.col("v")).alias("value"))


def changes_of(evidence: DataFrame) -> DataFrame:
    return change_log(evidence, by=("query_id",), order=("addendum_number", "page_number"))

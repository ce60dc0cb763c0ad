"""Composed answers: claims with citations from ranked evidence, one composer for each intent.

Evidence rows: (query_id, query, bid_id, record_id, source_file, page_number, doc_type, authority_status,
rank, text). Claims: (query_id, bid_id, seq, claim, value, established, citations).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze
from . import answers, extract

# fixed values: wordings of obligations and negations around a term, amounts, and what names a field in a question
OBLIGED = r"(?:must|shall|required|provide|submit|complete|affirm|certif[a-z]*)"
AFFIDAVIT = rf"(?is)(?<![a-z]){OBLIGED}(?![a-z]).{{0,100}}(?<![a-z])affidavit(?![a-z])|(?<![a-z])affidavit(?![a-z]).{{0,100}}(?<![a-z]){OBLIGED}(?![a-z])"
WARRANTY = r"(?i)(?<![a-z])(?:warrant[a-z]*|affidavit)(?![a-z])"
BOND = r"(?:bid\s+bond|bid\s+security|bond)"
NO_BOND = rf"(?is)(?<![a-z])(?:no|not|never)(?![a-z]).{{0,50}}(?<![a-z]){BOND}(?![a-z]).{{0,50}}(?:required|necessary|needed)|(?<![a-z]){BOND}(?![a-z]).{{0,50}}not\s+(?:required|necessary|needed)"
NEEDS_BOND = (
    rf"(?is)(?<![a-z]){BOND}(?![a-z]).{{0,80}}(?:required|(?:must|shall)\s+(?:provide|submit|furnish))"
    rf"|(?:required|(?:must|shall)\s+(?:provide|submit|furnish)).{{0,80}}(?<![a-z]){BOND}(?![a-z])"
)
AMOUNT = r"[0-9]+(?:\.[0-9]+)?\s*%|\$\s*[0-9][0-9,]*(?:\.[0-9]{2})?"
QUESTION_FIELDS = (
    ("deadline", "submission_deadline"), ("due date", "submission_deadline"), ("bid bond", "bid_bond"), ("solicitation", "solicitation_number"), ("submission method", "submission_method"),
    ("insurance", "insurance"), ("warranty", "warranty"), ("model", "model_number"), ("evaluation", "evaluation_criteria"), ("mandatory", "mandatory_requirements"), ("requirement", "mandatory_requirements"),
)
NOT_FOUND = {
    "affidavit": "The documents do not establish any affidavit requirements for the requested bid.",
    "warranty": "The documents do not establish warranty requirements for the requested bid or bids.",
    "bond": "The documents do not establish whether a bond is required or its amount.",
}
#: What an affidavit document says is quoted up to so many characters, a requirement with so many around it.
QUOTED, AROUND_BEFORE, AROUND_AFTER = 600, 100, 140


def question_field(question) -> Column:
    """The agent's field that a question asks for, null if none."""
    low, out = F.lower(question), F.lit(None).cast("string")
    for term, name in reversed(QUESTION_FIELDS):
        out = F.when(F.contains(low, F.lit(term)), name).otherwise(out)
    return out


def _window(text, pattern: str, before: int, after: int) -> Column:
    """The text around the first match of a pattern."""
    at = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substr(text, start, at - start + F.length(F.regexp_extract(text, pattern, 0)) + after))


def _key(text) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def _claims(rows: DataFrame, claim: Column, value=None, established=None) -> DataFrame:
    return rows.select("query_id", "bid_id", F.col("rank").cast("long").alias("seq"), claim.alias("claim"), (F.lit(None) if value is None else value).cast("string").alias("value"),
                       (F.lit(True) if established is None else established).alias("established"), F.array(extract.citation()).alias("citations"))


def _first_of(rows: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("rank", "record_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def affidavit_claims(evidence: DataFrame) -> DataFrame:
    """Each distinct affidavit document or obligation of a bid."""
    document = F.coalesce(F.col("doc_type") == "affidavit", F.lit(False))
    rows = evidence.where(document | F.col("text").rlike(AFFIDAVIT)).withColumn("k", _key("text")).where("k <> ''")
    quoted = F.when(document, F.substring(squeeze("text"), 1, QUOTED)).otherwise(squeeze(_window(F.col("text"), AFFIDAVIT, AROUND_BEFORE, AROUND_AFTER)))
    return _claims(_first_of(rows, "query_id", "bid_id", "k"), F.concat(F.col("bid_id"), F.lit(" affidavit requirement: "), quoted))


def warranty_claims(evidence: DataFrame) -> DataFrame:
    """The distinct passages around the mentions of warranties, one claim for each bid with all its citations."""
    rows = evidence.where(F.contains(F.lower("text"), F.lit("warrant")))
    keyed = rows.withColumn("key", F.concat_ws("#", F.col("query_id").cast("string"), F.col("record_id").cast("string")))
    parts = answers.excerpts(keyed.select(F.col("key").alias("record_id"), "text"), WARRANTY).select(F.col("record_id").alias("key"), "start", squeeze("excerpt").alias("passage"))
    both = keyed.join(parts, "key").withColumn("k", _key("passage")).where("k <> ''")
    w = Window.partitionBy("query_id", "bid_id", "k").orderBy("rank", "record_id", "start")
    once = both.withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumns({"cite": extract.citation(), "o": F.struct("rank", "record_id", "start")})
    each = once.groupBy("query_id", "bid_id").agg(
        F.array_sort(F.collect_list(F.struct("o", "passage"))).alias("p"), F.array_sort(F.collect_list(F.struct("o", "cite"))).alias("c"), F.min("rank").cast("long").alias("seq"))
    text = F.concat(F.col("bid_id"), F.lit(" warranty requirements: "), F.array_join(F.transform("p", lambda x: x["passage"]), " "))
    return each.select("query_id", "bid_id", "seq", text.alias("claim"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("established"),
                       F.array_distinct(F.transform("c", lambda x: x["cite"])).alias("citations"))


def bond_claims(evidence: DataFrame) -> DataFrame:
    """The first explicit requirement or negation of a bid with its amount; without any in a question's
    evidence, the passages that refer to bonds elsewhere."""
    near = _window(F.col("text"), rf"(?i)(?<![a-z]){BOND}(?![a-z])", 100, 180)
    rows = evidence.withColumn("near", near).where("near is not null").withColumn("says", F.when(F.col("near").rlike(NO_BOND), "no").when(F.col("near").rlike(NEEDS_BOND), "yes").when(
        F.col("near").rlike(r"(?is)bond.{0,100}(?<![a-z])elsewhere(?![a-z])"), "elsewhere"))
    stated = _first_of(rows.where("says in ('yes', 'no')"), "query_id", "bid_id")
    amount = F.nullif(F.regexp_extract("near", AMOUNT, 0), F.lit(""))
    tail = F.coalesce(F.concat(F.lit(" The stated amount is "), amount, F.lit(".")), F.lit(" The documents do not state the bond amount in this evidence."))
    said = F.when(F.col("says") == "no", F.concat("bid_id", F.lit(": the cited source explicitly states that a bond is not required."))).otherwise(
        F.concat(F.col("bid_id"), F.lit(": the cited source explicitly requires a bond."), tail))
    known = _claims(stated, said, F.when(F.col("says") == "no", "not required").otherwise(amount))
    open_ = _first_of(rows.where("says = 'elsewhere'"), "query_id", "bid_id").join(stated.select("query_id").distinct(), "query_id", "left_anti")
    refers = F.concat("bid_id", F.lit(": the cited document refers to bond requirements elsewhere but does not establish whether a bond is required or state an amount."))
    return known.unionByName(_claims(open_, refers, established=F.lit(False)))


def addendum_claims(evidence: DataFrame) -> DataFrame:
    """The changes that sentences of addenda state: what, from and to."""
    rows = evidence.where(F.coalesce(F.col("doc_type") == "addendum", F.lit(False)) & F.col("text").rlike(answers.EXPLICIT_CHANGE))
    parts = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(answers.EXPLICIT_CHANGE), F.lit(i)).alias(n) for i, n in ((1, "subject"), (2, "before"), (3, "after"))])
    each = rows.withColumn("c", F.explode(parts))
    text = F.concat(F.col("bid_id"), F.lit(": "), F.trim("c.subject"), F.lit(" changed from "), F.trim("c.before"), F.lit(" to "), F.trim("c.after"), F.lit("."))
    return _claims(each, text, F.trim("c.after")).dropDuplicates(["query_id", "bid_id", "claim"])


def field_claims(evidence: DataFrame) -> DataFrame:
    """The values of the field that the question asks for, each once for a bid; superseded evidence is left
    out, and for a deadline all but the authoritative, if there is any."""
    rows = evidence.withColumn("field", question_field(F.col("query"))).where("field is not null")
    rows = rows.where(F.coalesce("authority_status", F.lit("")) != "superseded")
    leads = F.col("authority_status").isin("current", "review_required")
    w = Window.partitionBy("query_id", "bid_id")
    led = (F.col("field") == "submission_deadline") & F.coalesce(F.max(leads).over(w), F.lit(False))
    rows = rows.withColumn("led", led).where(~F.col("led") | F.coalesce(leads, F.lit(False)))
    value = F.lit(None).cast("string")
    for name in dict.fromkeys(n for _, n in QUESTION_FIELDS):
        value = F.when(F.col("field") == name, extract.agent_value(name, "text")).otherwise(value)
    rows = _first_of(answers.relevant_by_bid(rows).withColumn("v", value).where("v is not null"), "query_id", "bid_id", "v")
    return _claims(rows, F.concat(F.col("bid_id"), F.lit(": "), F.replace("field", F.lit("_"), F.lit(" ")), F.lit(" is "), F.col("v"), F.lit(".")), F.col("v"))


COMPOSERS = {"addendum": addendum_claims, "affidavit": affidavit_claims, "warranty": warranty_claims, "bond": bond_claims, "field": field_claims}


def claims(evidence: DataFrame) -> DataFrame:
    """The claims of all questions, each composed by its intent; questions of any intents are answered at once."""
    asked = evidence.withColumn("intent", answers.intent("query"))
    out = None
    for name, composer in COMPOSERS.items():
        some = composer(asked.where(F.col("intent") == name)).withColumn("intent", F.lit(name))
        out = some if out is None else out.unionByName(some)
    return out


def compose(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, intent, answer, found, disputed, n_claims, citations) for every question (query_id, query).

    Claims are joined in the order of bids and ranks. More than one value of a field in a bid is a dispute,
    and the answer then names the bids instead of a value.
    """
    c = claims(evidence)
    order = F.struct("bid_id", "seq", "claim")
    each = c.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(order)), lambda x: x["claim"]).alias("said"), F.bool_or("established").alias("established"), F.count("*").alias("n_claims"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("bid_id", "seq", "citations"))), lambda x: x["citations"]))).alias("citations"))
    rival = c.where("intent = 'field'").groupBy("query_id", "bid_id").agg(F.count_distinct("value").alias("n")).where("n > 1").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("bid_id")), ", ").alias("rivals"))
    q = questions.select("query_id", "query", answers.intent("query").alias("intent"))
    both = q.join(each, "query_id", "left").join(rival, "query_id", "left")
    nothing = F.lit("Not found in documents")
    for name, text in NOT_FOUND.items():
        nothing = F.when(F.col("intent") == name, text).otherwise(nothing)
    field = F.replace(F.coalesce(question_field(F.col("query")), F.lit("")), F.lit("_"), F.lit(" "))
    conflict = F.concat(F.lit("Conflicting "), field, F.lit(" evidence for "), F.col("rivals"), F.lit("; review cited sources."))
    disputed = F.col("rivals").isNotNull()
    return both.select(
        "query_id", "intent", F.coalesce(F.when(disputed, conflict), F.array_join("said", " "), nothing).alias("answer"),
        (F.coalesce("established", F.lit(False)) & ~disputed).alias("found"), disputed.alias("disputed"), F.coalesce("n_claims", F.lit(0)).cast("long").alias("n_claims"), "citations")

"""Queries of reconciliation, validation, records, change detection and answers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, corpus, evaluation, extract, registry
from .registry import query
from .tables import records, table, values


@query("field_registry", "SELECT * FROM " + values([(i, f[0], f[1], f[2], f[4] and 1 or 0) for i, f in enumerate(registry.FIELDS, 1)], "ordinal, field_id, canonical_name, value_type, many"))
def field_registry(spark, sf):
    return registry.fields(spark).select("ordinal", "field_id", "canonical_name", "value_type", F.col("is_collection").cast("int").alias("many"))


#: A number that orders the lines of an order and is its own for each.
LINE = "(l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey)"


@query("latest_amendment", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, max(event_id) FILTER (rn = 1) AS event_id "
       f"FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY user_id")
def latest_amendment(spark, sf):
    """The latest event of each user controls."""
    o = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", o).alias("event_type"), F.max_by("value", o).alias("value"), F.max_by("event_id", o).alias("event_id"))


@query("change_log", f"""WITH e AS (SELECT user_id, event_type AS current, lag(event_type) OVER w AS previous, row_number() OVER w AS n, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, previous, current, event_id AS number, 'replacement' AS reason, false AS review FROM e WHERE n > 1 AND current <> previous""")
def change_log(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("value"), F.col("event_id").alias("number"), F.lit(1).alias("page"))
    return extract.change_log(e, by=("user_id",))


@query("change_conflicts", """WITH e AS (SELECT l_orderkey, l_returnflag AS current, nullif(l_linenumber % 3, 0) AS number, lag(l_returnflag) OVER w AS previous, lag(nullif(l_linenumber % 3, 0)) OVER w AS before, row_number() OVER w AS n
 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY nullif(l_linenumber % 3, 0) IS NULL, nullif(l_linenumber % 3, 0), (l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey)))
SELECT l_orderkey, previous, current, number::BIGINT AS number, CASE WHEN number IS NULL OR number = before THEN 'conflict' ELSE 'replacement' END AS reason, number IS NULL AS review FROM e WHERE n > 1 AND current <> previous""")
def change_conflicts(spark, sf):
    """Return flags of an order's lines as values of addenda 1, 2 and without number."""
    v = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("value"), F.nullif(F.col("l_linenumber") % 3, F.lit(0)).cast("long").alias("number"), F.expr(LINE).alias("page"))
    return extract.change_log(v, by=("l_orderkey",))


@query("reconcile_scalars", """WITH c AS (SELECT l_orderkey, l_returnflag AS v, l_linenumber % 3 AS number, (l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey) AS page, l_linestatus AS auth FROM lineitem WHERE l_linenumber > 1),
t AS (SELECT *, max(number) OVER (PARTITION BY l_orderkey) AS top FROM c),
l AS (SELECT l_orderkey, count(DISTINCT v) AS nv, count(DISTINCT auth) AS na, arg_max(v, page) AS v, max(number) AS number FROM t WHERE number = top GROUP BY l_orderkey),
b AS (SELECT l_orderkey, l_returnflag AS previous FROM lineitem WHERE l_linenumber = 1)
SELECT l_orderkey AS bid_id, 'flag' AS field, previous, CASE WHEN nv = 1 AND na = 1 THEN v END AS current, CASE WHEN nv > 1 OR na > 1 THEN 'review_required' WHEN v = previous THEN 'unchanged' ELSE 'replaced' END AS status,
 number::INT AS number FROM b JOIN l USING (l_orderkey)""")
def reconcile_scalars(spark, sf):
    """The first line of an order gives a field, the others amend it."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("bid_id"), F.lit("flag").alias("field"), F.col("l_returnflag").alias("value"), (F.col("l_linenumber") % 3).cast("int").alias("number"),
                                             F.lit("").alias("document_date"), F.expr(LINE).alias("page_number"), F.col("l_linestatus").alias("authority_status"), F.col("l_linenumber").alias("record_id"))
    return extract.reconcile_scalars(li.where("record_id = 1"), li.where("record_id > 1"))


OPS = [
    ("b1", "docs", 0, 0, "add", "W-9"), ("b1", "docs", 0, 0, "add", "Bond"), ("b1", "docs", 1, 0, "remove", "Bond"), ("b1", "docs", 2, 0, "add", "Form A"), ("b2", "docs", 0, 0, "add", "W-9"),
    ("b2", "docs", 1, 0, "replace", "Form B"), ("b2", "docs", 1, 1, "replace", "Form C"), ("b3", "docs", 0, 0, "add", "x"), ("b3", "docs", 3, 0, "replace", "y"), ("b3", "docs", 3, 0, "replace", "z"), ("b3", "docs", 4, 0, "add", "x"),
]


@query("reconcile_collections", "SELECT * FROM (VALUES ('b1', 'Form A,W-9', 'supported'), ('b2', 'Form C', 'review_required'), ('b3', 'x,y,z', 'supported')) AS t(bid_id, items, status)")
def reconcile_collections(spark, sf):
    o = spark.createDataFrame(OPS, "bid_id string, field string, number int, seq int, op string, value string")
    return extract.reconcile_collections(o).select("bid_id", F.array_join(F.array_sort("items"), ",").alias("items"), "status")


@query("collection_operations", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'replace|supersede') THEN 'replace' WHEN regexp_matches(lower(text), 'remove|delete|no longer') THEN 'remove' ELSE 'add' END AS op FROM documents")
def collection_operations(spark, sf):
    return table(spark, sf, "documents").select("doc_id", extract.collection_operation("text").alias("op"))


@query("distinct_collection_values", "SELECT l_orderkey, lower(l_returnflag) AS k, arg_min(l_returnflag, l_linenumber) AS shown, count(*) AS n FROM lineitem GROUP BY l_orderkey, lower(l_returnflag)")
def distinct_collection_values(spark, sf):
    """Values equal but for case are one; the first is shown."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey", F.lower("l_returnflag").alias("k")).agg(F.min_by("l_returnflag", "l_linenumber").alias("shown"), F.count("*").alias("n"))


@query("confidence_scores", """WITH c AS (SELECT source, lang, quality, toxic, contains(lower(text), 'the') AS labelled FROM documents JOIN labels USING (doc_id))
SELECT source AS bid_id, lang AS field, CASE WHEN bool_and(toxic = 0) THEN round(round(least(0.45::DOUBLE + 0.2::DOUBLE * avg(labelled::INT::DOUBLE) + 0.15::DOUBLE * avg(quality::DOUBLE)
 + CASE WHEN count(DISTINCT quality) > 1 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN bool_or(quality = 1) THEN 0.1::DOUBLE ELSE 0 END, 0.99::DOUBLE), 6), 2) ELSE 0.0::DOUBLE END AS confidence FROM c GROUP BY source, lang""")
def confidence_scores(spark, sf):
    """Documents of a source and language as the citations of a field."""
    c = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.col("source").alias("bid_id"), F.col("lang").alias("field"), F.col("quality").cast("string").alias("file"), F.contains(F.lower("text"), F.lit("the")).alias("labelled"),
        (F.col("quality") == 1).alias("locatable"), (F.col("quality") == 1).alias("authoritative"), F.lit(0.0).alias("coverage"), (F.col("toxic") == 0).alias("supported"))
    return extract.confidence(c)


@query("validation_summary", """WITH f AS (SELECT source, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'supported' WHEN quality = 0 THEN 'review_required' ELSE 'not_found' END AS s FROM documents LEFT JOIN labels USING (doc_id))
SELECT source AS bid_id, count(*) FILTER (s = 'supported') AS passed, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'not_found') AS not_found, count(*) FILTER (s = 'review_required') AS review_required FROM f GROUP BY source""")
def validation_summary(spark, sf):
    return extract.validation_summary(_field_statuses(spark, sf))


def _field_statuses(spark, sf):
    s = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "supported").when(F.col("quality") == 0, "review_required").otherwise("not_found")
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(F.col("source").alias("bid_id"), F.col("source").alias("run_id"), F.col("lang").alias("field"), s.alias("status"), F.col("toxic"), "quality")


@query("workflow_status", """WITH f AS (SELECT source, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'supported' WHEN quality = 0 THEN 'review_required' ELSE 'not_found' END AS s FROM documents LEFT JOIN labels USING (doc_id))
SELECT source AS run_id, CASE WHEN bool_and(s = 'failed') THEN 'failed' WHEN bool_or(s = 'review_required') THEN 'review_required' WHEN bool_or(s IN ('not_found', 'failed')) THEN 'partial' ELSE 'completed' END AS status FROM f GROUP BY source""")
def workflow_status(spark, sf):
    return evaluation.workflow_status(_field_statuses(spark, sf))


@query("citation_coverage", "SELECT source AS bid_id, round(coalesce(count(*) FILTER (toxic IS NOT NULL AND quality = 1) / nullif(count(toxic), 0)::DOUBLE, 1.0::DOUBLE), 6) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def citation_coverage(spark, sf):
    f = _field_statuses(spark, sf).select("bid_id", F.col("toxic").alias("value"), F.coalesce("quality", F.lit(0)).alias("n_citations"))
    return evaluation.citation_coverage(f)


OLD, NEW = "doc_id % 10 <> 3", "doc_id % 10 <> 7"


@query("index_diff", f"""WITH o AS (SELECT doc_id, sha256(text) AS f FROM documents WHERE {OLD}), n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN sha256(text || '!') ELSE sha256(text) END AS f FROM documents WHERE {NEW})
SELECT coalesce(o.doc_id, n.doc_id)::VARCHAR AS scope_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.f = n.f THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL JOIN n USING (doc_id)""")
def index_diff(spark, sf):
    """An older and a newer snapshot of all documents: some gone, some new, some changed."""
    return corpus.scope_changes(*_snapshots(spark, sf))


def _snapshots(spark, sf):
    d = table(spark, sf, "documents")
    pick = lambda rows, f: rows.select(F.col("doc_id").cast("string").alias("scope_id"), F.sha2(f, 256).alias("fingerprint"))
    changed = F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return pick(d.where(OLD), F.col("text")), pick(d.where(NEW), changed)


@query("index_update_counts", """SELECT count(*) FILTER (m IN (3, 5)) AS indexed, count(*) FILTER (m NOT IN (3, 5, 7)) AS skipped, count(*) FILTER (m = 5) AS replaced, count(*) FILTER (m = 7) AS removed, count(*) AS scopes
FROM (SELECT doc_id % 10 AS m FROM documents)""")
def index_update_counts(spark, sf):
    return corpus.change_counts(corpus.scope_changes(*_snapshots(spark, sf)))


@query("vector_readiness", "SELECT doc_id::VARCHAR AS record_id, CASE doc_id % 10 WHEN 3 THEN 'missing' WHEN 7 THEN 'left_over' ELSE 'stale' END AS state FROM documents WHERE doc_id % 10 IN (3, 5, 7)")
def vector_readiness(spark, sf):
    old, new = (x.select(F.col("scope_id").alias("record_id"), F.col("fingerprint").alias("content_fingerprint")) for x in _snapshots(spark, sf))
    return corpus.readiness(old, new)


@query("removed_ids", "SELECT doc_id FROM documents WHERE doc_id % 10 <> 3 EXCEPT SELECT doc_id FROM documents WHERE doc_id % 10 <> 7")
def removed_ids(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return d.where(OLD).subtract(d.where(NEW))



@query("excerpt_islands", """WITH parts AS (SELECT doc_id, string_split(text, 'the ') AS g, length(text) AS n FROM documents WHERE contains(text, 'the ')),
m AS (SELECT doc_id, n, unnest(list_transform(range(1, len(g)), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + 4 * (i - 1)))::BIGINT AS s FROM parts),
sp AS (SELECT doc_id, greatest(s - 50, 0) AS a, least(s + 4 + 260, n) AS b FROM m),
f AS (SELECT *, CASE WHEN a > coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh FROM sp),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT doc_id AS record_id, min(a)::BIGINT AS "start", max(b)::BIGINT AS "end", count(*) AS merged FROM g GROUP BY doc_id, island""")
def excerpt_islands(spark, sf):
    """Windows around every ``the`` of all documents, merged where they overlap."""
    spans = answers.excerpt_spans(records(spark, sf), "the ")
    return answers.islands(spans).select("record_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "merged")


CHANGES = [(1, "Payment term is revised from Net 30 to Net 45."), (2, "The due date was extended from June 1 to June 9; see below"), (3, "no change"), (4, "Delivery is changed from A to B.\nWarranty has been amended from one to two years.")]


@query("explicit_changes", "SELECT * FROM (VALUES (1::BIGINT, 'Payment term', 'Net 30', 'Net 45'), (2, 'The due date', 'June 1', 'June 9'), (4, 'Delivery', 'A', 'B'), (4, 'Warranty', 'one', 'two years')) AS t(record_id, subject, before, after)")
def explicit_changes(spark, sf):
    return answers.explicit_changes(spark.createDataFrame(CHANGES, "record_id long, text string"))


@query("disputed_values", """SELECT l_orderkey AS query_id, l_suppkey AS bid_id, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'disputed' ELSE 'answered' END AS status, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS value
FROM lineitem WHERE l_linestatus <> 'F' GROUP BY ALL""")
def disputed_values(spark, sf):
    v = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("bid_id"), F.col("l_returnflag").alias("value"), F.when(F.col("l_linestatus") == "F", "superseded").alias("authority_status"))
    return answers.disputed(v)


@query("unique_evidence", "SELECT user_id AS query_id, event_type AS record_id, max(event_id) AS seq, min(event_id) AS first_seq FROM events GROUP BY ALL")
def unique_evidence(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("record_id"), F.col("event_id").alias("seq"))
    return answers.unique(e).select("query_id", "record_id", "seq", "first_seq")


POLARITY = [(1, "A bid bond is required with each bid."), (2, "No bid bond is needed; the bid bond is not required."), (3, "The bid bond form is below."), (4, "nothing"), (5, "All vendors must provide a bid bond of 5%.")]


@query("bond_polarity", "SELECT * FROM (VALUES (1::BIGINT, 'required', NULL), (2, 'not_required', 'not required'), (3, 'unstated', NULL), (4, NULL, NULL), (5, 'required', '5%')) AS t(id, polarity, value)")
def bond_polarity(spark, sf):
    d = spark.createDataFrame(POLARITY, "id long, text string")
    return d.select("id", answers.requirement_polarity("text", "bid bond").alias("polarity"), extract.scalar("Bid Bond Requirement", "text").alias("value"))


@query("evaluation_case_problems", """SELECT item_id AS case_id, 'not_in_source' AS problem FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = b.item_id AND d.source = 'src1' AND contains(d.text, b.text))
UNION SELECT item_id, 'long_excerpt' FROM benchmark WHERE length(text) > 240""")
def evaluation_case_problems(spark, sf):
    c = table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.col("item_id").alias("record_id"), F.lit("src1").alias("bid_id"), F.col("text").alias("excerpt"))
    return evaluation.invalid_cases(c, records(spark, sf))


@query("refreshed_cases", r"""WITH k AS (SELECT doc_id, length(text) AS n, trim(regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS t FROM documents), c AS (SELECT item_id, trim(regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS x FROM benchmark)
SELECT item_id AS case_id, arg_min(doc_id, (n, doc_id)) AS record_id FROM c JOIN k ON contains(t, x) GROUP BY item_id""")
def refreshed_cases(spark, sf):
    one = {"bid_id": F.lit("all"), "source_file": F.lit("all"), "page_number": F.lit(1)}
    c = table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("excerpt")).withColumns(one)
    return evaluation.refresh_cases(c, records(spark, sf).withColumns(one))


EVIDENCE = [
    ("b1", "r1", "RFP.html", 1, "rfp", "text", None, "2026-01-02", "current", "Solicitation Number: RFP-77\nTitle: School laptops\nSubmission deadline: June 27, 2026 at 2:00 PM CST\nPayment terms: Net 30"),
    ("b1", "r2", "RFP.html", 2, "rfp", "text", None, "2026-01-02", "current", "Initial term: 1. Renewal 1: 1. Renewal 2: 1. Not exceed a total of 3 years. Installation and imaging services are required."),
    ("b1", "r3", "RFP.html", 3, "rfp", "table", None, "2026-01-02", "current", "Product Name | Maker | Model | Qty\n1. Laptop A | X | M-100 | 25\n2. Dock B | Y | D-20 | 5\nModel number: M-100, D-20; m-100"),
    ("b1", "r4", "Addendum 1.pdf", 1, "addendum", "text", 1, "2026-02-01", "current", "The new due date: July 9, 2026 2:00 PM CST.\nPayment terms: Net 45"),
    ("b2", "r5", "Bid.html", 1, "bid_page", "text", None, None, "current", "Submit proposals through the online portal. Delivery within 30 days of award. Required documents: W-9, insurance certificate and bid form"),
    ("b3", "r6", "Other.html", 1, "bid_page", "text", None, None, "current", "Nothing of use here."),
]
EVIDENCE_SCHEMA = "bid_id string, record_id string, source_file string, page_number int, doc_type string, content_kind string, addendum_number int, document_date string, authority_status string, text string"


@query("extracted_fields", "SELECT * FROM (VALUES ('b1', 'Bid Number', 'RFP-77'), ('b1', 'Title', 'School laptops'), ('b1', 'Due Date', '2026-07-09 14:00 CST'), ('b1', 'Payment Terms', 'Net 45'), "
       "('b1', 'Term of Bid', '1-year initial term with two 1-year renewals; maximum 3 years'), ('b1', 'Installation', 'true'), ('b1', 'Model_no', 'M-100|D-20'), ('b1', 'Product', 'Laptop A|Dock B'), "
       "('b2', 'Bid Submission Type', 'Electronic portal'), ('b2', 'Delivery Date', 'Within 30 days of award'), ('b2', 'Any Additional Documentation Required', 'W-9|insurance certificate|bid form')) AS t(bid_id, field, value)")
def extracted_fields(spark, sf):
    """Fields of three small bids, in the order in which their files are read."""
    f = extract.extract(spark.createDataFrame(EVIDENCE, EVIDENCE_SCHEMA)).where("status = 'supported'")
    return f.select("bid_id", "field", F.coalesce("value", F.array_join(F.transform("items", lambda x: x["value"]), "|")).alias("value"))


@query("reconciled_fields", "SELECT * FROM (VALUES ('b1', 'Due Date', '2026-06-27 14:00 CST', '2026-07-09 14:00 CST', 'replaced', 1), ('b1', 'Payment Terms', 'Net 30', 'Net 45', 'replaced', 1)) AS t(bid_id, field, previous, current, status, number)")
def reconciled_fields(spark, sf):
    """Base values of the bids and what the addendum makes of them."""
    e = spark.createDataFrame(EVIDENCE, EVIDENCE_SCHEMA)
    base = extract.extract(e.where(~extract.is_addendum_evidence()))
    return extract.reconcile_scalars(base, extract.update_candidates(e))


@query("record_summaries", "SELECT 'b1' AS bid_id, 5::BIGINT AS n_sentences, 'The solicitation is titled School laptops. The submission deadline is 2026-07-09 14:00 CST. The contract term is 1-year initial term with two 1-year renewals; maximum 3 years. Payment terms are Net 45. Requested products include Laptop A, Dock B.' AS summary "
       "UNION ALL SELECT 'b2', 3, 'The submission method is Electronic portal. The delivery requirement is Within 30 days of award. Required documents include W-9, insurance certificate, bid form.'")
def record_summaries(spark, sf):
    return extract.summary(extract.extract(spark.createDataFrame(EVIDENCE, EVIDENCE_SCHEMA)))


@query("supported_citations", "SELECT doc_id AS bid_id FROM documents WHERE contains(lower(text), lower(source)) OR contains(lower(text), 'password')")
def supported_citations(spark, sf):
    """Claims about every document that its own text holds."""
    r = records(spark, sf).withColumn("bid_id", F.col("record_id"))
    claims = r.select("bid_id", F.col("source_file").alias("file"), F.col("page_number").alias("page"), F.explode(F.array(F.substring_index("source_file", "/", 1), F.lit("password"))).alias("value"))
    return extract.supported_by_source(claims, r).select("bid_id").distinct()


FORMATS = [("submission_deadline", "2026-07-09 14:00"), ("submission_deadline", "July 9, 2026"), ("submission_deadline", "soon"), ("bid_bond", "5 %"), ("bid_bond", "120%"), ("bid_bond", "five"), ("warranty", "3 years"), ("warranty", " ")]


@query("valid_formats", "SELECT * FROM (VALUES ('submission_deadline', '2026-07-09 14:00', true), ('submission_deadline', 'July 9, 2026', true), ('submission_deadline', 'soon', false), ('bid_bond', '5 %', true), ('bid_bond', '120%', false), "
       "('bid_bond', 'five', false), ('warranty', '3 years', true), ('warranty', ' ', false)) AS t(field, value, ok)")
def valid_formats(spark, sf):
    return spark.createDataFrame(FORMATS, "field string, value string").withColumn("ok", extract.valid_format("field", "value"))

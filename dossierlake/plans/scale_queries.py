"""Rule operators over whole tables: notices, clauses, tables and amendments worded from every row of a table.

The rules themselves are checked on small cases elsewhere; here each row of orders, lineitem, documents or
pages becomes a text of a known meaning, so that the same rules run at the size of the table.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T
from ..operators import answers, corpus, evaluation, extract, ingest, views
from ..sources.folders import detected_format
from ..sources.scratch import own_dir, spread
from ..streaming.incremental import windowed_counts
from .extract_queries import LINE
from .ingest_queries import LINES, _lines
from .registry import query
from .tables import table


def _when(key: Column, *cases: Column) -> Column:
    """The case whose number the key is; null for any other."""
    out = F.when(key == 0, cases[0])
    for i, c in enumerate(cases[1:], 1):
        out = out.when(key == i, c)
    return out


def _dated(spark, sf):
    """Orders with their date as text, twenty years later."""
    d = F.add_months(F.to_date("o_orderdate"), 240)
    return spread(table(spark, sf, "orders"), "o_orderkey", each=16).select(
        F.col("o_orderkey").alias("k"), F.date_format(d, "yyyy-MM-dd").alias("iso"), F.date_format(d, "MMMM d, yyyy").alias("long"),
        F.date_format(F.date_add(d, 30), "yyyy-MM-dd").alias("iso30"), F.date_format(F.date_add(d, 30), "MMMM d, yyyy").alias("long30"))


DATED = """dated AS (SELECT o_orderkey AS k, strftime(d, '%Y-%m-%d') AS iso, strftime((d + INTERVAL 30 DAY)::DATE, '%Y-%m-%d') AS iso30
 FROM (SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 20 YEAR)::DATE AS d FROM orders))"""


@query("order_document_dates", f"""WITH {DATED} SELECT k AS document_id, CASE k % 4 WHEN 0 THEN 'selected_with_conflict' WHEN 1 THEN 'conflict' ELSE 'selected' END AS date_status,
 CASE WHEN k % 4 <> 1 THEN iso END AS document_date FROM dated WHERE k % 4 <> 3""")
def order_document_dates(spark, sf):
    """A notice for each order: a labelled and a plain date, two plain dates, one, or none."""
    text = _when(
        F.col("k") % 4, F.concat(F.lit("Issue Date: "), "long", F.lit(". Due "), "iso30", F.lit(".")), F.concat(F.lit("Dates "), "iso", F.lit(" and "), "iso30"),
        F.concat(F.lit("Published on "), "long"), F.lit("to be announced"))
    found = _dated(spark, sf).select(F.col("k").alias("document_id"), F.posexplode(dates.candidates(text)).alias("ord", "c"))
    found = found.select("document_id", "ord", "c.kind", "c.precedence", dates.parse("c.raw").alias("p"))
    return dates.select_document_date(found.select("document_id", "ord", "kind", "precedence", F.col("p.iso").alias("iso"), F.col("p.status").alias("status")))


WORDS = ("Addendum", "RFP final", "affidavit", "tech specs", "amendment no", "misc", "BidNet page")
SUFFIXES = (".pdf", ".html", ".PDF", ".htm", ".txt")


@query("page_file_types", f"""WITH n AS (SELECT page_id, lower({list(WORDS)}[1 + page_id % 7] || ' ' || page_id || {list(SUFFIXES)}[1 + page_id % 5]) AS n FROM pages)
SELECT page_id, CASE WHEN ends_with(n, '.txt') THEN 'unknown' WHEN page_id % 7 IN (0, 4) THEN 'addendum' WHEN page_id % 7 = 2 THEN 'affidavit' WHEN page_id % 7 = 3 THEN 'specs'
 WHEN regexp_matches(n, '\\.html?$') OR page_id % 7 = 6 THEN 'bid_page' WHEN page_id % 7 = 1 THEN 'rfp' ELSE 'supporting' END AS doc_type,
 CASE WHEN page_id % 7 IN (0, 4) THEN page_id::INT END AS number, CASE WHEN regexp_matches(n, '\\.html?$') THEN 'html' WHEN ends_with(n, '.pdf') THEN 'pdf' ELSE 'unknown' END AS fmt FROM n""")
def page_file_types(spark, sf):
    """A file name for each page, of seven kinds and five suffixes."""
    name = F.concat(_when(F.col("page_id") % 7, *map(F.lit, WORDS)), F.lit(" "), F.col("page_id").cast("string"), _when(F.col("page_id") % 5, *map(F.lit, SUFFIXES)))
    paths = table(spark, sf, "pages").select("page_id", F.concat(F.lit("bids/"), name).alias("path"))
    return paths.select("page_id", ingest.classify_filename("path").alias("doc_type"), ingest.addendum_number("path").alias("number"), detected_format("path").alias("fmt"))


@query("order_tables", f"""SELECT l_orderkey AS page_id, 0::BIGINT AS table_no, true AS has_header, 2::BIGINT AS width, bool_or(l_returnflag = 'N') AS uneven,
 'Flag | Line' || chr(10) || string_agg(l_returnflag || ' | ' || CASE WHEN l_returnflag = 'N' THEN '' ELSE l_linenumber::VARCHAR END, chr(10) ORDER BY {LINE}) AS text FROM lineitem GROUP BY l_orderkey""")
def order_tables(spark, sf):
    """Each order as an HTML table of its lines, some rows one cell short."""
    second = F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(F.concat(F.lit("<td>"), F.col("l_linenumber").cast("string"), F.lit("</td>")))
    row = F.concat(F.lit("<tr><td>"), "l_returnflag", F.lit("</td>"), second, F.lit("</tr>"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.struct(F.expr(LINE).alias("at"), row.alias("row")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]), "")
    html = rows.groupBy("page_id").agg(F.concat(F.lit("<table><tr><th>Flag</th><th>Line</th></tr>"), body, F.lit("</table>")).alias("html"))
    t = ingest.html_tables(html).withColumn("r", ingest.rectangular("rows"))
    return t.select(
        "page_id", F.col("table_no").cast("long").alias("table_no"), "has_header", F.col("r.width").cast("long").alias("width"), F.col("r.uneven").alias("uneven"),
        ingest.table_text("r.rows").alias("text"))


@query("order_page_furniture", """SELECT o_orderkey || '-' || p AS page_id, l::BIGINT AS line_no, CASE WHEN l = 1 THEN 'kept' ELSE 'removed' END AS furniture FROM orders, range(3) a(p), range(3) b(l)""")
def order_page_furniture(spark, sf):
    """Each order as a file of three pages with a header and a page number."""
    k = F.col("o_orderkey").cast("string")
    page = lambda i: F.concat(F.lit("<div class='page'><p>Order "), k, F.lit(f"</p><p>body {'abc'[i]} text</p><p>Page {i + 1} of 3</p></div>"))
    html = spread(table(spark, sf, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("<body>"), *[page(i) for i in range(3)], F.lit("</body>")).alias("html"))
    return ingest.page_furniture(ingest.html_page_lines(html)).select("page_id", F.col("line_no").cast("long").alias("line_no"), "furniture")


@query("line_changes", """SELECT l_orderkey AS record_id, 'Line status' AS subject, l_returnflag AS before, l_linestatus AS after FROM lineitem WHERE l_linenumber % 5 <> 4""")
def line_changes(spark, sf):
    """A sentence for each line of an order: a change in one of four wordings, or none."""
    verb = _when(F.col("l_linenumber") % 5, *map(F.lit, ("is revised", "was changed", "has been extended", "is hereby amended", "stays")))
    text = F.concat(F.lit("Line status "), verb, F.lit(" from "), "l_returnflag", F.lit(" to "), "l_linestatus", F.lit(".\n"))
    return answers.explicit_changes(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), text.alias("text")))


@query("order_bond_polarity", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'required' WHEN 1 THEN 'not_required' WHEN 2 THEN 'unstated' END AS polarity, o_orderkey % 3 = 0 AS valid_bond FROM orders""")
def order_bond_polarity(spark, sf):
    """A clause on the bond for each order, and a value of which one in three is a percentage."""
    k = F.col("o_orderkey")
    text = _when(k % 4, F.lit("A bid bond is required with each bid."), F.lit("The bid bond is not required."), F.lit("The bid bond form is below."), F.lit("Nothing on it."))
    value = _when(k % 3, F.concat((k % 100).cast("string"), F.lit(" %")), F.concat((k % 100 + 101).cast("string"), F.lit("%")), F.lit("five"))
    return table(spark, sf, "orders").select(k.alias("id"), answers.requirement_polarity(text, "bid bond").alias("polarity"), extract.valid_format(F.lit("bid_bond"), value).alias("valid_bond"))


def _order_evidence(spark, sf):
    """A solicitation for each order, and an addendum with a later deadline and other terms for every second."""
    o = _dated(spark, sf).withColumn("bid_id", F.concat(F.lit("b"), F.col("k").cast("string")))
    k = F.col("k").cast("string")
    fixed = lambda kind, number, text: [
        "bid_id", F.concat(F.lit(f"{kind}-"), k).alias("record_id"), F.lit(f"{kind}.html").alias("source_file"), F.lit(1).alias("page_number"), F.lit(kind).alias("doc_type"),
        F.lit("text").alias("content_kind"), F.lit(number).cast("int").alias("addendum_number"), "iso", F.lit("current").alias("authority_status"), text.alias("text")]
    base = F.concat(F.lit("Solicitation Number: RFP-"), k, F.lit("\nTitle: School order\nSubmission deadline: "), "long", F.lit(" at 2:00 PM CST\nPayment terms: Net 30"))
    later = F.concat(F.lit("The new due date: "), "long30", F.lit(" 2:00 PM CST.\nPayment terms: Net 45"))
    rows = o.select(*fixed("rfp", None, base)).unionByName(o.where("k % 2 = 0").select(*fixed("addendum", 1, later)))
    return rows.withColumnRenamed("iso", "document_date")


@query("order_fields", f"""WITH {DATED} SELECT 'b' || k AS bid_id, unnest(['Bid Number', 'Title', 'Due Date', 'Payment Terms']) AS field,
 unnest(['RFP-' || k, 'School order', CASE WHEN k % 2 = 0 THEN iso30 ELSE iso END || ' 14:00 CST', CASE WHEN k % 2 = 0 THEN 'Net 45' ELSE 'Net 30' END]) AS value FROM dated""")
def order_fields(spark, sf):
    """Fields of the solicitations of all orders."""
    f = extract.extract(_order_evidence(spark, sf), found_only=True)
    return f.select("bid_id", "field", F.coalesce("value", F.array_join(F.transform("items", lambda x: x["value"]), "|")).alias("value"))


@query("order_amended_fields", f"""WITH {DATED} SELECT 'b' || k AS bid_id, unnest(['Due Date', 'Payment Terms']) AS field, unnest([iso || ' 14:00 CST', 'Net 30']) AS previous,
 unnest([iso30 || ' 14:00 CST', 'Net 45']) AS current, 'replaced' AS status, 1 AS number FROM dated WHERE k % 2 = 0""")
def order_amended_fields(spark, sf):
    """What the addenda of the orders make of their fields."""
    e = _order_evidence(spark, sf)
    base = e.where(~extract.is_addendum_evidence())
    return extract.reconcile_scalars(extract.extract(base, found_only=True), extract.update_candidates(e), base)


@query("order_field_support", """SELECT 'b' || o_orderkey AS bid_id, o_orderkey % 3 = 0 AS supported, true AS labelled FROM orders""")
def order_field_support(spark, sf):
    """Payment terms of every order against the passage that gives them: a third is right."""
    e = _order_evidence(spark, sf).where("doc_type = 'rfp'")
    k = F.substring("bid_id", 2, 20).cast("long")
    claim = F.when(k % 3 == 0, "Net 30").otherwise("Net 60")
    return e.select("bid_id", extract.supports_value("Payment Terms", "text", claim).alias("supported"), extract.has_label("Payment Terms", "text").alias("labelled"))


@query("order_agent_fields", """SELECT 'b' || o_orderkey AS bid_id, 'solicitation_number' AS field, 'RFP-' || o_orderkey AS value, 'rfp-' || o_orderkey AS record_id FROM orders""")
def order_agent_fields(spark, sf):
    return extract.agent_fields(_order_evidence(spark, sf).where("doc_type = 'rfp'"), ["solicitation_number", "bid_bond"])


@query("order_collections", f"""WITH l AS (SELECT l_orderkey, 'item ' || l_partkey % 3 AS v, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE}) AS n FROM lineitem),
t AS (SELECT l_orderkey, v, arg_max(f, n) AS f FROM l GROUP BY ALL)
SELECT l_orderkey AS bid_id, coalesce(string_agg(v, ',' ORDER BY v) FILTER (f <> 'R'), '') AS items, 'supported' AS status FROM t GROUP BY l_orderkey""")
def order_collections(spark, sf):
    """Lines of an order as additions and, where they were returned, removals of an item."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.expr(LINE)))
    o = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("bid_id"), F.lit("items").alias("field"), n.alias("number"), F.lit(0).alias("seq"), F.when(F.col("l_returnflag") == "R", "remove").otherwise("add").alias("op"),
        F.concat(F.lit("item "), (F.col("l_partkey") % 3).cast("string")).alias("value"))
    return extract.reconcile_collections(o).select("bid_id", F.array_join(F.array_sort("items"), ",").alias("items"), "status")


NEXT = "lead(trim(line)) OVER (PARTITION BY doc_id ORDER BY line_no)"
STRUCTURAL = r"(regexp_matches({0}, '^(?:[-*•▪]|[0-9]+[.)])[ \t]+') OR contains({0}, '|') OR regexp_matches({0}, '[.!?:;]$'))"


@query("line_classes", rf"""WITH {LINES}, n AS (SELECT doc_id, line_no, trim(line) AS line, {NEXT} AS follow FROM lines)
SELECT doc_id, line_no::BIGINT AS line_no, {STRUCTURAL.format('line')} AS structural, regexp_matches(lower(line), '^(?:(?:header|footer)(?:[ \t]+[0-9]+)?|page[ \t]+[0-9]+(?:[ \t]+of[ \t]+[0-9]+)?)$') AS noise,
 coalesce(line <> '' AND follow <> '' AND NOT {STRUCTURAL.format('line')} AND NOT {STRUCTURAL.format('follow')} AND len(regexp_extract_all(line, '[^ \t\n\x0b\f\r]+')) >= 3
  AND regexp_matches(follow, '^[\p{{Ll}},)\]}}]'), false) AS joins FROM n""")
def line_classes(spark, sf):
    """What each line of every document is, and whether the next one continues it."""
    from pyspark.sql import Window

    rows = _lines(spark, sf).withColumn("line", F.trim("line"))
    rows = rows.withColumn("follow", F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_no")))
    return rows.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), T.is_structural_line("line").alias("structural"), T.is_layout_noise("line").alias("noise"),
        F.coalesce(T.can_join("line", "follow"), F.lit(False)).alias("joins"))


@query("pdf_metadata_rows", """SELECT doc_id AS document_id, nullif(trim(lang), '') AS title, CASE WHEN doc_id % 2 = 0 THEN source END AS description, CASE WHEN doc_id % 3 = 0 THEN 'semantic_metadata' ELSE 'technical_timestamp' END AS kind,
 'D:20260131' AS raw FROM documents""")
def pdf_metadata_rows(spark, sf):
    """A metadata map for each document, as a PDF holds one."""
    key = F.when(F.col("doc_id") % 3 == 0, "PublicationDate").otherwise("creationDate")
    raw = F.create_map(F.lit("title"), F.concat(F.lit(" "), "lang"), F.lit("subject"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.lit(" ")), key, F.lit("D:20260131"))
    m = ingest.pdf_metadata(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), raw.alias("raw")))
    return m.select("document_id", "title", "description", F.explode("dates").alias("d")).select("document_id", "title", "description", F.col("d.kind").alias("kind"), F.col("d.raw").alias("raw"))


@query("merged_record_fields", """SELECT doc_id AS bid_id, 'quality' AS field, quality::VARCHAR AS value FROM labels
UNION ALL SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'source' ELSE 'quality' END, source FROM documents""")
def merged_record_fields(spark, sf):
    """Labels as the canonical record; of the agent's two proposals for a document that of a new name counts, and
    for those without a label the one named as the label would be."""
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("bid_id"), F.lit("quality").alias("field"), F.col("quality").cast("string").alias("value"))
    d = table(spark, sf, "documents")
    labelled = d.join(known.select(F.col("bid_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    agent = d.select(F.col("doc_id").alias("bid_id"), F.lit("quality").alias("field"), F.col("source").alias("value")).unionByName(
        labelled.select(F.col("doc_id").alias("bid_id"), F.lit("source").alias("field"), F.col("source").alias("value")))
    return views.merged_fields(known, agent)


@query("prior_value_records", """SELECT item_id AS change_id, (SELECT min(d.doc_id) FROM documents d WHERE d.source = 'src' || (item_id % 3 + 1) AND contains(lower(d.text), lower(split_part(b.text, ' ', 1))) AND contains(lower(d.text), 'the')) AS base_record FROM benchmark b""")
def prior_value_records(spark, sf):
    """The first document of a source that holds the first word of a benchmark item and a further term."""
    c = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("change_id"), F.concat(F.lit("src"), (F.col("item_id") % 3 + 1).cast("string")).alias("bid_id"), F.array(F.lit("the")).alias("field_terms"),
        F.split_part("text", F.lit(" "), F.lit(1)).alias("previous"))
    b = table(spark, sf, "documents").select(F.col("source").alias("bid_id"), F.col("doc_id").alias("record_id"), "text")
    return answers.prior_values(c, b)


@query("answer_intents", """SELECT conv_id, turn, CASE WHEN regexp_matches(t, 'addend|amend|changed|revised') THEN 'addendum' WHEN contains(t, 'affidavit') THEN 'affidavit' WHEN contains(t, 'warrant') THEN 'warranty'
 WHEN regexp_matches(t, 'bid bond|bid security') THEN 'bond' ELSE 'field' END AS intent FROM (SELECT conv_id, turn, lower(coalesce(text, '')) || ['', ' addendum', ' affidavit', ' warranty', ' bid bond'][1 + turn % 5] AS t FROM conversations)""")
def answer_intents(spark, sf):
    """What each turn asks for, with one of five endings."""
    end = _when(F.col("turn") % 5, *map(F.lit, ("", " addendum", " Affidavit", " warranty", " bid bond")))
    return table(spark, sf, "conversations").select("conv_id", "turn", answers.intent(F.concat(F.coalesce("text", F.lit("")), end)).alias("intent"))


def _chunks(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("source").alias("bid_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".html")).alias("source_file"), F.col("doc_id").cast("string").alias("chunk_id"),
        F.lit("").alias("section_title"), F.lit(1).alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))


def _snapshot(spark, sf, which: str):
    """Records of the older or the newer snapshot of all documents."""
    c = _chunks(spark, sf).withColumn("m", F.col("chunk_id").cast("long") % 10)
    if which == "old":
        return corpus.index_records(c.where("m <> 3"))
    return corpus.index_records(c.where("m <> 7").withColumn("text", F.when(F.col("m") == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))


def _updated_index(spark, sf, name: str) -> corpus.Index:
    import uuid

    index = corpus.Index(spark, f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}")
    index.update(_snapshot(spark, sf, "old"))
    index.update(_snapshot(spark, sf, "new"))
    return index


@query("index_lifecycle", """WITH d AS (SELECT source, doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT source, doc_id, t || CASE WHEN doc_id % 10 = 5 THEN '!' ELSE '' END AS t FROM d WHERE doc_id % 10 <> 7),
o AS (SELECT * FROM d WHERE doc_id % 10 <> 3 AND source NOT IN (SELECT source FROM n WHERE trim(t) <> ''))
SELECT source AS bid_id, doc_id::VARCHAR AS chunk_id, sha256(t) AS text_sha256 FROM (FROM n UNION ALL FROM o) WHERE trim(t) <> ''""")
def index_lifecycle(spark, sf):
    """The corpus of all documents after an update: what went is gone, what changed is replaced, the rest stays, and so
    does a source that the update does not name."""
    return _updated_index(spark, sf, "lifecycle").records().select("bid_id", "chunk_id", F.sha2("text", 256).alias("text_sha256"))


@query("index_rollback", "SELECT source AS bid_id, doc_id::VARCHAR AS chunk_id, sha256(text) AS text_sha256 FROM documents WHERE doc_id % 10 <> 3 AND trim(coalesce(text, '')) <> ''")
def index_rollback(spark, sf):
    """The version before the update, pointed at again."""
    index = _updated_index(spark, sf, "rollback")
    index.rollback()
    return index.records().select("bid_id", "chunk_id", F.sha2("text", 256).alias("text_sha256"))


@query("vector_lifecycle", """SELECT doc_id::VARCHAR AS chunk_id, round(('0x' || substr(sha256(t), 1, 2))::INT / 255.0::DOUBLE, 6) AS first, round(('0x' || substr(sha256(t), 3, 2))::INT / 255.0::DOUBLE, 6) AS second, 'sha256' AS model
 FROM (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 10 = 5 THEN '!' ELSE '' END AS t FROM documents WHERE doc_id % 10 <> 7) WHERE trim(t) <> ''""")
def vector_lifecycle(spark, sf):
    """Vectors of the same two snapshots: only new and changed records are embedded by the second update."""
    import uuid

    store, provider = corpus.VectorStore(spark, f"{own_dir(spark)}/vectors-{uuid.uuid4().hex}"), corpus.HashEmbedding(2)
    new = _snapshot(spark, sf, "new")
    store.update(_snapshot(spark, sf, "old"), provider)
    store.update(new, provider)
    v = store.load(provider).join(new.select("record_id", "chunk_id"), "record_id")
    return v.select("chunk_id", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(F.get("vector", F.lit(1)), 6).alias("second"), "model")


@query("event_windows", """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, sf):
    """All events by hour and type, by the plan that a stream of them runs."""
    w = windowed_counts(table(spark, sf, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))

"""Queries of the ingestion operators over documents, pages and other given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, ids
from ..functions import text as T
from ..operators import ingest as I
from .registry import query
from .tables import table, values


def _inline(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query("stable_ids", """SELECT doc_id, substr(sha256('document|' || source || '|' || doc_id::VARCHAR || '.html'), 1, 16) AS document_id,
 substr(sha256('chunk|' || substr(sha256('document|' || source || '|' || doc_id::VARCHAR || '.html'), 1, 16) || '|0|' || coalesce(text, 'None')), 1, 16) AS chunk_id,
 source || ':' || doc_id::VARCHAR || '.html' AS scope_id FROM documents""")
def stable_ids(spark, sf):
    d = table(spark, sf, "documents").withColumn("path", F.concat(F.col("doc_id").cast("string"), F.lit(".html")))
    d = d.withColumn("document_id", ids.document_id("source", "path"))
    return d.select("doc_id", "document_id", ids.chunk_id("document_id", F.lit(0), "text").alias("chunk_id"), ids.scope_id("source", F.concat(F.lit("./"), "path")).alias("scope_id"))


@query("fingerprints", """WITH f AS (SELECT doc_id, source || ':' || doc_id::VARCHAR AS scope, doc_id::VARCHAR AS chunk,
 sha256('{"lang":"' || lang || '","n_chars":' || n_chars::VARCHAR || ',"source":"' || source || '"}') AS fingerprint FROM documents)
SELECT doc_id, fingerprint, substr(sha256('["' || scope || '","' || chunk || '","' || fingerprint || '"]'), 1, 24) AS record_id FROM f""")
def fingerprints(spark, sf):
    d = table(spark, sf, "documents").withColumn("fingerprint", ids.fingerprint(("source", "source"), ("lang", "lang"), ("n_chars", "n_chars")))
    chunk = F.col("doc_id").cast("string")
    return d.select("doc_id", "fingerprint", ids.record_id(ids.scope_id("source", chunk), chunk, "fingerprint").alias("record_id"))


@query("bid_numbers", """WITH s AS (SELECT DISTINCT url, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages)
SELECT url, (100000000000::HUGEINT + ('0x' || substr(sha256(slug), 1, 16))::UBIGINT::HUGEINT % 900000000000::HUGEINT)::VARCHAR AS bid_number FROM s""")
def bid_numbers(spark, sf):
    return table(spark, sf, "pages").select("url").distinct().select("url", ids.bid_number("url").alias("bid_number"))


@query("relative_paths", r"SELECT page_id, regexp_replace(replace('.\' || url, '\', '/'), '^[./]+', '') AS path FROM pages")
def relative_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", ids.relative_path(F.concat(F.lit(".\\"), "url")).alias("path"))


@query("squeezed_text", r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS squeezed FROM documents")
def squeezed_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.squeeze("text"), 256).alias("squeezed"))


@query("normalized_text")
def normalized_text(spark, sf):
    """A fold over each text's lines; the tests hold it against a line-by-line version."""
    return table(spark, sf, "documents").select("doc_id", T.normalize_text("text").alias("normalized"))


LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
 len(string_split(text, chr(10))) AS n_lines, source FROM documents)"""
KEY = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(line), '[ \t\n\x0b\f\r]+', ' ', 'g')),
 '(^|[^a-z0-9_])page [0-9]+(?: of [0-9]+)?($|[^a-z0-9_])', '\1page #\2', 'g'), '(^|[^\p{L}\p{N}_])[0-9]+($|[^\p{L}\p{N}_])', '\1#\2', 'g'),
 '(^|[^\p{L}\p{N}_])[0-9]+($|[^\p{L}\p{N}_])', '\1#\2', 'g'), '[^\p{L}\p{N}_#]+', ' ', 'g'))"""


def _lines(spark, sf):
    parts = F.split("text", "\n", -1)
    return table(spark, sf, "documents").select("doc_id", "source", F.size(parts).alias("n_lines"), F.posexplode(parts).alias("line_no", "line"))


@query("edge_line_keys", f"WITH {LINES} SELECT doc_id, line_no::BIGINT AS line_no, {KEY} AS edge_key FROM lines WHERE line_no < 2 OR line_no >= n_lines - 1")
def edge_line_keys(spark, sf):
    edge = _lines(spark, sf).where("line_no < 2 or line_no >= n_lines - 1")
    return edge.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.edge_line_key("line").alias("edge_key"))


@query("page_furniture", f"""WITH {LINES}, k AS (SELECT *, {KEY} AS key, (line_no < 2 OR line_no >= n_lines - 1) AS edge FROM lines),
c AS (SELECT source, key, count(DISTINCT doc_id) AS n FROM k WHERE edge AND key <> '' AND trim(line) <> '' AND length(line) <= 120 GROUP BY ALL),
p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source)
SELECT doc_id, line_no::BIGINT AS line_no, CASE WHEN pages < 2 THEN 'kept' WHEN n >= greatest(2, ceil(pages * 3 / 5.0)) THEN 'removed' WHEN n >= 2 THEN 'uncertain' ELSE 'kept' END AS furniture
FROM k LEFT JOIN c ON k.edge AND k.source = c.source AND k.key = c.key JOIN p ON k.source = p.source""")
def page_furniture(spark, sf):
    """Each source is a document and its texts the pages."""
    rows = _lines(spark, sf).select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_id"), "line_no", "n_lines", "line")
    return I.page_furniture(rows).select(F.col("page_id").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "furniture")


@query("html_title_lang", r"""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
 length(regexp_extract(html, '<title>([^<]*)</title>', 1))::BIGINT > 0 AS has_title FROM pages""")
def html_title_lang(spark, sf):
    m = I.html_metadata(table(spark, sf, "pages"))
    one = m.groupBy("page_id").agg(F.max(F.when(F.col("key") == "language", F.col("value"))).alias("lang"), F.bool_or(F.col("key") == "title").alias("has_title"))
    return table(spark, sf, "pages").select("page_id").join(one, "page_id", "left").select("page_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("has_title", F.lit(False)).alias("has_title"))


@query("html_sections")
def html_sections(spark, sf):
    return I.html_sections(table(spark, sf, "pages"))


@query("html_section_counts", r"""SELECT page_id, (len(regexp_extract_all(html, '<h[1-6][^>]*>')))::BIGINT AS n_headings,
 len(regexp_extract_all(html, '<li[ >]'))::BIGINT AS n_items FROM pages""")
def html_section_counts(spark, sf):
    s = I.html_sections(table(spark, sf, "pages")).groupBy("page_id").agg(
        F.count_if(F.col("kind") == "heading").alias("n_headings"), F.count_if(F.col("kind") == "list_item").alias("n_items"))
    return s


@query("html_metadata")
def html_metadata(spark, sf):
    return I.html_metadata(table(spark, sf, "pages"))


HTML_TABLES = [
    (1, "<table><tr><th>Name</th><th>Qty</th></tr><tr><td>A</td><td>1</td></tr><tr><td>B</td></tr></table>"),
    (2, "<h1>T</h1><table><tr><td>x</td></tr></table><p>p</p><table><tr><th>y</th></tr></table>"),
]


@query("html_tables", """SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, true, 2::BIGINT, true, 'Name | Qty' || chr(10) || 'A | 1' || chr(10) || 'B | '),
 (2, 0, false, 1, false, 'x'), (2, 1, true, 1, false, 'y')) AS t(page_id, table_no, has_header, width, uneven, text)""")
def html_tables(spark, sf):
    t = I.html_tables(_inline(spark, HTML_TABLES, "page_id long, html string")).withColumn("r", I.rectangular("rows"))
    return t.select("page_id", F.col("table_no").cast("long").alias("table_no"), "has_header", F.col("r.width").cast("long").alias("width"), F.col("r.uneven").alias("uneven"), I.table_text("r.rows").alias("text"))


@query("chunk_windows")
def chunk_windows(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    return I.chunks(d).select("document_id", "chunk_index", "start_word", "end_word")


@query("chunk_coverage", r"""SELECT doc_id AS document_id, len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+'))::BIGINT AS n_words, true AS whole, true AS within_limit FROM documents WHERE regexp_matches(text, '[^ \t\n\x0b\f\r]')""")
def chunk_coverage(spark, sf):
    """Chunks reach from the first word to the last without a gap, none above the limit."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    c = I.chunks(d).groupBy("document_id").agg(
        F.max("end_word").cast("long").alias("n_words"), F.max(F.col("end_word") - F.col("start_word")).alias("longest"), F.min("start_word").alias("first"),
        F.sum(F.col("end_word") - F.col("start_word")).alias("covered"), F.count("*").alias("n"))
    return c.select("document_id", "n_words", ((F.col("first") == 0) & (F.col("covered") >= F.col("n_words")) & (F.col("covered") <= F.col("n_words") + I.OVERLAP * (F.col("n") - 1))).alias("whole"), (F.col("longest") <= I.LARGEST).alias("within_limit"))


FRAGMENTS = "(SELECT doc_id, pos, sum(n) OVER w - n AS s, sum(n) OVER w AS e FROM (SELECT doc_id, pos, len(regexp_extract_all(line, '[^ \\t\\x0b\\f\\r]+')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"


@query("chunk_fragments", f"""WITH f AS {FRAGMENTS}, t AS (SELECT doc_id, max(e) AS n FROM f GROUP BY doc_id),
c AS (SELECT doc_id, unnest(range(0, greatest(n, 1)::BIGINT, 100)) AS a, n FROM t)
SELECT c.doc_id AS document_id, (a / 100)::BIGINT AS chunk_index, count(*)::BIGINT AS n_fragments FROM c JOIN f ON c.doc_id = f.doc_id AND greatest(a, s) < least(a + 100, e) GROUP BY ALL""")
def chunk_fragments(spark, sf):
    """Lines that each window of a hundred words meets: an interval join within the document."""
    from pyspark.sql import Window

    words = F.size(F.filter(F.split("line", "[ \\t\\x0b\\f\\r]+"), lambda w: w != ""))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    f = _lines(spark, sf).withColumn("n", words).withColumn("e", F.sum("n").over(w)).select(F.col("doc_id").alias("document_id"), F.col("line_no").alias("fragment"), (F.col("e") - F.col("n")).alias("s"), "e")
    total = f.groupBy("document_id").agg(F.max("e").alias("n"))
    ranges = total.select("document_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0).cast("long")), F.lit(100).cast("long"))).alias("start_word"))
    ranges = ranges.select("document_id", (F.col("start_word") / 100).cast("long").alias("chunk_index"), "start_word", (F.col("start_word") + 100).alias("end_word"))
    return I.fragments_of(ranges, f).groupBy("document_id", "chunk_index").agg(F.count("*").alias("n_fragments"))


NAMES = [
    (1, "bids/1/Addendum 2.pdf"), (2, "bids/1/RFP final.pdf"), (3, "x/Bid Information.html"), (4, "x/affidavit.pdf"), (5, "tech-specs.PDF"), (6, "notes.txt"), (7, "amendment_no-12.htm"),
    (8, "misc.pdf"), (9, "BidNet page.pdf"), (10, "proposal.pdf"),
]


@query("classify_filenames", "SELECT id::BIGINT AS id, CASE WHEN NOT regexp_matches(n, '\\.(html?|pdf)$') THEN 'unknown' WHEN regexp_matches(n, 'addendum|amendment') THEN 'addendum' "
       "WHEN contains(n, 'affidavit') THEN 'affidavit' WHEN contains(n, 'spec') THEN 'specs' WHEN regexp_matches(n, '\\.html?$|bidnet|bid information') THEN 'bid_page' "
       "WHEN regexp_matches(n, 'rfp|proposal|final|solicitation') THEN 'rfp' ELSE 'supporting' END AS doc_type, "
       "try_cast(nullif(regexp_extract(n, '(addendum|amendment)[^0-9]*([0-9]+)', 2), '') AS INT) AS number, "
       "CASE WHEN regexp_matches(n, '\\.html?$') THEN 'html' WHEN ends_with(n, '.pdf') THEN 'pdf' ELSE 'unknown' END AS fmt "
       f"FROM (SELECT id, lower(string_split(path, '/')[-1]) AS n FROM {values(NAMES, 'id, path')})")
def classify_filenames(spark, sf):
    from ..sources.folders import detected_format

    d = _inline(spark, NAMES, "id long, path string")
    return d.select("id", I.classify_filename("path").alias("doc_type"), I.addendum_number("path").alias("number"), detected_format("path").alias("fmt"))


CONTENT = [
    (1, "Addendum No. 2\nRequest for Proposal 77\nThe affidavit is attached."), (2, "Scope\n\nThis request for proposal has technical specifications."),
    (3, "Affidavit\nAmendment 1"), (4, "nothing"), (5, "RFP\nAFFIDAVIT"), (6, "Addendum 1\nAddendum 2"),
]


@query("classify_content", "SELECT * FROM (VALUES (1::BIGINT, 'doc_type', 'addendum', 'classified'), (1, 'addendum_number', '2', 'classified'), (2, 'doc_type', NULL, 'conflict'), "
       "(3, 'doc_type', NULL, 'conflict'), (3, 'addendum_number', '1', 'classified'), (5, 'doc_type', NULL, 'conflict'), (6, 'doc_type', 'addendum', 'classified'), (6, 'addendum_number', NULL, 'conflict')) "
       "AS t(document_id, field, value, status)")
def classify_content(spark, sf):
    e = I.content_evidence(_inline(spark, CONTENT, "document_id long, text string")).withColumn("source_kind", F.lit("content"))
    return I.resolve_evidence(e)


@query("content_mentions", "SELECT (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(lower(text), '(^|[^\\p{L}\\p{N}_])(addendum|amendment|affidavit)($|[^\\p{L}\\p{N}_])')) FROM documents))::BIGINT AS n_mentions")
def content_mentions(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    e = I.content_evidence(d).where("field = 'doc_type' and value in ('addendum', 'affidavit')")
    return e.agg(F.count("*").alias("n_mentions"))


FORMATS = "CASE o_orderkey % 6 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%-m/%-d/%Y') WHEN 2 THEN strftime(d, '%B %-d, %Y') WHEN 3 THEN strftime(d, '%-d %b %Y') WHEN 4 THEN strftime(d, '%Y/%-m/%-d') ELSE strftime(d, '%b %-d %Y') END"


@query("parse_dates", f"""WITH o AS (SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 20 YEAR)::DATE AS d FROM orders), s AS (SELECT o_orderkey, d, {FORMATS} AS raw FROM o)
SELECT o_orderkey, raw, CASE WHEN o_orderkey % 6 = 1 AND day(d) <= 12 THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS iso,
 CASE WHEN o_orderkey % 6 = 1 AND day(d) <= 12 THEN 'ambiguous' ELSE 'candidate' END AS status FROM s""")
def parse_dates(spark, sf):
    """Order dates, twenty years later, in six spellings."""
    d = F.add_months(F.to_date("o_orderdate"), 240)
    o = table(spark, sf, "orders").select("o_orderkey", d.alias("d"))
    k = F.pmod("o_orderkey", F.lit(6))
    fmt = ["yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy/M/d", "MMM d yyyy"]
    raw = F.when(k == 0, F.date_format("d", fmt[0]))
    for i in range(1, 6):
        raw = raw.when(k == i, F.date_format("d", fmt[i]))
    o = o.withColumn("raw", raw).withColumn("p", dates.parse("raw"))
    return o.select("o_orderkey", "raw", F.col("p.iso").alias("iso"), F.col("p.status").alias("status"))


ODD_DATES = [
    (1, "D:20260131120000"), (2, "2026-02-30"), (3, "31/12/2026"), (4, "05/05/2026"), (5, "13/13/2026"), (6, "June 3, 2026"), (7, "june 3 2026"), (8, "3 Jun 2026"), (9, "soon"), (10, "2026-06-03T10:00:00Z"),
    (11, "2026/2/3"),
]


@query("odd_dates", "SELECT * FROM (VALUES (1::BIGINT, '2026-01-31', 'candidate'), (2, NULL, 'invalid'), (3, '2026-12-31', 'candidate'), (4, NULL, 'ambiguous'), (5, NULL, 'invalid'), (6, '2026-06-03', 'candidate'), "
       "(7, '2026-06-03', 'candidate'), (8, '2026-06-03', 'candidate'), (9, NULL, 'invalid'), (10, '2026-06-03', 'candidate'), (11, '2026-02-03', 'candidate')) AS t(id, iso, status)")
def odd_dates(spark, sf):
    return _inline(spark, ODD_DATES, "id long, raw string").withColumn("p", dates.parse("raw")).select("id", F.col("p.iso").alias("iso"), F.col("p.status").alias("status"))


DATED = [
    (1, "Issue Date: June 3, 2026. Due 2026-07-01."), (2, "Dates 2026-01-02 and 2026-01-03"), (3, "on 05/06/2026"), (4, "nothing"), (5, "Published 2026-01-02; 2026-01-02"), (6, "Bad 2026-02-30"),
]


@query("document_dates", "SELECT * FROM (VALUES (1::BIGINT, 'selected_with_conflict', '2026-06-03'), (2, 'conflict', NULL), (3, 'ambiguous', NULL), (5, 'selected', '2026-01-02'), (6, 'invalid', NULL)) AS t(document_id, date_status, document_date)")
def document_dates(spark, sf):
    d = _inline(spark, DATED, "document_id long, text string").select("document_id", F.posexplode(dates.candidates("text")).alias("ord", "c"))
    d = d.select("document_id", "ord", "c.kind", "c.precedence", dates.parse("c.raw").alias("p")).select("*", F.col("p.iso").alias("iso"), F.col("p.status").alias("status"))
    return dates.select_document_date(d)


@query("order_date_selection", """WITH v AS (SELECT l_orderkey AS document_id, (l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey) AS ord, strftime(l_shipdate::DATE, '%Y-%m-%d') AS iso, CASE WHEN l_returnflag = 'N' THEN 2 ELSE 3 END AS p FROM lineitem),
b AS (SELECT *, min(p) OVER (PARTITION BY document_id) AS best FROM v),
g AS (SELECT document_id, count(DISTINCT iso) FILTER (p = best) AS nb, count(DISTINCT iso) AS na, arg_min(iso, ord) FILTER (p = best) AS f FROM b GROUP BY document_id)
SELECT document_id, CASE WHEN nb > 1 THEN 'conflict' WHEN na > 1 THEN 'selected_with_conflict' ELSE 'selected' END AS date_status, CASE WHEN nb = 1 THEN f END AS document_date FROM g""")
def order_date_selection(spark, sf):
    """Ship dates of an order as its date candidates, by precedence."""
    c = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.expr("(l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey)").alias("ord"), F.date_format(F.to_date("l_shipdate"), "yyyy-MM-dd").alias("iso"), F.lit("candidate").alias("status"),
        F.lit("visible_text").alias("kind"), F.when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("precedence"))
    return dates.select_document_date(c)


@query("retention_spans", """SELECT item_id, CASE WHEN EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, benchmark.text)) THEN 'retained' ELSE 'missing' END AS status FROM benchmark""")
def retention_spans(spark, sf):
    spans = table(spark, sf, "benchmark").select("item_id", "text", F.lit("corpus").alias("file_name"), F.lit(None).cast("int").alias("page_number"))
    pages = table(spark, sf, "documents").select(F.lit("corpus").alias("file_name"), F.lit(None).cast("int").alias("page_number"), "text")
    return I.retention(spans, pages).select("item_id", "status")


@query("retention_coverage", """WITH r AS (SELECT item_id, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, benchmark.text)) AS ok FROM benchmark)
SELECT count(*) AS expected, count(*) FILTER (ok) AS retained, count(*) FILTER (NOT ok) AS missing, 0::BIGINT AS uncertain, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS coverage FROM r""")
def retention_coverage(spark, sf):
    return I.coverage(retention_spans(spark, sf))


@query("manifest_documents", """WITH d AS (SELECT page_id, lower(regexp_extract(url, '://(.*)$', 1)) AS path FROM pages), e AS (SELECT DISTINCT string_split(path, '/')[-1] AS f FROM d WHERE string_split(path, '/')[-1] <> '')
SELECT f AS file_name, min(page_id) AS document_id FROM e JOIN d ON string_split(path, '/')[-1] = f GROUP BY f HAVING count(*) = 1""")
def manifest_documents(spark, sf):
    d = table(spark, sf, "pages").select(F.col("page_id").alias("document_id"), F.lower(F.regexp_extract("url", "://(.*)$", 1)).alias("relative_path"))
    e = d.select(F.element_at(F.split("relative_path", "/"), -1).alias("file_name")).where("file_name <> ''")
    return I.matching_document(e, d)


@query("status_rollup", """WITH s AS (SELECT d.source, d.doc_id, CASE WHEN bool_or(l.toxic = 1) THEN 'failed' WHEN bool_or(l.quality = 0) THEN 'partial' ELSE 'parsed' END AS status
 FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL)
SELECT source AS bid_id, CASE WHEN bool_and(status = 'failed') THEN 'failed' WHEN bool_and(status = 'parsed') THEN 'complete' ELSE 'incomplete' END AS status,
 count(*) AS discovered, count(*) FILTER (status <> 'failed') AS processed, count(*) FILTER (status = 'failed') AS failed FROM s GROUP BY source""")
def status_rollup(spark, sf):
    """Toxic labels as errors, poor quality as incompleteness."""
    d = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("toxic") == 1, "error").otherwise("warning").alias("severity"), (F.col("quality") == 0).alias("affects_completeness"))
    s = I.document_status(d).join(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("bid_id")), "document_id")
    return I.folder_status(s)


@query("usable_documents", "SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> '' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def usable_documents(spark, sf):
    from ..operators.corpus import usable_chunks

    c = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    d = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "parsed").otherwise("failed").alias("status"))
    return usable_chunks(c, d).select(F.col("document_id").alias("doc_id"))


@query("redacted_text", r"SELECT doc_id, substr(regexp_replace(text, '(?i)((?:api[_-]?)?key|token|password|secret)[ \t]*[=:][ \t]*[^ \t\n,;]+', '\1=[REDACTED]', 'g'), 1, 500) AS redacted FROM documents")
def redacted_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.redact("text").alias("redacted"))


@query("diagnostic_rows", """SELECT doc_id AS owner, substr(sha256('diagnostic|file|document_flagged|toxic=' || toxic::VARCHAR || '|{"doc_id":' || doc_id::VARCHAR || '}'), 1, 16) AS diagnostic_id, 'document_flagged' AS code FROM labels""")
def diagnostic_rows(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("owner"), F.concat(F.lit("toxic="), F.col("toxic").cast("string")).alias("message"), F.to_json(F.struct("doc_id")).alias("locator"))
    return I.diagnostics(rows, "file", "document_flagged").select("owner", "diagnostic_id", "code")


@query("failure_events", """SELECT doc_id, CASE WHEN toxic = 1 THEN 'table_extraction' ELSE 'metadata' END AS operation, CASE WHEN quality = 1 THEN 'recovered' ELSE 'partial' END AS recovery_status FROM labels""")
def failure_events(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "table_empty").otherwise("document_date_invalid").alias("code"), F.when(F.col("quality") == 1, "parsed").otherwise("partial").alias("status"))
    return I.failure_events(rows).select("doc_id", "operation", "recovery_status")


@query("coalesced_metadata", """SELECT user_id AS document_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) FILTER (value > 50) AS high FROM events GROUP BY user_id""")
def coalesced_metadata(spark, sf):
    """Events of a user as the pages of a document: the first value of each attribute."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("page_number"), "event_type", F.when(F.col("value") > 50, F.col("value")).alias("high"))
    return I.coalesced_metadata(e, ["event_type", "high"])


@query("running_headings", """SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS heading_id FROM events""")
def running_headings(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", "heading").otherwise("paragraph").alias("kind"), F.col("event_id").cast("string").alias("text"))
    return I.running_heading(e, ["event_id"], "user_id").select("event_id", F.col("heading").cast("long").alias("heading_id"))


@query("heading_levels", """WITH b AS (SELECT user_id, list_sort(list(value))[1 + ((count(*) - 1) // 4)::INT] AS body FROM events GROUP BY user_id)
SELECT event_id, CASE WHEN value / body >= 1.7 THEN 1 WHEN value / body >= 1.3 THEN 2 END AS heading_level FROM events JOIN b USING (user_id)""")
def heading_levels(spark, sf):
    """Events of a user as the lines of a page, values as letter sizes."""
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("page_id"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("text"), F.col("value").alias("size"), F.lit(False).alias("bold"))
    return I.heading_levels(e).select("event_id", "heading_level")

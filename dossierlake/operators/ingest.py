"""Ingestion: HTML pages to sections, classification, page furniture, tables, chunks, retention, statuses."""
from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.ids import stable_id
from ..functions.text import col, edge_line_key
from ..session import ship
from ..sources.scratch import materialize

# fixed values: chunk sizes in words, furniture limits, elements without text, blocks
TARGET, LARGEST, OVERLAP = 120, 150, 20
EDGE_LINES, EDGE_CHARS = 2, 120
SKIPPED = ("script", "style", "noscript", "template")
LEAF_BLOCKS = ("div", "section", "article", "main", "header", "footer", "aside", "dd", "dt", "figcaption", "blockquote", "pre", "address")
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
DATE_META = {
    "published": ("semantic_metadata", 0), "issued": ("semantic_metadata", 0), "modified": ("modified_metadata", 99), "date": ("html_date_metadata", 2),
}


class _Node:
    __slots__ = ("tag", "attrs", "items", "line")

    def __init__(self, tag: str, attrs: dict, line: int):
        self.tag, self.attrs, self.items, self.line = tag, attrs, [], line

    def text(self) -> str:
        items = self.items
        if len(items) == 1 and isinstance(items[0], str):
            return " ".join(items[0].split())
        return " ".join("".join(self._strings()).split())

    def _strings(self) -> Iterator[str]:
        for x in self.items:
            if isinstance(x, str):
                yield x
            elif x.tag not in SKIPPED:
                yield " " if x.tag == "br" else ""
                yield from x._strings()

    def below(self, *tags: str) -> Iterator[_Node]:
        left = self.items[::-1]
        while left:
            x = left.pop()
            if not isinstance(x, str):
                if x.tag in tags:
                    yield x
                left += x.items[::-1]


class _Tree(HTMLParser):
    """Nested elements as they open and close; an element left open holds what follows it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {}, 0)
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.getpos()[0])
        self.open[-1].items.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].items.append(_Node(tag, {k: v or "" for k, v in attrs}, self.getpos()[0]))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].items.append(data)


# fixed values: elements whose text the parser reads as any other, and what a page may consist of to be read by tokens
_SIMPLE = "p|h[1-6]|div|span|table|thead|tbody|tr|td|th|ul|ol|li|b|i|em|strong|a|br|hr|header|footer|section|article|main|aside|nav|body"
_SIMPLE_PAGE = re.compile(rf"""(?:[^<&]++|<(?:{_SIMPLE})(?:[ ][a-z][a-z-]*=(?:'[^'<>&]*'|"[^"<>&]*"))*+>|</(?:{_SIMPLE})>)*+""")
_PIECE = re.compile(r"<(/?)([a-z0-9]+)([^>]*)>|([^<]+)")
_ATTRIBUTE = re.compile(r"""([a-z-]+)=(?:'([^']*)'|"([^"]*)")""")


def _simple_tree(html: str) -> _Node:
    """The tree of a page of plain tags without references, comments and the like: what the parser makes of it."""
    root = _Node("", {}, 0)
    stack = [root]
    for end, tag, attrs, data in _PIECE.findall(html):
        if data:
            stack[-1].items.append(data)
        elif end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
        else:
            node = _Node(tag, {k: a or b for k, a, b in _ATTRIBUTE.findall(attrs)} if attrs else {}, 1)
            stack[-1].items.append(node)
            if tag not in _VOID:
                stack.append(node)
    return root


def parse_tree(html: str) -> _Node:
    if _SIMPLE_PAGE.fullmatch(html):
        return _simple_tree(html)  # lines of elements are not counted: none of these is asked for its line
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def sections(html: str) -> list[tuple]:
    """(kind, text, heading_level, heading_path, table_no) in page order. Headings keep a path cut to
    their level; paragraphs, list items, labels and leaf blocks give text; a table gives one row and hides
    what is in it. A list item within another gives its text twice, as part of the outer one and alone."""
    out: list[tuple] = []
    path: list[str] = []
    tables = 0

    def visit(node: _Node) -> None:
        nonlocal tables
        for x in node.items:
            if isinstance(x, str) or x.tag in SKIPPED:
                continue
            if re.fullmatch("h[1-6]", x.tag):
                level, text = int(x.tag[1]), x.text()
                if text:
                    del path[level - 1 :]
                    path.append(text)
                    out.append(("heading", text, level, list(path), None))
            elif x.tag == "table":
                out.append(("table", x.text(), None, list(path), tables))
                tables += 1
                continue
            elif x.tag in ("p", "li"):
                text = x.text()
                if text:
                    out.append(("paragraph" if x.tag == "p" else "list_item", text, None, list(path), None))
                visit(x)
                continue
            elif x.tag == "span" and x.attrs.get("class", "").endswith("field-label"):
                if x.text():
                    out.append(("other", x.text(), None, list(path), None))
            elif x.tag in LEAF_BLOCKS and not any(True for _ in x.below("p", "li", "table", "h1", "h2", "h3", "h4", "h5", "h6", *LEAF_BLOCKS)):
                if x.text():
                    out.append(("other", x.text(), None, list(path), None))
                continue
            visit(x)

    visit(parse_tree(html))
    return out


def tables(html: str) -> list[tuple]:
    """(table_no, has_header, rows) of each table, cells as text, rows as long as they are."""
    out = []
    for no, table in enumerate(parse_tree(html).below("table")):
        rows = [[c.text() for c in r.below("td", "th")] for r in table.below("tr")]
        first = next(table.below("tr"), None)
        out.append((no, bool(first) and any(True for _ in first.below("th")), rows))
    return out


def metadata(html: str) -> list[tuple]:
    """(key, value, line) of language, title, canonical link and meta elements, in page order."""
    root, out = parse_tree(html), []
    for x in root.below("html", "title", "meta", "link"):
        if x.tag == "html" and x.attrs.get("lang"):
            out.append(("language", x.attrs["lang"], x.line))
        elif x.tag == "title" and x.text():
            out.append(("title", x.text(), x.line))
        elif x.tag == "link" and "canonical" in x.attrs.get("rel", "").lower().split():
            href = x.attrs.get("href", "")
            out.append(("canonical" if re.match(r"https?://[^/]", href) else "invalid_canonical", href, x.line))
        elif x.tag == "meta":
            name = next((x.attrs[k] for k in ("name", "property", "itemprop", "http-equiv") if x.attrs.get(k)), None)
            if name and x.attrs.get("content"):
                out.append((name.lower(), x.attrs["content"].strip(), x.line))
    return out


def _parsed(pages: DataFrame, parse: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    ship(pages.sparkSession)
    schema = f"page_id long, ordinal int, {schema}"
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i, *r) for p, h in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist()) if h is not None for i, r in enumerate(parse(h))]
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], names=kinds.names)

    return pages.select("page_id", "html").mapInArrow(run, schema)


def html_sections(pages: DataFrame) -> DataFrame:
    return _parsed(pages, sections, "kind string, text string, heading_level int, heading_path array<string>, table_no int")


def html_tables(pages: DataFrame) -> DataFrame:
    return _parsed(pages, tables, "table_no int, has_header boolean, rows array<array<string>>")


def html_metadata(pages: DataFrame) -> DataFrame:
    return _parsed(pages, metadata, "key string, value string, line int")


def pdf_unavailable(documents: DataFrame) -> DataFrame:
    """Without a PDF parser at hand, each PDF becomes a diagnostic that affects completeness."""
    return documents.where(F.col("detected_format") == "pdf").select(
        "document_id", F.lit("file").alias("scope"), F.lit("parse_failure").alias("code"), F.lit("error").alias("severity"), F.lit(True).alias("affects_completeness"))


def pdf_pages(documents: DataFrame, parser: Callable[[bytes], list[str]]) -> DataFrame:
    """(document_id, page_number, raw_text, error) of PDFs through a pluggable parser of bytes to page texts;
    a parser's exception becomes the row's error, so one broken file fails alone."""
    ship(documents.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, content in zip(f["document_id"], f["content"]):
                try:
                    rows += [(d, n, t, None) for n, t in enumerate(parser(content), 1)]
                except Exception as e:  # becomes a diagnostic of this file
                    rows.append((d, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "raw_text", "error"])

    return documents.where(F.col("detected_format") == "pdf").select("document_id", "content").mapInPandas(
        run, "document_id string, page_number int, raw_text string, error string")


def heading_levels(spans: DataFrame) -> DataFrame:
    """Adds heading_level to layout lines (page_id, ordinal, text, size, bold): body size is the span size at
    a quarter of the page's sorted sizes; short lines clearly larger, or bold or in capitals and somewhat
    larger, are headings; by size they are level 1, 2 or 3."""
    w = Window.partitionBy("page_id")
    sizes = F.array_sort(F.collect_list("size").over(w))
    body = F.get(sizes, F.floor((F.size(sizes) - 1) / 4).cast("int"))
    ratio = F.col("size") / body
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    short = (F.length("text") <= 120) & (words <= 14) & ~F.col("text").rlike(r"^(?:[-*•▪]|[0-9]+[.)])\s+")
    capitals = (F.upper("text") == F.col("text")) & F.col("text").rlike(r"\p{Lu}")
    heading = short & ((ratio >= 1.3) | F.col("bold") & (ratio >= 1.08) | capitals & (ratio >= 1.1))
    return spans.withColumn("heading_level", F.when(heading, F.when(ratio >= 1.7, 1).when(ratio >= 1.3, 2).otherwise(3)))


def running_heading(lines: DataFrame, order: list[str], by: str = "document_id") -> DataFrame:
    """Carries the last heading on over the following lines, also across pages."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(w))


def classify_filename(path) -> Column:
    """A document type from markers in the file's name."""
    name = F.lower(F.element_at(F.split(col(path), "/"), -1))

    def some(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(name, F.lit(w))
        return out

    return (
        F.when(~name.rlike(r"\.(?:html?|pdf)$"), "unknown").when(some("addendum", "amendment"), "addendum").when(some("affidavit"), "affidavit")
        .when(some("spec"), "specs").when(name.rlike(r"\.html?$") | some("bidnet", "bid information"), "bid_page")
        .when(some("rfp", "porfp", "proposal", "final", "solicitation"), "rfp").otherwise("supporting")
    )


def addendum_number(path) -> Column:
    name = F.lower(F.element_at(F.split(col(path), "/"), -1))
    return F.try_to_number(F.nullif(F.regexp_extract(name, r"(?:addendum|amendment)[^0-9]*([0-9]+)", 1), F.lit("")), F.lit("999999999")).cast("int")


# fixed values: what in a text speaks for a document type
CONTENT_TYPES = {
    "addendum": "addendum|amendment", "rfp": "request for proposal|rfp|porfp", "affidavit": "affidavit", "specs": "(?:technical[ \t]+)?specifications?",
    "bid_page": "bid information|bidnet direct",
}


def content_evidence(documents: DataFrame) -> DataFrame:
    """(document_id, field, value, offset, strength) of every mention of a type or addendum number in the
    text; a mention that starts one of the first ten lines is explicit. Shortly below an explicit addendum
    heading, the name of the amended RFP is only supporting."""
    heading = r"(?m)^[ \t]*(?:addendum|amendment)[ \t]*(?:no\.?|number)?[ \t]*[:#-]?[ \t]*[0-9]+"
    low = F.lower("text")
    base = documents.select("document_id", low.alias("low"))
    after = F.when(F.regexp_instr("low", F.lit(heading)) > 0, F.regexp_instr("low", F.lit(heading)) + F.length(F.regexp_extract("low", heading, 0)) - 1)
    base = base.withColumn("after", after)
    parts = [("doc_type", t, rf"(?<![\p{{L}}\p{{N}}_])(?:{p})(?![\p{{L}}\p{{N}}_])", 0) for t, p in CONTENT_TYPES.items()]
    parts.append(("addendum_number", None, r"(?<![\p{L}\p{N}_])(?:addendum|amendment)[ \t]*(?:no\.?|number)?[ \t]*[:#-]?[ \t]*([0-9]+)(?![\p{L}\p{N}_])", 1))
    out = None
    for field, value, pattern, group in parts:
        zipped = F.arrays_zip(
            F.split("low", pattern, -1).alias("gap"), F.regexp_extract_all("low", F.lit(pattern), F.lit(0)).alias("hit"),
            F.regexp_extract_all("low", F.lit(pattern), F.lit(group)).alias("val"),
        )
        start = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<offset:int,val:string>>))")
        folded = F.aggregate(zipped, start, lambda s, m: F.named_struct(
            F.lit("at"), s["at"] + F.length(m["gap"]) + F.coalesce(F.length(m["hit"]), F.lit(0)),
            F.lit("out"), F.when(m["hit"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct((s["at"] + F.length(m["gap"])).alias("offset"), m["val"].alias("val"))))),
        ))["out"]
        some = base.where(F.col("low").rlike(pattern)).select("document_id", "low", "after", F.explode(folded).alias("e")).select(
            "document_id", F.lit(field).alias("field"), (F.col("e.val") if value is None else F.lit(value)).alias("value"), F.col("e.offset").alias("offset"), "low", "after")
        out = some if out is None else out.unionAll(some)
    before = F.substr("low", F.lit(1), F.col("offset"))
    line_no = F.regexp_count(before, F.lit("\n"))
    explicit = (line_no < 10) & before.rlike(r"(?:^|\n)[ \t\r]*$")
    between = F.substr("low", F.col("after") + 1, F.greatest(F.col("offset") - F.col("after"), F.lit(0)))
    amended = (F.col("field") == "doc_type") & (F.col("value") == "rfp") & (F.col("offset") > F.col("after")) & (F.regexp_count(between, F.lit("\n")) <= 3)
    strength = F.when(explicit & ~F.coalesce(amended, F.lit(False)), "explicit").otherwise("supporting")
    return out.select("document_id", "field", "value", "offset", strength.alias("strength"))


def resolve_evidence(evidence: DataFrame) -> DataFrame:
    """(document_id, field, value, status) from rows (document_id, field, value, source_kind, strength):
    explicit content outranks the file name, which outranks other content; two values at the best rank conflict."""
    rank = F.when((F.col("source_kind") == "content") & (F.col("strength") == "explicit"), 0).when(F.col("source_kind") == "filename", 1).otherwise(2)
    best = evidence.withColumn("rank", rank).withColumn("best", F.min("rank").over(Window.partitionBy("document_id", "field"))).where("rank = best")
    out = best.groupBy("document_id", "field").agg(F.count_distinct("value").alias("n"), F.min("value").alias("v"))
    return out.select("document_id", "field", F.when(F.col("n") == 1, F.col("v")).alias("value"), F.when(F.col("n") == 1, "classified").otherwise("conflict").alias("status"))


def page_furniture(lines: DataFrame) -> DataFrame:
    """Adds ``furniture`` to rows (document_id, page_id, line_no, n_lines, line): removed for a short edge line
    whose key stands on three fifths of the document's pages and at least two, uncertain for one on two or more."""
    edge = (F.col("line_no") < EDGE_LINES) | (F.col("line_no") >= F.col("n_lines") - 1)
    # inner lines have no key and stay as they are, so they take part in no join; what follows reads all lines four
    # times, so they are made and their keys computed once
    marked = materialize(lines.withColumn("key", F.when(edge, edge_line_key("line"))), "page-lines")
    keyed, inner = marked.where(edge), marked.where(~edge).withColumn("furniture", F.lit("kept"))
    counts = keyed.where((F.col("key") != "") & (F.trim("line") != "") & (F.length("line") <= EDGE_CHARS)).groupBy("document_id", "key").agg(F.count_distinct("page_id").alias("on_pages"))
    pages = marked.groupBy("document_id").agg(F.count_distinct("page_id").alias("pages"))
    on = counts.where("on_pages >= 2").join(pages, "document_id")
    needed = F.greatest(F.lit(2), F.ceil(F.col("pages") * 3 / 5))
    state = on.select("document_id", "key", F.when(F.col("on_pages") >= needed, "removed").otherwise("uncertain").alias("furniture"))
    both = keyed.join(state, ["document_id", "key"], "left").withColumn("furniture", F.coalesce("furniture", F.lit("kept")))
    return both.select(*lines.columns, "key", "furniture").unionByName(inner.select(*lines.columns, "key", "furniture"))


def rectangular(rows, columns=None) -> Column:
    """A struct (rows, width, uneven): rows padded with nulls to the widest."""
    rows = col(rows)
    widths = F.transform(rows, F.size) if columns is None else F.concat(F.transform(rows, F.size), F.array(F.size(col(columns))))
    width = F.coalesce(F.array_max(widths), F.lit(0))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(None).cast("string"), width - F.size(r))))
    return F.struct(padded.alias("rows"), width.alias("width"), F.exists(rows, lambda r: F.size(r) != width).alias("uneven"))


def table_text(rows) -> Column:
    """Cells joined by bars, rows by newlines; null cells are empty."""
    return F.array_join(F.transform(col(rows), lambda r: F.array_join(r, " | ", "")), "\n")


def word_ranges(text: str, target: int = TARGET, largest: int = LARGEST, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Half-open word ranges that cover a text: each ends at the last paragraph end up to the target, else
    the last sentence end there, else the first of either up to the limit, else at the limit; the next one
    starts ``overlap`` words earlier. What fits the limit is the last range."""
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    n = len(spans)
    paragraphs, sentences = [], []
    for i in range(1, n):
        if "\n" in text[spans[i - 1][1] : spans[i][0]]:
            paragraphs.append(i)
        if re.search(r"[.!?][\"')\]]*$", text[slice(*spans[i - 1])]):
            sentences.append(i)

    def last(ends: list[int], low: int, high: int) -> int | None:
        """The greatest end over ``low`` and up to ``high``."""
        k = bisect_right(ends, high)
        return ends[k - 1] if k and ends[k - 1] > low else None

    def first(ends: list[int], low: int, high: int) -> int:
        k = bisect_right(ends, low)
        return ends[k] if k < len(ends) and ends[k] <= high else high

    out, at = [], 0
    while at < n:
        end = n
        if n - at > largest:
            near = last(paragraphs, at + overlap, at + target) or last(sentences, at + overlap, at + target)
            end = near or min(first(b, at + target, at + largest) for b in (paragraphs, sentences))
        out.append((at, end))
        if end == n:
            return out
        at = max(at + 1, end - overlap)
    return out


def chunks(texts: DataFrame, **sizes) -> DataFrame:
    """(document_id, chunk_index, start_word, end_word, text) of rows (document_id, text)."""
    ship(texts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, t in zip(f["document_id"], f["text"]):
                spans = [m.span() for m in re.finditer(r"\S+", t or "")]
                rows += [(d, i, a, b, t[spans[a][0] : spans[b - 1][1]]) for i, (a, b) in enumerate(word_ranges(t or "", **sizes))]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "start_word", "end_word", "text"])

    kind = texts.schema["document_id"].dataType.simpleString()
    return texts.select("document_id", "text").mapInPandas(run, f"document_id {kind}, chunk_index int, start_word int, end_word int, text string")


def fragments_of(ranges: DataFrame, fragments: DataFrame) -> DataFrame:
    """Fragments (document_id, fragment, s, e) that each word range (document_id, chunk_index, start_word,
    end_word) meets: an interval join within the document."""
    meets = (F.greatest("start_word", "s") < F.least("end_word", "e"))
    return ranges.join(fragments, "document_id").where(meets).select("document_id", "chunk_index", "fragment")


def retention(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``status`` to expected spans (item_id, text, file_name, page_number): retained if a page of that
    file and number (any, where null) contains it, missing if not, uncertain if there is no such page."""
    p = pages.select(F.lower("file_name").alias("f"), F.col("page_number").alias("pn"), F.col("text").alias("body"))
    both = spans.withColumn("f", F.lower("file_name")).join(p, "f", "left").where("page_number is null or pn is null or pn = page_number")
    out = both.groupBy("item_id").agg(F.count("body").alias("n"), F.max(F.contains("body", "text")).alias("found"))
    return spans.join(out, "item_id", "left").withColumn(
        "status", F.when(F.coalesce("n", F.lit(0)) == 0, "uncertain").when(F.col("found"), "retained").otherwise("missing")).drop("n", "found")


def coverage(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count("*").alias("expected"), F.count_if(F.col("status") == "retained").alias("retained"), F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_if(F.col("status") == "uncertain").alias("uncertain"), F.round(F.try_divide(F.count_if(F.col("status") == "retained"), F.count("*")), 6).alias("coverage"))


def matching_document(expected: DataFrame, documents: DataFrame) -> DataFrame:
    """(file_name, document_id) of manifest files that exactly one document's path ends with."""
    e = expected.select("file_name", F.lower(F.element_at(F.split("file_name", "/"), -1)).alias("base")).distinct()
    d = documents.select("document_id", F.lower("relative_path").alias("path"), F.lower(F.element_at(F.split("relative_path", "/"), -1)).alias("base"))
    hit = e.join(d, "base").where(F.endswith("path", F.lower("file_name")))
    return hit.groupBy("file_name").agg(F.count("*").alias("n"), F.min("document_id").alias("document_id")).where("n = 1").drop("n")


def document_status(diagnostics: DataFrame) -> DataFrame:
    """(document_id, status): failed with an error, partial if completeness is affected, else parsed."""
    return diagnostics.groupBy("document_id").agg(
        F.when(F.bool_or(F.col("severity") == "error"), "failed").when(F.bool_or("affects_completeness"), "partial").otherwise("parsed").alias("status"))


def folder_status(documents: DataFrame) -> DataFrame:
    """(bid_id, status, counts): failed if all documents failed, complete if all parsed, else incomplete."""
    s = F.col("status")
    return documents.groupBy("bid_id").agg(
        F.when(F.every(s.isin("failed", "unsupported")), "failed").when(F.every(s == "parsed"), "complete").otherwise("incomplete").alias("status"),
        F.count("*").alias("discovered"), F.count_if(s.isin("parsed", "partial")).alias("processed"), F.count_if(s == "failed").alias("failed"))


def diagnostics(rows: DataFrame, scope, code, severity="warning", affects=False) -> DataFrame:
    """Diagnostic rows with a stable id for rows (owner, message, locator)."""
    return rows.select(
        stable_id(F.lit("diagnostic"), F.lit(scope), F.lit(code), "message", "locator").alias("diagnostic_id"), "owner", F.lit(scope).alias("scope"),
        F.lit(code).alias("code"), "message", F.lit(severity).alias("severity"), "locator", F.lit(affects).alias("affects_completeness"))


def failure_events(diagnostic_rows: DataFrame) -> DataFrame:
    """The failure log: operation from the code, recovery from the document's status."""
    code = F.col("code")
    operation = F.when(code.contains("table"), "table_extraction").when(code.contains("date"), "metadata").when(code.contains("ocr"), "ocr").when(
        code.contains("format"), "format_detection").otherwise("parsing")
    recovery = F.when(F.col("status") == "failed", "unrecovered").when(F.col("status") == "partial", "partial").otherwise("recovered")
    return diagnostic_rows.withColumns({"operation": operation, "recovery_status": recovery})


def coalesced_metadata(pages: DataFrame, attributes: list[str], order: str = "page_number") -> DataFrame:
    """Per document the first non-null value of each attribute over its pages."""
    return pages.groupBy("document_id").agg(*[F.min_by(a, F.when(F.col(a).isNotNull(), F.col(order))).alias(a) for a in attributes])


def page_lines(html: str) -> list[tuple]:
    """(block, line_no, n_lines, line) of the outermost explicit page containers of one file: elements of a
    class page, with a data-page mark or a page-break style; none, if there are fewer than two."""
    found: list[_Node] = []

    def visit(node: _Node) -> None:
        for x in node.items:
            if isinstance(x, str):
                continue
            classes = x.attrs.get("class", "").lower().split()
            if "page" in classes or any(k.startswith("data-page") for k in x.attrs) or re.search(r"page-break|break-(?:before|after)\s*:\s*page", x.attrs.get("style", "").lower()):
                found.append(x)
            else:
                visit(x)

    visit(parse_tree(html))
    out = []
    for no, node in enumerate(found if len(found) > 1 else []):
        lines = [t for t in (x.text() for x in node.below("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div", "header", "footer") if not any(True for _ in x.below("p", "li", "div"))) if t]
        out += [(no, i, len(lines), t) for i, t in enumerate(lines)]
    return out


def html_page_lines(pages: DataFrame) -> DataFrame:
    """Lines of explicit pages within HTML files, ready for ``page_furniture`` with the file as document."""
    rows = _parsed(pages, page_lines, "page_block int, line_no int, n_lines int, line string")
    return rows.select(F.col("page_id").alias("document_id"), F.concat_ws("-", "page_id", "page_block").alias("page_id"), "line_no", "n_lines", "line")


def metadata_dates(metadata_rows: DataFrame) -> DataFrame:
    """Date candidates (page_id, ord, raw, kind, precedence) of meta elements: published and issued first,
    plain dates next, times of change never."""
    key = F.lower("key")
    kind = F.when(key.rlike("publish|issued"), "published").when(key.rlike("modif|updated"), "modified").when(key.rlike("date"), "date")
    k, p = None, None
    for name, (source, precedence) in DATE_META.items():
        k = F.when(kind == name, source) if k is None else k.when(kind == name, source)
        p = F.when(kind == name, precedence) if p is None else p.when(kind == name, precedence)
    return metadata_rows.where(kind.isNotNull()).select("page_id", F.col("ordinal").alias("ord"), F.col("value").alias("raw"), k.alias("kind"), p.alias("precedence"))


def pdf_metadata(documents: DataFrame) -> DataFrame:
    """(document_id, title, description, dates) of a PDF's raw metadata map: subject is the description, times of
    creation and change are technical."""
    m = lambda k: F.nullif(F.trim(F.try_element_at("raw", F.lit(k))), F.lit(""))
    date = lambda k, kind: F.struct(m(k).alias("raw"), F.lit(kind).alias("kind"))
    dates = F.filter(F.array(date("PublicationDate", "semantic_metadata"), date("modDate", "modified_metadata"), date("creationDate", "technical_timestamp")), lambda d: d["raw"].isNotNull())
    return documents.select("document_id", m("title").alias("title"), m("subject").alias("description"), dates.alias("dates"))

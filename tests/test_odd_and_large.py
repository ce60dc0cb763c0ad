"""Odd rows, and plans that must not move what they need not."""
import random

import pytest
from oracle import compare, connect

from dossierlake.functions import dates
from dossierlake.operators import extract, ingest, retrieval
from dossierlake.plans import registry
from dossierlake.sources.scratch import spread

TEXTS = [None, "", " ", "  two blanks before", "one", "one two three", "the the the the", "the " * 300, "emoji 🦆 the 🦆 the end", "\tthe tab\nand the line "]


@pytest.fixture
def odd(spark, tmp_path):
    """A folder of the small tables whose documents are odd."""
    for t in ("labels", "conversations", "embeddings", "pages", "orders", "lineitem", "benchmark", "customer", "supplier", "part", "nation", "region", "events"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["supported_proposals", "excerpt_islands"])
def test_odd_texts_equal_sql(spark, odd, name):
    problem = compare(spark, connect(odd), name, registry.QUERIES[name], registry.ORACLES[name], odd)
    assert problem is None, problem


def _words(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice("the oak desk of pine zx-21 zx-210 lamp 4gb and chair".split()) for _ in range(n))


def test_records_are_read_not_shuffled(spark):
    """Ranking moves what a task found best, not the words of the records, and gives what stored postings give."""
    rows = [(f"r{i:03}", f"b{i % 3}", None if i % 41 == 40 else _words(i % 60, i % 17)) for i in range(150)]
    r = spark.createDataFrame(rows, "record_id string, bid_id string, text string").repartition(5)
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["the oak desk", "oak desk", "zx-21 lamp", "zx-210", "of pine of", "b1", "the oak desk", "none", " ", "Lamp 4gb and"])], "query_id long, query string")
    index = retrieval.Postings.of(r).stored()
    for ranked in (retrieval.keyword_candidates, retrieval.semantic_candidates):
        for limit in (3, 50, None):
            own = ranked(r, q, limit)
            assert "Generate" not in own._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, own.collect())) == sorted(map(tuple, ranked(r.where("text is not null"), q, limit, index).collect()))


def test_vectors_are_multiplied_in_blocks(spark):
    """Undefined cosines come last, ties go by id, and a task passes on only its best."""
    v = [(i, [float(i % 7 - 3), float(i % 5), 1.0]) for i in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, None), (62, [1.0]), (63, [None, 1.0, 1.0])]
    vectors = spark.createDataFrame(v, "record_id long, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, x) for i, x in v if i % 9 == 0], "query_id long, qvector array<double>")

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
            return None
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5), 6)

    want = {}
    for qid, x in v:
        if qid % 9 == 0:
            scored = sorted(((cosine(y, x), i) for i, y in v), key=lambda p: (p[0] is None, -(p[0] or 0), p[1]))
            want[qid] = [(i, s) for s, i in scored]
    for limit in (4, 62, None):
        got = {}
        for r in retrieval.vector_candidates(vectors, asked, limit).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.record_id, r.score))
        assert got == {k: rows[:limit] for k, rows in want.items()}


def test_date_selection_is_one_aggregation(spark):
    """Neither windows nor sets of dates; ties, nulls and technical dates as before."""
    rows = [(1, 1, "2024-01-02", "candidate", "visible_text", 3), (1, 2, "2024-01-03", "candidate", "visible_text", 2), (2, 1, "2024-01-02", "candidate", "visible_text", 2),
            (2, 1, "2024-01-05", "candidate", "visible_text", 2), (3, 1, None, "invalid", "visible_text", 3), (4, 1, None, "ambiguous", "visible_text", 2), (4, 2, "2024-01-02", "candidate", "visible_text", 3),
            (5, 1, "2024-01-02", "candidate", "modified_metadata", 0), (6, 1, "2024-01-02", "candidate", "visible_text", 3), (6, 2, "2024-01-02", "candidate", "visible_text", 3)]
    out = dates.select_document_date(spark.createDataFrame(rows, "document_id long, ord int, iso string, status string, kind string, precedence int"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Expand" not in plan
    assert {r.document_id: (r.date_status, r.document_date) for r in out.collect()} == {
        1: ("selected_with_conflict", "2024-01-03"), 2: ("conflict", None), 3: ("invalid", None), 4: ("ambiguous", None), 5: ("unavailable", None), 6: ("selected", "2024-01-02")}


def _flat(node):
    out = []
    for x in node.items:
        if not isinstance(x, str):
            out.append((x.tag, x.attrs, _flat(x)))
        elif out and isinstance(out[-1], str):
            out[-1] += x
        else:
            out.append(x)
    return out


def test_simple_pages_make_the_same_tree():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<div class='page x'>", "</div>", "<br>", "</br>", "<hr>", "a > b", " \n", "x", "<td>", "</td>", "<tr>", "<table>", "</table>", "<li>", "<a href=\"u?x=1\" id='2'>", "</a>", "é ", "</ul>", "]]>", "--> ", "\r\n", "<a href=''>"]
    for _ in range(3000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert ingest._SIMPLE_PAGE.fullmatch(html)
        tree = ingest._Tree()
        tree.feed(html)
        tree.close()
        assert _flat(ingest.parse_tree(html)) == _flat(tree.root), html
    for html in ("a &amp; b", "<!-- x --><p>", "<script>1</script>", "<P>", "<p", "<title>x</title>", "<p a=b>", "<p/>", "< p>"):
        assert not ingest._SIMPLE_PAGE.fullmatch(html)


def test_furniture_parses_pages_once(spark):
    html = "<body>" + "".join(f"<div class='page'><p>Head 7</p><p>body {c}</p><p>Page {c} of 3</p></div>" for c in "123") + "</body>"
    out = ingest.page_furniture(ingest.html_page_lines(spark.createDataFrame([(1, html)], "page_id long, html string")))
    assert "MapIn" not in out._jdf.queryExecution().executedPlan().toString() and out.where("furniture = 'removed'").count() == 9


EVIDENCE = [
    ("b1", "r1", "a.html", 1, "rfp", None, "Solicitation Number: RFP-7\nPayment terms: Net 30"), ("b1", "r2", "b.html", 1, "addendum", 1, "Payment terms: Net 45. The new due date: May 4, 2026"),
    ("b2", "r3", "a.html", 1, "rfp", None, "Nothing of note."), ("b2", "r4", "b.html", 1, "addendum", 2, "Payment terms: Net 60"), ("b3", "r5", "b.html", 1, "addendum", 1, "Payment terms: Net 10"),
]


def test_found_only_and_reconciled_without_absent_fields(spark):
    """Rows of absent fields need not be made; updates of them count as before, those of unknown bids do not."""
    e = spark.createDataFrame([(*r[:4], None, r[4], "text", r[5], "2026-01-01", "current", r[6]) for r in EVIDENCE],
                              "bid_id string, record_id string, source_file string, page_number int, section_title string, doc_type string, content_kind string, addendum_number int, document_date string, authority_status string, text string")
    base = e.where(~extract.is_addendum_evidence())
    every, found = extract.extract(base), extract.extract(base, found_only=True)
    columns = ["bid_id", "field", "value"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, every.where("status = 'supported'").select(columns).collect()))
    updates = extract.update_candidates(e)
    got = sorted(map(tuple, extract.reconcile_scalars(found, updates, base).collect()))
    assert got == sorted(map(tuple, extract.reconcile_scalars(every, updates).collect())) and len(got) == 3


def test_parts_grow_with_splits(spark):
    """Rows that become texts are dealt into more parts where there are more splits."""
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(100).repartition(cores)
    assert spread(rows, "id").rdd.getNumPartitions() == cores and spread(rows, "id", each=16).rdd.getNumPartitions() == 16 * cores


def _moved(spark, query, folder):
    """Bytes that the stages of a query shuffle, spill and write."""
    sc, none = spark.sparkContext._jsc.sc(), spark._jvm.java.util.ArrayList()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() + s.memoryBytesSpilled() + s.diskBytesSpilled() + s.outputBytes() for s in map(found.apply, range(found.size()))}

    before = stages()
    query(spark, folder).collect()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.fixture(scope="module")
def growing(spark, tmp_path_factory):
    """Folders of the documents once and four times, in as many splits as there are cores."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out, n = [], d.agg({"doc_id": "max"}).first()[0] + 1
    for times in (1, 4):
        rows = d.crossJoin(spark.range(times).withColumnRenamed("id", "copy")).selectExpr(f"doc_id + copy * {n} as doc_id", "text", "lang", "source", "n_chars")
        out.append(str(tmp_path_factory.mktemp(f"x{times}")))
        rows.repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(f"{out[-1]}/documents.parquet")
    return out


@pytest.mark.parametrize("name", ["token_cosine_topk", "semantic_only_search", "bm25_topk", "invalid_results", "citation_rows", "model_rerank", "evidence_by_bid"])
def test_what_is_moved_does_not_grow(spark, growing, name):
    """What a ranking shuffles, spills and writes follows questions and limit, not the documents."""
    once, four = (_moved(spark, registry.QUERIES[name], folder) for folder in growing)
    assert four < 2 * once, (once, four)

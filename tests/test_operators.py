"""Small cases with known results for the engine's own operators."""
import hashlib
import random
import re
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossierlake import service
from dossierlake.config import Config
from dossierlake.functions import dates, ids
from dossierlake.functions import text as T
from dossierlake.operators import answers, corpus, evaluation, extract, ingest, qa, registry, retrieval, workflow
from dossierlake.sources import folders
from dossierlake.sources.store import VersionedStore, export_json
from dossierlake.streaming import incremental


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


# ---- texts and ids

def test_tokens(spark):
    assert one(spark, T.tokens("t"), t="ZX-210, zx_2-b! A--b É9") == ["zx-210", "zx_2-b", "a", "b", "9"]


def test_stable_id(spark):
    want = hashlib.sha256(b"a|None|3").hexdigest()[:16]
    assert spark.createDataFrame([("a", None, 3)], "a string, b string, c int").select(ids.stable_id("a", "b", "c").alias("x")).first().x == want


def test_paths_and_bid_numbers(spark):
    assert one(spark, ids.relative_path("p"), p="..\\.hidden/x.html") == "hidden/x.html"
    digest = int(hashlib.sha256(b"my-bid-7").hexdigest()[:16], 16)
    assert one(spark, ids.bid_number("p"), p="My Bid #7!") == str(10**11 + digest % (9 * 10**11))
    assert one(spark, ids.bid_number("p", "o"), p="x", o=" RFP-1 ") == "RFP-1"


def fold(text):
    """Line by line, what normalize_text folds."""
    lines, now = [], ""
    structural = lambda x: bool(re.match(r"(?:[-*•▪]|\d+[.)])[ \t]+", x)) or "|" in x or x[-1:] in ".!?:;"
    for line in [re.sub("[ \t]+", " ", x).strip(" ") for x in text.replace("­", "").replace("\r\n", "\n").replace("\r", "\n").split("\n")] + [""]:
        if line and re.search(r"\w-$", now) and line[0].islower():
            now = now[:-1] + line
        elif line and now and not structural(now) and not structural(line) and len(now.split()) >= 3 and (line[0].islower() or line[0] in ",)]}"):
            now = f"{now} {line}"
        else:
            lines += [now] if now else []
            now = line
    if len(lines) > 2:
        noise = lambda x: re.fullmatch(r"(?:header|footer)(?:[ \t]+\d+)?|page[ \t]+\d+(?:[ \t]+of[ \t]+\d+)?", x.lower()) and len(x) < 120 and lines.count(x) >= 3
        lines = [x for x in lines if not noise(x)]
    return "\n".join(lines).strip()


def test_normalize_text(spark):
    rng = random.Random(4)
    words = ["the", "School-", "dis", "Offer", "must.", "a|b", "1.", "Page", "3", "header", ")", "soft­hy", "x:", "-", "• item", "é", "  wide"]
    texts = ["", "one\ntwo", "This is a wrapped\nline of prose", "dehy-\nphenated word", "Page 1 of 3\nx\nPage 1 of 3\ny\nPage 1 of 3", "a b c\n\nd"]
    texts += ["\n".join(" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.normalize_text("t").alias("n"))
    for r in df.collect():
        assert r.n == fold(texts[r.i]), texts[r.i]


def test_redaction(spark):
    assert one(spark, T.redact("t"), t="api_key=abc, password: x;token = 'q' rest") == "api_key=[REDACTED], password=[REDACTED];token=[REDACTED] rest"
    assert len(one(spark, T.redact("t"), t="x" * 900)) == 500


def test_date_status(spark):
    assert tuple(one(spark, dates.parse("t"), t="05/05/2026")) == (None, "ambiguous")
    got = one(spark, dates.candidates("t"), t="Issued: 2026-01-02 and Jan 5, 2026")
    assert [(c.raw, c.offset, c.kind) for c in got] == [("2026-01-02", 8, "labeled_visible_text"), ("Jan 5, 2026", 23, "visible_text")]


# ---- ingestion

def test_chunk_anchor():
    text = " ".join(f"w{i}" for i in range(170))
    a, b = ingest.word_ranges(text)
    assert a == (0, 150) and b == (130, 170)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", "end.", "\n", "q?", 'said."', "x" * 30]), max_size=600))
def test_chunks_cover_all_words(parts):
    text = " ".join(parts)
    n = len(text.split())
    ranges = ingest.word_ranges(text)
    assert (not ranges) == (n == 0)
    if ranges:
        assert ranges[0][0] == 0 and ranges[-1][1] == n
        for (a, b), (c, d) in zip(ranges, ranges[1:]):
            assert b - a <= ingest.LARGEST and c == max(a + 1, b - ingest.OVERLAP) and c <= b and d > b


def test_sections_and_tables():
    html = "<html lang='en'><body><h1>A</h1><p>one <b>two</b></p><h2>B</h2><ul><li>x<ul><li>y</li></ul></li></ul><script>no</script><table><tr><td><p>cell</p></td></tr></table><div>leaf</div></body></html>"
    got = ingest.sections(html)
    assert [(k, t, p) for k, t, _, p, _ in got] == [
        ("heading", "A", ["A"]), ("paragraph", "one two", ["A"]), ("heading", "B", ["A", "B"]), ("list_item", "xy", ["A", "B"]), ("list_item", "y", ["A", "B"]), ("table", "cell", ["A", "B"]),
        ("other", "leaf", ["A", "B"]),
    ]


def test_furniture_on_pages(spark):
    lines = []
    for d, n in ((1, 3), (2, 5)):
        for p in range(n):
            body = ["City of X  Page %d of %d" % (p + 1, n), "RFP 7", f"text {d} {p} word", "footer"] if d == 1 or p < 2 else [f"own {'abcdefg'[p]}", "mid", "z" + "abcdefg"[p]]
            lines += [(d, d * 10 + p, i, len(body), x) for i, x in enumerate(body)]
    df = spark.createDataFrame(lines, "document_id int, page_id int, line_no int, n_lines int, line string")
    got = {(r.document_id, r.page_id, r.line_no): r.furniture for r in ingest.page_furniture(df).collect()}
    assert all(got[1, 10 + p, i] == "removed" for p in range(3) for i in (0, 1, 3)) and got[1, 10, 2] == "kept"
    assert got[2, 20, 0] == got[2, 21, 3] == "uncertain"


def test_rectangular(spark):
    df = spark.createDataFrame([([["a", "b"], ["c"]],), ([],)], "rows array<array<string>>").select(ingest.rectangular("rows").alias("r"))
    a, b = [r.r for r in df.collect()]
    assert (a.rows, a.width, a.uneven) == ([["a", "b"], ["c", None]], 2, True) and (b.rows, b.width, b.uneven) == ([], 0, False)


def test_broken_pdf_fails_alone(spark):
    df = spark.createDataFrame([("a", "pdf", b"ok"), ("b", "pdf", b"bad"), ("c", "html", b"")], "document_id string, detected_format string, content binary")

    def parser(content):
        if content == b"bad":
            raise ValueError("broken")
        return ["page one", "page two"]

    got = {(r.document_id, r.page_number): r.error for r in ingest.pdf_pages(df, parser).collect()}
    assert got == {("a", 1): None, ("a", 2): None, ("b", None): "ValueError: broken"}
    assert [r.document_id for r in ingest.pdf_unavailable(df).orderBy("document_id").collect()] == ["a", "b"]


def test_folder_scan(spark, tmp_path):
    (tmp_path / "bids/b1/sub").mkdir(parents=True)
    (tmp_path / "bids/b1/a.html").write_text("<html><body><p>hello there</p></body></html>")
    (tmp_path / "bids/b1/sub/x.pdf").write_text("not a pdf")
    (tmp_path / "bids/b1/n.txt").write_text("t")
    scan = folders.scan_folder(spark, str(tmp_path / "bids"))
    got = {r.relative_path: (r.bid_id, r.detected_format, r.m) for r in scan.withColumn("m", folders.has_format_mismatch("detected_format", "content")).collect()}
    assert got == {"a.html": ("b1", "html", False), "sub/x.pdf": ("b1", "pdf", True), "n.txt": ("b1", "unknown", False)}
    assert folders.scan_folder(spark, str(tmp_path / "none")).count() == 0


# ---- retrieval

def make_records(spark, rows):
    return spark.createDataFrame([(i, b, "rfp", t, f, p, None, None, "current") for i, b, t, f, p in rows],
                                 "record_id string, bid_id string, doc_type string, text string, source_file string, page_number int, addendum_number int, document_date string, status string")


def queries(spark, *texts):
    return retrieval.make_queries(spark, [{"text": t, "query_id": i} for i, t in enumerate(texts)])


def test_rrf_anchor(spark):
    df = spark.createDataFrame([(1, "a", "keyword", 1), (1, "b", "keyword", 2), (1, "a", "keyword", 1)], "query_id long, record_id string, method string, rank int")
    got = retrieval.fuse(df).orderBy("rank").collect()
    assert len(got) == 2 and got[0].score == round(1 / 61, 9)


def test_identifier_never_matches_a_longer_one(spark):
    r = make_records(spark, [("r1", "b1", "Model ZX-2100 in stock", "f", 1)])
    q = queries(spark, "ZX-210")
    assert retrieval.keyword_candidates(r, q).count() == 0
    e = retrieval.envelopes(q, retrieval.keyword_candidates(r, q), spark.createDataFrame([(0, 1)], "query_id long, n long")).first()
    assert e.diagnostic == "no_supporting_evidence"
    e = retrieval.envelopes(q, retrieval.keyword_candidates(r.limit(0), q), spark.createDataFrame([(0, 0)], "query_id long, n long")).first()
    assert e.diagnostic == "no_filter_match"


def test_duplicates_do_not_crowd_out(spark):
    rows = [(f"r{i:02}", "b1", "laptop warranty text", "f", 1) for i in range(40)] + [("r99", "b1", "warranty of another laptop model", "f", 1), ("r98", "b2", "laptop warranty text", "f", 1)]
    got = retrieval.search(make_records(spark, rows), queries(spark, "laptop warranty"), "keyword-only", 5)
    assert {r.record_id for r in got.collect()} == {"r00", "r99", "r98"}


def test_copies_do_not_fill_the_candidates(spark):
    rows = [(f"r{i:03}", "b1", "laptop warranty", "f", 1) for i in range(120)]
    rows += [(f"s{i}", "b2", f"laptop warranty of the model that hall number {w} holds", "f", i) for i, w in enumerate(("one", "two", "three", "four", "five"))]
    rows += [(f"t{i:02}", "b3", f"laptop warranty of the long and careful text about all {i:02}", "f", 1) for i in range(3)]
    for how in ("keyword-only", "semantic-only", "hybrid"):
        got = {r.record_id for r in retrieval.search(make_records(spark, rows), queries(spark, "laptop warranty"), how, 7).collect()}
        assert got == {"r000", "t00", *(f"s{i}" for i in range(5))}


def test_fuzzy_duplicates(spark):
    base = "the laptop must have sixteen gigabytes of memory and a display"
    rows = [(1, "b", "f", 1, "r1", base, 1, "keyword"), (1, "b", "f", 1, "r2", base + " x", 2, "semantic"), (1, "b", "f", 2, "r3", base, 3, "keyword"), (1, "b", "f", 1, "r4", "all else", 4, "keyword")]
    df = spark.createDataFrame(rows, "query_id long, bid_id string, source_file string, page_number int, record_id string, text string, rank int, methods string")
    assert {r.record_id: r.methods for r in retrieval.dedup_fuzzy(df).collect()} == {"r1": "keyword,semantic", "r3": "keyword", "r4": "keyword"}


def test_model_that_fails_changes_nothing(spark):
    rows = [(1, "q", f"r{i}", f"text {i}", 1.0 - i / 10, i + 1) for i in range(4)]
    df = spark.createDataFrame(rows, "query_id long, query string, record_id string, text string, score double, rank int")
    for bad in (lambda p: [1.0], lambda p: [float("nan")] * len(p), lambda p: 1 / 0):
        assert [r.record_id for r in retrieval.model_rerank(df, bad).orderBy("rank").collect()] == ["r0", "r1", "r2", "r3"]
    good = retrieval.model_rerank(df, lambda p: [float(t[-1]) for _, t in p]).orderBy("rank").collect()
    assert [r.record_id for r in good] == ["r0", "r1", "r2", "r3"] and good[0].score == round(1 / (1 + 3 + 4), 6)
    assert [r.record_id for r in retrieval.model_rerank(df.where("rank <= 2"), lambda p: [0.0, 1.0]).orderBy("rank").collect()] == ["r1", "r0"]


def test_scorer_and_bad_requests(spark):
    r = make_records(spark, [("r1", "b1", "aaa", "f", 1), ("r2", "b1", "b", "f", 1)])
    got = retrieval.scored_candidates(r, queries(spark, "x"), lambda q, t: float("inf") if t == "b" else len(t))
    assert [(x.record_id, x.score) for x in got.collect()] == [("r1", 3.0)]
    for request in ({"text": " "}, {"text": "x", "top_k": 0}, {"text": "x", "mode": "other"}):
        with pytest.raises(ValueError):
            retrieval.make_queries(spark, [request])


def test_queries_in_blocks(spark):
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 9)], "query_id long, qvector array<double>")
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 9)], "record_id long, vector array<double>")
    whole = retrieval.vector_candidates(v, q, 2).collect()
    parts = retrieval.in_blocks(q, lambda some: retrieval.vector_candidates(v, some, 2), size=3).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and len(whole) == 16


# ---- corpus

def chunk_rows(spark, rows):
    return spark.createDataFrame([(c, b, f, t, "s", 1) for c, b, f, t in rows], "chunk_id string, bid_id string, source_file string, text string, section_title string, page_number int")


def test_index_lifecycle(spark, tmp_path):
    index = corpus.Index(spark, str(tmp_path / "idx"))
    first = corpus.index_records(chunk_rows(spark, [("c1", "b1", "a.html", "old text"), ("c2", "b2", "a.html", "other"), ("c3", "b1", "z.html", " ")]))
    assert index.update(first)["indexed"] == 2
    again = index.update(first)
    assert (again["indexed"], again["skipped"]) == (0, 2)
    changed = index.update(corpus.index_records(chunk_rows(spark, [("c1", "b1", "a.html", "new text")])))
    assert (changed["replaced"], changed["removed"]) == (1, 0)
    assert {r.text for r in index.records().collect()} == {"new text", "other"}
    index.rollback()
    assert {r.text for r in index.records().collect()} == {"old text", "other"}
    keep = index.records().where("bid_id = 'b1'").select("scope_id")
    kept = index.update(corpus.index_records(chunk_rows(spark, [("c9", "b1", "n.html", "fresh")])), preserve=keep)
    assert (kept["indexed"], kept["removed"]) == (1, 0) and index.records().count() == 3
    index.update(corpus.index_records(chunk_rows(spark, [("c7", "b3", "a.html", "only")])), full_rebuild=True)
    assert [r.text for r in index.records().collect()] == ["only"]


def test_vector_lifecycle(spark, tmp_path):
    store = corpus.VectorStore(spark, str(tmp_path / "vec"))
    make = lambda *t: corpus.index_records(chunk_rows(spark, [(f"c{i}", "b1", f"f{i}", x) for i, x in enumerate(t)]))
    p = corpus.HashEmbedding(8)
    assert store.update(make("a", "b", "c"), p)["embedded"] == 3
    assert store.update(make("a", "b", "c"), p)["unchanged"] == 3
    last = store.update(make("a", "B"), p)
    assert (last["embedded"], last["unchanged"], last["removed"]) == (1, 1, 2)
    assert corpus.readiness(store.load(), make("a", "B")).count() == 0
    assert {r.state for r in corpus.readiness(store.load(), make("a", "x")).collect()} == {"missing", "left_over"}
    failed = corpus.sync(store, make("a"), corpus.HashEmbedding(16))
    assert failed["status"] == "failed" and store.load().count() == 2
    v = {tuple(r.vector) for r in store.load().collect()}
    assert tuple(b / 255 for b in hashlib.sha256(b"a").digest()[:8]) in v


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    """Data written and manifest not yet renamed: readers see the version before, and the next writer goes on."""
    store = VersionedStore(spark, str(tmp_path / "s"), "a int, b string", key="b", lock_seconds=2, lease_seconds=0.5)
    rows = lambda *x: spark.createDataFrame([(i, str(i)) for i in x], "a int, b string")
    assert store.load().count() == 0 and store.current() is None
    store.commit(rows(1, 2, 3))
    other = VersionedStore(spark, str(tmp_path / "s"), "a int, b string", key="b", lock_seconds=2, lease_seconds=0.5)

    def killed(manifest):
        raise KeyboardInterrupt

    monkeypatch.setattr(other, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        other.commit(rows(9))
    assert sorted(r.a for r in store.load().collect()) == [1, 2, 3]
    (tmp_path / "s" / "_lock").touch()  # as a writer leaves it that was killed with its lock
    version = store.commit(rows(4))
    assert store.current() == version and [r.a for r in store.load().collect()] == [4]


def test_commits_share_unchanged_buckets(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"), "a int, b string", key="b")
    rows = spark.createDataFrame([(i, f"k{i}") for i in range(50)], "a int, b string")
    store.commit(rows)
    before = store.manifest()["buckets"]
    touched = store.buckets_of(rows.where("b = 'k7'"))
    store.commit(store.load(touched).where("b <> 'k7'").unionByName(spark.createDataFrame([(70, "k7")], "a int, b string")), touched)
    after = store.manifest()["buckets"]
    assert {b for b in after if after[b] != before[b]} == {str(b) for b in touched}
    assert sorted(r.a for r in store.load().collect()) == sorted([70, *(i for i in range(50) if i != 7)])


def test_failed_commit_and_lock(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"), "a int", lock_seconds=0.3)
    store.commit(spark.createDataFrame([(1,)], "a int"))
    bad = spark.createDataFrame([(1,)], "a int").select(F.assert_true(F.col("a") > 1).cast("int").alias("a"))
    with pytest.raises(Exception):
        store.commit(bad)
    assert [r.a for r in store.load().collect()] == [1]
    again = VersionedStore(spark, str(tmp_path / "s"), "a int", lock_seconds=0.3)
    with store.locked(), pytest.raises(TimeoutError):
        again.commit(spark.createDataFrame([(2,)], "a int"))
    export_json(spark.createDataFrame([("b", 1)], "bid_id string, a int"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().a == 1


def test_stream_ingests_new_files(spark, tmp_path):
    root = tmp_path / "bids"
    (root / "b1").mkdir(parents=True)
    (root / "b1/a.html").write_text("<body><h1>Head</h1><p>First words here</p></body>")
    index, seen = corpus.Index(spark, str(tmp_path / "idx")), []
    run = lambda: incremental.ingest(spark, str(root), index, str(tmp_path / "cp"), lambda n, c: seen.append(c)).awaitTermination()
    run()
    (root / "b1/b.html").write_text("<body><p>Second file</p></body>")
    (root / "b2").mkdir()
    (root / "b2/c.html").write_text("<body><p>Third</p></body>")
    run()
    assert {r.source_file: r.text for r in index.records().collect()} == {"a.html": "Head\nFirst words here", "b.html": "Second file", "c.html": "Third"}
    assert seen[0]["indexed"] == 1 and seen[-1]["indexed"] == 2 and seen[-1]["scopes"] == 2  # a batch compares its own files only


def test_windowed_counts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = incremental.windowed_counts(df)
    assert got.agg(F.sum("n")).first()[0] == df.count()


# ---- extraction, answers, evaluation, workflow

def test_field_values(spark):
    cases = [
        ("Due Date", "Responses due: 6/27/2024 14:00 CST", "2024-06-27 14:00 CST"), ("Due Date", "Bid due 27-JUN-2024 at 2:00 PM", "2024-06-27 14:00"), ("Due Date", "Deadline: June 27", "June 27"),
        ("Due Date", "no date", None), ("Pre Bid Meeting", "Pre-bid meeting: May 3, 2026 10:30 AM EST", "2026-05-03 10:30 EST"), ("Delivery Date", "Delivery within 10 days of delivery", "Within 10 days of delivery"),
        ("Installation", "Installation is not required", "false"), ("Installation", "Imaging services are required", "true"), ("Installation", "laptops", None),
        ("Bid Submission Type", "Send a sealed bid", "Sealed physical submission"), ("Bid Submission Type", "No email responses are accepted. hard copy", None), ("Bid Number", "RFP No. 12-A7", "12-A7"),
        ("Bid Number", "see JA-207652 here", "JA-207652"), ("Bid Number", "Bid number: none", None), ("Term of Bid", "Contract duration: 3 years", "3-year term"), ("Term of Bid", "Term of the contract: two years", "two years"),
        ("Payment Terms", "Invoice(s) shall be submitted within 30 days of delivery.", "Invoices must be submitted within 30 days of delivery"), ("Payment Terms", "Payment terms: Net 45; other", "Net 45"),
        ("Title", "Title: Desks and chairs\nmore", "Desks and chairs"), ("Title", "Request for Proposal 77. Network switches\nmore", "Network switches"), ("Bid Bond Requirement", "A bid bond of 5% applies", "5%"),
        ("MFG for Registration", "Manufacturer name: Acme", "Acme"), ("Contract or Cooperative to Use", "State contract: TX-9", "TX-9"),
    ]
    for field, text, want in cases:
        assert one(spark, extract.scalar(field, "t"), t=text) == want, (field, text)


def test_empty_evidence_gives_all_fields(spark):
    schema = "bid_id string, record_id string, source_file string, page_number int, doc_type string, content_kind string, addendum_number int, document_date string, authority_status string, text string"
    got = extract.extract(spark.createDataFrame([("b", "r", "f", 1, None, None, None, None, None, "")], schema)).collect()
    assert len(got) == 20 and {r.status for r in got} == {"not_found"}
    assert registry.terms(spark).where("list_kind = 'alias'").select("field_id").distinct().count() == 24


def test_recall_and_rank(spark):
    rows = [(["a"], ["a"], 1.0, 1.0), (["a"], ["b", "a"], 1.0, 0.5), (["a", "b"], ["a"], 0.5, 1.0), ([], [], 1.0, 1.0), ([], ["a"], 0.0, 0.0), (["z"], ["a"], 0.0, 0.0)]
    df = spark.createDataFrame(rows, "e array<string>, r array<string>, want double, rr double")
    for x in df.select("want", "rr", evaluation.recall_at_k("e", "r", 5).alias("got"), evaluation.reciprocal_rank("e", "r").alias("grr")).collect():
        assert (x.got, x.grr) == (x.want, x.rr)


def test_evaluation_case_hash_has_no_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, t string")
    assert evaluation.case_set_hash(a).first() == evaluation.case_set_hash(a.orderBy(F.desc("i"))).first()


def test_excerpts_merge(spark):
    text = "x" * 100 + "warranty" + "y" * 100 + "warranty" + "z" * 600 + "warranty"
    got = answers.excerpts(make_records(spark, [("r", "b", text, "f", 1)]), "warranty").orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(50, 476), (766, 824)]


def test_intents(spark):
    df = spark.createDataFrame([("Which addendum changed it?",), ("affidavit needed?",), ("Is there a warranty",), ("bid bond?",), ("who buys",)], "q string")
    assert [r.i for r in df.select(answers.intent("q").alias("i")).collect()] == ["addendum", "affidavit", "warranty", "bond", "field"]


def test_plan_filters_and_traces(spark):
    plan = workflow.build_plan("extraction", "submission deadline and warranty and flying cars", ["b1"])
    assert plan["groups"] == {"submission": ["submission_deadline"], "commercial": ["warranty"]} and plan["unsupported"] == ["flying cars"]
    assert len(workflow.build_plan("extraction", "all fields", ["b"])["fields"]) == 10
    with pytest.raises(ValueError):
        workflow.build_plan("other", "x", ["b"])
    with pytest.raises(ValueError):
        workflow.validate_filters({"color": 1})
    trace = workflow.Trace("r")
    with pytest.raises(ZeroDivisionError):
        trace.tool("divide", lambda: 1 / 0, password="p", note="token=abc")
    row = trace.rows(spark).first()
    assert row.status == "failed" and "abc" not in row.details and '"password"' not in row.details
    m = workflow.Message("r", "a", "b", "evidence", {"count": 1})
    assert m.check("r", "a", "b") is m
    with pytest.raises(ValueError):
        m.check("r", "a", "c")


def test_workflow_run(spark):
    schema = "bid_id string, record_id string, source_file string, page_number int, doc_type string, content_kind string, addendum_number int, document_date string, authority_status string, status string, text string"
    rows = [("b1", "r1", "a.html", 1, "rfp", "text", None, "", "current", "current", "Title: Desks\nDue date: June 27, 2024 2:00 PM CST\nPayment terms: Net 30"),
            ("b1", "r2", "Addendum 2.pdf", 1, "addendum", "text", 2, "2024-06-01", "current", "current", "New due date: July 9, 2024 2:00 PM CST. Deadline extended.")]
    df = spark.createDataFrame(rows, schema)
    out = workflow.run(df, "extraction", "all fields", ["b1"])
    values = {r.field: r.value for r in out["fields"].where("status = 'supported'").collect()}
    assert values["Due Date"] == "2024-07-09 14:00 CST" and values["Payment Terms"] == "Net 30"
    assert out["summary"].count() == 1 and out["validation"].first().passed == len(values)
    answer = workflow.run(df, "qa", "When is the due date?", ["b1"])["answer"].first()
    assert "due date" in answer.answer.lower()


def test_jobs():
    jobs = workflow.Jobs(workers=1, limit=2)
    a, b = jobs.submit(lambda: 5), jobs.submit(lambda: 1 / 0)
    with pytest.raises(workflow.JobCapacityError):
        jobs.submit(lambda: 1)
    jobs.shutdown()
    assert jobs.get(a)["result"] == 5 and jobs.get(b)["status"] == "failed"


def test_session_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


ITEMS = [
    ("Any Additional Documentation Required", "Required documents: W-9, bid form and license", ["W-9", "bid form", "license"]),
    ("Any Additional Documentation Required", "Vendors must provide Mercury Affidavit and pertinent literature/documentation. Also a Form 1295. A warranty certificate or affidavit is due.",
     ["Mercury Affidavit", "pertinent literature/documentation", "Form 1295", "warranty certificate or affidavit"]),
    ("Any Additional Documentation Required", "The required documents are replaced by: Form A, Form B.", ["Form A", "Form B"]),
    ("Any Additional Documentation Required", "Remove Bond and W-9 from the required documents", ["Bond", "W-9"]),
    ("Any Additional Documentation Required", "The site map is no longer required.", ["The site map"]),
    ("contact_info", "Buyer DOE, JANE Email Jane.Doe@City.GOV", ["Jane Doe; jane.doe@city.gov"]),
    ("contact_info", "Agency POC Name: Al Smith Agency POC Phone Number: (410) 555-0100 Agency POC Email Address: al@state. md.us", ["Al Smith; (410) 555-0100; al@state.md.us"]),
    ("Product Specification", "Intro\n• Intel processor, 8 cores;\n- 16 GB DDR5\n16 gb ddr5\nNothing", ["Intel processor, 8 cores", "16 GB DDR5"]),
    ("Product Specification", "All laptops must be Microsoft Copilot ready.", ["Microsoft Copilot ready"]),
    ("Product", "many items including laptops, desktops and tablets.\nend", ["laptops", "desktops", "tablets"]),
    ("Part_no", "SKU: 210-BLYZ 619-AQMP Description 999-X", ["210-BLYZ", "619-AQMP"]),
    ("Part_no", "Part number: A1, B2", ["A1", "B2"]),
    ("Model_no", "SI# 1234 Dell\nModel #: Latitude 5450.", ["SI# 1234", "Latitude 5450"]),
    ("company_name", "The Dallas Independent School District is soliciting", ["Dallas Independent School District"]),
]


@pytest.mark.parametrize("field, text, want", ITEMS)
def test_collection_forms(spark, field, text, want):
    assert one(spark, F.transform(extract.collection(field, "t"), lambda i: i["value"]), t=text) == want


def test_product_attributes(spark):
    text = "Product: Laptop A\nQuantity: 25\nModel: M-100.\nProduct: SI# 77 Dock B\nPart number: P-9"
    got = [tuple(i) for i in one(spark, extract.collection("Product", "t"), t=text)]
    assert got == [("Laptop A", 25, "M-100", None, None), ("Dock B", None, "SI# 77", "P-9", None)]


UPDATED = [
    ("Due Date", "The new due date is July 9", True), ("Due Date", "renewed due date", False), ("Due Date", "Submission  deadline", True), ("Payment Terms", "payment terms - Net 30", True),
    ("Payment Terms", "payment terms are", False), ("Installation", "Installation of racks is no longer required", True), ("Installation", "installation\nis revised", False),
    ("Bid Number", "the revised RFP number is", True), ("Bid Number", "revised bid numbers", False), ("Pre Bid Meeting", "pre-bid meetings are rescheduled", True), ("Pre Bid Meeting", "pre proposal conference: new room", True),
    ("Term of Bid", "The renewal option was extended", True), ("Term of Bid", "prerenewal extended", False), ("Title", "changed solicitation title", True), ("Bid Submission Type", "submission instructions have been updated", True),
]


@pytest.mark.parametrize("field, text, want", UPDATED)
def test_update_wording(spark, field, text, want):
    assert one(spark, extract.is_update(field, "t"), t=text) is want


def test_titles_and_numbers(spark):
    for field, text, want in [
        ("Title", "Solicitation Number: 5 Title Laptops for all Source ID 9", "Laptops for all"), ("Title", "Request for Proposal 123 . JA-207652 Student and Staff Devices\nmore", "Student and Staff Devices"),
        ("Title", "JA-207652 Student Devices **SOURCING x", "Student Devices"), ("Bid Submission Type", "Use eMMA to submit", "eMMA e-Procurement system"),
        ("Bid Submission Type", "iSupplier or a sealed envelope", "iSupplier electronic portal or sealed manual submission"), ("Model_no", "Model number: Latitude-5450 x", "Latitude-5450"),
    ]:
        assert one(spark, extract.scalar(field, "t"), t=text) == want, (field, text)


def test_due_dates_and_scope(spark):
    schema = "bid_id string, record_id string, source_file string, page_number int, section_title string, doc_type string, content_kind string, addendum_number int, document_date string, authority_status string, text string"
    rows = [
        ("b", "r1", "a.html", 1, "Dates", "bid_page", "text", None, None, None, "Open Date 5/1/2026 Close 6/9/2026"),
        ("b", "r2", "b.pdf", 1, None, "rfp", "text", None, None, None, "Due date: June 27, 2026"),
        ("b", "r3", "c.pdf", 1, None, "rfp", "text", None, None, None, "Submission deadline: June 27, 2026 2:00 PM CST"),
        ("b", "r4", "c.pdf", 2, None, "rfp", "text", None, None, None, "Bid number: 55\nInitial term: 1. Renewal 1: 1"),
        ("b", "r5", "d.pdf", 1, None, "rfp", "text", None, None, None, "PORFP Number: F50-77"),
        ("p", "r6", "a.html", 1, "Dates", "bid_page", "text", None, None, None, "Open Date 5/1/2026 Close 6/9/2026"),
        (None, "r7", "z.html", 1, None, "rfp", "text", None, None, None, "Due date: March 3, 2026"),
    ]
    bids = spark.createDataFrame([("b",), ("p",), ("q",)], "bid_id string")
    got = {(r.bid_id, r.field): r for r in extract.extract(spark.createDataFrame(rows, schema), bids).where("status = 'supported'").collect()}
    due = got["b", "Due Date"]
    assert due.value == "2026-06-27 14:00 CST" and [c.record_id for c in due.citations] == ["r2", "r3"]
    assert got["p", "Due Date"].value == "2026-06-09" and got["q", "Due Date"].value == "2026-03-03" and got["b", "Bid Number"].value == "F50-77"


def test_agent_rules(spark):
    for key, text, goal, want in [
        ("mandatory_requirements", "Vendors must insure. Laptops must have 16 GB memory. Ok.", "memory of laptops", "Laptops must have 16 GB memory."), ("mandatory_requirements", "You must a. You must b.", "", None),
        ("model_number", "SI# 12-A Dell Latitude 5450 here", "", "Dell Latitude 5450"), ("solicitation_number", "RFP JA-207652 due", "", "JA-207652"), ("bid_bond", "bid bond of 5 % of total", "", "5 %"),
    ]:
        assert one(spark, extract.agent_value(key, "t", goal), t=text) == want, (key, text)


# ---- composed answers, workflow parts, service

EVID = "query_id long, query string, bid_id string, record_id string, source_file string, page_number int, doc_type string, authority_status string, rank int, text string"


def test_composed_answers(spark):
    ask = {1: "Which affidavit is needed?", 2: "warranty of laptops", 3: "Is a bid bond required?", 4: "What is the submission deadline?", 5: "What changed in the addendum?", 6: "Tell me a story", 7: "bid security please"}
    rows = [
        (1, "b1", "r1", "affidavit", None, 1, "I affirm under penalty"), (1, "b1", "r2", "rfp", None, 2, "Bidders must submit a signed affidavit with the bid."), (1, "b1", "r3", "rfp", None, 3, "Bidders must submit a signed AFFIDAVIT with the bid!"),
        (2, "b1", "r4", "rfp", None, 1, "The warranty is three years. " + "x " * 200 + "Warranties cover parts."), (2, "b2", "r5", "rfp", None, 2, "No mention"),
        (3, "b1", "r6", "rfp", None, 1, "A bid bond of 5% is required."), (3, "b2", "r7", "rfp", None, 2, "A bid bond is not required."), (3, "b1", "r8", "rfp", None, 3, "No bond is needed."),
        (4, "b1", "r9", "rfp", "current", 1, "Submission deadline: June 27, 2026"), (4, "b1", "r10", "rfp", "superseded", 2, "Submission deadline: May 1, 2026"), (4, "b2", "r11", "rfp", "current", 3, "Deadline: June 1, 2026"),
        (4, "b2", "r12", "rfp", "current", 4, "Deadline: June 2, 2026"),
        (5, "b1", "r13", "addendum", None, 1, "The payment term is revised from Net 30 to Net 45."), (6, "b1", "r14", "rfp", None, 1, "once"), (7, "b1", "r15", "rfp", None, 1, "Bond forms are found elsewhere in the package."),
    ]
    evidence = spark.createDataFrame([(q, ask[q], b, r, "f.pdf", 1, d, a, n, t) for q, b, r, d, a, n, t in rows], EVID)
    got = {r.query_id: r for r in qa.compose(spark.createDataFrame(list(ask.items()), "query_id long, query string"), evidence).collect()}
    assert got[1].n_claims == 2 and got[1].found and "I affirm under penalty" in got[1].answer and "Bidders must submit" in got[1].answer
    assert got[2].n_claims == 1 and got[2].answer.startswith("b1 warranty requirements: The warranty is three years.") and "cover parts" in got[2].answer and len(got[2].citations) == 1
    assert got[3].answer == "b1: the cited source explicitly requires a bond. The stated amount is 5%. b2: the cited source explicitly states that a bond is not required."
    assert got[4].disputed and not got[4].found and got[4].answer == "Conflicting submission deadline evidence for b2; review cited sources." and "June 27, 2026" in str(qa.claims(evidence).where("query_id = 4").collect())
    assert "Net 30 to Net 45" in got[5].answer and not got[6].found and got[6].answer == "Not found in documents" and got[6].n_claims == 0
    assert not got[7].found and "elsewhere" in got[7].answer


def test_groups_wait_for_what_they_need():
    done = []
    groups = {"c": ["x"], "a": ["y"], "b": ["z"], "d": ["w"]}

    def work(group, keys):
        if group == "b":
            raise ValueError("no")
        done.append(group)
        return keys

    results, errors = workflow.run_groups(groups, work, {"c": ("a",), "d": ("b",)})
    assert results == {"a": ["y"], "c": ["x"]} and done.index("a") < done.index("c") and set(errors) == {"b", "d"}
    assert set(workflow.run_groups({"a": [], "b": []}, work, {"a": ("b",), "b": ("a",)})[1]) == {"a", "b"}


def test_field_validation(spark):
    fields = [("b", "submission_deadline", "2026-06-27", "r1", "supported"), ("b", "bid_bond", "5%", "r1", "supported"), ("b", "mandatory_requirements", "No bond required here", "r1", "supported"),
              ("b", "warranty", None, None, "not_found"), ("b", "insurance", "two million", "r1", "supported"), ("b", "model_number", None, None, "review_required"), ("b", "solicitation_number", "soon", "r1", "supported")]
    evidence = spark.createDataFrame([("r1", "Deadline June 27, 2026. Bid bond 5%. No bond required here. Soon.")], "record_id string, text string")
    got = {r.field: r for r in workflow.validate(spark.createDataFrame(fields, "bid_id string, field string, value string, record_id string, status string"), evidence).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"submission_deadline": "passed", "bid_bond": "rejected", "mandatory_requirements": "passed", "warranty": "passed", "insurance": "rejected",
                                                      "model_number": "review_required", "solicitation_number": "passed"}
    assert "conflicts" in got["bid_bond"].reason and got["insurance"].retry and not got["warranty"].retry


def test_messages():
    ok = workflow.Message("r", "a", "b", "plan", {"mode": "qa", "groups": {}, "bid_ids": []})
    assert ok.check("r", "a", "b") is ok and ok.rejected("no").check("r", "b", "a").payload == {"reason": "no"}
    for bad in (workflow.Message("r", "a", "b", "plan", {}), workflow.Message("r", "a", "b", "other", {"x": 1})):
        with pytest.raises(ValueError):
            bad.check("r", "a", "b")


class Proposing:
    def extract_fields(self, evidence, names):
        if "bid_bond" in names:
            raise RuntimeError("model down")
        return {"submission_method": "online portal", "solicitation_number": "made up", "other": "x"}

    def generate_report(self, question, claims, fallback):
        return "worded: " + fallback


def _scope(spark):
    schema = "bid_id string, record_id string, source_file string, page_number int, doc_type string, content_kind string, addendum_number int, document_date string, authority_status string, status string, text string"
    rows = [("b1", "r1", "a.html", 1, "rfp", "text", None, "", "current", "current", "Title: Desks\nSolicitation number: RFP-778\nDue date: June 27, 2024\nSubmission method: use the online portal to submit"),
            ("b1", "r2", "b.html", 1, "rfp", "text", None, "", "current", "current", "Warranty: three years on all desks.")]
    return spark.createDataFrame(rows, schema)


def test_provider_and_failures(spark):
    records = _scope(spark)
    out = workflow.run(records, "extraction", "all fields", ["b1"], provider=Proposing())
    agent = {r.field: r for r in out["agent"].collect()}
    assert agent["submission_method"].value == "online portal" and agent["solicitation_number"].value == "RFP-778" and agent["bid_bond"].verdict == "review_required"
    assert out["status"] == "review_required" and [d["code"] for d in out["diagnostics"]] == ["extraction_group_failed"]
    shown = workflow.extraction_response(out)
    assert {f["field"]: f["value"] for f in shown["fields"]}["Title"] == "Desks" and shown["evaluation"]["dispositions"]["supported"] >= 3
    said = workflow.qa_response(workflow.run(records, "qa", "What is the solicitation number?", ["b1"], provider=Proposing()))
    assert said["found"] and said["answer"].startswith("worded: b1: solicitation number is RFP-778") and said["citations"][0]["record_id"] == "r1"
    failed = workflow.run(records, "other", "x", ["b1"])
    assert failed["status"] == "failed" and failed["diagnostics"][0]["code"] == "node_failed" and "planner" in failed["diagnostics"][0]["message"]


def test_service_and_index_check(spark, tmp_path):
    config = Config.from_env({"DOSSIERLAKE_TOP_K": "3"}, index=str(tmp_path / "i"), vectors=str(tmp_path / "v"))
    assert config.top_k == 3
    with pytest.raises(ValueError):
        Config(max_retries=9)
    site = service.Service(spark, config)
    assert site.status() == {"ready": False, "current": True, "vectors_ready": False}
    rows = corpus.index_records(_scope(spark).withColumnRenamed("record_id", "chunk_id").drop("status").withColumn("section_title", F.lit(None).cast("string")))
    assert workflow.ensure_index(site.index, ["b1", "zz"], lambda missing: rows) == {"ready": ["b1"], "missing": ["zz"]}
    assert site.status()["current"] is False
    site.refresh()
    request = service.Request("qa", ("b1",), "What is the solicitation number?")
    assert site.run(request)["found"]
    found = site.search([{"text": "warranty desks", "filters": {"bid_id": "b1"}, "top_k": None}, {"text": "portal", "top_k": 1}])
    assert {r.query_id for r in found.collect()} == {0, 1} and retrieval.invalid_results(found).count() == 0
    assert {r.field for r in site.views(service.Request("extraction", ("b1",))).collect()} >= {"Title", "warranty"}
    for bad in (("other", ("b",), "x", {}), ("qa", (), "x", {}), ("qa", ("b",), " ", {}), ("qa", ("b",), "x", {"color": 1})):
        with pytest.raises(ValueError):
            service.Request(*bad)


def test_observers(spark):
    vectors = evaluation.ObservedVectors(lambda q: q.selectExpr("no_such_column"))
    assert vectors(spark.range(1)) is None and vectors.diagnostics and evaluation.configuration_status("hybrid", vectors) == "lexical-fallback"
    assert evaluation.configuration_status("keyword-only", vectors) == "available"
    model = evaluation.ObservedReranker(lambda pairs: [float("nan")] * len(pairs))
    model([("a", "b")])
    assert model.calls == 1 and "invalid" in model.diagnostic
    df = spark.createDataFrame([(1, 0.5), (1, None), (2, 0.1)], "query_id long, score double")
    assert {r.query_id: r.valid for r in evaluation.valid_scores(df).collect()} == {1: False, 2: True}


def test_result_contract(spark):
    schema = "query_id long, record_id string, bid_id string, source_file string, page_number int, text string, rank int, score double, authority_status string, superseded_by string"
    rows = [(1, "a", "b", "f", 1, "t", 1, 0.5, "current", None), (2, "", "b", "f", 0, " ", 0, float("nan"), "odd", None), (3, "c", "b", "f", None, "t", 2, 0.1, "superseded", None)]
    got = {}
    for r in retrieval.invalid_results(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.query_id, set()).add(r.problem)
    assert got == {2: {"no_citation", "no_text", "rank", "score", "page", "authority"}, 3: {"superseded_by"}}


def test_unlimited_search_and_stored_postings(spark):
    rows = [(f"r{i}", "b", "rfp", f"s{i}.html", 1, f"desk number {i} of oak {'and pine' if i % 2 else ''}") for i in range(70)]
    df = spark.createDataFrame(rows, "record_id string, bid_id string, doc_type string, source_file string, page_number int, text string").withColumns(
        {"addendum_number": F.lit(None).cast("int"), "document_date": F.lit(None).cast("string"), "status": F.lit("current")})
    q = spark.createDataFrame([(1, "oak desk pine")], "query_id long, query string")
    every = retrieval.search(df, q, top_k=None)
    assert every.count() == 70
    index = retrieval.Postings.of(df).stored()
    plain = [tuple(r) for r in retrieval.search(df, q, top_k=9).select("record_id", "score", "rank").orderBy("rank").collect()]
    assert plain == [tuple(r) for r in retrieval.search(df, q, top_k=9, index=index).select("record_id", "score", "rank").orderBy("rank").collect()]


def test_pieces_bound_the_ratio():
    """No pair that reaches the ratio is left out before it is compared."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(5, 150))) for _ in range(30)]
    hits = 0
    for a in base:
        for _ in range(20):
            b = list(a)
            for _ in range(rng.randint(0, max(1, len(a) // 6))):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randint(0, 1)] = rng.choice("abcxyz")
            b = "".join(b)
            if SequenceMatcher(None, a, b).ratio() >= 0.9:
                hits += 1
                assert retrieval._may_be_similar(retrieval._pieces(a), retrieval._pieces(b), len(a) + len(b), 0.9)
    assert hits > 100


def test_sql_functions(spark):
    from dossierlake.functions.register import register

    assert register(spark) == ["parse_html", "parse_tables", "chunk_words"]
    rows = spark.sql("SELECT kind, text FROM parse_html('<h1>Head</h1><p>One</p><table><tr><td>x</td></tr></table>') ORDER BY ordinal").collect()
    assert [tuple(r) for r in rows] == [("heading", "Head"), ("paragraph", "One"), ("table", "x")]
    assert spark.sql("SELECT cells FROM parse_tables('<table><tr><td>x</td><td>y</td></tr></table>')").first().cells == [["x", "y"]]
    assert [tuple(x) for x in spark.sql("SELECT chunk_words('a b c') AS c").first().c] == [(0, 3)]


def brute_ranges(text, target, largest, overlap):
    words = [m.span() for m in re.finditer(r"\S+", text)]
    n = len(words)
    para = [i for i in range(1, n) if "\n" in text[words[i - 1][1] : words[i][0]]]
    sent = [i for i in range(1, n) if re.search(r"[.!?][\"')\]]*$", text[slice(*words[i - 1])])]
    out, at = [], 0
    while at < n:
        end = n
        if n - at > largest:
            near = [max(c) for c in ([x for x in b if at + overlap < x <= at + target] for b in (para, sent)) if c]
            later = [x for x in para + sent if at + target < x <= at + largest]
            end = near[0] if near else min(later, default=at + largest)
        out.append((at, end))
        if end == n:
            break
        at = max(at + 1, end - overlap)
    return out


def test_word_ranges_equal_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "word ", "end. ", "line\n", "so! "]) for _ in range(rng.randint(0, 120)))
        assert ingest.word_ranges(text, 12, 16, 3) == brute_ranges(text, 12, 16, 3)


def test_readers_of_json_files(spark, tmp_path):
    import json

    report = {"chunks": [{"chunk_id": "c1", "bid_id": "b1", "text": "one", "page_number": 2, "diagnostic_ids": ["d"]}, {"chunk_id": "c2", "text": None}], "other": 1}
    (tmp_path / "report.json").write_text(json.dumps(report, indent=2))
    rows = {r.chunk_id: r for r in folders.read_report_chunks(spark, str(tmp_path / "report.json")).collect()}
    assert rows["c1"].text == "one" and rows["c1"].page_number == 2 and rows["c1"].diagnostic_ids == ["d"] and rows["c2"].text is None
    (tmp_path / "cases.json").write_text(json.dumps([{"case_id": "1", "query": "q", "expected_passages": [{"record_id": "r", "excerpt": "x"}]}]))
    case = folders.read_cases(spark, str(tmp_path / "cases.json")).first()
    assert case.case_id == "1" and case.expected_passages[0].excerpt == "x" and case.category is None
    (tmp_path / "bad.json").write_text(json.dumps([{"bid_id": "b", "n": "many"}]))
    with pytest.raises(Exception):
        folders.read_records(spark, str(tmp_path / "bad.json"), "bid_id string, n int").collect()


def test_folders_that_a_request_may_name():
    assert workflow.authorize_folders(["b1"], ["/bids/b1/"], "/bids/") == ["/bids/b1/"]
    for bad in ("/bids/b2", "/bids/x/b1", "/other/b1", "/bids/..", "/bids"):
        with pytest.raises(ValueError):
            workflow.authorize_folders(["b1"], [bad], "/bids")

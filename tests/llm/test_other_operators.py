"""Brute-force comparisons and edge cases of the operators on embeddings, pages and conversations, and of the pipeline."""
import hashlib
import html as entities
import itertools
import math
import re

import numpy as np
import pytest
from oracle import compare, connect

import corpus_pipeline
from dossierlake.llm import chat, common, htmltext, linededup, nndescent, queries, simhash, urlfilter

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    assert compare(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF) is None


# ---- components

@pytest.mark.parametrize("small", (0, 10**6))
def test_components_of_long_chains_and_stars(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL_GRAPH", small)
    rng = np.random.default_rng(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 640)]
    edges = chain + star + [(7, 7), (None, 3), (9, 3), (3, 9), (3, 9)]
    edges = [edges[i] for i in rng.permutation(len(edges))]
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 640)} | {3: 3, 9: 3}
    assert got == want
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- embeddings

def brute_links(vectors, threshold=nndescent.THRESHOLD):
    """vectors: [(id, embedding, label)] to {id: (links, component)} for distinct ids."""
    ok = [i for i, (v, e, l) in enumerate(vectors) if v is not None and e is not None and l is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    n = len(vectors)
    links, parent = np.zeros(n, int), list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unit = {i: np.array(vectors[i][1], float) / np.linalg.norm(np.array(vectors[i][1], float)) for i in ok}
    for a in ok:
        for b in ok:
            if a < b and vectors[a][2] == vectors[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y, key=lambda i: vectors[i][0])] = min(x, y, key=lambda i: vectors[i][0])
    return {vectors[i][0]: (int(links[i]), vectors[find(i)][0]) for i in range(n)}


def planted(seed, n=600, dim=32):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    out = [(i, base[i].tolist(), int(i % 3)) for i in range(n)]
    at = n
    for i in range(0, 60):  # pairs and small groups
        for _ in range(1 + i % 3):
            out.append((at, (base[i] + 0.05 * rng.standard_normal(dim)).tolist(), int(i % 3)))
            at += 1
    for _ in range(80):  # a group that fills every list
        out.append((at, (base[0] + 0.04 * rng.standard_normal(dim)).tolist(), 0))
        at += 1
    for _ in range(40):  # exact copies
        out.append((at, base[1].tolist(), 1))
        at += 1
    return out


def test_links_equal_brute_force(spark):
    vectors = planted(4)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    exact = [(v, [float(np.float32(x)) for x in e], l) for v, e, l in vectors]
    want = brute_links(exact)
    got = {r.vec_id: (r.n_links, r.component_id) for r in nndescent.near_duplicates(df).collect()}
    assert set(got) == set(want)
    true, found = sum(n for n, _ in want.values()), sum(min(got[v][0], n) for v, (n, _) in want.items())
    assert found / true >= 0.97 and all(got[v][0] <= n for v, (n, _) in want.items())


def test_blocks_of_a_dense_group(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "LEAST_BLOCK", 16)
    monkeypatch.setattr(nndescent, "TILE", (5, 7))
    rng = np.random.default_rng(8)
    e = rng.standard_normal((90, 8)) * 0.12 + 1
    df = spark.createDataFrame([(i, x.tolist(), 5) for i, x in enumerate(e)], "vec_id long, embedding array<double>, label int")
    want = brute_links([(i, x.tolist(), 5) for i, x in enumerate(e)])
    got = {r.vec_id: (r.n_links, r.component_id) for r in nndescent.near_duplicates(df).collect()}
    assert got == want and max(n for n, _ in want.values()) > nndescent.NEIGHBOURS


def test_a_dense_group_does_not_hide_lost_links(spark, monkeypatch):
    """Short orders and one round lose links of ordinary pairs, which a dense group outweighs in links."""
    for name, value in (("ORDERS", 1), ("AHEAD", 1), ("ROUNDS", 1), ("DOUBLINGS", 0), ("LEAST_BLOCK", 32)):
        monkeypatch.setattr(nndescent, name, value)
    vectors = [(v, [float(np.float32(x)) for x in e], l) for v, e, l in planted(9)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in nndescent.near_duplicates(df).collect()}
    assert got == brute_links(vectors)


def test_lists_are_doubled_until_the_audit_holds(spark, monkeypatch):
    """Lists of one entry miss most of what 32 vectors have; one doubling, then another, bring it."""
    monkeypatch.setattr(nndescent, "ROUNDS", 2)
    asked = []
    first = nndescent.first_lists
    monkeypatch.setattr(nndescent, "first_lists", lambda held, k, at=0: asked.append(k) or first(held, k, at))
    vectors = [(v, [float(np.float32(x)) for x in e], l) for v, e, l in planted(11)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    out = nndescent.near_duplicates(df, neighbours=1).collect()
    want = brute_links(vectors)
    true, found = sum(n for n, _ in want.values()), sum(r.n_links for r in out)
    assert asked[:2] == [1, 2] and out[0].recall >= nndescent.RECALL and found / true >= 0.95 and all(r.n_links <= want[r.vec_id][0] for r in out)


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [1.0, 0.0], 2),
            (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (None, [1.0, 0.0], 1), (12, [1e-30, 0.0], 1), (13, [-1.0, 0.0], 1)]
    df = spark.createDataFrame([(*d, None, None) for d in data], "vec_id long, embedding array<double>, label int, n long, pid long")
    got = {r.vec_id: r for r in nndescent.near_duplicates(df).collect()}
    assert len(got) == len(data)
    assert {v: got[v].n_links for v in got} == {**{v: 0 for v in got}, 7: 2, 8: 2, 12: 2}
    assert got[8].component_id == got[12].component_id == 7 and not got[8].kept and got[7].kept and got[2].component_id == 2
    assert nndescent.near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links) for r in nndescent.near_duplicates(twice).collect()) == [(1, 1), (1, 1), (2, 0)]


# ---- HTML

def article(page):
    """The article of a generated page, by its marks."""
    inner = page.split("<article>")[1].split("</article>")[0]
    parts = [" ".join(entities.unescape(re.sub("<[^>]*>?", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)]
    return " ".join(x for x in parts if x)


def test_articles_of_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.main_text(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id] == article(r.html)


SITE = """<html><head><title>t</title><script>var a="</p>";</script></head><body><div>Shop home cart search all departments today %s</div>
<div class="cookie-notice">We use cookies</div><header><a href="/">Logo</a></header><p>Story number %d begins &amp; goes on with words {w}</p>
<aside>Side</aside><form>Send <input name="q"></form><section id="comments"><article class="comment">First!</article></section>
<div>Shop home cart search all departments today</div><footer>Foot</footer></body></html>"""


def test_boilerplate_by_suffix_array(spark):
    pages = [(i, f"http://shop.example/{i}", (SITE % ("offers", i)).replace("{w}", " ".join(f"w{i}x{j}" for j in range(30)))) for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for r in htmltext.main_text(df).collect():
        # what every page says goes, also the first and last words of the story; the unique run stays
        assert r.text == f"{r.page_id} " + " ".join(f"w{r.page_id}x{j}" for j in range(30))


def test_boilerplate_of_a_section_of_a_large_host(spark, monkeypatch):
    """A text on four of 200 pages goes, whether the host is one array or fifty."""
    unique = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    page = lambda i: f"<body><div>{unique(i)}</div>" + ("<div>Read more stories of the garden section each week</div>" if i % 50 == 0 else "") + "</body>"
    copies = "<body><div>These words stand on copies of one page only here</div></body>"
    rows = [(i, f"http://news.example/{i}", page(i)) for i in range(200)] + [(i, f"http://news.example/{i}", copies) for i in range(200, 220)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: unique(i) for i in range(200)} | {i: "These words stand on copies of one page only here" for i in range(200, 220)}
    for size in (256, 4):
        monkeypatch.setattr(htmltext, "SHARD", size)
        assert {r.page_id: r.text for r in htmltext.main_text(df).collect()} == want


def brute_boilerplate(pages):
    """pages: {id: list of blocks}. Words within a run of MIN_RUN that MIN_PAGES different pages hold go."""
    runs = {}
    for blocks in pages.values():
        w = " ".join(blocks).split(" ")
        for i in range(len(w) - htmltext.MIN_RUN + 1):
            runs.setdefault(tuple(w[i : i + htmltext.MIN_RUN]), set()).add(tuple(blocks))
    out = {}
    for p, blocks in pages.items():
        w = " ".join(blocks).split(" ")
        gone = {i + k for i in range(len(w) - htmltext.MIN_RUN + 1) if len(runs[tuple(w[i : i + htmltext.MIN_RUN])]) >= htmltext.MIN_PAGES for k in range(htmltext.MIN_RUN)}
        out[p] = " ".join(x for i, x in enumerate(w) if i not in gone) if len(w) - len(gone) >= 0.1 * len(w) else " ".join(w)
    return out


@pytest.mark.parametrize("n", (200, 3000))
def test_pages_without_article_equal_brute_force(spark, n):
    """The same boilerplate on the same pages goes, however many other pages the host has. Runs are short and
    long, stand on two, three or many pages, within and across blocks."""
    rng = np.random.default_rng(12)
    phrases = [" ".join(f"p{k}x{j}" for j in range(length)) for k, length in enumerate((5, 6, 7, 9, 14, 40, 120))]
    pages = {}
    for i in range(n):
        blocks = [" ".join(f"w{i}x{j}" for j in range(30))]
        if i < 200:
            for k in rng.choice(len(phrases), rng.integers(0, 4), replace=False):
                blocks.insert(int(rng.integers(0, len(blocks) + 1)), phrases[k] if i % 3 else phrases[k].replace("x3", f"x3u{i % 6}"))
        if i in (10, 20, 30, 190):
            blocks += ["this section only", "stands on four pages of all"]
        if i in (40, 50):
            blocks += ["this sentence stands on two pages and no more"]
        pages[i] = blocks
    rows = [(i, f"http://plain.example/{i}", "<body>" + "".join(f"<div>{b}</div>" for b in blocks) + "</body>") for i, blocks in pages.items()]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = brute_boilerplate(pages)
    assert got == want and "four" not in got[10] and "two pages" in got[40]


def test_suffix_array_order():
    rng = np.random.default_rng(1)
    tokens, page = rng.integers(0, 4, 300), np.repeat(np.arange(6), 50)
    order, rank, whole = htmltext.repeated(tokens, page, 5)
    keys = [tuple(tokens[i : i + 5]) for i in range(300)]
    assert [keys[i] for i in order] == sorted(keys)
    inside = np.flatnonzero(whole)
    assert all((rank[i] == rank[j]) == (keys[i] == keys[j]) for i in inside[:80] for j in inside[:80])
    assert all(page[i] == page[i + 4] for i in inside)


def test_html_edges(spark):
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    data = [(1, None, None), (2, "", ""), (3, "no scheme", "<article>a<b>b</b>c &lt;x&gt; &#233;&nbsp;d</article"), (4, "http://h/", "plain text"), (4, "http://h/", "plain text"), (5, "http://h/x", long),
            (None, "http://h/y", "<p>open<div class=ad>ad</div><p>after<!-- c -->"), (6, "http://h/z", "<nav>only</nav>"), (7, "http://h/w", "<article>a<p>b <script>x")]
    df = spark.createDataFrame([(*d, None) for d in data], "page_id long, url string, html string, host string")
    got = {}
    for r in htmltext.main_text(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[1] == [""] and got[2] == [""] and got[3] == ["abc <x> é d"] and got[4] == ["plain text"] * 2
    assert got[5][0] == " ".join(["word"] * 20_000) and got[None] == ["open after"] and got[6] == [""] and got[7] == ["a b"]
    assert htmltext.main_text(df.limit(0)).count() == 0


# ---- chat

TURNS = [
    (1, 0, "user", "a & b < c | d <|end|>\n"), (1, 1, "user", "<|and|>"), (1, 2, "assistant", "&lt;|turn:&amp;"), (1, 3, "assistant", ""), (1, 4, "assistant", "\U0001f600é"),
    (2, 1, "assistant", "later"), (2, 0, None, None), (2, 0, None, None), (3, None, "weird|>role", "x" * 50_000), (None, 0, "user", "n"), (4, 0, "assistant", None), (5, 0, "assistant", "\n"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, None) for t in TURNS], "conv_id long, turn long, role string, text string, turns string")
    out = rows(chat.read_back(chat.format_conversations(df)))
    want = {}
    for c, t, r, x in sorted(TURNS, key=lambda t: (t[0] is None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out} == want
    for r in out:
        assert r["loss_text"] == "".join(x for role, x in want[r["conv_id"]] if role == "assistant")
        assert r["formatted"].count("<|turn:") == sum(1 for i, (role, _) in enumerate(want[r["conv_id"]]) if not i or want[r["conv_id"]][i - 1][0] != role)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_probe(spark):
    got = {r["conv_id"]: r for r in rows(chat.query(spark, SF))}
    x = "</s>[INST] ok [/INST]"
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_chars"] == len(x)
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{x}\nassistant\n{x}\n".encode()).hexdigest()


# ---- URLs

def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules_equal_brute_force(spark):
    odd = ["", None, "noscheme/org/", "http://ORG/", "http://xorg/", "http://a.b.ORG/x?y", "http://example.org/es/1", "http://e.example.org/es", "http://example.org/en/12#x", "://org/", "http://org?x", "ftp://m.com/fr/?",
           "http://com/de/", "http://a://b.org/", "http://é.Org/x\ny"]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").unionAll(spark.createDataFrame(list(enumerate(odd, 10**6)), "page_id long, url string"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in urlfilter.judge(pages.withColumn("host", pages.url), labels).collect():
        host, path, rule, verdict = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.mined is not None else "allow"))


def test_mined_rules(spark):
    pages = [(i, f"http://{'bad' if i % 4 == 0 else 'good'}.example.net/{'x' if i % 8 == 0 else 'y'}/{i}") for i in range(400)]
    labels = [(i, 0, 1 if i % 8 == 0 else 0) for i in range(300)] + [(None, 0, 1), (5, None, None)]
    df, lf = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urlfilter.judge(df, lf).collect()}
    assert got == {i: "block" if i % 8 == 0 else "allow" for i in range(400)}
    rules = urlfilter.mine(df.join(lf, df.page_id == lf.doc_id).selectExpr("url", "toxic = 1 as bad"))
    sets = [set(r.tokens) for r in rules.collect()]
    assert sets and not any(a < b for a in sets for b in sets)
    assert urlfilter.judge(df.limit(0), lf).count() == 0 and {r.verdict for r in urlfilter.judge(df, lf.limit(0)).collect()} == {"allow"}


def brute_rules(labelled):
    """All combinations of up to MAX_TOKENS tokens of the urls, counted one by one; the smallest ones that pass."""
    def tokens(url):
        host, path = brute_rule(url)[:2]
        labels = host.split(".")
        return {"h:" + ".".join(labels[i:]) for i in range(len(labels))} | {"p:" + re.sub("[0-9]+", "#", x) for x in path.split("/") if x}

    pages = [(tokens(u), b) for u, b in labelled if u is not None and b is not None]
    share = sum(b for _, b in pages) / len(pages)
    counts = {}
    for t, b in pages:
        for k in range(1, urlfilter.MAX_TOKENS + 1):
            for c in itertools.combinations(sorted(t), k):
                n = counts.setdefault(c, [0, 0])
                n[0] += 1
                n[1] += b
    good = [set(c) for c, (n, bad) in counts.items() if n >= urlfilter.LEAST and bad >= urlfilter.CONFIDENCE * n and bad / n >= urlfilter.LIFT * share]
    return {tuple(sorted(c)) for c in good if not any(d < c for d in good)}


def test_mined_rules_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        host = rng.choice(["a.net", "b.net", "shop.a.net"])
        path = [x for x in ("x", "y", "z", "w", f"n{i}") if rng.random() < 0.5]
        bad = ("x" in path and "y" in path and host != "b.net") or rng.random() < 0.05
        rows.append((f"http://{host}/{'/'.join(path)}", bool(bad)))
    rows += [(None, True), ("http://a.net/x", None), ("nothing", True)]
    got = urlfilter.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert {tuple(r.tokens) for r in got} == brute_rules(rows) and got and all(r.n >= 10 and r.n_bad >= 0.8 * r.n for r in got)


@pytest.mark.parametrize("segments", (18, 60))
def test_mining_long_urls(spark, segments):
    """Bad urls share all their path segments: as many tokens that go together as there are."""
    rows = [(f"http://long.example/{'/'.join(f's{chr(97 + k // 26)}{chr(97 + k % 26)}' for k in range(segments))}/{i}", True) for i in range(20)]
    rows += [(f"http://long.example/t/{i}", False) for i in range(20)]
    rules = urlfilter.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert len(rules) == segments and all(len(r.tokens) == 1 and r.n == r.n_bad == 20 for r in rules)


def test_few_labels_make_no_rule(spark):
    rows = [(f"http://few.example/{'/'.join('abcdefghijklmnopqr')}/{i}", i == 0) for i in range(20)]
    assert urlfilter.mine(spark.createDataFrame(rows, "url string, bad boolean")).count() == 0


# ---- pipeline

def test_pipeline_against_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [
        (10**6, None, "en", "s", None), (10**6 + 1, "12345 %%%", "en", "s", 9), (10**6 + 2, "the same text stands here and here it is again", "en", "s", 46),
        (10**6 + 3, "the same text stands here and here it is again", "en", "s", 46), (10**6 + 5, "one id stands on this text", "en", "s", 25),
        (10**6 + 5, "the very id is on quite another text here", "en", "s", 41),
    ]
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    more.append((10**6 + 4, f"before it {leak} after it", "es", "s", 100))
    every = docs.unionAll(spark.createDataFrame(more, docs.schema))
    now = every
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.materialize(stage(spark, now, SF), f"test-{name}")
        assert now.columns == corpus_pipeline.COLUMNS
        assert now.where(f"doc_id = {10**6 + 5}").count() == 2
        kept.append({r.doc_id: r.text for r in now.where(f"doc_id <> {10**6 + 5}").collect()})
    by_language, by_line, by_copy, by_leak = kept
    assert set(every.select("doc_id").toPandas()["doc_id"]) - set(by_language) == {10**6, 10**6 + 1, 10**6 + 5}
    assert set(by_line) == set(by_language)
    again = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(by_line.items()), "doc_id long, text string")).collect()}
    assert set(by_copy) == {d for d, c in again.items() if d == c} and 10**6 + 3 not in by_copy and 10**6 + 2 in by_copy
    assert 10**6 + 4 in by_copy and 10**6 + 4 not in by_leak and set(by_leak) <= set(by_copy)
    last = corpus_pipeline.encode_tokens(spark, now.where(f"doc_id <> {10**6 + 5}"), SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in last} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in by_leak.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]


def test_pipeline_on_empty_documents(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0


def test_missing_lines_make_no_bitmap(spark):
    assert linededup.keep_bitmaps(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).count() == 0

"""HTML main text: page structure, and per host a suffix array that shows repeated boilerplate."""
from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import materialize, resident, table

#: Words that a repeated run must have, and the distinct pages it must stand on.
MIN_RUN, MIN_PAGES = 6, 3
#: Pages of one suffix array, and bytes of html. A host with more is dealt out by hash into arrays of about so
#: many, and the pages of a run are counted over all arrays of the host.
SHARD, SHARD_BYTES = 256, 8 << 20
#: Arrays that one task takes, about, whatever the size of the input.
ARRAYS_A_TASK = 4
#: Hosts above SHARD pages that are looked up in memory; with more of them, a join does it.
MAX_LARGE_HOSTS = 10_000

#: Kinds of blocks: main region; elsewhere; boilerplate by its markup.
MAIN, OTHER, BOILERPLATE = "m", "o", "b"
_BREAK = "\x1e"  # white space, so no block holds it

# fixed values: elements whose content is never text, is boilerplate, starts a block, has no end tag
_RAW = "script style noscript template iframe svg math canvas object audio video textarea select title".split()
_DROPPED = "nav aside footer form menu dialog button fieldset datalist option head".split()
_BLOCK = (
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul"
).split()
_VOID = "area base br col embed hr img input link meta param source track wbr".split()
_SKIPPED_ROLES = "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split()

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(_RAW) + r")\b(?P<rawattrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|cookies?|consent|gdpr|notices?|"
    r"alerts?|popups?|modals?|overlay|newsletters?|subscribe|signup|sidebars?|side-bar|nav|navbar|navigation|menus?|breadcrumbs?|footer|"
    r"comments?|commentlist|disqus|respond|related|recommend(?:ed|ations)?|share|sharing|social|widgets?|login|search|pagination|pager|"
    r"toolbar|skip-link)(?:$|[\s_-])", re.I)
_NAMED_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:header|masthead|banner|topbar|site-header|page-header)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _judge(tag: str, attrs: str, in_main: bool) -> str | None:
    """BOILERPLATE or MAIN if the element's markup says so."""
    if tag in _DROPPED or tag == "header" and not in_main:
        return BOILERPLATE
    values = {}
    if "=" in attrs or "hidden" in attrs.lower():
        for name, a, b, c in _ATTRIBUTE.findall(attrs):
            values.setdefault(name.lower(), a or b or c)
    role = values.get("role", "").lower()
    name = f"{values.get('class', '')} {values.get('id', '')}".strip()
    if role in _SKIPPED_ROLES or "hidden" in values or values.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(values.get("style", "")):
        return BOILERPLATE
    if tag not in ("body", "html", "main") and name and (_NAMED.search(name) or not in_main and tag != "article" and _NAMED_OUTSIDE.search(name)):
        return BOILERPLATE
    if tag in ("article", "main") or role in ("main", "article"):
        return MAIN
    return None


def blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) of each block in page order: character references decoded, white space runs one space."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = [("", OTHER)]
    kind, at = OTHER, 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((kind, text))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            if m.group("raw") and m.group("raw").lower() == "title":
                flush()
            continue
        tag = tag.lower()
        if m.group("end"):
            if tag in _BLOCK:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        else:
            if tag in _BLOCK:
                flush()
            if not page.endswith(">", 0, at):
                continue  # the page ends within a tag
            if tag in _VOID or m.group("attrs").endswith("/") and tag not in _BLOCK:
                continue
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == tag:
                stack.pop()
            before = stack[-1][1]
            judged = BOILERPLATE if before == BOILERPLATE else _judge(tag, m.group("attrs"), before == MAIN) or before
            stack.append((tag, judged))
        if stack[-1][1] != kind:
            flush()
            kind = stack[-1][1]
    parts.append(page[at:])
    flush()
    return out


def repeated(tokens: np.ndarray, page: np.ndarray, depth: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of the token stream, sorted by ``depth`` tokens: the order of the suffixes, the
    number of each one's class of equal prefixes, and which suffixes have a whole prefix on their page.

    Ranks of prefixes are doubled in length until they reach ``depth``; a substring of that length or
    more repeats exactly where classes hold several suffixes.
    """
    n = len(tokens)
    rank, length = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while length < depth:
        step = min(length, depth - length)
        other = np.zeros(n, np.int64)
        other[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 2) + other, return_inverse=True)[1].astype(np.int64)
        length += step
    whole = np.zeros(n, bool)
    if n >= depth:
        whole[: n - depth + 1] = page[depth - 1 :] == page[: n - depth + 1]
    return np.argsort(rank, kind="stable"), rank, whole


def _streams(pages: list[list[tuple[str, str]]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of all pages, the page of each, and for each page the first one equal to it."""
    words, page = [], []
    seen: dict[int, int] = {}
    source = []
    for i, p in enumerate(pages):
        # equal pages are one page: what only copies share is not boilerplate
        key = hash(tuple(p))
        source.append(seen.setdefault(key, i))
        for _, text in p:
            w = text.split(" ")
            words += w
            page += [i] * len(w)
    return words, np.array(page, np.int64), np.array(source, np.int64)


def _run_hashes(words: list[str], starts: np.ndarray) -> np.ndarray:
    """A hash of MIN_RUN words from each of the places, equal in every process."""
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    each = pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False)
    out = np.zeros(len(starts), np.uint64)
    for k in range(MIN_RUN):
        out = (out ^ each[codes[starts + k]]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _runs(pages: list[list[tuple[str, str]]]) -> tuple[np.ndarray, np.ndarray]:
    """(run, page): hashes of the runs of one array's pages and of distinct pages each stands on, at most MIN_PAGES of them."""
    words, page_no, source = _streams(pages)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tokens = pd.factorize(np.array(words, dtype=object))[0]
    _, rank, whole = repeated(tokens, page_no)
    starts = np.flatnonzero(whole)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct = source[page_no[starts]]
    _, at = np.unique(np.stack([rank[starts], distinct], axis=1), axis=0, return_index=True)
    of_class = rank[starts[at]]
    at = at[np.arange(len(at)) - np.searchsorted(of_class, of_class) < MIN_PAGES]
    keys = [int.from_bytes(hashlib.blake2b(_BREAK.join(k + t for k, t in p).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for p in pages]
    return _run_hashes(words, starts[at]), np.array(keys, np.int64)[distinct[at]]


def _host_texts(pages: list[list[tuple[str, str]]], common: np.ndarray | None = None) -> list[str]:
    """The main text of each page of one host, or of a share of it; then ``common`` are the hashes of
    the runs that stand on enough pages of the host."""
    words, page_no, source = _streams(pages)
    if not words:
        return [""] * len(pages)
    if common is None:
        tokens = pd.factorize(np.array(words, dtype=object))[0]
        order, rank, whole = repeated(tokens, page_no)
        classes = rank.max() + 1
        distinct = source[page_no]
        pairs = np.unique(np.stack([rank[whole], distinct[whole]], axis=1), axis=0)
        on_pages = np.bincount(pairs[:, 0], minlength=classes)
        hit = order[whole[order] & (on_pages[rank[order]] >= MIN_PAGES)]
    elif len(common) and len(words) >= MIN_RUN:
        starts = np.arange(len(words) - MIN_RUN + 1)
        starts = starts[page_no[MIN_RUN - 1 :] == page_no[: len(starts)]]
        hit = starts[np.isin(_run_hashes(words, starts), common)]
    else:
        hit = np.zeros(0, np.int64)
    covered = np.zeros(len(words), bool)
    for k in range(MIN_RUN):
        covered[hit + k] = True
    out = []
    first = np.searchsorted(page_no, np.arange(len(pages) + 1))
    for i, p in enumerate(pages):
        a = first[i]
        has_main = any(kind == MAIN for kind, _ in p)
        kept, flags = [], []
        for kind, text in p:
            n = text.count(" ") + 1
            if kind == MAIN:
                kept.append(text)  # the article is whole, also where it says what other pages say
            elif kind == OTHER and not has_main:
                flags.append((a, n, len(kept)))
                kept.append(text)
            a += n
        total = sum(n for _, n, _ in flags)
        unique = total - sum(int(covered[s : s + n].sum()) for s, n, _ in flags)
        if flags and unique >= 0.1 * total:  # else the page is a near copy of others as a whole, and stays
            for s, n, k in flags:
                if covered[s : s + n].any():
                    w = kept[k].split(" ")
                    kept[k] = " ".join(x for x, c in zip(w, covered[s : s + n]) if not c)
        out.append(" ".join(x for x in kept if x))
    return out


def _host(url):
    """The host of a url: after :// up to / ? # or the end; none: the empty text."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1), F.lit("")))


def main_text(pages: DataFrame, url: str = "url") -> DataFrame:
    """(page_id, url, text) for every page.

    A page is cut into blocks; elements such as nav, footer or aside, and names such as ad, sidebar or
    comments, mark boilerplate, article and main the main region. The token streams of the pages of one
    host are concatenated and sorted as a suffix array; runs of MIN_RUN words or more on MIN_PAGES
    distinct pages of the host are boilerplate wherever no main region is marked: they are removed and the unique
    runs between them stay. A marked main region is whole, but for what its own markup excludes. What
    is left is joined by one space.

    Null html: empty text. Null url or one without host: the pages without host form a host. Repeated
    rows: each returned; equal pages count as one page. Pages of any length are read whole. Further
    columns are ignored. An empty table gives no rows.
    """
    ship(pages.sparkSession)
    rows = pages.select("page_id", F.col(url).alias("url"), "html", _host(F.col(url)).alias("host"))
    sizes = pages.select(_host(F.col(url)).alias("host"), F.octet_length("html").alias("b")).groupBy("host").agg(
        F.greatest(F.ceil(F.count("*") / SHARD), F.ceil(F.sum("b") / SHARD_BYTES), F.lit(1)).cast("int").alias("n"))
    sizes = materialize(sizes, "hosts")
    arrays = sizes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-arrays // ARRAYS_A_TASK))
    large = sizes.where("n > 1")
    some = large.limit(MAX_LARGE_HOSTS + 1)
    known = some.collect()
    if len(known) <= MAX_LARGE_HOSTS:
        held = pages.sparkSession.createDataFrame([(r.host, r.n) for r in known], "host string, n int")
        sized = rows.join(F.broadcast(held), "host", "left")  # at most MAX_LARGE_HOSTS rows
    else:
        sized = rows.join(large, "host", "left")
    shards = F.coalesce("n", F.lit(1))
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("page_id", "url"), shards)).withColumn("shards", shards).select("host", "shard", "shards", "page_id", "url", "html")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resident("html")
        for f in frames:
            for at in range(0, len(f), 256):
                part = f.iloc[at : at + 256]
                texts = [_BREAK.join(k + t for k, t in blocks(h)) if isinstance(h, str) else "" for h in part["html"]]
                yield part[["host", "shard", "page_id", "url"]].assign(blocks=texts)

    def bare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Hosts with a page that marks no main region: only there do runs change a text."""
        for f in cut(frames):
            kinds = f["blocks"].map(lambda x: {b[0] for b in x.split(_BREAK)} if x else set())
            yield f[kinds.map(lambda k: OTHER in k and MAIN not in k)][["host"]].drop_duplicates()

    def lists(f: pd.DataFrame) -> list[list[tuple[str, str]]]:
        return [[(b[0], b[1:]) for b in x.split(_BREAK)] if x else [] for x in f["blocks"]]

    def runs(f: pd.DataFrame) -> pd.DataFrame:
        run, page = _runs(lists(f))
        return pd.DataFrame({"host": f["host"].iloc[0], "shard": f["shard"].iloc[0], "run": run, "page": page})

    def extract(f: pd.DataFrame) -> pd.DataFrame:
        return f[["page_id", "url"]].assign(text=_host_texts(lists(f)))

    def extract_share(f: pd.DataFrame, common: pd.DataFrame) -> pd.DataFrame:
        return f[["page_id", "url"]].assign(text=_host_texts(lists(f), common["run"].to_numpy(np.int64)))

    shape, text = "host string, shard long, page_id long, url string, blocks string", "page_id long, url string, text string"
    by_array = lambda rows: rows.repartition(parts, "host", "shard")  # noqa: E731  as many partitions as the arrays ask for
    small = by_array(dealt.where("shards = 1").drop("shards").mapInPandas(cut, shape)).groupBy("host", "shard").applyInPandas(extract, text)
    if not known:
        return small
    of_large = dealt.where("shards > 1").drop("shards")
    hosts = materialize(of_large.mapInPandas(bare, "host string").distinct(), "hosts")
    counted = by_array(of_large.join(hosts, "host", "left_semi").mapInPandas(cut, shape)).groupBy("host", "shard").applyInPandas(
        runs, "host string, shard long, run long, page long")
    # an array gives at most MIN_PAGES pages of a run, so a run's set is bounded by the host's arrays
    stands = counted.groupBy("host", "run").agg(F.collect_set(F.struct("page", "shard")).alias("s"))
    stands = stands.where(F.size(F.array_distinct(F.col("s.page"))) >= MIN_PAGES)
    common = stands.select("host", F.explode(F.array_distinct(F.col("s.shard"))).alias("shard"), "run")
    large_texts = by_array(of_large.mapInPandas(cut, shape)).groupBy("host", "shard").cogroup(by_array(common).groupBy("host", "shard")).applyInPandas(extract_share, text)
    return small.unionAll(large_texts)


def query(spark, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages", "page_id"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))

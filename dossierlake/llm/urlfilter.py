"""URL filter: fixed host and path rules, then association rules mined with FP-growth from labels."""
from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, table

#: (verdict, host, path prefix). A rule fits its host and all subdomains; the longest that fits wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labelled pages that a combination must be on (a count, so that a rule needs the same evidence in a table of
#: any size), least share of those that are bad, how much likelier than by chance, and tokens at most.
LEAST, CONFIDENCE, LIFT, MAX_TOKENS = 10, 0.8, 1.2, 4
#: Labelled pages that the rules are mined from, chosen by hash.
SAMPLE = 100_000
#: Tokens that are mined together. A url with more is mined in windows of so many, each half over the next,
#: since what FP-growth finds in n tokens that go together is 2^n combinations.
TOGETHER = 10
#: Mined rules up to which the inverted index is sent to all tasks; beyond, it is joined by shuffle.
MAX_BROADCAST_RULES = 50_000


def host_of(url):
    """After the first :// up to / ? # or the end, A-Z lowered; empty where there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url):
    """After the host up to ? # or the end; empty where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host, path):
    """The distinct tokens of a url: host suffixes by label, path segments with digits made #, marked by place."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, -i, i), ".")))
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    paths = F.transform(segments, lambda s: F.concat(F.lit("p:"), F.regexp_replace(s, "[0-9]+", "#")))
    return F.array_distinct(F.when(host == "", paths).otherwise(F.concat(hosts, paths)))


def fixed_rule(host, path, rules=RULES):
    """A struct (rule, verdict) of the longest rule that fits, null if none does."""
    fitting = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        named = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        fitting = F.when(fits, named) if fitting is None else fitting.when(fits, named)
    return fitting


def _windows(tokens):
    n, step = F.size(tokens), TOGETHER // 2
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - TOGETHER + step), F.lit(step))
    return F.transform(starts, lambda at: F.slice(tokens, at, F.lit(TOGETHER)))


def mine(labelled: DataFrame, least: int = LEAST, confidence: float = CONFIDENCE, sample: int = SAMPLE) -> DataFrame:
    """(rule_id, tokens, token, n, n_bad): token combinations of ``labelled(url, bad)`` that bad pages have.

    FP-growth mines the bad ones of at most ``sample`` labelled pages, those of least hash, for
    combinations of the tokens that enough bad pages have. Each is then counted over all pages of the
    sample. One stays if at least ``least`` pages have it, enough of those are bad, and more than by
    chance; one that holds a smaller rule as a part is dropped, since the smaller one matches whatever it
    does. ``token`` is the one that fewest pages have. Null urls and labels are left out.
    """
    spark = labelled.sparkSession
    items = labelled.where("url is not null and bad is not null").select(tokens_of(host_of(F.col("url")), path_of(F.col("url"))).alias("tokens"), "bad", "url")
    items = items.orderBy(F.xxhash64("url", "bad"), "url").limit(sample).select(F.monotonically_increasing_id().alias("key"), "tokens", "bad")
    items = materialize(items.where(F.size("tokens") > 0), "urls")
    schema = "rule_id long, tokens array<string>, token string, n long, n_bad long"
    all_pages, all_bad = items.agg(F.count("*"), F.count_if("bad")).first()
    needed = math.ceil(least * confidence)
    if all_bad < needed:
        return spark.createDataFrame([], schema)
    each = items.select("key", "bad", F.posexplode("tokens").alias("at", "token"))
    # no combination is on more bad pages than each of its tokens
    counts = each.groupBy("token").agg(F.count("*").alias("on"), F.count_if("bad").alias("b")).where((F.col("b") >= needed) & (F.col("on") >= least))
    counts = materialize(counts.select("token", "on"), "tokens")
    frequent = each.where("bad").join(counts, "token").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("t"))
    windows = materialize(frequent.select(F.explode(_windows(F.col("t"))).alias("items")), "windows")
    n = windows.count()
    if not n:
        return spark.createDataFrame([], schema)
    found = FPGrowth(itemsCol="items", minSupport=(needed - 0.5) / n).fit(windows).freqItemsets
    found = found.where(F.size("items") <= MAX_TOKENS).select(F.array_sort("items").alias("tokens")).select(F.xxhash64("tokens").alias("rule_id"), "tokens")
    rarest = found.select("rule_id", "tokens", F.explode("tokens").alias("token")).join(counts, "token")
    found = materialize(rarest.groupBy("rule_id", "tokens").agg(F.min_by("token", F.struct("on", "token")).alias("token")), "found")
    counted = matches(items, found).join(items.select("key", "bad"), "key").groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"))
    good = (F.col("n") >= least) & (F.col("n_bad") >= confidence * F.col("n")) & (F.col("n_bad") * all_pages >= LIFT * all_bad * F.col("n"))
    rules = materialize(found.join(counted.where(good), "rule_id"), "rules")
    smaller = rules.select(F.col("tokens").alias("part"), F.element_at("tokens", 1).alias("t"))
    larger = rules.select("tokens", F.explode("tokens").alias("t")).join(smaller, "t")
    implied = larger.where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0)).select("tokens").distinct()
    return rules.join(implied, "tokens", "left_anti").select("rule_id", "tokens", "token", "n", "n_bad")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule_id) of the urls(key, tokens) that hold all tokens of a rule.

    The inverted index lists each of ``rules(rule_id, tokens, token)`` under its rarest token only, so a
    url meets few rules; the other tokens are then looked up in its own list.
    """
    index = rules.select("rule_id", F.col("tokens").alias("need"), "token")
    if rules.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES:
        index = F.broadcast(index)
    held = urls.select("key", "tokens", F.explode("tokens").alias("token"))
    return held.join(index, "token").where(F.size(F.array_except("need", "tokens")) == 0).select("key", "rule_id")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, **options) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, mined) for every page.

    The longest fixed rule that fits decides. Other pages are blocked if a mined rule matches (``mined``,
    the least rule id) and allowed if none does. A page counts as labelled if ``labels`` has its id as
    doc_id, bad if any such label is toxic = 1. Null url or one without ://: host and path empty, which
    no rule fits. Repeated rows: each judged. Null ids: unlabelled. Ties between fixed rules: none, two
    of equal length that both fit would be the same rule. Further columns are ignored. Empty tables:
    no pages give no rows, no labels no mined rules.
    """
    label = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") == 1).alias("bad"))
    mined = materialize(mine(pages.select("page_id", "url").join(label, F.col("page_id") == F.col("doc_id")).select("url", "bad"), **options), "mined")
    base = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    base = base.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    if mined.limit(1).count():
        urls = base.where("fixed is null").select("host", "path").distinct()
        found = matches(urls.select(F.struct("host", "path").alias("key"), tokens_of(F.col("host"), F.col("path")).alias("tokens")), mined)
        found = found.groupBy("key").agg(F.min("rule_id").alias("mined")).select(F.col("key.host").alias("host"), F.col("key.path").alias("path"), "mined")
        base = base.join(found, ["host", "path"], "left")
    else:
        base = base.withColumn("mined", F.lit(None).cast("long"))
    return base.select(
        "page_id", "url", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce(F.col("fixed.verdict"), F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined",
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "pages", "page_id"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("page_id", "host", "path", "rule", "verdict")

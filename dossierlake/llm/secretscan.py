"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio.

Spark expressions only: no Python, pandas, Arrow or RDD code touches a row.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

# fixed values: kind, pattern, group whose length counts, least length
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Cheap conditions without which a pattern gives nothing; most texts end there.
_NEEDED = {"assign": r"(?i)(?:pass(?:word|wd)|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}

#: Strings that the models judge, in runs of at least so many characters.
CANDIDATE, LEAST = r"[A-Za-z0-9+/_=.-]+", 20
_HAS_CANDIDATE = r"[A-Za-z0-9+/_=.-]{20}"
MODEL_KIND = "markov"
#: States of the models: letters, digits, one for each of the marks, and one for all else.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-"
#: Mean log-likelihood ratio per character of a stretch from which a string counts as random.
THRESHOLD = 1.5
#: Documents whose words are samples of ordinary identifiers (those of least hash), and random samples of each form.
SAMPLE_DOCUMENTS, SAMPLE_RANDOM = 100, 2000


@dataclass(frozen=True)
class Model:
    """log P(b | a) under the model of random strings minus that of identifiers, row by row; and the same of first characters."""

    ratios: tuple[float, ...]
    firsts: tuple[float, ...]


def _states(col):
    """The state of each character, 0 for all outside the alphabet."""
    return F.transform(F.split(col, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _transitions(samples: DataFrame) -> dict[tuple[str, int, int], int]:
    """How often state b follows a (a = -1: b comes first), by label. At most 2 * 70 * 69 rows."""
    s = samples.select("label", _states(F.col("s")).alias("x"))
    pairs = s.select("label", F.explode(F.concat(
        F.array(F.struct(F.lit(-1).alias("a"), F.element_at("x", 1).cast("int").alias("b"))),
        F.zip_with(F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.size("x") - 1), lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))),
    )).alias("p"))
    return {(r.label, r.a, r.b): r.n for r in pairs.groupBy("label", "p.a", "p.b").agg(F.count("*").alias("n")).collect()}


def samples(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, randoms: int = SAMPLE_RANDOM) -> DataFrame:
    """(s, label): ordinary identifiers, which are words of the corpus, alone and joined as names and
    paths are, dates, numbers and rules of one mark; and random strings: digests as hexadecimal, as base 64, and upper-case letters with digits."""
    spark = docs.sparkSession
    some = docs.where("text is not null").select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    words = some.select(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z0-9_.-]{3,15}"), F.lit(0))).alias("w"))
    # a word with both letters and digits may itself be a secret, so it is no sample of ordinary ones
    words = words.select(F.filter("w", lambda x: ~x.rlike("[0-9]")).alias("w")).where(F.size("w") >= 3)
    joined = lambda sep, make: F.zip_with(
        F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(make(a), F.lit(sep), make(b)))
    ordinary = words.select(F.explode(F.concat(
        F.col("w"), joined("_", F.lower), joined("-", F.lower), joined("/", F.lower), joined("", F.initcap), joined("_", F.upper), joined(".", F.lower),
        F.transform("w", lambda x: F.concat(F.lower(x), F.lit("_"), F.length(x).cast("string"))),
        F.transform("w", lambda x: F.concat(F.lower(x), F.lit("-20"), F.lpad(F.pmod(F.hash(x), F.lit(100)).cast("string"), 2, "0"))),
    )).alias("s")).withColumn("label", F.lit("ordinary"))
    n = F.col("id")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    date = F.concat(F.lit("20"), two(n % 100), F.lit("-"), two(n % 12 + 1), F.lit("-"), two(n % 28 + 1))
    time = F.concat(F.lit("T"), two(n % 24), F.lit("."), two(n % 60), F.lit("."), two(n % 59), F.lit("."), F.lpad((n * 7919 % 1000).cast("string"), 3, "0"))
    numbers = spark.range(randoms).select(F.explode(F.array(
        date, F.concat(date, time), (n * 1_000_003 + 12_345).cast("string"), F.lpad((n * 7919).cast("string"), 20, "0"),
        F.concat_ws(".", n % 10, n % 17, n % 23, n % 7), *[F.repeat(F.lit(mark), F.lit(24)) for mark in "+/_=.-"],
        *[F.repeat(F.lit(mark), F.lit(24)) for mark in "x0"],
    )).alias("s")).withColumn("label", F.lit("ordinary"))
    digest = spark.range(randoms).select(F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256).alias("h"))
    upper = F.translate(F.upper(F.regexp_replace(F.base64(F.unhex("h")), "[+/=]", "")), "018", "QXZ")
    random = digest.select(F.explode(F.array(F.col("h"), F.base64(F.unhex("h")), F.upper("h"), upper, F.regexp_replace(F.base64(F.unhex("h")), "[+/=]", "_"))).alias("s"))
    return ordinary.unionAll(numbers).unionAll(random.withColumn("label", F.lit("random"))).where(F.length("s") >= 2)


def train(docs: DataFrame, **options) -> Model:
    """Both models from the labelled samples, with add-one smoothing over all states."""
    counts = _transitions(materialize(samples(docs, **options), "samples"))
    n = len(ALPHABET) + 1

    def logs(label: str, a: int) -> list[float]:
        row = [counts.get((label, a, b), 0) + 1 for b in range(n)]
        total = math.log(sum(row))
        return [math.log(x) - total for x in row]

    def differences(a: int) -> list[float]:
        return [round(r - o, 6) for r, o in zip(logs("random", a), logs("ordinary", a))]

    return Model(tuple(x for a in range(n) for x in differences(a)), tuple(differences(-1)))


def _constant(values: tuple[float, ...]):
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<double>")


def surplus(col, model: Model, threshold: float, least: int = LEAST):
    """The greatest sum of log-likelihood ratios less ``threshold`` each over a stretch of ``least``
    characters or more: 0 or more where some stretch's mean reaches the threshold, whatever ordinary
    characters stand around it."""
    n = len(ALPHABET) + 1
    table, first = _constant(model.ratios), _constant(model.firsts)
    zero = F.lit(0.0)

    def scores(states):
        return F.zip_with(F.concat(F.array(F.lit(-1)), F.slice(states, F.lit(1), F.size(states) - 1)), states, lambda a, b: F.when(
            a < 0, F.get(first, b)).otherwise(F.get(table, a * n + b)) - threshold)

    def walk(x):
        # with each character the one that leaves the window of the last ``least``: window + best stretch that ends before it
        lagged = F.slice(F.concat(F.array_repeat(zero, least), x), F.lit(1), F.size(x))
        start = F.named_struct(F.lit("k"), F.lit(0), F.lit("window"), zero, F.lit("before"), zero, F.lit("best"), F.lit(float("-inf")))

        def step(s, p):
            window = s["window"] + p["x"] - p["gone"]
            before = F.greatest(zero, s["before"] + p["gone"])
            best = F.when(s["k"] + 1 >= least, F.greatest(s["best"], window + before)).otherwise(s["best"])
            return F.named_struct(F.lit("k"), s["k"] + 1, F.lit("window"), window, F.lit("before"), before, F.lit("best"), best)

        return F.aggregate(F.zip_with(x, lagged, lambda x, y: F.struct(x.alias("x"), y.alias("gone"))), start, step)["best"]

    # arrays of one bind a value, so it is computed once
    bound = F.transform(F.array(_states(col)), scores)
    return F.get(F.transform(bound, walk), F.lit(0))


_SPANS = "cast(array() as array<struct<start:bigint,end:bigint,kind:string,value:string>>)"


def _spans(text, pattern: str, kind: str, group: int, least: int):
    """All matches, leftmost and without overlap, whose group is long enough. The gaps between matches
    and the matches themselves give the places, counted in code points."""
    gaps = F.split(text, pattern, -1)
    found = F.arrays_zip(
        gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part")
    )
    start = F.named_struct(F.lit("at"), F.lit(0).cast("long"), F.lit("spans"), F.expr(_SPANS))

    def step(s, m):
        begin = s["at"] + F.char_length(m["gap"])
        end = begin + F.coalesce(F.char_length(m["whole"]), F.lit(0))
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(kind).alias("kind"), m["part"].alias("value"))
        good = F.coalesce(F.char_length(m["part"]) >= least, F.lit(False))
        return F.named_struct(F.lit("at"), end.cast("long"), F.lit("spans"), F.when(good, F.concat(s["spans"], F.array(span))).otherwise(s["spans"]))

    return F.aggregate(found, start, step)["spans"]


def scan(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, base, extra) for every document: arrays of (start, end, kind), end exclusive, in code points.

    ``base`` are the matches of PATTERNS by start, then kind as listed; ``extra`` the runs of candidate
    characters that overlap none of them and in which the mean log-likelihood ratio of some stretch of
    LEAST characters or more reaches the threshold; the whole run is the span.
    Null or empty text: no spans. Repeated rows: each scanned. Texts of any length are scanned whole.
    Further columns are ignored. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    nothing = F.expr(_SPANS)
    out = docs.select("doc_id", text.alias("text"))
    kinds = [k for k, *_ in PATTERNS]
    for kind, pattern, group, least in PATTERNS:
        out = out.withColumn(kind, F.when(F.col("text").rlike(_NEEDED[kind]), _spans(F.col("text"), pattern, kind, group, least)).otherwise(nothing))
    candidates = F.when(F.col("text").rlike(_HAS_CANDIDATE), _spans(F.col("text"), CANDIDATE, MODEL_KIND, 0, LEAST)).otherwise(nothing)
    out = out.withColumn("candidates", candidates).drop("text")
    order = F.array(*[F.lit(k) for k in kinds])
    placed = F.transform(F.concat(*kinds), lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    out = out.withColumn("base", F.array_sort(placed))
    free = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    extra = F.filter(free, lambda c: surplus(c["value"], model, threshold) >= -1e-9)
    return out.select("doc_id", *kinds, "base", F.transform(extra, lambda s: F.struct(
        s["start"].alias("start"), F.lit(len(kinds) + 1).cast("long").alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("extra"))


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id")
    out = scan(docs, train(docs))
    return out.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k, *_ in PATTERNS],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )

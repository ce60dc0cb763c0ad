"""Column functions on text: tokens, normalization, redaction, windows around matches."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the token pattern, the QA stop words, page-marker lines
TOKEN = "[a-z0-9]+(?:[-_][a-z0-9]+)*"
STOP_WORDS = (
    "a an and are about applies apply between does do for how is it me of on or the to what when where which who with "
    "mandatory requirement requirements must"
).split()
LAYOUT_NOISE = r"^(?:(?:header|footer)(?:[ \t]+[0-9]+)?|page[ \t]+[0-9]+(?:[ \t]+of[ \t]+[0-9]+)?)$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used: without it each use repeats the whole
    expression, and long chains of them no longer compile."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text) -> Column:
    """Lower-cased runs of ASCII letters and digits, joined over single - or _; order and repeats stay."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(0))


def question_terms(text) -> Column:
    """Distinct alphanumeric terms without stop words; a plural s goes from terms of over four letters."""
    words = F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    return F.array_distinct(F.transform(kept, lambda w: F.when((F.length(w) > 4) & w.endswith("s"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)))


def squeeze(text) -> Column:
    """Runs of ASCII white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"[ \t\n\x0b\f\r]+", " "))


def same_text_key(text) -> Column:
    """What exact near-duplicate removal compares: squeezed and lower-cased."""
    return F.lower(squeeze(text))


def edge_line_key(line) -> Column:
    """A page-edge line without what varies from page to page: page numbers and integers."""
    key = squeeze(F.lower(col(line)))
    key = F.regexp_replace(key, r"(^|[^a-z0-9_])page [0-9]+(?: of [0-9]+)?($|[^a-z0-9_])", "$1page #$2")
    key = F.regexp_replace(key, r"(^|[^\p{L}\p{N}_])[0-9]+($|[^\p{L}\p{N}_])", "$1#$2")
    # neighbours share their border, so a second pass takes what the first could not
    key = F.regexp_replace(key, r"(^|[^\p{L}\p{N}_])[0-9]+($|[^\p{L}\p{N}_])", "$1#$2")
    return F.trim(F.regexp_replace(key, r"[^\p{L}\p{N}_#]+", " "))


def is_layout_noise(line) -> Column:
    return F.lower(col(line)).rlike(LAYOUT_NOISE)


def is_structural_line(line) -> Column:
    """A list item, a table row, or a line that ends a sentence."""
    line = col(line)
    return line.rlike(r"^(?:[-*•▪]|[0-9]+[.)])[ \t]+") | line.contains("|") | line.rlike(r"[.!?:;]$")


def can_join(current, following) -> Column:
    """Whether the next line continues this one's prose."""
    current, following = col(current), col(following)
    words = F.size(F.filter(F.split(current, r"\s+"), lambda w: w != ""))
    starts = following.rlike(r"^[\p{Ll},)\]}]")
    return (current != "") & (following != "") & ~is_structural_line(current) & ~is_structural_line(following) & (words >= 3) & starts


def normalize_text(text) -> Column:
    """Soft hyphens dropped, blanks squeezed, wrapped words and prose lines joined, repeated page markers gone.

    A fold over the lines: the state is the finished lines and the line that may still grow; a blank
    line ends it. Null stays null.
    """
    raw = F.replace(F.replace(F.replace(col(text), F.lit("­"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.transform(F.split(raw, "\n", -1), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    start = F.named_struct(F.lit("done"), F.expr("cast(array() as array<string>)"), F.lit("now"), F.lit(""))

    def state(done, now):
        return F.named_struct(F.lit("done"), done, F.lit("now"), now)

    def push(s):
        return F.when(s["now"] != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])

    def step(s, line):
        now = s["now"]
        hyphen = now.rlike(r"[\p{L}\p{N}_]-$") & line.rlike(r"^\p{Ll}")
        return (
            F.when(line == "", state(push(s), F.lit("")))
            .when(hyphen, state(s["done"], F.concat(F.substr(now, F.lit(1), F.length(now) - 1), line)))
            .when(can_join(now, line), state(s["done"], F.concat_ws(" ", now, line)))
            .otherwise(state(push(s), line))
        )

    folded = F.aggregate(lines, start, step, push)
    # bound once, so that neither the fold nor the page markers among its lines are computed for each line
    bound = F.transform(F.array(folded), lambda lines: F.struct(lines.alias("lines"), F.filter(lines, lambda x: is_layout_noise(x) & (F.length(x) < 120)).alias("marks")))
    repeats = lambda s, x: F.size(F.filter(s["marks"], lambda y: y == x)) >= 3
    kept = F.transform(bound, lambda s: F.when(
        (F.size(s["lines"]) > 2) & (F.size(s["marks"]) >= 3), F.filter(s["lines"], lambda x: ~(is_layout_noise(x) & (F.length(x) < 120) & repeats(s, x)))).otherwise(s["lines"]))
    return F.trim(F.array_join(F.get(kept, F.lit(0)), "\n"))


def redact(text, limit: int = 500) -> Column:
    """Values after key, token, password or secret masked, then cut to ``limit`` characters."""
    masked = F.regexp_replace(col(text), r"(?i)((?:api[_-]?)?key|token|password|secret)[ \t]*[=:][ \t]*[^ \t\n,;]+", "$1=[REDACTED]")
    return F.substring(masked, 1, limit)


def excerpt(text, limit: int = 5000) -> Column:
    return F.substring(col(text), 1, limit)

"""Dates in text: candidate spellings, parsing with a status, and the best supported date of a document."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bound, col

# fixed values: month names and the source kinds that never date a document
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
TECHNICAL = ("technical_timestamp", "modified_metadata")
SPELLINGS = (
    r"20[0-9]{2}-[0-9]{2}-[0-9]{2}(?:[Tt][0-9:.+Zz-]+)?|20[0-9]{2}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/20[0-9]{2}|"
    rf"(?:{MONTHS})\s+[0-9]{{1,2}},?\s+20[0-9]{{2}}|[0-9]{{1,2}}\s+(?:{MONTHS})\s+20[0-9]{{2}}"
)
_LABEL = r"(?i)(?:issue|issued|publication|published|release|solicitation)\s*(?:date)?\s*[:\-]?\s*$"
_WORDED = ("MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy")


def _built(year, month, day) -> Column:
    return F.date_format(F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")


def parse(raw) -> Column:
    """A struct (iso, status) of a date's spelling: candidate, ambiguous (day and month could be swapped) or invalid."""
    iso, first_year, slashed = r"^(20[0-9]{2})-([0-9]{2})-([0-9]{2})", r"^(20[0-9]{2})/([0-9]{1,2})/([0-9]{1,2})$", r"^([0-9]{1,2})/([0-9]{1,2})/(20[0-9]{2})$"

    def date(value, both):
        part = lambda pattern, g: F.regexp_extract(value, pattern, g)
        swapped = F.when(part(slashed, 1).cast("int") <= 12, _built(part(slashed, 3), part(slashed, 1), part(slashed, 2))).otherwise(_built(part(slashed, 3), part(slashed, 2), part(slashed, 1)))
        worded = lambda capital: F.coalesce(*[F.date_format(F.try_to_date(capital, f), "yyyy-MM-dd") for f in _WORDED])
        return (
            F.when(value.rlike(iso), _built(part(iso, 1), part(iso, 2), part(iso, 3)))
            .when(value.rlike(first_year), _built(part(first_year, 1), part(first_year, 2), part(first_year, 3)))
            .when(both, F.lit(None).cast("string"))
            .when(value.rlike(slashed), swapped)
            .otherwise(bound(F.regexp_replace(F.initcap(value), r"\s+", " "), worded))
        )

    def result(both, date):
        return F.struct(date.alias("iso"), F.when(both, "ambiguous").when(date.isNull(), "invalid").otherwise("candidate").alias("status"))

    def status(value):
        small = lambda g: F.regexp_extract(value, slashed, g).cast("int") <= 12
        return bound(value.rlike(slashed) & small(1) & small(2), lambda both: bound(date(value, both), lambda found: result(both, found)))

    value = F.trim(col(raw))
    packed = F.regexp_replace(value, r"^D:(20[0-9]{2})([0-9]{2})([0-9]{2}).*$", "$1-$2-$3")
    return bound(F.when(value.rlike(r"^D:20[0-9]{6}"), packed).otherwise(value), status)


def candidates(text) -> Column:
    """All date spellings of a text in order: array of (raw, offset, kind, precedence); a label such as
    ``issue date:`` in the 48 characters before makes it labelled."""
    pattern = rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{SPELLINGS})(?![\p{{L}}\p{{N}}_])"
    text = col(text)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("raw"))
    start = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<raw:string,offset:int,kind:string,precedence:int>>))")

    def step(s, m):
        offset = s["at"] + F.length(m["gap"])
        before = F.substr(text, F.greatest(offset - 47, F.lit(1)), F.least(offset, F.lit(48)))
        labelled = before.rlike(_LABEL)
        found = F.struct(
            m["raw"].alias("raw"), offset.alias("offset"), F.when(labelled, "labeled_visible_text").otherwise("visible_text").alias("kind"),
            F.when(labelled, 2).otherwise(3).alias("precedence"),
        )
        return F.named_struct(
            F.lit("at"), offset + F.coalesce(F.length(m["raw"]), F.lit(0)),
            F.lit("out"), F.when(m["raw"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(found))),
        )

    return F.aggregate(zipped, start, step)["out"]


def select_document_date(dates: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, document_date, date_status) from rows (key, ord, iso, status, kind, precedence).

    The best precedence wins if its dates agree; an ambiguous date at least as good leaves none. Status
    is selected, selected_with_conflict (a lesser source disagrees), conflict, ambiguous, invalid or unavailable.
    """
    ok = ~F.col("kind").isin(*TECHNICAL)
    valid = ok & F.col("iso").isNotNull()
    ranked = valid & F.col("precedence").isNotNull()
    # more than one date is a least that is not the greatest: one aggregation, without sets and without a window
    out = dates.groupBy(key).agg(
        F.min(F.when(ok & (F.col("status") == "ambiguous"), F.col("precedence"))).alias("unsure"), F.min(F.when(ranked, F.struct("precedence", "iso"))).alias("low"),
        F.max(F.when(ranked, F.struct((-F.col("precedence")).alias("precedence"), "iso"))).alias("high"), F.min(F.when(valid, F.col("iso"))).alias("first"),
        F.max(F.when(valid, F.col("iso"))).alias("last"), F.count_if(ok & (F.col("status") == "invalid")).alias("bad"),
    )
    best = F.col("low.precedence")
    unsure = F.col("unsure").isNotNull() & (best.isNull() | (F.col("unsure") <= best))
    status = (
        F.when(unsure, "ambiguous").when(best.isNull() & (F.col("bad") > 0), "invalid").when(best.isNull(), "unavailable")
        .when(F.col("low.iso") != F.col("high.iso"), "conflict").when(F.col("first") != F.col("last"), "selected_with_conflict").otherwise("selected")
    )
    return out.select(key, status.alias("date_status"), F.when(status.startswith("selected"), F.col("low.iso")).alias("document_date"))

"""Line dedup: lines that recur across documents, returned as compressed keep bitmaps."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, lower_ascii, materialize, table

#: Documents in which a key must occur before its lines go, and its least length in code points.
MIN_DOCUMENTS, MIN_CHARS = 10, 1


def lines_of(text):
    """The lines of a whole text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line):
    return F.trim(line, F.lit(ASCII_SPACE))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, th, pos): a 96-bit hash of each counted line's key and where it stands."""
    text = lower_ascii(F.coalesce("text", F.lit("")))
    each = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")
    ).withColumn("line", _key(F.col("line")))
    return each.where(F.char_length("line") >= min_chars).select(
        F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), "doc_id", "th", "pos"
    )


def keep_bitmaps(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, keep: str = "none") -> DataFrame:
    """(doc_id, th, words): which lines stay, as compressed bitmaps: bit pos % 64 of word pos / 64 is set
    where the line at pos stays. Words in which all lines stay, and documents without any other word,
    are left out.

    A key in at least ``min_documents`` documents loses its lines: all of them with keep="none", all
    but the first by (doc_id, position) with keep="first". The hashes are dealt out by range over (hash,
    document) and sorted by position within, which splits a key that a third of all lines carry over many
    tasks. Each task streams through its sorted range and passes on one row for each key it holds: its
    documents there and its first place; a key whose documents lie beyond a border of ranges has a row
    from each, and these are added up. No text moves.
    """
    if keep not in ("none", "first"):
        raise ValueError(keep)
    occ = materialize(occurrences(docs, min_chars), "lines")
    frequent = materialize(frequent_keys(occ, min_documents), "frequent")
    gone = occ.join(frequent, ["h1", "h2"])
    if keep == "first":
        gone = gone.where(~F.col("first").eqNullSafe(F.struct("doc_id", "th", "pos")))
    stays = F.expr("~bit_or(shiftleft(1L, pos % 64))").alias("bits")
    words = gone.groupBy("doc_id", "th", F.expr("pos div 64").cast("int").alias("word")).agg(stays)
    return words.groupBy("doc_id", "th").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def frequent_keys(occ: DataFrame, min_documents: int) -> DataFrame:
    """(h1, h2, first) of the keys in at least so many documents, first the least (doc_id, th, pos)."""
    parts = int(occ.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_document = ["h1", "h2", "doc_id", "th"]
    ranged = occ.repartitionByRange(parts, *of_document)
    # the window sorts each range by hash, document and position and streams through it; since the range keeps a
    # key's lines of one document together, it takes no further exchange, and the counts follow in its order
    place = F.row_number().over(Window.partitionBy(*of_document).orderBy("pos"))
    once = ranged.withColumn("place", place).where("place = 1").drop("place")
    counted = once.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos")).alias("first"))
    return counted.where(F.col("n") >= min_documents).select("h1", "h2", "first")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, **columns) -> DataFrame:
    """``docs`` with ``columns`` added, each a function of (text, words): the document's text and its
    bitmap, null where it has none. Columns of ``docs`` may have any names; those added replace equal ones."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    key = {"no_id": F.col(doc_id).isNull(), "id": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), "th": F.xxhash64(text)}
    held = bitmaps.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "th", "words")
    both = docs.toDF(*names).withColumns(key).join(held, list(key), "left")
    made = {f"m{i}": make(F.col(text), F.col("words")) for i, make in enumerate(columns.values())}
    kept = [F.col(a).alias(b) for a, b in zip(names, docs.columns) if b not in columns]
    # two steps, so that no new name is taken for one that a function reads
    return both.withColumns(made).select(*kept, *[F.col(m).alias(n) for m, n in zip(made, columns)])


def kept_text(text, words):
    """The text without dropped lines; null and empty texts are one empty line."""
    mask = lambda i: F.coalesce(F.try_element_at(words, F.floor(i / 64).cast("int")), F.lit(-1).cast("long"))
    stays = F.filter(lines_of(text), lambda _, i: F.getbit(mask(i), F.pmod(i, F.lit(64))) == 1)
    return F.when(words.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(stays, "\n"))


def dropped(text, words):
    return F.when(words.isNull(), F.lit(0).cast("long")).otherwise(
        F.aggregate(F.map_values(words), F.lit(0).cast("long"), lambda a, w: a + 64 - F.bit_count(w))
    )


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``text`` replaced by its kept lines joined by newlines and ``n_lines``, ``n_dropped`` added.

    A line's key is the line stripped of ASCII white space with A-Z lowered. A document is what has one
    doc_id and one text: repeated rows are one document, and each row of it gets the same lines; rows that
    share an id but not their text are several. Null doc_id: an id like any other. Null or empty text: one
    empty line, whose key is too short to count, so the result is an empty text. Further columns pass
    through; columns called n_lines or n_dropped are replaced. An empty table gives no rows.
    """
    out = apply_bitmaps(
        docs, keep_bitmaps(docs, **options), text=kept_text, n_lines=lambda t, _: F.size(lines_of(t)).cast("long"), n_dropped=dropped
    )
    return out.select(*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents", "doc_id"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '') AS d FROM documents),
lines AS (
  SELECT r, d, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
keyed AS (
  SELECT r, d, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT d) >= 10),
marked AS (SELECT keyed.*, frequent.k IS NOT NULL AS gone FROM keyed LEFT JOIN frequent USING (k)),
kept AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
  FROM marked GROUP BY r)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM docs JOIN kept USING (r)
"""

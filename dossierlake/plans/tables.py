"""The given tables under the engine's names, and SQL fragments that the oracles share."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..operators.retrieval import Postings
from ..sources.scratch import spread


#: Tables whose rows are texts or vectors, by their key: even a small file of these is worth all cores.
_WIDE = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "embeddings": "vec_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, _WIDE[name]) if name in _WIDE else rows


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as index records: source is the bid, language the type, label rows are diagnostics."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("record_id"), F.col("source").alias("bid_id"), F.col("lang").alias("doc_type"), F.coalesce("text", F.lit("")).alias("text"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(".html")).alias("source_file"), F.lit(1).alias("page_number"), F.lit(None).cast("int").alias("addendum_number"),
        F.lit(None).cast("string").alias("document_date"), F.lit("current").alias("status"),
    )


_postings: dict[tuple, Postings] = {}


def postings(spark: SparkSession, sf_dir: str) -> Postings:
    """The stored postings of ``records``: built when a corpus is first searched, as an index is, and anew when
    its files change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files = [fs.getFileStatus(path), *fs.listStatus(path)]
    key = (spark.sparkContext.applicationId, sf_dir, *((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))
    if key not in _postings:
        _postings[key] = Postings.of(records(spark, sf_dir)).stored()
    return _postings[key]


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN}')"


def values(rows: list[tuple], names: str) -> str:
    """A VALUES list under a name, for SQL and rows alike."""

    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") AS t({names})"


#: Words of four languages that the documents hold, and an identifier that they do not.
QUERIES = [
    (1, "the and that with"), (2, "le la de que pour"), (3, "und der die enge"), (4, "the of est delivery"), (5, "para osmente de los"), (6, "no such zx-210 identifier"),
]
EXPANSION_QUERIES = [
    (1, "What is the deadline"), (2, "latest due date for RFP 1234"), (3, "Warranty and support"), (4, "pricing of item X-99"), (5, "current closing date BID-7A"), (6, "nothing here"),
    (7, "evaluation requirements"), (8, "Delivery quantity"), (9, "deadlines only"),
]

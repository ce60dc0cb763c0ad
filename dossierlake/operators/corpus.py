"""The indexed corpus and its vectors, kept up to date by comparing scope fingerprints."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import fingerprint, record_id, scope_id
from ..session import ship
from ..sources.store import VersionedStore

RECORDS = (
    "record_id string, chunk_id string, scope_id string, content_fingerprint string, text string, bid_id string, source_file string, page_number int, section_title string, "
    "doc_type string, addendum_number int, document_date string, source_locator string, diagnostic_ids array<string>, status string, content_kind string"
)
VECTORS = "record_id string, scope_id string, content_fingerprint string, vector array<double>, model string, dimension int, normalize boolean"


class EmbeddingProvider(Protocol):
    model_name: str
    dimension: int
    normalize: bool

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class EmbeddingUnavailable(RuntimeError):
    """No embeddings can be had now; searches fall back to keywords."""


class VectorIndexError(RuntimeError):
    """The stored vectors do not fit the provider or the corpus."""


def scope_changes(old: DataFrame, new: DataFrame, key: str = "scope_id", value: str = "fingerprint") -> DataFrame:
    """(key, state) over the scopes of both sides: new, changed, unchanged or deleted."""
    o, n = old.select(key, F.col(value).alias("_o")), new.select(key, F.col(value).alias("_n"))
    state = (
        F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "deleted").when(F.col("_o") == F.col("_n"), "unchanged").otherwise("changed")
    )
    return o.join(n, key, "full_outer").select(key, state.alias("state"))


def change_counts(changes: DataFrame) -> DataFrame:
    s = F.col("state")
    return changes.agg(
        F.count_if(s.isin("new", "changed")).alias("indexed"), F.count_if(s == "unchanged").alias("skipped"), F.count_if(s == "changed").alias("replaced"),
        F.count_if(s == "deleted").alias("removed"), F.count("*").alias("scopes"))


def index_records(chunks: DataFrame) -> DataFrame:
    """Corpus rows of chunks: scope and content fingerprints and record ids; blank texts are left out."""
    c = chunks.where(F.trim("text") != "").withColumn("scope_id", scope_id("bid_id", "source_file"))
    c = c.withColumn("content_fingerprint", fingerprint(("text", "text"), ("section", "section_title"), ("page", "page_number")))
    c = c.withColumn("record_id", record_id("scope_id", "chunk_id", "content_fingerprint"))
    return c.select(*[F.col(n) if n in c.columns else (F.lit("current") if n == "status" else F.lit(None)).cast(t).alias(n) for n, t in (x.split(" ", 1) for x in RECORDS.split(", "))])


def usable_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with text whose document was parsed, in full or in part."""
    good = documents.where(F.col("status").isin("parsed", "partial")).select("document_id")
    return chunks.where(F.trim("text") != "").join(good, "document_id", "left_semi")


def scope_fingerprints(records: DataFrame) -> DataFrame:
    """(scope_id, fingerprint): one hash over the content of each scope, whatever the order of its rows."""
    each = records.select("scope_id", F.xxhash64("chunk_id", "content_fingerprint").cast("decimal(20,0)").alias("h"))
    return each.groupBy("scope_id").agg(F.sha2(F.concat_ws(":", F.sum("h").cast("string"), F.count("*").cast("string")), 256).alias("fingerprint"))


class Index:
    """Incremental corpus: unchanged scopes keep their rows, changed ones are replaced, missing ones go
    unless they are to be preserved; bids that a request does not name are untouched. An update rewrites
    the buckets of bids with a changed scope and no others."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, VersionedStore(spark, root, RECORDS, key="bid_id")

    def records(self) -> DataFrame:
        return self.store.load().where("status = 'current'")

    def update(self, records: DataFrame, full_rebuild: bool = False, preserve: DataFrame | None = None, scopes: DataFrame | None = None) -> dict:
        """Commit a new version; the counts of what happened to the scopes. A failure leaves the old version.
        ``scopes(scope_id)``: the only ones that are compared, all others stay as they are."""
        with self.store.locked():
            named = self.store.buckets_of(records)
            old = self.store.load(None if full_rebuild else named)
            bids = records.select("bid_id").distinct()
            same = old if full_rebuild else old.join(bids, "bid_id", "left_semi")
            if scopes is not None:
                same = same.join(scopes.select("scope_id"), "scope_id", "left_semi")
            changes = scope_changes(scope_fingerprints(same), scope_fingerprints(records))
            if preserve is not None:
                changes = changes.join(preserve.select("scope_id"), "scope_id", "left_anti")
            counts = change_counts(changes).first().asDict()
            if full_rebuild:
                self.store.commit(records)
                return counts
            gone = changes.where("state in ('changed', 'deleted')").select("scope_id")
            fresh = records.join(changes.where("state in ('new', 'changed')").select("scope_id"), "scope_id", "left_semi")
            touched = sorted({*self.store.buckets_of(fresh), *self.store.buckets_of(old.join(gone, "scope_id", "left_semi"))})
            if touched:
                kept = self.store.load(touched).join(gone, "scope_id", "left_anti")
                self.store.commit(kept.unionByName(fresh), touched)
            return counts

    def rollback(self) -> str:
        """Point at the version before the current one."""
        names = self.store.versions()
        before = names[names.index(self.store.current()) - 1] if self.store.current() in names[1:] else None
        if before is None:
            raise LookupError("there is no earlier version")
        self.store.point(before)
        return before


def embed(records: DataFrame, provider: EmbeddingProvider, batch: int = 32) -> DataFrame:
    """(record_id, scope_id, content_fingerprint, vector, ...) of non-blank records through a provider, in batches."""
    ship(records.sparkSession)
    model, dimension, normalize = provider.model_name, provider.dimension, provider.normalize

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                vectors = [[float(x) for x in v] for v in provider.embed(part["text"].tolist())]
                if any(len(v) != dimension for v in vectors):
                    raise VectorIndexError(f"{model} gave a vector that is not {dimension} long")
                yield part.drop(columns="text").assign(vector=vectors, model=model, dimension=dimension, normalize=normalize)

    return records.where(F.trim("text") != "").select("record_id", "scope_id", "content_fingerprint", "text").mapInPandas(run, VECTORS)


class VectorStore:
    """Vectors of the corpus: only changed scopes are embedded anew; another model or dimension is refused."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, VersionedStore(spark, root, VECTORS, key="record_id")

    def load(self, provider: EmbeddingProvider | None = None) -> DataFrame:
        vectors = self.store.load()
        if provider is not None:
            other = vectors.where(
                (F.col("model") != provider.model_name) | (F.col("dimension") != provider.dimension) | (F.col("normalize") != provider.normalize)).limit(1).count()
            if other:
                raise VectorIndexError("the stored vectors come from another model")
        return vectors

    def update(self, records: DataFrame, provider: EmbeddingProvider, full_rebuild: bool = False) -> dict:
        """Embed new and changed records; only the buckets that hold them or records that went are rewritten."""
        with self.store.locked():
            old = self.store.load().limit(0) if full_rebuild else self.load(provider)
            pair = lambda d: d.select(F.col("record_id").alias("scope_id"), F.col("content_fingerprint").alias("fingerprint")).distinct()
            changes = scope_changes(pair(old), pair(records.where(F.trim("text") != "")))
            counts = change_counts(changes).first().asDict()
            fresh = records.join(changes.where("state in ('new', 'changed')").select(F.col("scope_id").alias("record_id")), "record_id", "left_semi")
            gone = changes.where("state in ('changed', 'deleted')").select(F.col("scope_id").alias("record_id"))
            empty = records.where(F.coalesce(F.trim("text"), F.lit("")) == "").count()
            touched = None if full_rebuild else self.store.buckets_of(changes.where("state <> 'unchanged'"), "scope_id")
            if touched is None or touched:
                kept = old if full_rebuild else self.store.load(touched).join(gone, "record_id", "left_anti")
                self.store.commit(kept.unionByName(embed(fresh, provider)), touched)
        return {"embedded": counts["indexed"], "unchanged": counts["skipped"], "replaced": counts["replaced"], "removed": counts["removed"], "skipped_empty": empty}


def sync(store: VectorStore, records: DataFrame, provider: EmbeddingProvider) -> dict:
    """An update whose failure is a result; the old vectors stay."""
    try:
        return {"status": "completed", **store.update(records, provider)}
    except Exception as e:
        return {"status": "failed", "error": f"{type(e).__name__}: {e}"}


def readiness(vectors: DataFrame, records: DataFrame) -> DataFrame:
    """Records whose vector is missing, left over or stale: no rows, if the store is ready."""
    v = vectors.select("record_id", F.col("content_fingerprint").alias("_v"))
    r = records.select("record_id", F.col("content_fingerprint").alias("_r"))
    both = v.join(r, "record_id", "full_outer").where(~F.col("_v").eqNullSafe(F.col("_r")))
    return both.select("record_id", F.when(F.col("_v").isNull(), "missing").when(F.col("_r").isNull(), "left_over").otherwise("stale").alias("state"))


class HashEmbedding:
    """Deterministic provider for tests: bytes of the text's SHA-256 over 255."""

    model_name, normalize = "sha256", False

    def __init__(self, dimension: int = 8):
        if not 1 <= dimension <= 32:
            raise ValueError("dimension is from 1 to 32")
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        import hashlib

        if any(not t.strip() for t in texts):
            raise EmbeddingUnavailable("blank text")
        return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[: self.dimension]] for t in texts]


def with_scorer(scorer: Callable[[str, str], float]) -> Callable[[str, str], float]:
    """A scorer whose failures and non-finite results count as 0."""

    def safe(q: str, t: str) -> float:
        try:
            x = float(scorer(q, t))
        except (TypeError, ValueError):
            return 0.0
        return x if abs(x) < float("inf") else 0.0

    return safe

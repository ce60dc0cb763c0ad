"""Requests as a service takes them: checked on the driver, answered by the operators, long ones as jobs."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import corpus, extract, retrieval, views, workflow


@dataclass(frozen=True)
class Request:
    """A request for extraction or an answer. Unknown filters, no bids, blank goals and folders that were not
    submitted for its bids are refused."""

    mode: str
    bid_ids: tuple[str, ...]
    goal: str = "all fields"
    filters: dict = field(default_factory=dict)
    folders: tuple[str, ...] = ()
    root: str | None = None

    def __post_init__(self):
        if self.mode not in ("extraction", "qa") or not self.bid_ids or any(not b.strip() for b in self.bid_ids):
            raise ValueError("mode or bid_ids is not valid")
        if self.mode == "qa" and not self.goal.strip():
            raise ValueError("a question has text")
        workflow.validate_filters(self.filters)
        if self.folders:
            workflow.authorize_folders(list(self.bid_ids), list(self.folders), self.root or "")


class Service:
    """The corpus, its vectors and the runs over them. ``refresh`` reads the current version; until then a run
    sees the version it began with."""

    def __init__(self, spark: SparkSession, config: Config, provider: workflow.ModelProvider | None = None, embedder: corpus.EmbeddingProvider | None = None):
        self.spark, self.config, self.provider, self.embedder = spark, config, provider, embedder
        self.index, self.vectors = corpus.Index(spark, config.index), corpus.VectorStore(spark, config.vectors)
        self.jobs = workflow.Jobs(config.workers, config.job_limit)
        self.refresh()

    def refresh(self) -> None:
        self.records = self.index.records()
        self.version = self.index.store.current()

    def status(self) -> dict:
        """Whether there is a corpus, whether the records read are its current version, and whether vectors fit."""
        stale = self.embedder is not None and corpus.readiness(self.vectors.load(), self.records).limit(1).count() > 0
        return {"ready": self.version is not None, "current": self.version == self.index.store.current(), "vectors_ready": self.embedder is not None and not stale}

    def run(self, request: Request) -> dict:
        state = workflow.run(self.records, request.mode, request.goal, list(request.bid_ids), self.config.max_retries, request.filters, provider=self.provider)
        return workflow.qa_response(state) if request.mode == "qa" else workflow.extraction_response(state)

    def submit(self, request: Request) -> str:
        return self.jobs.submit(lambda: self.run(request))

    def search(self, requests: list[dict]) -> DataFrame:
        """Ranked evidence of a batch of search requests, each within its own filters, all in one plan for each
        filter. A request's ``top_k`` None means all that match."""
        found = None
        for key, some in _by_filter(requests).items():
            bids, doc_type, addendum, incomplete, top_k = key
            scope = retrieval.filter_records(self.records, list(bids) or None, doc_type, addendum, incomplete)
            plain = [{**r, "top_k": r.get("top_k") or 5} for r in some]
            out = retrieval.search(scope, retrieval.make_queries(self.spark, plain), top_k=top_k)
            found = out if found is None else found.unionByName(out)
        return found

    def views(self, request: Request) -> DataFrame:
        """A reader's rows of an extraction: canonical fields, and the agent's where the record has none of that name."""
        state = workflow.run(self.records, request.mode, request.goal, list(request.bid_ids), self.config.max_retries, request.filters, provider=self.provider)
        agent = state["agent"].where("verdict = 'passed' and value is not null").select("bid_id", "field", "value", "status")
        canonical = state["fields"]
        extra = agent.withColumns({"ordinal": F.lit(100), "items": F.expr(f"cast(null as array<{extract.ITEM}>)"), "citations": F.lit(None).cast(canonical.schema["citations"].dataType)})
        return views.field_views(views.merged_fields(canonical, extra))


def _by_filter(requests: list[dict]) -> dict[tuple, list[dict]]:
    out: dict[tuple, list[dict]] = {}
    for i, r in enumerate(requests):
        f = r.get("filters") or {}
        bids = f.get("bid_id") or ()
        key = (tuple([bids] if isinstance(bids, str) else bids), f.get("doc_type"), f.get("addendum_number"), bool(r.get("include_incomplete")), r.get("top_k", 5))
        out.setdefault(key, []).append({"query_id": i, **r})
    return out

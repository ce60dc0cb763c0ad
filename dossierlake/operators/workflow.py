"""The analysis workflow on the driver: plan, retrieve, extract, reconcile, validate with retries, report.

Every step is a DataFrame operator over all bids and fields at once; the loop only decides whether
rejected rows are retrieved once more.
"""
from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from . import answers, evaluation, extract, qa, registry, retrieval

VERSION = "1"
# fixed values: the contract of requests and goals
DOC_TYPES = ("bid_page", "rfp", "addendum", "specs", "affidavit", "supporting", "unknown")
FILTER_KEYS = ("doc_type", "addendum_number", "include_incomplete")
BROAD_GOALS = ("all fields", "everything", "full extraction", "complete extraction", "all requirements")
SECRET = re.compile(r"(?i)((?:api[_-]?)?key|token|password|secret)(\s*[=:]\s*)\S+")
HIDDEN_KEYS = ("content", "prompt", "api_key", "authorization", "password", "token", "secret")


class ModelProvider(Protocol):
    def extract_fields(self, evidence: list[dict], field_names: list[str]) -> dict[str, Any]: ...

    def generate_report(self, question: str, claims: list[dict], fallback: str) -> str: ...


class DeterministicProvider:
    """Proposes nothing and repeats the composed answer."""

    def extract_fields(self, evidence: list[dict], field_names: list[str]) -> dict[str, Any]:
        return {}

    def generate_report(self, question: str, claims: list[dict], fallback: str) -> str:
        return fallback


def build_plan(mode: str, goal: str, bid_ids: list[str]) -> dict:
    """Field groups that a goal asks for: all for a broad goal, else those whose phrases it holds; what
    matches nothing is listed as unsupported."""
    if mode not in ("extraction", "qa"):
        raise ValueError(f"mode {mode}")
    if not bid_ids:
        raise ValueError("no bids")
    low = goal.lower()
    keys = {f[5]: f[0] for f in registry.FIELDS if f[5]}
    wanted = [k for k, fid in keys.items() if any(re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low) for t in registry.ALIASES[fid].split("|"))]
    if any(b in low for b in BROAD_GOALS) or not goal.strip():
        wanted = list(keys)
    groups = {g: [k for k in members if k in wanted] for g, members in registry.AGENT_GROUPS.items()}
    parts = [p.strip() for p in re.split(r",|;|\band\b", low) if p.strip()]
    known = [t for k in wanted for t in registry.ALIASES[keys[k]].split("|")]
    unsupported = [] if mode == "qa" or wanted == list(keys) else [p for p in parts if not any(t in p for t in known)]
    return {"mode": mode, "groups": {g: m for g, m in groups.items() if m}, "fields": wanted, "bid_ids": list(bid_ids), "unsupported": unsupported}


def validate_filters(filters: dict) -> dict:
    unknown = set(filters) - set(FILTER_KEYS)
    if unknown:
        raise ValueError(f"unknown filters {sorted(unknown)}")
    if filters.get("doc_type") is not None and filters["doc_type"] not in DOC_TYPES:
        raise ValueError("doc_type")
    if filters.get("addendum_number") is not None and int(filters["addendum_number"]) < 1:
        raise ValueError("addendum_number")
    return filters


def safe_summary(value: Any, limit: int = 500) -> Any:
    """What a trace may hold: secrets masked, texts cut, content left out, collections bounded."""
    if isinstance(value, str):
        return SECRET.sub(r"\1=[REDACTED]", value)[:limit]
    if isinstance(value, dict):
        return {str(k): safe_summary(v) for k, v in list(value.items())[:30] if str(k).lower() not in HIDDEN_KEYS}
    if isinstance(value, (list, tuple)):
        return [safe_summary(v) for v in value[:20]]
    return value if value is None or isinstance(value, (int, float, bool)) else str(value)[:limit]


#: Keys that the payload of a message must have, by its type.
PAYLOADS = {
    "plan": ("mode", "groups", "bid_ids"), "evidence": ("count",), "rejection": ("reason",), "workflow_handoff": ("node",),
}


@dataclass
class Message:
    """A handoff between steps; ``check`` rejects another version, sender, recipient or run, and payloads that
    are of no known type or lack a key of theirs."""

    run_id: str
    sender: str
    recipient: str
    payload_type: str
    payload: dict
    version: str = VERSION
    task_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])

    def check(self, run_id: str, sender: str, recipient: str) -> Message:
        if (self.version, self.run_id, self.sender, self.recipient) != (VERSION, run_id, sender, recipient):
            raise ValueError("invalid_message")
        missing = [k for k in PAYLOADS.get(self.payload_type, ("",)) if k not in self.payload]
        if missing:
            raise ValueError(f"invalid_message: {self.payload_type} without {missing}")
        return self

    def rejected(self, reason: str) -> Message:
        """The answer to a message that cannot be accepted."""
        return Message(self.run_id, self.recipient, self.sender, "rejection", {"reason": reason}, task_id=self.task_id)


class Trace:
    """Events of a run, written as rows."""

    def __init__(self, run_id: str):
        self.run_id, self.events = run_id, []

    def event(self, node: str, name: str, status: str = "ok", **details: Any) -> None:
        self.events.append((self.run_id, len(self.events), node, name, status, json.dumps(safe_summary(details), default=str), time.time()))

    def tool(self, name: str, call: Callable[[], Any], **details: Any) -> Any:
        began = time.perf_counter()
        try:
            out = call()
        except Exception as e:
            self.event("tool", name, "failed", error=str(e), ms=round(1000 * (time.perf_counter() - began), 3), **details)
            raise
        self.event("tool", name, ms=round(1000 * (time.perf_counter() - began), 3), **details)
        return out

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.events, "run_id string, seq int, node string, event string, status string, details string, at double")


#: Groups of fields whose result others wait for; groups run on so many threads.
GROUP_NEEDS = {"compliance": ("submission",)}
GROUP_WORKERS = 4
#: Records of one bid that a model provider is shown for a group.
PROVIDER_EVIDENCE = 50


def run_groups(groups: dict[str, list[str]], work: Callable[[str, list[str]], Any], needs: dict[str, tuple] = GROUP_NEEDS, workers: int = GROUP_WORKERS) -> tuple[dict[str, Any], dict[str, str]]:
    """({group: result}, {group: error}): each group starts once those it needs are done; one whose needs
    failed, are circular or are not there counts as failed, and no other is held up by it."""
    results, errors, waiting = {}, {}, dict(groups)
    needed = {g: [n for n in needs.get(g, ()) if n in groups] for g in groups}
    with ThreadPoolExecutor(max(1, min(workers, len(groups) or 1))) as pool:
        while waiting:
            for g in [g for g in waiting if any(n in errors for n in needed[g])]:
                errors[g] = "a group that it needs failed"
                del waiting[g]
            ready = [g for g in waiting if all(n in results for n in needed[g])]
            if not ready:
                errors.update({g: "its needs cannot be met" for g in waiting})
                break
            started = {g: pool.submit(work, g, waiting.pop(g)) for g in ready}
            for g, future in started.items():
                try:
                    results[g] = future.result()
                except Exception as e:
                    errors[g] = f"{type(e).__name__}: {e}"
    return results, errors


def field_queries(spark: SparkSession, fields: list[str]) -> DataFrame:
    """One query for each field, of all its phrases: (query_id, query), numbered in the given order."""
    ids = {f[5]: f[0] for f in registry.FIELDS if f[5]} | {f[1]: f[0] for f in registry.FIELDS if f[1]}
    rows = [(i, registry.ALIASES[ids[name]].replace("|", " ")) for i, name in enumerate(fields)]
    return spark.createDataFrame(rows, "query_id long, query string")


def retrieve(scope: DataFrame, fields: list[str], limit: int | None = None) -> DataFrame:
    """(field, and the columns of the records): the evidence of every field in one plan, best first by ``rank``;
    without a limit all that holds a word of its phrases."""
    names = scope.sparkSession.createDataFrame(list(enumerate(fields)), "query_id long, field string")
    found = retrieval.keyword_candidates(scope, field_queries(scope.sparkSession, fields), limit)
    return found.join(F.broadcast(names), "query_id").select("field", "record_id", "rank").join(scope, "record_id")  # a row for each field


def propose(provider: ModelProvider, evidence: DataFrame, fields: list[str], trace: Trace) -> DataFrame:
    """(bid_id, field, value, record_id): what a provider proposes for the fields of each bid and a passage it
    was shown supports. It is shown the best PROVIDER_EVIDENCE passages of a bid."""
    from pyspark.sql import Window

    w = Window.partitionBy("bid_id").orderBy("rank", "record_id")
    shown = evidence.where(F.col("field").isin(fields)).dropDuplicates(["bid_id", "record_id"]).withColumn("n", F.row_number().over(w)).where(F.col("n") <= PROVIDER_EVIDENCE)
    by_bid: dict[str, list[dict]] = {}
    for r in shown.select("bid_id", "record_id", "text").collect():  # bounded by the bids of the request
        by_bid.setdefault(r.bid_id, []).append(r.asDict())
    rows = []
    for bid, passages in sorted(by_bid.items()):
        values = trace.tool("extract_fields", lambda passages=passages: provider.extract_fields(passages, fields), bid=bid)
        if not isinstance(values, dict):
            raise TypeError("the provider's result is no mapping")
        rows += [(bid, k, str(v)) for k, v in values.items() if k in fields and v is not None]
    spark = evidence.sparkSession
    proposed = spark.createDataFrame(rows, "bid_id string, field string, proposal string")
    held = proposed.join(shown.select("bid_id", "record_id", "text"), "bid_id").where(extract.supported_proposal("proposal", "text"))
    return held.groupBy("bid_id", "field").agg(F.min("proposal").alias("value"), F.min("record_id").alias("record_id"))


def validate(fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds to fields (bid_id, field, value, record_id, status): format_valid, evidence_supported, consistent,
    verdict (passed, review_required or rejected), reason, retry (rejected, so worth another retrieval).

    A value must have its form, stand in its cited passage or in another spelling there, and a bid bond must
    not contradict a requirement that says none is needed. A field that was not found is accepted.
    """
    texts = evidence.select(F.col("record_id").alias("_r"), F.col("text").alias("_t")).dropDuplicates(["_r"])
    none = fields.where("field = 'mandatory_requirements'").where(F.lower("value").contains("no bond required")).select("bid_id", F.lit(True).alias("_none")).distinct()
    f = fields.join(texts, F.col("record_id") == F.col("_r"), "left").join(none, "bid_id", "left")
    has = F.col("value").isNotNull()
    form = F.when(has, F.coalesce(extract.valid_format("field", "value"), F.lit(False))).otherwise(True)
    held = has & F.coalesce(extract.supported_proposal("value", "_t"), F.lit(False))
    consistent = ~(has & (F.col("field") == "bid_bond") & F.coalesce("_none", F.lit(False)))
    f = f.withColumns({"format_valid": form, "evidence_supported": held, "consistent": consistent})
    good = (has & form & held & consistent & (F.col("status") == "supported")) | (~has & (F.col("status") == "not_found"))
    verdict = F.when(good, "passed").when(F.col("status") == "review_required", "review_required").otherwise("rejected")
    reason = F.when(good, F.lit(None)).when(~form, "invalid field value or unit").when(~held, "cited evidence does not support the value").when(
        ~consistent, "field conflicts with another requirement").otherwise("field failed validation")
    return f.withColumns({"verdict": verdict, "reason": reason}).withColumn("retry", F.col("verdict") == "rejected").drop("_r", "_t", "_none")


def ensure_index(index, bid_ids: list[str], ingest: Callable[[list[str]], DataFrame] | None = None) -> dict:
    """Which of the bids the corpus holds; those it lacks are ingested, if it is said how, and compared again."""
    def held() -> set[str]:
        wanted = index.spark.createDataFrame([(b,) for b in bid_ids], "bid_id string")
        return {r.bid_id for r in index.records().select("bid_id").join(F.broadcast(wanted), "bid_id", "left_semi").distinct().collect()}  # bids of one request

    have = held()
    missing = [b for b in bid_ids if b not in have]
    if missing and ingest is not None:
        index.update(ingest(missing))
        have = held()
    return {"ready": [b for b in bid_ids if b in have], "missing": [b for b in bid_ids if b not in have]}


class Failed(RuntimeError):
    """A step failed; the run's state holds the step and the reason."""


def node(trace: Trace, name: str, operation: Callable[[], Any], message: Message | None = None) -> Any:
    """Run a step within its boundary: the handoff is checked first, start and end are traced, and a failure
    is raised as one of the step."""
    try:
        if message is not None:
            message.check(trace.run_id, message.sender, name)
        trace.event(name, "start")
        out = operation()
    except Exception as e:
        trace.event(name, "failed", "failed", error=str(e))
        raise Failed(f"{name}: {type(e).__name__}: {e}") from e
    trace.event(name, "end")
    return out


def run(
    records: DataFrame, mode: str, goal: str, bid_ids: list[str], max_retries: int = 2, filters: dict | None = None, trace: Trace | None = None,
    provider: ModelProvider | None = None,
) -> dict:
    """One run over the bids: for extraction the reconciled and validated fields, for a question the composed
    answer with its claims. A failed step gives a state with status failed and what failed.

    ``provider`` proposes values for the agent's fields and may word an answer; what it says counts only
    where evidence supports it, and without one all is deterministic.
    """
    trace, provider = trace or Trace(uuid.uuid4().hex), provider or DeterministicProvider()
    state: dict = {"run_id": trace.run_id, "status": "completed", "diagnostics": [], "trace": trace}
    try:
        state["plan"] = plan = node(trace, "planner", lambda: build_plan(mode, goal, bid_ids))
        filters = validate_filters(filters or {})
        handoff = Message(trace.run_id, "planner", "retrieval", "plan", plan)
        scope = node(trace, "retrieval", lambda: retrieval.filter_records(
            records, bids=bid_ids, doc_type=filters.get("doc_type"), addendum=filters.get("addendum_number"), include_incomplete=bool(filters.get("include_incomplete"))), handoff)
        state |= _answered(scope, goal, provider, trace) if mode == "qa" else _extracted(records, scope, goal, plan, max_retries, provider, trace)
    except Failed as e:
        state |= {"status": "failed", "diagnostics": [*state["diagnostics"], {"code": "node_failed", "message": str(e), "severity": "error"}]}
    return state


#: Passages that a question is answered from; all that match, where it asks for everything of a kind.
QA_TOP_K, ALL_OF = 10, ("all ", "list ", "every", "compare", "addend", "amend")


def _answered(scope: DataFrame, goal: str, provider: ModelProvider, trace: Trace) -> dict:
    spark = scope.sparkSession
    questions = retrieval.make_queries(spark, [{"text": goal, "query_id": 1}])
    top_k = None if any(w in goal.lower() for w in ALL_OF) else QA_TOP_K
    found = node(trace, "evidence", lambda: retrieval.search(scope, questions, top_k=top_k))
    said = node(trace, "report", lambda: qa.compose(questions, found).first())
    text, diagnostics = said.answer, []
    if said.found and not isinstance(provider, DeterministicProvider):
        try:
            text = trace.tool("generate_report", lambda: provider.generate_report(goal, [c.asDict() for c in said.citations], said.answer))
        except Exception as e:  # the composed answer stands
            diagnostics.append({"code": "report_generation_fallback", "message": f"{type(e).__name__}; deterministic answer returned", "severity": "warning"})
    best = answers.relevant(found).withColumn("rank", F.row_number().over(_by_rank()))
    return {"evidence": best, "answer": answers.top_answer(best), "composed": {**said.asDict(), "answer": text}, "diagnostics": diagnostics}


def _extracted(records: DataFrame, scope: DataFrame, goal: str, plan: dict, max_retries: int, provider: ModelProvider, trace: Trace) -> dict:
    # small tables, a row for each field of a bid: written once, since the steps below read them again and again
    base = node(trace, "extraction", lambda: materialize(extract.extract(scope.where(~extract.is_addendum_evidence())), "fields"))
    changes = node(trace, "reconciliation", lambda: materialize(extract.reconcile_scalars(base, extract.update_candidates(scope)), "changes"))
    fields = materialize(final_fields(base, changes), "fields")
    # what the base documents of the request do not give, incomplete records of its bids and then addenda may
    wider = [lambda: records.where(F.col("bid_id").isin(plan["bid_ids"])).where(~extract.is_addendum_evidence()), lambda: records.where(F.col("bid_id").isin(plan["bid_ids"]))]
    retried = 0
    for attempt in range(max_retries):
        missing = fields.where("status = 'not_found'").select("bid_id", "field")
        if not missing.limit(1).count():
            break
        trace.event("validator", "retry_scheduled", attempt=attempt + 1)
        retried += 1
        again = materialize(extract.extract(wider[min(attempt, len(wider) - 1)]()).join(missing, ["bid_id", "field"], "left_semi").where("status = 'supported'"), "again")
        if again.limit(1).count():
            fields = materialize(fields.join(again.select("bid_id", "field"), ["bid_id", "field"], "left_anti").unionByName(again.select(*fields.columns)), "fields")
        elif attempt + 1 >= len(wider):
            trace.event("validator", "retry_exhausted")
            break
    agent, diagnostics = agent_record(scope, plan, goal, provider, trace)
    status = {r.status for r in fields.select("status").distinct().collect()} | ({"review_required"} if diagnostics else set())
    return {
        "fields": fields, "changes": changes, "agent": agent, "summary": extract.summary(fields), "validation": extract.validation_summary(fields), "diagnostics": diagnostics, "retries": retried,
        "status": "review_required" if "review_required" in status else "partial" if "not_found" in status else "completed",
    }


def agent_record(scope: DataFrame, plan: dict, goal: str, provider: ModelProvider, trace: Trace) -> tuple[DataFrame, list[dict]]:
    """The agent's fields by group, validated: a supported proposal of the provider before the rule's value. The
    fields of a group that failed ask for review."""
    spark = scope.sparkSession
    evidence = retrieve(scope, plan["fields"]) if plan["fields"] else None
    bids = spark.createDataFrame([(b,) for b in plan["bid_ids"]], "bid_id string")

    def work(group: str, keys: list[str]) -> DataFrame:
        ruled = extract.agent_fields(scope, keys, goal)
        if isinstance(provider, DeterministicProvider):
            return ruled
        proposed = propose(provider, evidence, keys, trace)
        return proposed.unionByName(ruled.join(proposed.select("bid_id", "field"), ["bid_id", "field"], "left_anti"))

    results, errors = run_groups(plan["groups"], work)
    values = None
    for found in results.values():
        values = found if values is None else values.unionByName(found)
    names = [(k, g in errors) for g, keys in plan["groups"].items() for k in keys]
    every = bids.crossJoin(F.broadcast(spark.createDataFrame(names, "field string, failed boolean")))  # the fields of a request
    values = values if values is not None else spark.createDataFrame([], "bid_id string, field string, value string, record_id string")
    rows = every.join(values.withColumn("record_id", F.col("record_id").cast(scope.schema["record_id"].dataType)), ["bid_id", "field"], "left")
    status = F.when(F.col("failed"), "review_required").when(F.col("value").isNotNull(), "supported").otherwise("not_found")
    checked = materialize(validate(rows.withColumn("status", status).drop("failed"), scope), "agent")
    return checked, [{"code": "extraction_group_failed", "message": f"group {g}: {e}", "severity": "error"} for g, e in errors.items()]


def extraction_response(state: dict) -> dict:
    """What a caller gets of an extraction: status, fields, evaluation and diagnostics as plain values; the
    fields are those of the bids that were asked for."""
    out = {"run_id": state["run_id"], "status": state["status"], "diagnostics": state["diagnostics"], "plan": state.get("plan")}
    if "fields" in state:
        shown = state["fields"].withColumn("n_citations", F.greatest(F.coalesce(F.size("citations"), F.lit(0)), F.lit(0)))
        out["fields"] = [r.asDict(recursive=True) for r in shown.orderBy("bid_id", "ordinal").collect()]
        out["evaluation"] = build_evaluation(shown, state["retries"])
    return out


def build_evaluation(fields: DataFrame, retries: int) -> dict:
    """Citation coverage, how many fields came to which status, and the retries of a run."""
    given = F.coalesce(F.col("value"), F.array_join(F.transform("items", lambda x: x["value"]), ","))
    cited = evaluation.citation_coverage(fields.select(F.lit("run").alias("bid_id"), F.nullif(given, F.lit("")).alias("value"), "n_citations")).first()
    dispositions = {r.status: r.n for r in fields.groupBy("status").agg(F.count("*").alias("n")).collect()}
    return {"citation_coverage": cited.coverage if cited else 1.0, "dispositions": dispositions, "retries": retries}


def qa_response(state: dict) -> dict:
    out = {"run_id": state["run_id"], "status": state["status"], "diagnostics": state["diagnostics"]}
    said = state.get("composed")
    if said:
        out |= {"answer": said["answer"], "found": said["found"], "disputed": said["disputed"], "citations": [c.asDict() for c in said["citations"] or []]}
    return out


def _by_rank():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy("rank", "record_id")


def final_fields(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Base fields with what the addenda make of them."""
    c = changes.select("bid_id", "field", F.col("current").alias("_c"), F.col("status").alias("_s"))
    both = base.join(c, ["bid_id", "field"], "left")
    return both.withColumns({
        "value": F.when(F.col("_s") == "replaced", F.col("_c")).when(F.col("_s") == "review_required", F.lit(None)).otherwise(F.col("value")),
        "status": F.when(F.col("_s") == "review_required", "review_required").when(F.col("_s") == "replaced", "supported").otherwise(F.col("status")),
    }).drop("_c", "_s")


class JobCapacityError(RuntimeError):
    pass


class Jobs:
    """Runs in the background: few workers, a bounded number of jobs, finished ones kept for a while."""

    def __init__(self, workers: int = 2, limit: int = 64, keep_seconds: float = 3600):
        self.pool, self.limit, self.keep = ThreadPoolExecutor(workers), limit, keep_seconds
        self.jobs: dict[str, tuple[Future, float]] = {}
        self.lock = threading.Lock()

    def submit(self, operation: Callable[[], Any]) -> str:
        with self.lock:
            now = time.time()
            for k in [k for k, (f, at) in self.jobs.items() if f.done() and now - at > self.keep]:
                del self.jobs[k]
            if len(self.jobs) >= self.limit:
                raise JobCapacityError(f"{self.limit} jobs are held")
            name = uuid.uuid4().hex
            self.jobs[name] = (self.pool.submit(operation), now)
            return name

    def get(self, name: str) -> dict:
        future, _ = self.jobs[name]
        if not future.done():
            return {"job_id": name, "status": "running"}
        error = future.exception()
        return {"job_id": name, "status": "failed", "error": str(error)} if error else {"job_id": name, "status": "completed", "result": future.result()}

    def shutdown(self, wait: bool = True) -> None:
        self.pool.shutdown(wait=wait, cancel_futures=True)


def authorize_folders(bid_ids: list[str], references: list[str], root: str) -> list[str]:
    """Folders that were submitted: each a direct child of the root that is named as a bid of the request."""
    root = root.rstrip("/")
    for ref in references:
        parent, _, name = ref.rstrip("/").rpartition("/")
        if parent != root or name in ("", ".", "..") or name not in bid_ids:
            raise ValueError(f"folder {ref} is not allowed")
    return references

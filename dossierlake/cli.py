"""spark-submit commands: ingest, rebuild, vector-index, search, ask, extract, evaluate."""
from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from .operators import answers, corpus, evaluation, retrieval, views, workflow
from .session import session
from .sources.folders import read_cases, scan_folder
from .streaming.incremental import html_chunks


def main(argv: list[str] | None = None, provider: corpus.EmbeddingProvider | None = None) -> int:
    parser = argparse.ArgumentParser(prog="dossierlake")
    parser.add_argument("command", choices=("ingest", "rebuild", "vector-index", "search", "ask", "extract", "evaluate"))
    parser.add_argument("--index", required=True, help="folder of the corpus")
    parser.add_argument("--root", help="folder of bid folders")
    parser.add_argument("--text", help="question")
    parser.add_argument("--bid", action="append", help="only these bids")
    parser.add_argument("--vectors", help="folder of the vectors")
    parser.add_argument("--output", help="folder that records and changes are written to")
    parser.add_argument("--cases", help="JSON file of evaluation cases")
    parser.add_argument("--top-k", type=int, default=5)
    args = parser.parse_args(argv)
    spark = session("dossierlake")
    index = corpus.Index(spark, args.index)
    if args.command in ("ingest", "rebuild"):
        rows = corpus.index_records(html_chunks(scan_folder(spark, args.root)))
        print(json.dumps(index.update(rows, full_rebuild=args.command == "rebuild")))
        return 0
    if args.command == "vector-index":
        result = corpus.sync(corpus.VectorStore(spark, args.vectors), index.records(), provider or corpus.HashEmbedding(32))
        print(json.dumps(result))
        return 0 if result["status"] == "completed" else 1
    records = retrieval.filter_records(index.records(), bids=args.bid)
    if args.command == "extract":
        bids = args.bid or [r.bid_id for r in records.select("bid_id").distinct().orderBy("bid_id").collect()]
        state = workflow.run(records, "extraction", args.text or "all fields", bids)
        if args.output and "fields" in state:
            views.export_records(state["fields"], state["changes"], args.output)
        print(json.dumps(workflow.extraction_response(state), default=str))
        return 1 if state["status"] == "failed" else 0
    if args.command == "evaluate":
        cases = read_cases(spark, args.cases).withColumn("query_id", F.xxhash64("case_id"))
        found = retrieval.search(records, cases.select("query_id", "query"), top_k=args.top_k)
        got = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "record_id"))), lambda x: x["record_id"]).alias("returned"))
        both = cases.join(got, "query_id", "left").select(F.col("expected_record_ids").alias("expected"), F.coalesce("returned", F.expr("cast(array() as array<string>)")).alias("returned"), F.lit(0.0).alias("seconds"))
        print(evaluation.report(both, args.top_k).toJSON().first())
        return 0
    found = retrieval.search(records, retrieval.make_queries(spark, [{"text": args.text, "query_id": 1, "top_k": args.top_k}]), top_k=args.top_k)
    out = answers.top_answer(found) if args.command == "ask" else found.select("rank", "record_id", "bid_id", "source_file", "score", "authority_status").orderBy("rank")
    for line in out.toJSON().collect():
        print(line)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

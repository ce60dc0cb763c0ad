"""Helpers shared by the training-data operators: tables, what a worker keeps, graph components."""
from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources.scratch import discard, materialize, spread

__all__ = ["connected_components", "discard", "give_back", "lower_ascii", "materialize", "resident", "spread", "table"]

#: What ASCII-only strippers and splitters treat as white space: space and \t \n \x0b \f \r.
ASCII_SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of a data folder, dealt out over all cores if its file has fewer splits than there are."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), key)


_resident: dict[Any, Any] = {}


def resident(key: Any, make: Callable[[], Any] = lambda: None) -> Any:
    """What a Python worker keeps from task to task: one structure, that of the operator it serves now.
    Workers are reused, so a stage that asks for its own frees what the stage before has left."""
    if key not in _resident:
        _resident.clear()
        give_back()
        _resident[key] = make()
    return _resident[key]


def give_back() -> None:
    """Return freed memory to the system, which the allocators would keep for this worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lower_ascii(col):
    """A-Z to a-z and nothing else. Pure-ASCII values take Spark's vectorised lower()."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, UPPER.lower())
    )


#: Edges up to which one task joins a whole graph: 16 bytes each.
SMALL_GRAPH = 1_000_000


def _join_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, component) of a small graph: roots hook to the smaller root of an edge, then pointers jump."""
    resident("components")
    ends = [f[["u", "v"]].to_numpy(np.int64) for f in frames if len(f)]
    if not ends:
        return
    ids, place = np.unique(np.concatenate(ends), return_inverse=True)
    u, v = place.reshape(-1, 2).T
    label = np.arange(len(ids))
    while True:
        low, new = np.minimum(label[u], label[v]), label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if (new == label).all():
            break
        label = new
    yield pd.DataFrame({"id": ids, "component": ids[label]})


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph ``edges(a, b)``: one row (id, component) per vertex of an
    edge, component = the smallest id reachable.

    Alternating large-star and small-star rounds; each only takes minima per vertex and joins them
    back, so no vertex's neighbour list is ever gathered in one place. Every round is written to the
    shared folder. A graph that was counted to have at most SMALL_GRAPH edges is joined in one task
    instead, with the same result. Null ends and self-loops are ignored; no edges give no rows.
    """
    ship(edges.sparkSession)
    now = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    seen = _signature(now)
    if seen[0] <= SMALL_GRAPH:
        return now.coalesce(1).mapInPandas(_join_all, "id long, component long")
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionAll(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = materialize(small, "edges")
        discard(now)
        now, before, seen = after, seen, _signature(after)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionAll(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)

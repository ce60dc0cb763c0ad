"""Embedding near-duplicates by NN-descent: a neighbour graph refined through neighbours of neighbours."""
from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import connected_components, discard, materialize, resident, table

log = logging.getLogger(__name__)

THRESHOLD = 0.93
#: Neighbours in a list at first, rounds of refinement for one list length, share of changed entries that ends them.
NEIGHBOURS, ROUNDS, SETTLED = 8, 5, 0.02
#: Orders by random hyperplanes that the first lists are read from, how far each looks ahead, bits of an order.
ORDERS, AHEAD, BITS = 3, 12, 24
#: Vectors that one range of an order holds at least.
RANGE = 1000
#: What 8-bit copies of the vectors may be off by; candidates within it are settled in double precision.
SLACK = 0.03
#: Vectors that the audit takes at a time, those with a link that it must have seen, the recall it asks
#: for, and how often the lists may be doubled before all is compared in blocks.
AUDITED, ENOUGH, RECALL, DOUBLINGS = 2048, 200, 0.97, 2
#: Where a group is compared whole: bytes of the vectors on one side of a block at most, the least vectors of a
#: side, and the sides that a group is cut into if that leaves them so large.
BLOCK_BYTES, LEAST_BLOCK, SIDES = 16 << 20, 64, 16
#: Parts that a group's rows are dealt into where they are joined with its size.
SALTS = 32
#: Tiles of a block that are multiplied at a time.
TILE = 1024, 4096

_EDGE = "u long, v long, s float, new boolean"


def points(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct vectors that can link, and for each of their rows the vector it holds.

    points: pid (least vec_id), kind (label and length), n (rows), e (unit vector as doubles), q (8-bit copy).
    members: vec_id, pid.
    """
    ok = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    hashed = vectors.where(ok).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string")).alias("kind"),
        F.col("embedding").cast("array<double>").alias("e"),
    )
    hashed = hashed.withColumns({"h1": F.xxhash64("kind", "e"), "h2": F.hash("kind", "e")})
    classes = hashed.groupBy("h1", "h2").agg(F.min("vec_id").alias("pid"), F.count("*").alias("n"), F.first("kind").alias("kind"), F.first("e").alias("e"))

    def shape(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            e = [np.asarray(x, np.float64) for x in f["e"]]
            # scale first: the squares of very small or large components would not fit
            e = [x / np.abs(x).max() for x in e]
            e = [x / np.sqrt((x * x).sum()) for x in e]
            q = [np.round(x * (127 / np.abs(x).max())).astype(np.int8).tobytes() for x in e]
            yield f[["h1", "h2", "pid", "n", "kind"]].assign(e=[x.tobytes() for x in e], q=q)

    held = materialize(classes.mapInPandas(shape, "h1 long, h2 int, pid long, n long, kind string, e binary, q binary"), "points")
    members = hashed.select("vec_id", "h1", "h2").join(held.select("h1", "h2", "pid"), ["h1", "h2"]).select("vec_id", "pid")
    return held, members


def _matrix(column: pd.Series, dtype) -> np.ndarray:
    """Equal-length rows as a matrix; shorter ones, which only meet their own kind, are padded with 0."""
    raw = column.tolist()
    longest = max(map(len, raw), default=0)
    if any(len(x) != longest for x in raw):
        raw = [x.ljust(longest, b"\0") for x in raw]
    return np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1)


def _unit8(column: pd.Series) -> np.ndarray:
    m = _matrix(column, np.int8).astype(np.float32)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def _best(u, v, s, new, k: int) -> pd.DataFrame:
    """The k nearest of each u, each pair once."""
    f = pd.DataFrame({"u": u, "v": v, "s": s, "new": new}).sort_values(["u", "s", "v"], ascending=[True, False, True], kind="stable")
    f = f[~f.duplicated(["u", "v"])]
    return f[f.groupby("u").cumcount() < k]


def first_lists(held: DataFrame, k: int, first: int = 0) -> DataFrame:
    """Lists to start from: vectors that stand close in an order by the signs of random projections.
    The order is dealt out by range, so neither a large label nor a full cell lands in one task."""
    spark = held.sparkSession
    # a range border parts neighbours, so ranges are not small
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), held.count() // RANGE))
    out = None
    for order in range(first, first + ORDERS):

        def code(frames: Iterator[pd.DataFrame], order=order) -> Iterator[pd.DataFrame]:
            for f in frames:
                m = _unit8(f["q"])
                planes = np.random.default_rng([order, 77]).standard_normal((4096, BITS))  # as long as any vector is wide
                wide = np.resize(planes, (m.shape[1], BITS)) if m.shape[1] > len(planes) else planes[: m.shape[1]]
                bits = (m @ wide.astype(np.float32) > 0).astype(np.int64)
                yield f.assign(code=bits @ (1 << np.arange(BITS, dtype=np.int64)[::-1]))

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tail = None
            for f in frames:
                f = pd.concat([tail, f], ignore_index=True) if tail is not None else f
                m, pid, kind = _unit8(f["q"]), f["pid"].to_numpy(), pd.factorize(f["kind"])[0]
                us, vs, ss = [], [], []
                for d in range(1, min(AHEAD, len(f) - 1) + 1):
                    same = kind[d:] == kind[:-d]
                    s = np.einsum("ij,ij->i", m[d:], m[:-d])
                    us += [pid[d:][same], pid[:-d][same]]
                    vs += [pid[:-d][same], pid[d:][same]]
                    ss += [s[same]] * 2
                if us:
                    yield _best(np.concatenate(us), np.concatenate(vs), np.concatenate(ss), True, k)
                tail = f.tail(AHEAD)

        ordered = held.select("pid", "kind", "q").mapInPandas(code, "pid long, kind string, q binary, code long")
        ordered = ordered.repartitionByRange(parts, "kind", "code", "pid").sortWithinPartitions("kind", "code", "pid")
        some = ordered.select("pid", "kind", "q").mapInPandas(near, _EDGE)
        out = some if out is None else out.unionAll(some)
    return _merged(out, k)


def _merged(edges: DataFrame, k: int) -> DataFrame:
    """Each list cut to its k nearest; an entry that was there before is not new."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = edges.repartition(parts, "u").groupBy("u", "v").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return once.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def refine(held: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """One round: around each vector w its neighbours and those that list it meet, and each pair with a
    new entry is compared. Of those that list w, k come, chosen by hash, so a hub stays small; what
    that leaves out is met around other vectors, and the audit shows what is not."""
    spark = held.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = Window.partitionBy("w").orderBy(F.xxhash64("x", "w"))
    reverse = lists.select(F.col("v").alias("w"), F.col("u").alias("x"), "new").withColumn("r", F.row_number().over(back)).where(F.col("r") <= k).drop("r")
    around = (
        lists.select(F.col("u").alias("w"), F.col("v").alias("x"), "new").unionAll(reverse)
        .groupBy("w", "x").agg(F.max("new").alias("new"))
    )
    worst = lists.groupBy("u").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(F.lit(-2.0).cast("float")).alias("worst"))
    known = held.select("pid", "q").join(worst, held.pid == worst.u, "left").select("pid", "q", F.coalesce("worst", F.lit(-2.0)).cast("float").alias("worst"))
    met = around.join(known, around.x == known.pid).select("w", "x", "new", "worst", "q")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for f in frames:
            f = pd.concat([tail, f], ignore_index=True) if tail is not None else f
            cut = int(np.searchsorted(f["w"].to_numpy(), f["w"].iloc[-1])) if len(f) else 0
            tail = f.iloc[cut:]
            for part in _groups(f.iloc[:cut]):
                yield _meet(part, k)
        if tail is not None and len(tail):
            yield _meet(tail, k)

    found = met.repartition(parts, "w").sortWithinPartitions("w").mapInPandas(compare, _EDGE)
    return _merged(lists.select("u", "v", "s", F.lit(False).alias("new")).unionAll(found), k)


def _groups(f: pd.DataFrame, rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Runs of whole groups of about so many rows."""
    w, at = f["w"].to_numpy(), 0
    while at < len(f):
        end = min(len(f), at + rows)
        end = len(f) if end == len(f) else int(np.searchsorted(w, w[end - 1], "right"))
        yield f.iloc[at:end]
        at = end


def _meet(f: pd.DataFrame, k: int) -> pd.DataFrame:
    w, x, new, worst = (f[c].to_numpy() for c in ("w", "x", "new", "worst"))
    m = _unit8(f["q"])
    _, group = np.unique(w, return_inverse=True)
    place = np.arange(len(f)) - np.searchsorted(w, w)
    wide = int(place.max()) + 1
    padded = np.zeros((group.max() + 1, wide, m.shape[1]), np.float32)
    padded[group, place] = m
    row = np.full(padded.shape[:2], -1)
    row[group, place] = np.arange(len(f))
    i, j = np.triu_indices(wide, 1)
    s = np.matmul(padded, padded.transpose(0, 2, 1))[:, i, j]
    a, b = row[:, i], row[:, j]
    ok = (a >= 0) & (b >= 0)
    a, b, s = a[ok], b[ok], s[ok]
    fresh = new[a] | new[b]
    a, b, s = a[fresh], b[fresh], s[fresh]
    to_a, to_b = s > worst[a], s > worst[b]
    return _best(np.concatenate([x[a[to_a]], x[b[to_b]]]), np.concatenate([x[b[to_a]], x[a[to_b]]]), np.concatenate([s[to_a], s[to_b]]), True, k)


def verified(held: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b: list entries whose cosine in double precision reaches the threshold."""
    near = lists.where(F.col("s") >= threshold - SLACK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    left = held.select(F.col("pid").alias("a"), F.col("e").alias("ea"))
    right = held.select(F.col("pid").alias("b"), F.col("e").alias("eb"))
    both = near.join(left, "a").join(right, "b")

    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("ij,ij->i", _matrix(x, np.float64), _matrix(y, np.float64)) if len(x) else np.zeros(0))

    return both.withColumn("c", cosine("ea", "eb")).where(F.col("c") >= threshold).select("a", "b")


def _salt(pid):
    """The part of its group that a vector's row is dealt into, so that a large group does not meet in one task."""
    return F.pmod(F.xxhash64(pid), F.lit(SALTS)).cast("int")


def complete_groups(held: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(u, links): for each vector of ``groups(pid, component)`` the rows of other vectors of its group
    within the threshold. A list that is full of links is enlarged to its whole group."""
    return _in_blocks(held, groups, threshold).groupBy("u").agg(F.sum("links").alias("links"))


def _in_blocks(held: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(u, links, root): groups are compared in blocks, so that each is dealt out as pairs of sides; only
    counts leave a block, and for each vector the least one that it is connected with there.

    Each vector is copied once for each side of its group: SIDES times, and beyond what BLOCK_BYTES lets
    a side hold, once for each BLOCK_BYTES of the group.
    """
    spark = held.sparkSession
    widest = held.agg(F.max(F.octet_length("e"))).first()[0] or 8
    largest = max(LEAST_BLOCK, BLOCK_BYTES // widest)
    side = F.least(F.greatest(F.ceil(F.count("*") / SIDES), F.lit(LEAST_BLOCK)), F.lit(largest))
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / side).cast("int").alias("chunks"))
    # salted, so that the rows of one large group do not meet in one task to learn its size
    sizes = materialize(sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "sizes")
    salted = groups.withColumn("salt", _salt(F.col("pid")))
    rows = salted.join(sizes, ["component", "salt"]).join(held.select("pid", "kind", "n", "e"), "pid")
    rows = rows.withColumn("c", F.pmod(F.xxhash64("pid"), "chunks").cast("int")).select(
        "component", "pid", "n", "e", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")
    )
    rows = rows.select("component", F.least("c", "o").alias("ci"), F.greatest("c", "o").alias("cj"), "c", "pid", "n", "e")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resident("vectors")
        tail = None
        for f in frames:
            f = pd.concat([tail, f], ignore_index=True) if tail is not None else f
            if not len(f):
                continue
            keys = f[["component", "ci", "cj"]]
            edge = np.flatnonzero((keys != keys.iloc[-1]).any(axis=1).to_numpy())
            cut = int(edge[-1]) + 1 if len(edge) else 0
            tail = f.iloc[cut:]
            for _, g in f.iloc[:cut].groupby(["component", "ci", "cj"], sort=False):
                yield _count(g, threshold)
        if tail is not None and len(tail):
            yield _count(tail, threshold)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "component", "ci", "cj").sortWithinPartitions("component", "ci", "cj")
    return dealt.mapInPandas(count, "u long, links long, root long")


def _count(g: pd.DataFrame, threshold: float) -> pd.DataFrame:
    g = g.sort_values("pid", kind="stable")
    e, n, c, pid = _matrix(g["e"], np.float64), g["n"].to_numpy(), g["c"].to_numpy(), g["pid"].to_numpy()
    same = g["ci"].iloc[0] == g["cj"].iloc[0]
    left = np.arange(len(g)) if same else np.flatnonzero(c == g["ci"].iloc[0])
    right = left if same else np.flatnonzero(c == g["cj"].iloc[0])
    links, root = np.zeros(len(g), np.int64), np.arange(len(g))
    for at in range(0, len(left), TILE[0]):
        some = left[at : at + TILE[0]]
        for to in range(0, len(right), TILE[1]):
            other = right[to : to + TILE[1]]
            hit = e[some] @ e[other].T >= threshold
            if same:
                hit &= some[:, None] != other[None, :]
            links[some] += hit @ n[other]
            if not same:
                links[other] += n[some] @ hit
            for i in np.flatnonzero(hit.any(axis=1)):
                ends = np.append(root[other[hit[i]]], root[some[i]])
                least = ends.min()
                if (ends != least).any():
                    root[np.isin(root, ends)] = least
    return pd.DataFrame({"u": pid, "links": links, "root": pid[root]})


def exact_links(held: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """found (u, links) and components (id, component) of all vectors, each compared with all of its kind."""
    groups = held.select("pid", F.col("kind").alias("component"))
    blocks = materialize(_in_blocks(held, groups, threshold).where("links > 0"), "exact")
    components = materialize(connected_components(blocks.select(F.col("u").alias("a"), F.col("root").alias("b"))), "components")
    return materialize(blocks.groupBy("u").agg(F.sum("links").alias("links")), "found"), components


def _audit(held: DataFrame, found: DataFrame, completed: DataFrame, threshold: float) -> float:
    """Mean share of an audited vector's links that were found, over the vectors that have one. Vectors
    are taken in the order of a hash, AUDITED at a time, and compared with every vector, until ENOUGH
    outside of completed groups have a link or all were taken. Those of completed groups are judged
    apart, since there are many and they lose little; the lower mean of both counts."""
    shares: dict[bool, list[float]] = {True: [], False: []}
    queue = held.select("pid", "kind", "e", F.xxhash64("pid").alias("h"))
    last = None
    while len(shares[False]) < ENOUGH:
        rest = queue if last is None else queue.where((F.col("h") > last[0]) | (F.col("h") == last[0]) & (F.col("pid") > last[1]))
        chosen = rest.orderBy("h", "pid").limit(AUDITED).toPandas()
        if not len(chosen):
            break
        last = int(chosen["h"].iloc[-1]), int(chosen["pid"].iloc[-1])
        true = _true_links(held, chosen, threshold)
        ids = held.sparkSession.createDataFrame([(int(p), int(t)) for p, t in zip(chosen["pid"], true) if t], "pid long, true long")
        judged = found.join(F.broadcast(ids), F.col("u") == F.col("pid")).select("pid", "links")  # at most AUDITED ids
        links = {r.pid: r.links for r in judged.collect()}
        dense = {r.u for r in completed.join(F.broadcast(ids), F.col("u") == F.col("pid")).select("u").collect()}
        for p, t in zip(chosen["pid"], true):
            if t:
                shares[int(p) in dense].append(min(links.get(int(p), 0), int(t)) / int(t))
    return min((sum(x) / len(x) for x in shares.values() if x), default=1.0)


def _true_links(held: DataFrame, chosen: pd.DataFrame, threshold: float) -> np.ndarray:
    """Links of the chosen vectors, at most AUDITED, which are sent to all tasks."""
    shared = held.sparkSession.sparkContext.broadcast((chosen["pid"].to_numpy(), chosen["kind"].tolist(), chosen["e"].tolist()))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, kind, e = shared.value
        total = np.zeros(len(pid), np.int64)
        by_kind: dict[str, list[int]] = {}
        for i, name in enumerate(kind):
            by_kind.setdefault(name, []).append(i)
        known = {name: _matrix(pd.Series([e[i] for i in at]), np.float64) for name, at in by_kind.items()}
        for f in frames:
            for name, g in f.groupby("kind"):
                if name not in known:
                    continue
                at, other, n, ids = np.array(by_kind[name]), _matrix(g["e"], np.float64), g["n"].to_numpy(), g["pid"].to_numpy()
                for k in range(0, len(at), 256):
                    some = at[k : k + 256]
                    hit = known[name][k : k + 256] @ other.T >= threshold
                    hit &= pid[some][:, None] != ids[None, :]
                    total[some] += hit @ n
        yield pd.DataFrame({"i": np.arange(len(pid)), "true": total})

    true = np.zeros(len(chosen), np.int64)
    for r in held.select("pid", "kind", "n", "e").mapInPandas(count, "i long, true long").groupBy("i").agg(F.sum("true").alias("true")).collect():
        true[r.i] = r.true
    shared.unpersist()
    return true


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) for every row of ``vectors(vec_id, embedding, label)``;
    recall is the audited one of the result, 1 where all was compared.

    Vectors link when their labels are equal and not null and their cosine is at least ``threshold``.
    Null, zero or non-finite vectors, and rows without vec_id, link with nothing: n_links 0, their own
    component. Vectors of different lengths do not link. Equal vectors are one point with a count, so
    copies never fill a list; each of them counts the others. Repeated rows: each returned; they count
    as vectors that link. Ties in a list go to the smaller vec_id. Further columns are ignored. An
    empty table gives no rows.

    After each run of rounds the recall of a vector's links is audited; below RECALL the lists are
    doubled and read from further orders too, DOUBLINGS times; then all vectors of a label are compared
    in blocks, and the result is exact.
    """
    ship(vectors.sparkSession)
    held, members = points(vectors)
    k = neighbours
    lists = materialize(first_lists(held, k), "lists")
    for doubling in range(DOUBLINGS + 1):
        for _ in range(ROUNDS):
            after = materialize(refine(held, lists, k), "lists")
            discard(lists)
            lists = after
            changed = lists.agg(F.count_if("new"), F.count("*")).first()
            if changed[0] <= SETTLED * changed[1]:
                break
        links = materialize(verified(held, lists, threshold), "links")
        components = materialize(connected_components(links), "components")
        full = lists.groupBy("u").agg(F.count_if(F.col("s") >= threshold - SLACK).alias("f")).where(F.col("f") >= k).select("u")
        dense = full.join(components, full.u == components.id).select("component").distinct()
        dense = dense.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # a table of its own, whose rows are counted before they are dealt out by group
        members_of = components.withColumn("salt", _salt(F.col("id")))
        groups = materialize(members_of.join(dense, ["component", "salt"], "left_semi").select(F.col("id").alias("pid"), "component"), "groups")
        completed = materialize(complete_groups(held, groups, threshold), "dense")
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        listed = both.join(held.select(F.col("pid").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("m"))
        found = listed.join(completed, listed.a == completed.u, "left").select(F.col("a").alias("u"), F.coalesce("links", "m").alias("links"))
        found = materialize(found, "found")
        discard(links, groups)
        recall = _audit(held, found, completed, threshold)
        log.info("lists of %d: recall %.3f", k, recall)
        if recall >= RECALL:
            break
        if doubling == DOUBLINGS:
            discard(found, components)
            (found, components), recall = exact_links(held, threshold), 1.0
            break
        discard(found, components, completed)
        k *= 2
        # a longer list has room again: every entry counts as new once more
        further = first_lists(held, k, (doubling + 1) * ORDERS)
        reopened = materialize(_merged(lists.select("u", "v", "s", F.lit(True).alias("new")).unionAll(further), k), "lists")
        discard(lists)
        lists = reopened
    each = held.select("pid", "n").join(found, held.pid == found.u, "left").join(components, F.col("pid") == F.col("id"), "left").select(
        "pid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "pid").alias("component_id")
    )
    linked = members.join(each, "pid").select("vec_id", "n_links", "component_id")
    # rows that cannot link have no member row; equal ids with equal vectors have one each
    counted = linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(counted, "vec_id", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"), F.lit(float(recall)).alias("recall"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id"))

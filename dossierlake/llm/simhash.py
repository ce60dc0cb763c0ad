"""SimHash near-duplicates, linked by bit-sliced comparison of 64-bit fingerprints."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import connected_components, give_back, materialize, resident, table

RADIUS = 2
#: Four bands of 16 bits; two fingerprints at most two bits apart agree on at least two bands.
BANDS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
#: Members of one comparison block; a larger bucket is dealt out as pairs of such blocks.
BLOCK = 2048
SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype="<u8")
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = np.fromiter(
            (digest(join(s), SEED) for s in zip(*(words[i:] for i in range(width)))), dtype="<u8", count=len(words) - width + 1
        )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    resident("simhash")
    for frame in frames:
        fps = np.fromiter((fingerprint(t) for t in frame["text"]), dtype=np.uint64, count=len(frame))
        yield frame[["doc_id", "th"]].assign(fp=fps.view(np.int64))
    give_back()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp): the signed 64-bit fingerprint of each whole text, and a hash of the text that
    tells rows of one id apart; a null text counts as empty."""
    ship(docs.sparkSession)
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return each.mapInPandas(_fingerprints, "doc_id long, th long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Vertical layout: row k holds bit k of every value, 64 values to a word."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pad = -len(values) % 64
    bits = np.concatenate([bits, np.zeros((pad, 64), np.uint8)]) if pad else bits
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within_radius(difference_planes: Iterator[np.ndarray], shape: tuple) -> np.ndarray:
    """Packed mask of the lanes with at most RADIUS set bits over all planes.

    ones/twos are carry-save counters of every lane at once; ``over`` marks lanes that reached three.
    The block is abandoned as soon as every lane is over.
    """
    ones, twos, over = np.zeros(shape, "<u8"), np.zeros(shape, "<u8"), np.zeros(shape, "<u8")
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for k, plane in enumerate(difference_planes):
        carry = ones & plane
        ones ^= plane
        twos |= carry
        over |= ones & twos
        if k % 8 == 7 and (over == full).all():
            break
    return ~over


def _unpack(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def close_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For aligned arrays of fingerprints: which pairs are within the radius."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        part = planes(a[at : at + (1 << 16)] ^ b[at : at + (1 << 16)])
        out[at : at + (1 << 16)] = _unpack(within_radius(iter(part), part[0].shape), min(1 << 16, len(a) - at))
    return out


def close_rows(queries: np.ndarray, members: np.ndarray) -> Iterator[np.ndarray]:
    """For each query fingerprint, a mask of the members within the radius."""
    held = planes(members)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, len(queries), 64):
        some = queries[at : at + 64].astype(np.uint64)
        flips = [np.where((some >> np.uint64(k)) & np.uint64(1), full, np.uint64(0))[:, None] for k in range(64)]
        lanes = within_radius((held[k][None, :] ^ flips[k] for k in range(64)), (len(some), held.shape[1]))
        yield from _unpack(lanes, len(members))


def _forest(nodes: np.ndarray, rows: Iterator[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of a spanning star per component of the block; only nodes that have a link."""
    label = np.arange(len(nodes))
    for i, near in rows:
        joined = np.unique(np.append(label[near], label[i]))
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _block_links(fp: np.ndarray, rep: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one block: all against all where ``side`` is 0, else side 1 against side 2."""
    if side[0] == 0:
        return _forest(rep, ((i, np.flatnonzero(m)) for i, m in enumerate(close_rows(fp, fp)) if m.sum() > 1))
    left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    if not len(left) or not len(right):
        return rep[:0], rep[:0]
    return _forest(rep, ((left[i], right[m]) for i, m in enumerate(close_rows(fp[left], fp[right])) if m.any()))


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by block; a block may run over the border of two frames."""
    resident("simhash")
    held: list[pd.DataFrame] = []
    for frame in frames:
        frame = pd.concat([*held, frame], ignore_index=True) if held else frame
        if not len(frame):
            continue
        last = frame[["band", "key", "ci", "cj"]].ne(frame[["band", "key", "ci", "cj"]].iloc[-1]).any(axis=1).to_numpy()
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        held = [frame.iloc[cut:]]
        if cut:
            yield _linked(frame.iloc[:cut])
    if held and len(held[0]):
        yield _linked(held[0])


def _linked(frame: pd.DataFrame) -> pd.DataFrame:
    fp, rep, side = frame["fp"].to_numpy().view(np.uint64), frame["rep"].to_numpy(), frame["side"].to_numpy()
    ids = frame[["band", "key", "ci", "cj"]].to_numpy()
    start = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(axis=1)))
    size = np.diff(np.append(start, len(frame)))
    froms, tos = [], []
    for n in range(2, 33):  # all small blocks of one size at once
        at = start[(size == n) & (side[start] == 0)]
        if len(at):
            i, j = np.triu_indices(n, 1)
            for some in np.array_split(at, max(1, len(at) * len(i) >> 18)):
                a, b = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                ok = close_pairs(fp[a], fp[b])
                # the first link of each member to an earlier one spans what chains of links connect
                a, b = a[ok], b[ok]
                froms.append(rep[b])
                tos.append(rep[a])
    for at, n in zip(start, size):
        if n > 32 or n > 1 and side[at] != 0:
            a, b = _block_links(fp[at : at + n], rep[at : at + n], side[at : at + n])
            froms.append(a)
            tos.append(b)
    if not froms:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    return pd.DataFrame({"a": np.concatenate(froms), "b": np.concatenate(tos)}).drop_duplicates()


def link(fps: DataFrame) -> DataFrame:
    """Links between distinct fingerprints: rows (a, b) of representative doc_ids, enough to connect
    every pair at most two bits apart. ``fps``: (fp, rep), one row per fingerprint."""
    spark = fps.sparkSession
    ship(spark)
    band = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = fps.select(
        "fp", "rep", F.explode(F.array(*[F.struct(F.lit(n).alias("band"), (band(i) * 65536 + band(j)).alias("key")) for n, (i, j) in enumerate(BANDS)])).alias("k")
    ).select("k.band", "k.key", "fp", "rep")
    counts = keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = keys.join(counts, ["band", "key"]).withColumn("chunks", F.ceil(F.col("n") / BLOCK).cast("int"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = sized.withColumn("c", chunk).select(
        "band", "key", "fp", "rep", "c",
        F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))).alias("o"),
    )
    dealt = dealt.select(
        "band", "key", F.least("c", "o").alias("ci"), F.greatest("c", "o").alias("cj"),
        F.when(F.col("c") == F.col("o"), 0).when(F.col("c") < F.col("o"), 1).otherwise(2).alias("side"), "fp", "rep",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(parts, "band", "key", "ci", "cj").sortWithinPartitions("band", "key", "ci", "cj")
        .mapInPandas(_links, "a long, b long")
    )


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """each (doc_id, th, fp), and groups (fp, root): fingerprints that links connect share a root. The
    vertices are fingerprints, so neither a repeated nor a missing doc_id joins or parts anything."""
    each = materialize(fingerprints(docs), "fps")
    distinct = each.select("fp").distinct()
    roots = connected_components(link(distinct.select("fp", F.col("fp").alias("rep"))))
    return each, distinct.join(roots, distinct.fp == roots.id, "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every document.

    ``component_id`` is the smallest doc_id reachable over links of at most two differing bits.
    Null text: as empty, fingerprint zero, linked like any other. Repeated rows: each gets a row,
    all in one component; rows that share a doc_id but not their text each stand with their own text.
    Null doc_id: its row is returned; the component is the smallest non-null doc_id of its group, null
    if there is none. Further columns are ignored. An empty table gives no rows.
    """
    each, groups = _grouped(docs)
    least = each.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(groups, "fp")
    ids = least.groupBy("root").agg(F.min("rep").alias("component_id"))
    where = groups.join(ids, "root").select("fp", "component_id")
    return each.join(where, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, with all its columns: the one with the smallest doc_id,
    of several with that id the one whose text has the least hash; a row without id only where no other
    is in its group. Of repeated rows (equal id and text) one stays. A doc_id that stands on unrelated
    texts keeps each of them. Null text: as empty. An empty table gives no rows.
    """
    each, groups = _grouped(docs)
    of_fp = each.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first"))
    chosen = of_fp.join(groups, "fp").groupBy("root").agg(F.min("first").alias("first"))
    chosen = chosen.select("first.no_id", F.coalesce("first.doc_id", F.lit(0)).alias("id"), "first.th")
    names = [f"c{i}" for i in range(len(docs.columns))]  # own names, so no column of docs clashes
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    # keys without nulls, so that one exchange serves the join and the removal of repeated rows
    key = {"no_id": F.col(doc_id).isNull(), "id": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), "th": F.xxhash64(text)}
    kept = docs.toDF(*names).withColumns(key).join(chosen, list(key), "left_semi").dropDuplicates(list(key))
    return kept.select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns)])


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document: fingerprint as 16 hex digits and component."""
    out = near_duplicates(table(spark, sf_dir, "documents", "doc_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

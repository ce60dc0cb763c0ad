"""Benchmark decontamination by spaced-seed hashing of word positions."""
from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import discard, give_back, materialize, resident, table

#: 1: the word counts, 0: it is ignored. Five words each. Any run of twelve or more words of which a
#: fifth is substituted has a window of six with at most one substitution, which one of the first
#: five masks forgives; the last two forgive two substitutions side by side.
MASKS = ("11111", "101111", "110111", "111011", "111101", "1110011", "1100111")
#: Items of five words may lose any one of them; shorter ones must stand whole.
SHORT_MASKS = {5: ("1111", "10111", "11011", "11101"), 4: ("1111",), 3: ("111",), 2: ("11",), 1: ("1",)}
_ALL = tuple(dict.fromkeys(MASKS + sum(SHORT_MASKS.values(), ())))
#: Share of an item's words that must stand in place, or of any WINDOW words of it.
SIMILARITY, WINDOW = 0.8, 20
#: How far inserted or lost words may shift the rest of an item, and the least run counted there.
SHIFT, RUN = 8, 3
#: Characters of benchmark text indexed at a time; a larger benchmark is compared in several blocks.
BLOCK_CHARS = 4_000_000

#: Scripts that set no space between words: there each character is a word.
_UNSPACED = "\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_has_unspaced = re.compile(f"[{_UNSPACED}]").search
_spaced_words = re.compile(r"\w+").findall
_all_words = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+").findall
#: Hits of seeds that are looked at together.
_HITS = 2_000_000
_FILTER_BITS = 22
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return _all_words(low) if not low.isascii() and _has_unspaced(low) else _spaced_words(low)


class SeedIndex:
    """The spaced seeds of the benchmark items, sorted by hash, with a bit filter in front."""

    def __init__(self, items: list[tuple[int, str]]):
        tokens = [(i, words(t)) for i, t in items]
        tokens = [(i, w) for i, w in tokens if w]
        self.vocabulary: dict[str, int] = {}
        for _, w in tokens:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        self.item_ids = [i for i, _ in tokens]
        self.items = [np.array([self.vocabulary[x] for x in w], dtype=np.int64) for _, w in tokens]
        hashes, owners, places, used = [], [], [], set()
        for k, ids in enumerate(self.items):
            for mask in SHORT_MASKS.get(len(ids), MASKS):
                h, ok = seeds(ids, mask)
                at = np.flatnonzero(ok)
                used.add(mask)
                hashes.append(h[at])
                owners.append(np.full(len(at), k))
                places.append(at)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner = np.concatenate(owners)[order] if owners else np.zeros(0, int)
        self.place = np.concatenate(places)[order] if places else np.zeros(0, int)
        self.masks = [m for m in _ALL if m in used]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def encode(self, text: str | None) -> list[int]:
        get = self.vocabulary.get
        return [get(w, 0) for w in words(text)]

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, words in place, word length of the item, first word) of every leak, one per text and item."""
        if not self.items:
            return
        coded = [self.encode(t) for t in texts]
        start = np.cumsum([0] + [len(c) + len(MASKS[-1]) for c in coded])
        flat = np.zeros(start[-1], np.int64)
        for s, c in zip(start, coded):
            flat[s : s + len(c)] = c
        every = []
        for mask in self.masks:
            h, ok = seeds(flat, mask)
            at = np.flatnonzero(ok)
            at = at[self.filter[(h[at] >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]]
            low, high = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            some = high > low
            at, low, many = at[some], low[some], (high - low)[some]
            # a seed that many items share meets them in parts, of which only the diagonals are kept
            parts = np.searchsorted(np.cumsum(many), np.arange(_HITS, many.sum() + _HITS, _HITS)) + 1 if len(at) else []
            for a, b in zip([0, *parts[:-1]], parts):
                n = many[a:b]
                seed = np.repeat(low[a:b] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                where = np.repeat(at[a:b], n)
                text = np.searchsorted(start, where, "right") - 1
                every.append(np.unique(np.stack([text, self.owner[seed], where - self.place[seed]], axis=1), axis=0))
        if not every:
            return
        diagonals = np.unique(np.concatenate(every), axis=0)
        edges = np.flatnonzero(np.append(True, (diagonals[1:, :2] != diagonals[:-1, :2]).any(axis=1)))
        for a, b in zip(edges, np.append(edges[1:], len(diagonals))):
            t, k = int(diagonals[a, 0]), int(diagonals[a, 1])
            doc = flat[start[t] : start[t + 1] - len(MASKS[-1])]
            found = self.verify(doc, self.items[k], diagonals[a:b, 2] - start[t])
            if found:
                yield t, k, found[0], len(self.items[k]), found[1]

    @staticmethod
    def verify(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> tuple[int, int] | None:
        """The most words in place on a hit's diagonal, if that is enough. Longer runs on diagonals
        nearby, which inserted or lost words shift, count as well."""
        n = len(item)
        window = min(n, WINDOW)
        rows = {}
        for d in diagonals:
            j = np.arange(max(0, -d), min(n, len(doc) - d))
            row = np.zeros(n, bool)
            row[j] = doc[j + d] == item[j]
            rows[int(d)] = row
        best = None
        for d, row in rows.items():
            held = row.copy()
            for e in range(d - SHIFT, d + SHIFT + 1):
                if e != d and e in rows:
                    held |= _long_runs(rows[e], RUN)
            total = int(held.sum())
            sums = np.convolve(held, np.ones(window, int), "valid")
            if (total >= SIMILARITY * n or window == WINDOW and sums.max() >= SIMILARITY * window) and (best is None or total > best[0]):
                best = (total, max(0, d))
        return best


def seeds(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the mask's words at each position, and whether all of them are known words."""
    span = len(mask)
    n = max(0, len(ids) - span + 1)
    h, ok = np.full(n, int(mask, 2) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF, np.uint64), np.ones(n, bool)
    for factor, off in zip(_FACTORS, (i for i, c in enumerate(mask) if c == "1")):
        part = ids[off : off + n]
        h = (h ^ (part.astype(np.uint64) * factor)) * np.uint64(0x9FB21C651E98DF25)
        ok &= part > 0
    return h ^ (h << np.uint64(32)), ok


def _long_runs(row: np.ndarray, least: int) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
    out = np.zeros(len(row), bool)
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a >= least:
            out[a:b] = True
    return out


def _index(shared) -> SeedIndex:
    """The block's index, built once in each worker while it serves the block."""
    return resident(("seeds", shared.id), lambda: SeedIndex(shared.value))


def _blocks(benchmark: DataFrame) -> Iterator[tuple]:
    """(broadcast, whether it is the only one): the benchmark's items in blocks of at most BLOCK_CHARS
    characters (or one item); each is gathered when its turn comes."""
    spark = benchmark.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        block = _Block(next(_numbers), spark.sparkContext.broadcast([tuple(r) for r in part.collect()]))
        yield block, n == 1


_numbers = itertools.count()


class _Block:
    """A broadcast with a number of its own."""

    def __init__(self, number: int, items):
        self.id, self.items = number, items

    @property
    def value(self) -> list[tuple[int, str]]:
        return self.items.value


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_matched, n_item, overlap, at_word): each document and benchmark item of
    which at least SIMILARITY of the words, or of WINDOW words in a row, stand in place in it.

    Words are maximal runs of word characters, lower-cased; in scripts without spaces each character is
    one. Items of less than five words must stand whole. The benchmark's seeds are the hashed side, in
    blocks of bounded size; the documents stream past each block without a shuffle, and a block is
    released before the next one is gathered. Null or empty texts: no leak. Items with null id are
    reported with null. Repeated rows: each reported. Ties: the diagonal with most words, then the
    first. Whole texts of any length are read; further columns are ignored; empty tables give no rows.
    """
    out = None
    for shared, alone in _blocks(benchmark):

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = _index(shared)
            for frame in frames:
                for at in range(0, len(frame), 256):
                    part = frame.iloc[at : at + 256]
                    ids = part["doc_id"].tolist()
                    rows = [(ids[t], index.item_ids[k], m, n, m / n, w) for t, k, m, n, w in index.find(part["text"].tolist())]
                    if rows:
                        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_matched", "n_item", "overlap", "at_word"])
            give_back()

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
            run, "doc_id long, item_id long, n_matched long, n_item long, overlap double, at_word long"
        )
        if not alone:
            found = materialize(found, "leaks")
            shared.items.destroy()
        out = found if out is None else out.unionAll(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, all columns as they are; null and empty texts stay."""
    before = None
    for shared, alone in _blocks(benchmark):
        docs = docs.where(~_leaky(shared)("text"))
        if not alone:
            docs = materialize(docs, "clean")
            shared.items.destroy()
            if before is not None:
                discard(before)
            before = docs
    return docs


def _leaky(shared):
    @F.pandas_udf("boolean")
    def leaky(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index(shared)
        for texts in batches:
            out, values = np.zeros(len(texts), bool), texts.tolist()
            for at in range(0, len(values), 256):
                for t, *_ in index.find(values[at : at + 256]):
                    out[at + t] = True
            yield pd.Series(out)
        give_back()

    return leaky


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents", "doc_id"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

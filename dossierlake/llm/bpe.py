"""Byte-level BPE encoding and decoding with a segment tree over byte positions."""
from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..session import ship
from .common import give_back, resident, table

#: Distinct pieces whose ids one worker remembers; the half met longest ago is forgotten first.
REMEMBERED = 250_000
NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, a space, its rank, on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one piece: again and again the leftmost adjacent pair of least rank is merged.

    Leaf i of the tree holds rank and position of the pair that starts at byte i, the root the
    least of all. A merge changes three leaves: the merged pair's, its right part's, which dies,
    and the left neighbour's; each is O(log n), so a piece of n bytes takes O(n log n).
    """
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    after.append(n)

    def pair(i: int) -> int:
        middle = after[i]
        if middle >= n or after[middle] - i > longest:
            return NONE
        rank = ranks.get(piece[i : after[middle]])
        return NONE if rank is None else rank * size + i

    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = pair(i)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            if other < value:
                value = other
            i >>= 1
            if tree[i] == value:
                return
            tree[i] = value

    while tree[1] < NONE:
        i = tree[1] & (size - 1)
        gone = after[i]
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        put(gone, NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class PairTable:
    """Rank of the token that two adjacent tokens make, for arrays of pairs: an open-addressed hash table
    of every split of every token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        key = left << 32 | right
        place = self._place(key)
        while len(key):
            free = self.keys[place] == -1
            first = np.unique(place[free], return_index=True)[1]
            at = np.flatnonzero(free)[first]
            self.keys[place[at]], self.values[place[at]] = key[at], rank[at]
            rest = np.ones(len(key), bool)
            rest[at] = False
            key, rank, place = key[rest], rank[rest], (place[rest] + 1) & (len(self.keys) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the two make no token."""
        key = left << 32 | right
        place, out = self._place(key), np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            found = self.keys[place]
            hit = found == key
            out[open_[hit]] = self.values[place[hit]]
            on = ~hit & (found != -1)
            open_, key, place = open_[on], key[on], (place[on] + 1) & (len(self.keys) - 1)
        return out


def merge_many(pieces: list[bytes], pairs: PairTable, byte_ids: np.ndarray, size: int) -> list[bytes]:
    """Ids of many pieces of at most ``size`` bytes each, a power of two: the same trees as in ``merge``,
    one row for each piece, and each step merges one pair in every piece that still has one."""
    m, depth = len(pieces), size.bit_length() - 1
    length = np.fromiter(map(len, pieces), np.int64, m)
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
    token = byte_ids[raw]
    column = np.arange(size)
    after, before = np.tile(column + 1, (m, 1)), np.tile(np.arange(-1, size), (m, 1))
    tree = np.full((m, 2 * size), NONE, np.int64)
    row, i = np.nonzero(column[None, :] < length[:, None] - 1)
    rank = pairs(token[row, i], token[row, i + 1])
    some = rank >= 0
    tree[row[some], size + i[some]] = rank[some] * size + i[some]
    for level in range(depth - 1, -1, -1):
        w = 1 << level
        tree[:, w : 2 * w] = np.minimum(tree[:, 2 * w : 4 * w : 2], tree[:, 2 * w + 1 : 4 * w : 2])
    live = np.flatnonzero(tree[:, 1] < NONE)
    while len(live):
        least = tree[live, 1]
        i, rank = least & (size - 1), least >> depth
        gone = after[live, i]
        follows = after[live, gone]
        token[live, i] = rank
        after[live, i] = follows
        before[live, follows] = i
        tree[live, size + gone] = NONE
        ahead, value = follows < length[live], np.full(len(live), NONE, np.int64)
        made = pairs(rank[ahead], token[live[ahead], follows[ahead]])
        value[ahead] = np.where(made >= 0, made * size + i[ahead], NONE)
        tree[live, size + i] = value
        prior = before[live, i]
        has = prior >= 0
        made = pairs(token[live[has], prior[has]], rank[has])
        tree[live[has], size + prior[has]] = np.where(made >= 0, made * size + prior[has], NONE)
        # logarithmic point updates, level by level, of the three leaves' paths
        nodes = np.stack([i, gone, np.where(has, prior, i)]) + size
        for _ in range(depth):
            nodes >>= 1
            for node in nodes:
                tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
        live = live[tree[live, 1] < NONE]
    alive, at = np.zeros((m, size), bool), np.zeros(m, np.int64)
    left = np.arange(m)
    while len(left):
        alive[left, at[left]] = True
        at[left] = after[left, at[left]]
        left = left[at[left] < length[left]]
    ids = token[alive].astype("<u4").tobytes()
    ends = np.cumsum(alive.sum(axis=1)) * 4
    return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Encoder:
    """Pieces of a text to token ids, each id four bytes, least significant first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.ranks, self.longest, self.remembered = ranks, max(map(len, ranks), default=0), remembered
        self.split = regex.compile(pattern).findall
        # pieces met since the last turn of the cache, and those of the turn before
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: PairTable | None = None
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        tokens = {rank: token for token, rank in ranks.items()}
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces not yet known: short ones are merged together, long ones alone."""
        self.pairs = self.pairs or PairTable(self.ranks)
        out, by_size = {}, {}
        for p in pieces:
            raw = p.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            if whole is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(raw) > 64:
                out[p] = np.array(merge(raw, self.ranks, self.longest), dtype="<u4").tobytes()
            else:
                by_size.setdefault(1 << (len(raw) - 1).bit_length(), []).append((p, raw))
        for size, some in by_size.items():
            out.update(zip((p for p, _ in some), merge_many([r for _, r in some], self.pairs, self.byte_ids, size)))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        if len(self.known) > self.remembered // 2:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        missing = set().union(*split).difference(known)
        again = {p: older[p] for p in missing if p in older}
        known.update(again)
        fresh = self.learn(missing.difference(again))
        get = known.__getitem__
        known.update((p, i) for p, i in fresh.items() if len(p) <= 64)
        if any(len(p) > 64 for p in fresh):  # long pieces serve this call only
            def get(p: str) -> bytes:
                return known.get(p) or fresh[p]
        return [b"".join(map(get, pieces)) for pieces in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _encoder(key: tuple, ranks) -> Encoder:
    return resident(("bpe", *key), lambda: Encoder(ranks.value, key[1]))


def _shared(spark: SparkSession, path: str, pattern: str):
    """The rank table as a broadcast: it holds one vocabulary, whatever the size of the corpus."""
    ship(spark)
    return (path, pattern), spark.sparkContext.broadcast(read_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """``keep`` (default doc_id) and ``ids``: the token ids of each whole text as a buffer of
    little-endian unsigned 32-bit integers, without special tokens. With ``decoded`` the same worker
    decodes the ids again and adds the bytes as ``decoded``.

    Null text: as empty, an empty buffer. Repeated rows: each encoded. Very long texts: the texts of
    one Arrow batch are encoded one after the other and handed on in small frames; a piece of n bytes
    takes O(n log n). A column in ``keep`` that is called ids, text or decoded is refused. An empty
    table gives no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    made = ["ids", "decoded"] if decoded else ["ids"]
    if {"ids", "text", "decoded"} & set(keep):
        raise ValueError("ids, text and decoded are no columns to keep; join them back where needed")
    key, ranks = _shared(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(key, ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = enc.encode_all([t or "" for t in part.column("text").to_pylist()])
                columns = [ids, map(enc.decode, ids)] if decoded else [ids]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x, pa.binary()) for x in columns)], names=[*keep, *made])
        give_back()

    schema = StructType([docs.schema[c] for c in keep] + [StructField(c, BinaryType()) for c in made])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``: the bytes that the token ids stand for. Null ids give null. A table that has a
    column of that name is refused."""
    if "decoded" in encoded.columns:
        raise ValueError("a column is called decoded")
    key, ranks = _shared(encoded.sparkSession, path, pattern)

    @F.arrow_udf("binary")
    def back(ids: pa.Array) -> pa.Array:
        enc = _encoder(key, ranks)
        return pa.array([None if x is None else enc.decode(x) for x in ids.to_pylist()], pa.binary())

    return encoded.withColumn("decoded", back("ids"))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: token count and the digests of ids and of the decoded bytes."""
    both = encode(docs, path, pattern, decoded=True)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(table(spark, sf_dir, "documents", "doc_id"), path, public_tokenizers.PATTERN)

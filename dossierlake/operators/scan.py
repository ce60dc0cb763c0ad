"""Ranking a stated set of questions by reading the records: nothing of a record is stored or shuffled.

Each task compares its records with all questions of a block, as a product of sparse counts, and passes on its own
best rows of a question only. What is moved is bounded by questions, limit and tasks, not by the records' words.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import ship

#: Cells (record, question) that a task scores at once.
CELLS = 250_000
#: Limits beyond this pass on all rows that match instead of the best of a task.
LARGEST_LIMIT = 10_000


@dataclass
class Incidence:
    """For each term the questions that count it, and a weight of each."""

    ptr: np.ndarray
    question: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(pairs: list[tuple[int, int, float]], n_terms: int) -> Incidence:
        pairs = sorted(pairs)
        t = np.array([p[0] for p in pairs], np.int64)
        return Incidence(np.searchsorted(t, np.arange(n_terms + 1)), np.array([p[1] for p in pairs], np.int64), np.array([p[2] for p in pairs], np.float64))

    def summed(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, n_rows: int, n_questions: int) -> np.ndarray:
        """Sums of value * weight by row and question."""
        n = self.ptr[term + 1] - self.ptr[term]
        entry = np.repeat(np.arange(len(term)), n)
        at = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.ptr[term], n)
        cell = row[entry] * n_questions + self.question[at]
        return np.bincount(cell, value[entry] * self.weight[at], n_rows * n_questions).reshape(n_rows, n_questions)


@dataclass
class Block:
    """Questions that are compared with every record at a time."""

    terms: list[str]
    phrases: list[str]
    counts: Incidence
    inner: Incidence
    named: Incidence
    n_inner: np.ndarray = field(default=None)
    n_named: np.ndarray = field(default=None)
    norm: np.ndarray = field(default=None)

    @staticmethod
    def of(asked: list[tuple[str, tuple[str, ...]]], once: bool) -> Block:
        """``once``: terms count once, as for BM25, or as often as the question has them."""
        terms = sorted({t for _, toks in asked for t in toks})
        at = {t: i for i, t in enumerate(terms)}
        counts, inner, named = [], [], []
        for q, (_, toks) in enumerate(asked):
            for t in dict.fromkeys(toks):
                counts.append((at[t], q, 1.0 if once else float(toks.count(t))))
                if len(t) >= 3 and any(c in "0123456789" for c in t):
                    named.append((at[t], q, 1.0))
            inner += [(at[t], q, 1.0) for t in dict.fromkeys(toks[1:-1])]
        size = lambda pairs, value: np.bincount([p[1] for p in pairs], [value(p[2]) for p in pairs], len(asked))
        make = lambda pairs: Incidence.of(pairs, len(terms))
        return Block(terms, [p for p, _ in asked], make(counts), make(inner), make(named), size(inner, float), size(named, float), np.sqrt(size(counts, lambda w: w * w)))


def _places(lists: pa.ListArray, terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and terms of the tokens that are terms (of a list of terms), and the number of all tokens of each row."""
    flat, n = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    term = pc.fill_null(pc.index_in(flat, value_set=pa.array(terms, flat.type)), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    return row[term >= 0], term[term >= 0].astype(np.int64), n


def _norms(lists: pa.ListArray) -> np.ndarray:
    """The norm of the counts of each row's tokens."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    code = lists.flatten().dictionary_encode()
    key, count = np.unique(np.repeat(np.arange(len(n)), n) * max(1, len(code.dictionary)) + code.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    return np.sqrt(np.bincount(key // max(1, len(code.dictionary)), count.astype(np.float64) ** 2, len(n)))


def _counted(row: np.ndarray, term: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, n = np.unique(row * n_terms + term, return_counts=True)
    return key // n_terms, key % n_terms, n.astype(np.float64)


def _round(x: np.ndarray, digits: int = 6) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


class Best:
    """The best rows of each question so far, by score and then id."""

    def __init__(self, n_questions: int, limit: int):
        self.limit, self.least = limit, np.full(n_questions, -np.inf)
        self.question, self.score, self.record = np.empty(0, np.int64), np.empty(0), None

    def add(self, question: np.ndarray, score: np.ndarray, record: np.ndarray) -> None:
        if not len(question):
            return
        if self.record is not None:
            question, score, record = np.concatenate([self.question, question]), np.concatenate([self.score, score]), np.concatenate([self.record, record])
        order = np.lexsort((record, -score, question))
        question = question[order]
        place = np.arange(len(question)) - np.searchsorted(question, question)
        kept = place < self.limit
        self.question, self.score, self.record = question[kept], score[order][kept], record[order][kept]
        last = place == self.limit - 1
        self.least[question[last]] = score[order][last]


def _ids(column: pa.Array) -> np.ndarray:
    out = column.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


def _hopeful(score: np.ndarray, bonus: np.ndarray | float, best: Best | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and questions that may come among the best; in the first records also by these themselves."""
    if best is None:
        return np.nonzero(score > 0)
    least = best.least
    open_ = np.nonzero(np.isinf(least))[0]
    if len(open_) and len(score) > best.limit:
        own = np.partition(score[:, open_], len(score) - best.limit, axis=0)[len(score) - best.limit]
        least = least.copy()
        least[open_] = np.where(own > 0, own - 1e-6, -np.inf)  # scores are rounded later
    return np.nonzero((score > 0) & (score + bonus + 1e-6 >= least))


def _emitted(question: np.ndarray, score: np.ndarray, record: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(question, pa.int32()), pa.array(record.tolist(), kind), pa.array(score, pa.float64())], ["q", "record_id", "score"])


def _texts(records: DataFrame, *more: Column) -> DataFrame:
    """(toks, bid, ...): tokens of text and bid id; a record without text has neither."""
    bid = F.when(F.col("text").isNotNull(), tokens(F.coalesce("bid_id", F.lit("")))) if "bid_id" in records.columns else F.expr("cast(null as array<string>)")
    return records.select(tokens("text").alias("toks"), bid.alias("bid"), *more)


def asked_of(queries: DataFrame) -> tuple[list[tuple], list[tuple[str, tuple[str, ...]]]]:
    """(query_id, number) of all queries with a token, and the questions without repeats by number."""
    rows = queries.select("query_id", F.lower(F.trim("query")).alias("phrase"), tokens("query").alias("toks")).collect()
    numbers: dict[tuple, int] = {}
    of = [(r.query_id, numbers.setdefault((r.phrase, tuple(r.toks)), len(numbers))) for r in rows if r.toks]
    return of, list(numbers)


def statistics(records: DataFrame, terms: list[str]) -> tuple[int, float, dict[str, int]]:
    """Number and mean length of the records, and how many records hold each term: one scan, summed in the tasks."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, length = np.zeros(len(terms), np.int64), 0, 0
        for b in batches:
            row, term, size = _places(b.column("toks"), terms)
            other, also, more = _places(b.column("bid"), terms)
            held += np.bincount(np.unique(np.concatenate([row, other]) * len(terms) + np.concatenate([term, also])) % len(terms), minlength=len(terms))
            n, length = n + b.num_rows, length + int(size.sum() + more.sum())
        some = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], pa.int32()), pa.array([n, length, *held[some].tolist()], pa.int64())], ["term", "n"])

    found = {r.term: r.n for r in _texts(records).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, length = found.pop(-1, 0), found.pop(-2, 0)
    return n, length / n if n else 0.0, {terms[t]: k for t, k in found.items()}


def best_by_bm25(records: DataFrame, asked: list[tuple], limit: int | None, stats: tuple, k1: float, b: float, identifier_bonus: float, phrase_bonus: float) -> DataFrame:
    """(q, record_id, score): what each task holds best for the questions, see ``retrieval.keyword_candidates``."""
    n, mean, held = stats
    block = Block.of(asked, once=True)
    df = np.array([held.get(t, 0) for t in block.terms], np.float64)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    kind = records.schema["record_id"].dataType.simpleString()
    n_terms, n_questions = len(block.terms), len(asked)
    step = max(1, CELLS // n_questions)
    named, extra = bool(block.n_named.any()), identifier_bonus * block.n_named

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, id_type = None if limit is None else Best(n_questions, limit), None
        for batch in batches:
            id_type, low = batch.column("record_id").type, batch.column("low")
            row, term, size = _places(batch.column("toks"), block.terms)
            other, also, more = _places(batch.column("bid"), block.terms)
            row, term, tf = _counted(np.concatenate([row, other]), np.concatenate([term, also]), n_terms)
            part = idf[term] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * (size + more)[row] / (mean or 1.0))))
            ids = _ids(batch.column("record_id"))
            for at in range(0, batch.num_rows, step):
                s, e = np.searchsorted(row, (at, at + step))
                rows = min(step, batch.num_rows - at)
                of = lambda inc, value: inc.summed(row[s:e] - at, term[s:e], value, rows, n_questions)  # noqa: B023, E731
                score, one = of(block.counts, part[s:e]), np.ones(e - s)
                if named:
                    score = np.where((score > 0) & (of(block.named, one) == block.n_named), score + extra, 0.0)
                near = of(block.inner, one) == block.n_inner
                r, q = _hopeful(score, near * phrase_bonus, best)
                found = score[r, q]
                for i in np.nonzero(near[r, q])[0]:
                    if block.phrases[q[i]] in low[int(at + r[i])].as_py():
                        found[i] += phrase_bonus
                found = _round(found)
                r, q, found = r[found > 0], q[found > 0], found[found > 0]
                if best is None:
                    yield _emitted(q, found, ids[at + r], id_type)
                else:
                    best.add(q, found, ids[at + r])
        if best is not None and best.record is not None:
            yield _emitted(best.question, best.score, best.record, id_type)

    return _texts(records, F.col("record_id"), F.lower("text").alias("low")).mapInArrow(run, f"q int, record_id {kind}, score double")


def best_by_cosine(records: DataFrame, asked: list[tuple], limit: int | None) -> DataFrame:
    """(q, record_id, score): what each task holds best by the cosine of token counts."""
    block = Block.of(asked, once=False)
    kind = records.schema["record_id"].dataType.simpleString()
    n_terms, n_questions = len(block.terms), len(asked)
    step = max(1, CELLS // n_questions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, id_type = None if limit is None else Best(n_questions, limit), None
        for batch in batches:
            id_type, toks = batch.column("record_id").type, batch.column("toks")
            row, term, _ = _places(toks, block.terms)
            row, term, tf = _counted(row, term, n_terms)
            norm, ids = np.maximum(_norms(toks), 1.0), _ids(batch.column("record_id"))
            for at in range(0, batch.num_rows, step):
                s, e = np.searchsorted(row, (at, at + step))
                rows = min(step, batch.num_rows - at)
                dot = block.counts.summed(row[s:e] - at, term[s:e], tf[s:e], rows, n_questions)
                score = _round(dot / (norm[at : at + rows, None] * block.norm))
                r, q = _hopeful(score, 0.0, best)
                if best is None:
                    yield _emitted(q, score[r, q], ids[at + r], id_type)
                else:
                    best.add(q, score[r, q], ids[at + r])
        if best is not None and best.record is not None:
            yield _emitted(best.question, best.score, best.record, id_type)

    return records.select("record_id", tokens("text").alias("toks")).mapInArrow(run, f"q int, record_id {kind}, score double")


def _matrices(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each dimension; those that are null or hold a null are left out."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    start, out = np.cumsum(n) - n, {}
    for d in np.unique(n[n > 0]):
        rows = np.nonzero(n == d)[0]
        out[int(d)] = rows, flat.reshape(-1, d) if len(rows) == len(n) else flat[start[rows][:, None] + np.arange(d)]
    return out


def best_by_vector(vectors: DataFrame, asked: list, limit: int | None) -> DataFrame:
    """(q, record_id, score): what each task holds best by the cosine with the vectors asked for. A cosine that is
    undefined is null and comes last."""
    sides = {}
    for d in {len(v) for v in asked if v}:
        at = np.array([i for i, v in enumerate(asked) if v and len(v) == d])
        m = np.array([asked[i] for i in at], np.float64)
        sides[d] = at, m, np.sqrt((m * m).sum(axis=1))
    kind = vectors.schema["record_id"].dataType.simpleString()
    n_questions = len(asked)
    step = max(1, CELLS // n_questions)

    def cosines(rows: int, matrices: dict, at: int) -> np.ndarray:
        out = np.full((rows, n_questions), -np.inf)
        for d, (of, m) in matrices.items():
            if d not in sides:
                continue
            a, b = np.searchsorted(of, (at, at + rows))
            q, wanted, norm = sides[d]
            some = m[a:b]
            with np.errstate(divide="ignore", invalid="ignore"):
                score = (some @ wanted.T) / (np.sqrt((some * some).sum(axis=1))[:, None] * norm)
            score[~np.isfinite(score)] = -np.inf
            if len(q) == n_questions and b - a == rows:
                return score
            out[np.ix_(of[a:b] - at, q)] = score
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, id_type = None if limit is None else Best(n_questions, limit), None
        for batch in batches:
            id_type, ids = batch.column("record_id").type, _ids(batch.column("record_id"))
            matrices = _matrices(batch.column("vector"))
            for at in range(0, batch.num_rows, step):
                score = cosines(min(step, batch.num_rows - at), matrices, at)
                if best is None:
                    r, q = np.nonzero(np.ones_like(score, bool))
                    yield _emitted(q, _round(score[r, q]), ids[at + r], id_type)
                    continue
                least = best.least
                open_ = np.nonzero(np.isinf(least))[0]
                if len(open_) and len(score) > limit:
                    least = least.copy()
                    least[open_] = np.partition(score[:, open_], len(score) - limit, axis=0)[len(score) - limit] - 1e-6
                r, q = np.nonzero(score >= least - 1e-6)  # scores are rounded later
                best.add(q, _round(score[r, q]), ids[at + r])
        if best is not None and best.record is not None:
            yield _emitted(best.question, best.score, best.record, id_type)

    found = vectors.select("record_id", "vector").mapInArrow(run, f"q int, record_id {kind}, score double")
    return found.withColumn("score", F.when(F.col("score") > float("-inf"), F.col("score")))

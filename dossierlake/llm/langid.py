"""Language ID with hyperdimensional profiles of letter trigrams."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import give_back, resident, table

#: Components of a hypervector, and the seed of the random letter vectors.
DIMENSION, SEED = 1024, 20240229
#: Labelled documents that each language's profile is bundled from, about, chosen by hash of their id;
#: and the most languages there may be.
SAMPLE_PER_LANGUAGE, MAX_LANGUAGES = 1500, 10_000
_BUCKETS = 1 << 30
UNKNOWN = "und"
#: Partitions that the sample is bundled in.
_BUNDLERS = 6
_CHUNK = 400_000

_letters = np.array([chr(c).isalpha() for c in range(0x110000)])


class Space:
    """Letter vectors and the trigram vectors bound from them.

    A letter's vector is random in {-1, 1}, drawn from its code point; white space and everything
    that is no letter share one. A trigram abc is bound as rho(rho(a)) * rho(b) * c, where rho rolls
    a vector by one component.
    """

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension
        self.held = 0
        self.code = np.zeros(0x110000, np.int32)
        self.vectors = np.zeros((256, dimension), np.int8)
        self.bound: dict[int, int] = {}
        self.table = np.zeros((1024, dimension), np.int8)

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """Dense numbers of the code points in ``codes``, from 1 on; 0 is no letter yet seen."""
        out = self.code[codes]
        if not out.all():
            fresh = np.unique(codes[out == 0]).tolist()
            drawn = [np.random.default_rng([SEED, c]).integers(0, 2, self.dimension, dtype=np.int8) * 2 - 1 for c in fresh]
            while self.held + len(fresh) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            self.vectors[self.held : self.held + len(fresh)] = drawn
            self.code[fresh] = np.arange(self.held + 1, self.held + len(fresh) + 1)
            self.held += len(fresh)
            out = self.code[codes]
        return out

    def trigrams(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of trigram keys, one row each."""
        rows = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            row = self.bound.get(key)
            if row is None:
                a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
                if len(self.bound) >= 200_000:  # far more than any alphabet needs; start afresh
                    return self._fresh(keys)
                row = self.bound[key] = len(self.bound)
                if row >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[row] = np.roll(self.vectors[a - 1], 2) * np.roll(self.vectors[b - 1], 1) * self.vectors[c - 1]
            rows[i] = row
        return self.table[rows]

    def _fresh(self, keys: np.ndarray) -> np.ndarray:
        self.bound, self.table = {}, np.zeros((1024, self.dimension), np.int8)
        if len(keys) > 100_000:
            return np.concatenate([self.trigrams(keys[i : i + 100_000]) for i in range(0, len(keys), 100_000)])
        return self.trigrams(keys)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Trigram keys of the lower-cased text and how often each stands in it; None without letters."""
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        is_letter = _letters[codes]
        if not is_letter.any():
            return None
        codes = np.where(is_letter, codes, 32)
        stays = is_letter | np.append(True, is_letter[:-1])
        n = self.letters(codes[stays]).astype(np.int64)
        keys = n[:-2] << 42 | n[1:-1] << 21 | n[2:]
        return np.unique(keys, return_counts=True)

    def bundle(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """One bundled vector per text, and whether the text has letters."""
        out, known = np.zeros((len(texts), self.dimension), np.float32), np.zeros(len(texts), bool)
        at = 0
        while at < len(texts):
            keys, counts, owner, size, begin = [], [], [], 0, at
            while at < len(texts) and size < _CHUNK and at - begin < 256:
                got = self.counts(texts[at]) if isinstance(texts[at], str) else None
                if got:
                    known[at] = True
                    keys.append(got[0])
                    counts.append(got[1])
                    owner.append(np.full(len(got[0]), at - begin))
                    size += len(texts[at])
                at += 1
            if keys:
                every, place = np.unique(np.concatenate(keys), return_inverse=True)
                who, how = np.concatenate(owner), np.concatenate(counts).astype(np.float32)
                # blocks of trigrams keep the dense matrices small, however many kinds there are
                for low in range(0, len(every), 8192):
                    ok = (place >= low) & (place < low + 8192)
                    block = every[low : low + 8192]
                    dense = np.zeros((at - begin, len(block)), np.float32)
                    dense[who[ok], place[ok] - low] = how[ok]
                    out[begin:at] += dense @ self.trigrams(block).astype(np.float32)
        return out, known


def _space(dimension: int) -> Space:
    return resident(("language", dimension), lambda: Space(dimension))


def held_out(doc_id="doc_id"):
    """Whether a document is kept for evaluation: crc32 of its id as text, mod 4, is 2. Null: no."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, dimension: int = DIMENSION) -> tuple[list[str], np.ndarray]:
    """Languages and their profiles: the bundle of the unit vectors of about ``per_language`` labelled
    documents each, the ones with a small hash of doc_id, or all if there are fewer. Only text and non-null lang of documents
    that are not held out are read. What reaches the driver is bounded by the number of languages."""
    ship(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out() & F.col("doc_id").isNotNull())
    counts = labelled.where("text is not null").groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} values of lang")
    if not counts:
        return [], np.zeros((0, dimension))
    # a share of each language, decided row by row; at most MAX_LANGUAGES rows are sent to all tasks
    cuts = docs.sparkSession.createDataFrame([(r.lang, -(-per_language * _BUCKETS // r.n)) for r in counts], "lang string, cut long")
    sample = labelled.where("text is not null").select("doc_id", "lang", "text").join(F.broadcast(cuts), "lang")
    sample = sample.where(F.pmod(F.xxhash64("doc_id"), F.lit(_BUCKETS)) < F.col("cut")).select("doc_id", "lang", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, sums = _space(dimension), {}
        for frame in frames:
            vectors, known = space.bundle(frame["text"].tolist())
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            for lang in frame["lang"].unique():
                own = (frame["lang"] == lang).to_numpy() & known
                sums[lang] = sums.get(lang, 0) + vectors[own].sum(axis=0, dtype=np.float64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})
        give_back()

    rows = sample.repartition(_BUNDLERS, "doc_id").mapInPandas(run, "lang string, v array<double>").collect()
    total: dict[str, np.ndarray] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.v)):
        total[r.lang] = total.get(r.lang, 0) + np.array(r.v)
    langs = sorted(k for k, v in total.items() if np.any(v))
    if not langs:
        return [], np.zeros((0, dimension))
    profiles = np.stack([total[k] for k in langs])
    return langs, profiles / np.linalg.norm(profiles, axis=1, keepdims=True)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text"):
    """A struct column (lang, score) for each whole text: the language whose profile has the largest
    cosine with the text's vector, score that cosine cut to 0..1; ties go to the first language by name.
    Null text, no letter, or no profile: ``und``, 0."""
    langs, profiles = model
    dimension = profiles.shape[1]

    def judge(texts: pd.Series) -> pd.DataFrame:
        vectors, known = _space(dimension).bundle(texts.tolist())
        if not len(langs) or not len(vectors):
            return pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0})
        cosines = vectors @ profiles.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(best)), best], 0, 1)
        names = np.array(langs, dtype=object)[best]
        names[~known] = UNKNOWN
        return pd.DataFrame({"lang": names, "score": np.where(known, score, 0.0)})

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield judge(texts)
        give_back()

    return predict(F.col(text))


def predictions(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document.

    Learns from the documents that are not held out. Repeated rows: each predicted. Null doc_id: not
    held out, not learned from. Very long texts are read whole. No labelled row: every prediction is
    ``und``. Further columns are ignored. An empty table gives no rows.
    """
    model = train(docs, **options)
    out = docs.select("doc_id", "text").withColumn("p", identify(docs, model))
    return out.select("doc_id", held_out().alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def known_language(docs: DataFrame, **options) -> DataFrame:
    """The documents in which a language was recognised, all columns as they are. A text that has no
    letter is rejected; so is one whose score does not exceed 0, which resembles no profile at all."""
    p = identify(docs, train(docs, **options))
    name = "language" + "_" * max(map(len, docs.columns))  # longer than any column of docs
    return docs.withColumn(name, p).where((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.score") > 0)).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    return predictions(table(spark, sf_dir, "documents", "doc_id"))

"""Toxicity by compression distance.

Two Zstandard dictionaries are made: one is trained on ordinary documents, one holds what toxic
documents say more often than ordinary ones: the runs of one to ``TERM`` words whose share of toxic
texts exceeds that of ordinary ones by more than chance allows (``toxic_terms``; copies count once, a
word that some ordinary texts hold too stays).  A document is cut into windows of ``WINDOW`` words, and
every window is compressed twice, with the ordinary dictionary and with the ordinary one followed by
the toxic one.  The distance of a window is the bytes that the toxic dictionary saves.  Largest, second
largest and mean distance and the number of windows make the score, by a logistic curve that is
calibrated on labelled documents the dictionaries have not seen.

Training takes a bounded sample of labelled rows (``TOXIC_ROWS``, ``ORDINARY_ROWS``: least id
hashes; of texts beyond ``LONGEST`` characters ``PASSAGES`` passages at equal steps, which do not
calibrate), three quarters for the dictionaries, the rest for the
calibration.  It happens on the driver; dictionaries and weights are broadcast.  Every document is
scored over its whole text.

Defined cases: null and empty texts have no windows and get the score of the curve at zero; rows
without a label or id are not learned from; an id labelled twice counts as toxic if any label
says so; with fewer than ``LEAST_ROWS`` rows of a class every score is the share of toxic rows
(zero without rows); equal rows get equal scores; other columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import nsmallest
from zlib import crc32

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
TOXIC_ROWS = 1500
ORDINARY_ROWS = 7000
LONGEST = 20_000
LEAST_ROWS = 8
ORDINARY_BYTES = 112_000
TOXIC_BYTES = 65_536
SHARED_BY = 3
TERM = 3  # words of the longest term
RATE = 3.0  # a term's least rate in toxic texts, as a multiple of that in ordinary ones
PASSAGES = 10  # of a labelled text beyond LONGEST
#: Matches shorter than six bytes say nothing; large tables keep every place of a dictionary.
SETTINGS = dict(
    window_log=18, hash_log=17, chain_log=17, search_log=8, min_match=6, target_length=64, strategy=zstandard.STRATEGY_GREEDY,
    write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _wide(word: bytes) -> bytes:
    """Words too short for a match are written several times."""
    return word if len(word) > 4 else b"_".join([word] * (8 // (len(word) + 1)))


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Windows of ``size`` words with the first words of the next, so that every term lies whole in one."""
    words = [_wide(w) for w in words_of(text)]
    return [b" " + b" ".join(words[i:i + size + TERM - 1]) + b" " for i in range(0, len(words), size)]


def _trained(size: int, samples: list[bytes], segment: int, part: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=part).as_bytes()
    except zstandard.ZstdError:  # too few samples: their own bytes serve
        return b"".join(samples)[-size:]


@dataclass
class Model:
    """Dictionaries and the calibrated curve."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=lambda: [-30.0, 0.0, 0.0, 0.0, 0.0])

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self):
        return self.ordinary, self.toxic, self.weights

    def __setstate__(self, state) -> None:
        self.ordinary, self.toxic, self.weights = state
        self._pair = None

    def distances(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves, per window."""
        if self._pair is None:
            settings = zstandard.ZstdCompressionParameters(**SETTINGS)
            self._pair = [
                zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings).compress
                for data in (self.ordinary, self.ordinary + self.toxic)
            ]
        plain, both = self._pair
        return np.array([len(plain(w)) - len(both(w)) for w in windows(text)], dtype=np.float64)

    def features(self, text: str | None) -> list[float]:
        d = self.distances(text) if self.toxic else np.zeros(0)
        if not len(d):
            return [1.0, 0.0, 0.0, 0.0, 0.0]
        top = np.sort(d)[-2:]
        return [1.0, float(top[-1]), float(top[0]) if len(d) > 1 else 0.0, float(d.mean()), float(np.log(len(d)))]

    def score(self, text: str | None) -> float:
        return float(_curve(np.dot(self.features(text), self.weights)))


def _curve(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic curve by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = _curve(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def toxic_terms(toxic: list[str | None], ordinary: list[str | None]) -> list[tuple[bytes, ...]]:
    """Runs of one to ``TERM`` words that are more frequent in toxic texts than chance allows, the surest first.

    Frequencies are shares of the texts of each class, copies counted once.  The measure is the likelihood
    ratio of both shares, its limit grows with the number of terms looked at.
    """
    ids = {w: k for k, w in enumerate(dict.fromkeys(w for t in toxic for w in words_of(t)))}
    names, base = list(ids), len(ids) + 1

    def codes(texts: list[str | None]) -> Iterator[list[np.ndarray]]:
        seen: set[int] = set()
        for text in texts:
            words = words_of(text)
            runs = set(nsmallest(64, {crc32(b" ".join(words[i:i + 3])) for i in range(len(words) - 2)}))
            if len(runs) >= 10 and 2 * len(runs & seen) > len(runs):
                continue  # a copy of an earlier one
            seen |= runs
            k = np.array([ids.get(w, -1) for w in words], dtype=np.int64)
            found = []
            for n in range(1, TERM + 1):
                code = np.zeros(max(0, len(k) - n + 1), dtype=np.int64)
                known = np.ones(len(code), dtype=bool)
                for j in range(n):
                    part = k[j:j + len(code)]
                    code, known = code * base + part, known & (part >= 0)
                found.append(np.unique(code[known]))
            yield found

    def counted(texts: list[str | None], wanted: list[np.ndarray] | None) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
        n, kept = 0, [[] for _ in range(TERM)]
        for found in codes(texts):
            n += 1
            for k, c in enumerate(found):
                kept[k].append(c if wanted is None else c[np.isin(c, wanted[k], assume_unique=True)])
        return n, [np.unique(np.concatenate(c), return_counts=True) if c else (np.zeros(0, np.int64),) * 2 for c in kept]

    n1, often = counted(toxic, None)
    least = SHARED_BY if any((c >= SHARED_BY).any() for _, c in often) else 1
    often = [(t[c >= least], c[c >= least]) for t, c in often]
    n0, there = counted(ordinary, [t for t, _ in often])
    limit = 2 * np.log(max(2, sum(len(t) for t, _ in often)))
    out: dict[tuple[bytes, ...], float] = {}
    for n, ((terms, a), (also, counts)) in enumerate(zip(often, there), 1):
        b = np.zeros(len(terms))
        b[np.searchsorted(terms, also)] = counts
        share = (a + b) / (n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * sum(np.nan_to_num(x * np.log(x / y)) for x, y in ((a, n1 * share), (b, n0 * share), (n1 - a, n1 * (1 - share)), (n0 - b, n0 * (1 - share))))
        for k in np.flatnonzero((g > limit) & (a * n0 >= RATE * b * n1)):
            code, term = int(terms[k]), []
            for _ in range(n):
                code, w = divmod(code, base)
                term.append(names[w])
            out[tuple(reversed(term))] = float(g[k])
    kept: list[tuple[bytes, ...]] = []
    used: set[tuple[bytes, ...]] = set()
    below: set[tuple[bytes, ...]] = set()
    for term in sorted(out, key=lambda t: (-out[t], -len(t), t)):
        parts = {term[i:j] for i in range(len(term)) for j in range(i + 1, len(term) + 1)}
        if term not in below and used.isdisjoint(parts):  # neither part nor extension of a surer one
            kept.append(term)
            used.add(term)
            below |= parts
    return kept


def train(texts: list[str | None], toxic: list[int], parts: list[int] | None = None) -> Model:
    """Model of labelled texts, in a given order (the same order gives the same model).  ``parts`` marks texts that are passages of longer ones: they do not calibrate."""
    groups = {k: [t for t, label in zip(texts, toxic) if label == k] for k in (0, 1)}
    if min(map(len, groups.values())) < LEAST_ROWS:
        share = sum(toxic) / len(toxic) if toxic else 0.0
        return Model(weights=[float(np.clip(np.log((share + 1e-12) / (1 - share + 1e-12)), -30, 30)), 0.0, 0.0, 0.0, 0.0])
    cut = {k: [t for t, label, c in zip(texts, toxic, parts or [0] * len(texts)) if label == k and c] for k in (0, 1)}
    whole = {k: [t for t, label, c in zip(texts, toxic, parts or [0] * len(texts)) if label == k and not c] for k in (0, 1)}
    if min(map(len, whole.values())) < LEAST_ROWS:
        whole, cut = groups, {0: [], 1: []}
    learn = {k: [t for i, t in enumerate(g) if i % 4] + cut[k] for k, g in whole.items()}
    phrases = [b" " + b" ".join(map(_wide, term)) + b" " for term in toxic_terms(learn[1], learn[0])]
    samples = [w for t in learn[0] for w in windows(t, 30)]
    if phrases:  # the ordinary dictionary must not hold the terms, or they save nothing
        terms = re.compile(rb"(?<= )(?:" + b"|".join(re.escape(x[1:-1]) for x in sorted(phrases, key=len, reverse=True)) + rb")(?= )")
        samples = [terms.sub(b"", w) for w in samples]
    kept = 0
    while kept < len(phrases) and sum(map(len, phrases[:kept + 1])) <= TOXIC_BYTES:
        kept += 1
    model = Model(_trained(ORDINARY_BYTES, samples, 64, 8), b"".join(reversed(phrases[:kept])))
    rows = [(model.features(t), k) for k, g in whole.items() for t in g[::4]]
    model.weights = calibrate(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)).tolist()
    return model


def sample_rows(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str, text_col: str, label_col: str) -> list:
    """At most ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` labelled rows, chosen by id hash."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & allowed).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    picked = [
        known.where(F.col("_y") == k).orderBy(F.xxhash64(F.col(id_col)), id_col).limit(n).select(F.col(id_col).alias("_id"), "_y")
        for k, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))
    ]
    size, step = F.char_length(text_col), LONGEST // PASSAGES
    passages = F.transform(F.sequence(F.lit(0), F.lit(PASSAGES - 1)), lambda k: F.substring(F.col(text_col), (k * (size - step) / (PASSAGES - 1)).cast("int") + 1, F.lit(step)))
    texts = docs.select(F.col(id_col).alias("_d"), F.when(size <= LONGEST, F.col(text_col)).otherwise(F.array_join(passages, " ")).alias("_t"), (size > LONGEST).cast("int").alias("_p")).where("_t IS NOT NULL")
    found = texts.join(F.broadcast(picked[0].unionAll(picked[1])), F.col("_d") == F.col("_id"))
    return found.orderBy(F.xxhash64("_id"), "_id", "_t").limit(TOXIC_ROWS + ORDINARY_ROWS).select("_t", "_y", "_p").collect()


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Model from the labels of rows that ``allowed`` (a condition over ``labels``) admits."""
    rows = sample_rows(docs, labels, allowed, id_col, text_col, label_col)
    return train([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])


def add_score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of each whole text (0 to 1)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in texts:
            yield pd.Series([own.score(t) for t in batch], dtype="float64")

    return df.withColumn(out, score(F.col(text_col).cast("string")))

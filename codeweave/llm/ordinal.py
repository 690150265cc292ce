"""Quality classifier: ordinal cumulative-link regression over hashed text.

P(grade >= k) is the logistic function of w.x - t_k with one weight vector for all
grades and ordered thresholds t_1 < t_2 < ...; x holds hashed features of the
whole text: the words in it and their beginnings of 4 to 6 bytes (present or not, punctuation
stripped, lower-cased), the shares of word shapes (runs of letters, capitals, digits and signs), the shares of
repeated words and of words equal to the one before, and the length's band.

It is fitted on at most ``max_fit`` (4,000) graded documents, those whose ids have the
smallest hashes, and scores every document.  The default keeps a document if its
grade is more likely than not the highest (the tail probability).

Nulls and edge cases: null or empty text has its length's band only.  Labels without
a quality are not used; a document with several labels takes its lowest grade.
Null ids have no label; of rows that repeat an id that is fitted one is taken, the same in each run.  Without any label, or with a single grade, all
documents score the highest grade.  Repeated rows are kept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import shared, words_of

BITS = 18
GRADES = 3
BEGINNINGS = (4, 5, 6)
#: Weight of shares beside the 1 of a word that is present.
SHARE = 16
EDGE = b".,;:!?*#$%&|<>\"'()[]{}-_=+/\\~^`"
SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
RUN = re.compile(rb"(.)\1+", re.S)


def bucket(kind: bytes, value: bytes = b"") -> int:
    return zlib.crc32(kind + value) & (1 << BITS) - 1


class Features:
    """Hashed features of texts; buckets of words are remembered, ``keep`` words at most."""

    def __init__(self, keep: int = 300_000):
        self.keep = keep
        self.known: dict[bytes, tuple[int, tuple[int, ...]]] = {}

    def _word(self, word: bytes) -> tuple[int, tuple[int, ...]]:
        """Buckets of a word's shape, and of the word and its beginnings."""
        if len(self.known) >= self.keep:
            self.known.clear()
        bare = word.strip(EDGE).lower()
        parts = [bucket(b"w", bare)] + [bucket(b"p", bare[:k]) for k in BEGINNINGS if k <= len(bare)]
        found = self.known[word] = bucket(b"s", RUN.sub(rb"\1", word.translate(SHAPE))), tuple(parts)
        return found

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = words_of(text)
        n = len(words)
        if not n:
            return np.array([bucket(b"n", b"0")], np.int32), np.ones(1, np.float32)
        counts, known = Counter(words), self.known
        present: set[int] = set()
        shapes: dict[int, int] = {}
        for word, c in counts.items():
            shape, parts = known.get(word) or self._word(word)
            shapes[shape] = shapes.get(shape, 0) + c
            present.update(parts)
        same = sum(map(eq, words, islice(words, 1, None)))
        at = [bucket(b"n", str(n.bit_length()).encode()), bucket(b"d"), bucket(b"r"), *shapes, *sorted(present)]
        value = [1.0, SHARE * (1 - len(counts) / n), SHARE * same / max(1, n - 1), *(SHARE * c / n for c in shapes.values()), *[1.0] * len(present)]
        return np.array(at, np.int32), np.array(value, np.float32)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    def tails(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        return _logistic(float(self.weights[at] @ value) - self.thresholds)


def fit_rows(grade: np.ndarray, count: np.ndarray, at: np.ndarray, value: np.ndarray, least_docs: int = 4, ridge: float = 5e-4, steps: int = 250, rate: float = 0.1) -> Ordinal:
    """Weights by Adam on the mean log loss with a ridge; features of fewer documents have weight 0.

    ``count`` features a document stand one after another in ``at`` and ``value``.
    """
    grade = grade.astype(np.int64)
    if len(np.unique(grade)) < 2:
        return Ordinal(np.zeros(1 << BITS), np.full(GRADES - 1, -np.inf))
    often = (np.bincount(at, minlength=1 << BITS) >= least_docs)[at]
    row = np.repeat(np.arange(len(grade), dtype=np.int32), count)[often]
    at, value = at[often], value[often]
    used = np.unique(at)
    col = np.searchsorted(used, at).astype(np.int32)
    del at, often
    w = np.zeros(len(used))
    share = np.array([(grade >= k).mean() for k in range(1, GRADES)]).clip(0.01, 0.99)
    t = -np.log(share / (1 - share))
    gap = np.log(np.maximum(np.diff(t), 0.05))
    p = np.concatenate((w, t[:1], gap))
    m, v = np.zeros_like(p), np.zeros_like(p)
    n, k = len(grade), len(used)
    for step in range(1, steps + 1):
        t = p[k] + np.concatenate(([0.0], np.cumsum(np.exp(p[k + 1 :]))))
        z = np.bincount(row, weights=p[:k].astype(np.float32)[col] * value, minlength=n)
        tail = np.hstack([np.ones((n, 1)), _logistic(z[:, None] - t), np.zeros((n, 1))])
        slope = tail * (1 - tail)
        mine = np.maximum(tail[np.arange(n), grade] - tail[np.arange(n), grade + 1], 1e-12)
        up, down = slope[np.arange(n), grade] / mine, slope[np.arange(n), grade + 1] / mine
        dz = -(up - down) / n
        dt = np.zeros(GRADES + 1)
        np.add.at(dt, grade, up / n)
        np.add.at(dt, grade + 1, -down / n)
        dt = dt[1:GRADES]
        g = np.concatenate((np.bincount(col, weights=dz.astype(np.float32)[row] * value, minlength=k) + ridge * p[:k], [dt.sum()], [dt[j + 1 :].sum() * np.exp(p[k + 1 + j]) for j in range(GRADES - 2)]))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - rate * (1 - step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros(1 << BITS)
    weights[used] = p[:k]
    return Ordinal(weights, p[k] + np.concatenate(([0.0], np.cumsum(np.exp(p[k + 1 :])))))


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """``labels``: ``doc_id``, ``grade`` from 0 to GRADES - 1.  The graded rows that are joined, and their features, are bounded by ``max_fit``."""
    graded = labels.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit).select(F.col("doc_id").alias("__id"), "grade")
    narrow = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text"))
    joined = narrow.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select(F.col("__id").cast("long"), "grade", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, first = Features(), {}  # by id the row with the smallest features: at most max_fit rows
        for batch in batches:
            for doc, grade, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                at, value = features.of(text.as_py())
                row = at.tobytes(), value.tobytes(), grade
                if doc not in first or row < first[doc]:
                    first[doc] = row
        rows = [(doc, *row) for doc, row in first.items()]
        for start in range(0, len(rows), 64):
            part = list(zip(*rows[start : start + 64]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[3], pa.int32()), pa.array(part[1], pa.binary()), pa.array(part[2], pa.binary())], ["id", "grade", "at", "value"])

    made = joined.mapInArrow(run, "id long, grade int, at binary, value binary")
    rows = made.groupBy("id").agg(F.min(F.struct("at", "value", "grade")).alias("r")).select("id", "r.*").toArrow().sort_by("id")
    count = np.array([len(x.as_buffer()) // 4 for x in rows.column("at")], np.int64)
    at, value = (np.frombuffer(b"".join(rows.column(x).to_pylist()), kind) for x, kind in (("at", np.int32), ("value", np.float32)))
    grade = rows.column("grade").to_numpy()
    del rows
    return fit_rows(grade, count, at, value)


def graded(docs_labels: DataFrame) -> DataFrame:
    """Grades from ``quality`` and ``toxic``: 0 toxic, 1 poor, 2 good.

    Toxic words add up without bound, so that they belong at the end of the scale.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 2)
    return docs_labels.select("doc_id", grade.cast("int").alias("grade"))


def scored(docs: DataFrame, model: Ordinal, text: Column, keep: int = 300_000) -> Column:
    """A struct column: ``expected`` grade, ``p_ge1``, ``p_ge2``; a task remembers ``keep`` words (about 400 bytes each)."""
    get = shared(docs, model)

    @F.pandas_udf("expected double, p_ge1 double, p_ge2 double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features, m = Features(keep), get()
        for texts in batches:
            tails = np.array([m.tails(*features.of(t)) for t in texts]).reshape(-1, GRADES - 1)
            yield pd.DataFrame({"expected": tails.sum(1), "p_ge1": tails[:, 0], "p_ge2": tails[:, 1]})

    return score(text.cast("string"))


def classify(docs: DataFrame, model: Ordinal, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``expected``, ``p_ge1``, ``p_ge2``, ``kept``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), scored(docs, model, F.col(text_col)).alias("s"))
    return rows.select("doc_id", "s.expected", "s.p_ge1", "s.p_ge2", (F.col("s.p_ge2") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, model: Ordinal, threshold: float = 0.5, text_col: str = "text", keep: int = 120_000) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    return docs.where(scored(docs, model, F.col(text_col), keep)["p_ge2"] >= threshold)

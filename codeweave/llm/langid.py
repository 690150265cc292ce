"""Language identification by mixture inference.

A document is a mixture of languages: its words are drawn from languages with
unknown proportions, a word's likelihood in a language being the product over
its character trigrams (word ends included).  Expectation-maximisation finds
the proportions; nested sets of the leading languages, those with a share of ``least`` (2 %) or
more, are then refitted, and the set with the best penalised likelihood (a cost of
``penalty`` x log words for each further language) is taken.  The prediction is the largest share in it.

Spark counts trigrams by language over every learning document; tasks combine
their counts before they emit them.  A trigram is named by a 16-bit hash, so
that the model holds 65,536 weights for each language, and languages may number
at most ``MAX_LANGUAGES``; this bounds what is broadcast to 128 MB.

Learning takes only text and language of documents with a language whose
crc32(doc_id as text) mod 4 is not 2.  A prediction sees text alone.

Nulls and edge cases: null text, or text without a letter, is ``und`` with score
0, as is every text if nothing can be learned.  A null id counts as the empty
text for crc32.  Texts are never cut.  Repeated rows are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import durable, shared

HELD_OUT = 2
BUCKETS = 1 << 16
MAX_LANGUAGES = 512
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
LONGEST = 40


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == HELD_OUT


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters; runs over LONGEST letters fall into pieces."""
    if not text:
        return []
    words = LETTERS.findall(text.lower())
    if any(len(w) > LONGEST for w in words):
        words = [w[k : k + LONGEST] for w in words for k in range(0, len(w), LONGEST)]
    return words


def has_letter(words: list[str]) -> bool:
    return any(w.isalpha() for w in words) or any(c.isalpha() for w in words for c in w)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of the words, and the number of the word of each."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    middle = codes[1:-1] != 32
    number = np.cumsum(codes[1:-1] == 32)
    return (h >> np.uint64(48)).astype(np.int64)[middle], number[middle]


def trigram_counts(docs: DataFrame, hold: int = 150_000) -> DataFrame:
    """``lang``, ``bucket``, ``n`` over rows ``text``, ``lang``."""

    def counted(lang: str, words: Counter) -> pa.RecordBatch:
        many = np.fromiter(words.values(), np.int64, len(words))
        bucket, number = trigrams(list(words))
        n = np.bincount(bucket, weights=many[number], minlength=BUCKETS).astype(np.int64)
        at = np.nonzero(n)[0]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                own = held.setdefault(lang.as_py(), Counter())
                own.update(letter_words(text.as_py()))
                if len(own) > hold or len(held) > 64 and sum(map(len, held.values())) > hold:
                    for name in list(held):
                        if held[name]:
                            yield counted(name, held[name])
                    held.clear()
        for lang, own in held.items():
            if own:
                yield counted(lang, own)

    return docs.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of trigram buckets by language."""

    def __init__(self, counts: DataFrame, smooth: float = 0.5):
        names = [r.lang for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
        if len(names) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        self.langs = sorted(names)
        got = counts.toArrow()
        n = np.zeros((BUCKETS, len(self.langs)))
        place = {x: k for k, x in enumerate(self.langs)}
        cols = np.array([place[x] for x in got.column("lang").to_pylist()], np.int64)
        n[got.column("bucket").to_numpy(), cols] = got.column("n").to_numpy()
        used = max(1, int((n.sum(1) > 0).sum()))
        self.log = np.log((n + smooth) / (n.sum(0) + smooth * used)).astype(np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word in each language, the best at 0."""
        bucket, number = trigrams(words)
        ends = np.concatenate(([0], np.nonzero(np.diff(number))[0] + 1))
        score = np.add.reduceat(self.log[bucket], ends, axis=0)
        return score - score.max(1, keepdims=True)


def mixture(like: np.ndarray, weight: np.ndarray, steps: int, share: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Proportions by EM over word likelihoods, and the log likelihood."""
    total = weight.sum()
    share = np.full(like.shape[1], 1.0 / like.shape[1]) if share is None else share / share.sum()
    for _ in range(steps):
        joint = like * share
        new = (weight / joint.sum(1)) @ joint / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(weight @ np.log((like * share).sum(1)))


def infer(like: np.ndarray, weight: np.ndarray, penalty: float = 3.0, least: float = 0.02, steps: int = 25) -> tuple[int, float, list[int]]:
    """The language with the largest share, its share, and the set taken.  Ties go to the smaller name."""
    share, _ = mixture(like, weight, steps)
    ranked = [int(k) for k in np.argsort(-share, kind="stable") if share[k] >= least] or [int(share.argmax())]
    best, taken, parts = -np.inf, ranked[:1], np.ones(1)
    cost = penalty * np.log(max(2.0, weight.sum()))
    for m in range(1, len(ranked) + 1):
        part, fit = mixture(like[:, ranked[:m]], weight, steps if m > 1 else 1, share[ranked[:m]])
        if fit - cost * (m - 1) > best:
            best, taken, parts = fit - cost * (m - 1), ranked[:m], part
    top = int(parts.argmax())
    return taken[top], float(min(1.0, parts[top] * share[taken].sum())), taken


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: int = 400_000) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``languages`` (those of the mixture)."""
    get = shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = get()
        place: dict[str, int] = {}
        kept = max(1, min(keep, 16_000_000 // max(1, len(m.langs))))  # 64 MB of likelihoods, however many languages
        like = np.empty((kept + 1, len(m.langs)), np.float32)
        for batch in batches:
            out: list[tuple[str, float, list[str]]] = []
            for value in batch.column(1):
                words = Counter(letter_words(value.as_py()))
                if not words or not m.langs or not has_letter(list(words)):
                    out.append((UNKNOWN, 0.0, []))
                    continue
                new = [w for w in words if w not in place]
                if len(place) + len(new) > kept:
                    place.clear()
                    new = list(words)
                if len(new) > kept:  # a text with more words than are kept
                    own = np.exp(m.word_scores(new)) + 1e-12
                else:
                    if new:
                        at = len(place)
                        like[at : at + len(new)] = np.exp(m.word_scores(new)) + 1e-12
                        place.update(zip(new, range(at, at + len(new))))
                    own = like[np.fromiter((place[w] for w in words), np.int64, len(words))]
                top, share, taken = infer(own.astype(np.float64), np.fromiter(words.values(), np.float64, len(words)))
                out.append((m.langs[top], share, sorted(m.langs[k] for k in taken)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.list_(pa.string()))], ["doc_id", "lang_pred", "score", "languages"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    learn = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    return Model(durable(trigram_counts(learn.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")))))

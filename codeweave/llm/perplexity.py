"""Quality rules: rule counts of a text, and bands of n-gram perplexity by language.

The model is an interpolated modified Kneser-Ney model over the characters of words: a word is its characters
and an end sign, seen through up to ``ORDER - 1`` characters before each, start signs where the word has none.
Spark counts the n-grams of all documents; tasks combine counts of words before they emit them, and the counts are
summed by n-gram.  An n-gram is named by its symbols themselves (two longs) and its language, so that none are merged
and the model grows with what the corpus holds.  Counts of counts, discounts and interpolated probabilities are
DataFrame operations, language by language.

Scoring looks n-grams up in sorted arrays of 64-bit hashes beside their probabilities, as far as an n-gram was seen, else
by its suffix and the weights of its contexts.  Up to ``MOST_ENTRIES`` entries (12 bytes each) the arrays are broadcast;
a larger model stays a table, and the distinct words of the corpus are joined with it instead, then the documents with
their words' scores.  Both ways give the same scores.

A document's perplexity, by word, is judged by its language: the band reaches from its quartiles ``below`` and ``above``
interquartile ranges (of log perplexity, ``least`` at least), and further for short documents by ``allowance`` / sqrt(words).
The quartiles are those of distinct texts, so that a group of copies counts once.

Nulls and edge cases: null text has no word and fails the base rules.  Null language is a language of its own.  Texts
are never cut; a word of any length is scored whole.  Languages without a document that passes the base rules have no
band.  Repeated rows are kept and count for the model, an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import column, durable, fresh, hot_join, shared, small, words_of

ORDER = 5
#: Bits of a symbol; three symbols stand in the first long of an n-gram, the last two in the second.
BITS = 21
START, END = np.uint32(1), np.uint32(2)
SYMBOLS = "#*$%&|<>"
MIX = np.uint64(0x9E3779B97F4A7C15)
MIN_WORDS, MAX_REPEAT = 50, 50
MOST_ENTRIES = 6_000_000
#: Reach of a band below and above the quartiles in interquartile ranges, the least range, and the room of short texts.
BELOW, ABOVE, LEAST, ALLOWANCE = 2.5, 6.0, 0.05, 6.0


# ------------------------------------------------------------------ rule counts
def rule_counts(text: str | None, counts: Counter | None = None, words: list[bytes] | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; its words and their counts may be given."""
    if not text:
        return 0, 0, 0, 0, 0
    words = words_of(text) if words is None else words
    blank = sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(" \t\n\x0b\x0c\r"):
                seen.add(line)
    return len(words), len(text) - blank, symbols, dup, repeated_words(words, Counter(words) if counts is None else counts)


def repeated_words(words: list[bytes], counts: Counter) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    v = len(counts)
    if n < 4 or v == n:
        return 0
    number = dict(zip(counts, range(v)))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pairs = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1] if v > 1 << 20 else ids[:-1] * v + ids[1:]
    windows = pairs[:-1] * v + ids[2:]
    order = np.argsort(windows)
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= twice
    return int(cover.sum())


# ----------------------------------------------------------------------- n-grams
def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two longs of each longest n-gram of the words, one for each character and end sign, and the number of its word."""
    text = b" ".join(words) + b" "
    codes = np.frombuffer(text.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    last = codes == 32
    number = np.cumsum(last) - last
    starts = np.concatenate(([0], np.nonzero(last)[0][:-1] + 1))
    place = np.arange(len(codes)) - starts[number]
    codes = np.where(last, END, codes + np.uint32(3))
    lags = [codes.astype(np.int64)]
    for j in range(1, ORDER):
        before = np.full(len(codes), START)
        before[j:] = codes[:-j]
        lags.append(np.where(place >= j, before, START).astype(np.int64))
    return lags[4] << 2 * BITS | lags[3] << BITS | lags[2], lags[1] << BITS | lags[0], number


def _order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The order of n-grams from ``_grams``: by one long if the symbols, numbered among themselves, fit in."""
    low = (1 << BITS) - 1
    symbols = [a >> 2 * BITS, a >> BITS & low, a & low, b >> BITS, b & low]
    seen = np.zeros(int(symbols[-1].max()) + 1, bool)  # each symbol but the start sign is the last one of some n-gram
    seen[symbols[-1]] = seen[START] = True
    number = np.cumsum(seen)
    bits = int(number[-1]).bit_length()
    if bits * ORDER > 63:
        return np.lexsort((b, a))
    key = np.zeros(len(a), np.int64)
    for s in symbols:
        key = key << bits | number[s]
    return np.argsort(key)


def ngram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", hold: int = 150_000) -> DataFrame:
    """``lang``, ``a``, ``b``, ``n``: counts of the longest n-grams of all documents; a task holds about ``hold`` words."""

    def summed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = _order(a, b)
        a, b, n = a[order], b[order], n[order]
        first = np.nonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))[0]
        return a[first], b[first], np.add.reduceat(n, first)

    def counted(lang: str | None, words: Counter, step: int = 1 << 14) -> pa.RecordBatch:
        every, many, parts = list(words), np.fromiter(words.values(), np.int64, len(words)), []
        for at in range(0, len(every), step):
            a, b, number = _grams(every[at : at + step])
            parts.append(summed(a, b, many[at + number]))
        a, b, n = summed(*map(np.concatenate, zip(*parts)))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(a), pa.array(b), pa.array(n)], ["lang", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                own = held.setdefault(lang.as_py(), Counter())
                own.update(words_of(text.as_py()))
                if len(own) > hold or len(held) > 64 and sum(map(len, held.values())) > hold:
                    for name in list(held):
                        if held[name]:
                            yield counted(name, held[name])
                    held.clear()
        for lang, own in held.items():
            if own:
                yield counted(lang, own)

    rows = docs.select(column(text_col).cast("string").alias("text"), column(lang_col).cast("string").alias("lang")).mapInArrow(run, "lang string, a long, b long, n long")
    return rows.groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))


#: By order: the two longs of an n-gram's suffix of that order, and its first symbol.
_SUFFIX = {4: (f"a & {(1 << 2 * BITS) - 1}", "b"), 3: (f"a & {(1 << BITS) - 1}", "b"), 2: ("0L", "b"), 1: ("0L", f"b & {(1 << BITS) - 1}")}
_FIRST = {5: f"shiftright(a, {2 * BITS})", 4: f"shiftright(a, {BITS})", 3: "a", 2: f"shiftright(b, {BITS})", 1: "b"}


def probabilities(counts: DataFrame) -> tuple[dict[int, DataFrame], dict[int, DataFrame], DataFrame]:
    """By order ``lang``, ``a``, ``b``, ``p`` of n-grams and ``lang``, ``a``, ``b``, ``w`` of contexts, and ``lang``, ``p`` of a symbol never seen.

    An n-gram that starts a word keeps its count, others count the symbols that stand before them.  Discounts
    come from the counts of counts of the language and order.
    """
    level, leveled = durable(counts), {}
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            a, b = _SUFFIX[n]
            level = level.groupBy("lang", F.expr(a).alias("a"), F.expr(b).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
            level = durable(level.withColumn("c", F.when(F.expr(_FIRST[n]) == int(START), F.col("n")).otherwise(F.col("kinds"))))
        leveled[n] = level.select("lang", "a", "b", (F.col("n") if n == ORDER else F.col("c")).alias("c"))
    grams, weights, lower = {}, {}, None
    for n in range(1, ORDER + 1):
        own = leveled[n]
        of = small(own.groupBy(F.col("lang").alias("l")).agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)], F.count("*").alias("kinds")))
        y = "n1 / (n1 + 2 * n2)"
        off = [F.expr(f"case when n{k} > 0 and n{k + 1} > 0 then least({k} - 0.05D, greatest(0.05D, {k} - {k + 1} * {y} * n{k + 1} / n{k})) else 0.75D end").alias(f"d{k}") for k in (1, 2, 3)]
        own = own.join(of.select("l", "kinds", *off), F.col("lang").eqNullSafe(F.col("l")))
        less = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = own.select("lang", "a", "b", "c", less.alias("less"), F.expr(f"shiftright(b, {BITS})").alias("x"), "kinds")
        held = own.groupBy("lang", "a", "x").agg(F.sum("c").alias("total"), F.sum("less").alias("freed"), F.max("kinds").alias("kinds"))
        held = held.select(F.col("lang").alias("l"), F.col("a").alias("ca"), F.col("x").alias("cx"), "total", (F.col("freed") / F.col("total")).alias("w"), "kinds")
        held = durable(held)
        weights[n] = held.select(F.col("l").alias("lang"), F.col("ca").alias("a"), F.col("cx").alias("b"), "w")
        both = own.drop("kinds").join(held, F.col("lang").eqNullSafe(F.col("l")) & (F.col("a") == F.col("ca")) & (F.col("x") == F.col("cx")))
        part = (F.col("c") - F.col("less")) / F.col("total")
        if n == 1:
            unseen = held.select(F.col("l").alias("lang"), (F.col("w") / (F.col("kinds") + 1)).alias("p"))
            made = both.select("lang", "a", "b", (part + F.col("w") / (F.col("kinds") + 1)).alias("p"))
        else:
            a, b = _SUFFIX[n - 1]
            suffix = lower.select(F.col("lang").alias("sl"), F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("p").alias("q"))
            both = both.withColumn("ka", F.expr(a)).withColumn("kb", F.expr(b))
            made = both.join(suffix, F.col("lang").eqNullSafe(F.col("sl")) & (F.col("ka") == F.col("sa")) & (F.col("kb") == F.col("sb"))).select("lang", "a", "b", (part + F.col("w") * F.col("q")).alias("p"))
        grams[n] = lower = durable(made)
    return grams, weights, unseen


def language_number(lang: str | None) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42) if lang is not None else 0


def _key(language: int, tag: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams (tag: their order) or contexts (16 + order) of a language."""
    h = np.full(len(a), (language + (tag + 1) * int(MIX)) & (1 << 64) - 1, np.uint64)
    for s in (a, b):
        h = (h ^ s.view(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


class Model:
    """Sorted arrays of keys beside probabilities, for n-grams of all orders, and beside weights, for their contexts."""

    def __init__(self, grams: dict[int, DataFrame], weights: dict[int, DataFrame], unseen: DataFrame):
        self.grams = self._gathered([(n, df, "p") for n, df in grams.items()])
        self.weights = self._gathered([(16 + n, df, "w") for n, df in weights.items() if n > 1] + [(64, unseen.select("lang", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "p"), "p")])

    @staticmethod
    def _gathered(tables: list) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lang, a, c, tag = b.column(0).dictionary_encode(), *(b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 4))
                code = lang.indices.fill_null(len(lang.dictionary)).to_numpy(zero_copy_only=False)
                keys = np.zeros(len(a), np.uint64)
                for k, name in enumerate([*lang.dictionary.to_pylist(), None]):
                    for t in np.unique(tag):
                        at = (code == k) & (tag == t)
                        keys[at] = _key(language_number(name), int(t), a[at], c[at])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(3).cast(pa.float32())], ["k", "v"])

        every = None
        for tag, df, value in tables:
            one = df.select("lang", "a", "b", F.col(value).alias("v"), F.lit(tag).alias("tag"))
            every = one if every is None else every.union(one)
        got = every.mapInArrow(run, "k long, v float").toArrow()
        keys, values = got.column("k").to_numpy().view(np.uint64), got.column("v").to_numpy()
        order = np.argsort(keys)
        return keys[order], values[order]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], key: np.ndarray, default: float) -> np.ndarray:
        keys, values = table
        if not len(keys):
            return np.full(len(key), default)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], default)

    def log_probabilities(self, language: int, words: list[bytes]) -> np.ndarray:
        """Log probability of each word with its end sign."""
        a, b, number = _grams(words)
        # Each n-gram is looked up once, in the order of the table.
        key = _key(language, ORDER, a, b)
        order = np.argsort(key)
        ranked = key[order]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        which = np.empty(len(a), np.int64)
        which[order] = np.cumsum(first) - 1
        a, b = a[order[first]], b[order[first]]
        p, open_, factor = np.zeros(len(a)), np.arange(len(a)), np.ones(len(a))
        for n in range(ORDER, 0, -1):
            x, y = a[open_], b[open_]
            if n < 4:
                x = x & (1 << BITS) - 1 if n == 3 else np.zeros_like(x)
            elif n == 4:
                x = x & (1 << 2 * BITS) - 1
            if n == 1:
                y = y & (1 << BITS) - 1
            found = self._find(self.grams, _key(language, n, x, y), np.nan)
            seen = ~np.isnan(found)
            p[open_[seen]] = found[seen] * factor[seen]
            if seen.all():
                break
            open_, factor, x, y = open_[~seen], factor[~seen], x[~seen], y[~seen]
            if n > 1:
                factor = factor * self._find(self.weights, _key(language, 16 + n, x, y >> BITS), 1.0)
            else:
                zero = np.zeros(1, np.int64)
                p[open_] = factor * float(self._find(self.weights, _key(language, 64, zero, zero), 1e-4)[0])
        return np.bincount(number, weights=np.log(p)[which], minlength=len(words))


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: int = 150_000, carry: bool = False) -> DataFrame:
    """``doc_id``, ``lang``, ``h`` (a hash of the text), rule counts and ``log_ppl``, log perplexity by word (null without words), of each document.

    With ``carry`` the columns of ``docs`` come first under their own names, the others under fresh ones.
    A worker remembers the scores of ``keep`` words, of all languages together.
    """
    get = shared(docs, model)
    own = docs.columns if carry else []
    names = [fresh(x, own) for x in ("doc_id", "lang", "h", *NAMES, "log_ppl")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict[bytes, float]] = {}
        size, own_model = 0, get()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                doc, text, lang, h = part.columns[-4:]
                langs, counted, rules, found = lang.to_pylist(), [], [], []
                fresh_words: dict[str | None, dict[bytes, None]] = {}
                for name, value in zip(langs, text):
                    value = value.as_py()
                    words = words_of(value)
                    counted.append(counts := Counter(words))
                    rules.append(rule_counts(value, counts, words))
                    found.append(got := list(map(known.setdefault(name, {}).get, counts)))
                    if None in got:
                        fresh_words.setdefault(name, {}).update(dict.fromkeys([w for w, x in zip(counts, got) if x is None]))
                if size + sum(map(len, fresh_words.values())) > keep:
                    known, size = {}, 0  # scores that are found already stay as they are
                for name, new in fresh_words.items():
                    new = list(new)
                    size += len(new)
                    known.setdefault(name, {}).update(zip(new, own_model.log_probabilities(language_number(name), new).tolist()))
                scores = []
                for name, counts, got, rule in zip(langs, counted, found, rules):
                    if None in got:
                        old = known[name]
                        got = [old[w] if x is None else x for w, x in zip(counts, got)]
                    scores.append(-sum(map(mul, got, counts.values())) / rule[0] if rule[0] else None)
                columns = [pa.array([r[k] for r in rules], pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-4], doc, lang, h, *columns, pa.array(scores, pa.float64())], [*own, *names])

    text = column(text_col).cast("string")
    narrow = docs.select(*map(column, own), column(id_col).cast("long").alias(names[0]), text.alias(fresh("text", own)), column(lang_col).cast("string").alias(names[1]), F.xxhash64(text).alias(names[2]))
    schema = T.StructType([*(docs.schema.fields if carry else []), T.StructField(names[0], T.LongType()), T.StructField(names[1], T.StringType()), T.StructField(names[2], T.LongType()), *[T.StructField(x, T.LongType()) for x in names[3:8]], T.StructField(names[8], T.DoubleType())])
    return narrow.mapInArrow(run, schema)


def measure_joined(docs: DataFrame, grams: dict[int, DataFrame], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: bool = False) -> DataFrame:
    """As ``measure``, with a model that stays a table: words are joined with it, documents with their words.

    Every n-gram of ``docs`` must be in the model, as it is if the model is theirs.  Each row's words and their counts are
    written once; frequent words are broadcast with their scores, the others are joined by shuffle.
    """
    own = docs.columns if carry else []
    names = [fresh(x, own) for x in ("doc_id", "lang", "h", *NAMES, "log_ppl")]
    bag, row = fresh("bag", [*own, *names]), fresh("row", [*own, *names])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                doc, text, lang, h = part.columns[-4:]
                values = [t.as_py() for t in text]
                words = list(map(words_of, values))
                counted = list(map(Counter, words))
                rules = list(map(rule_counts, values, counted, words))
                held = [[{"w": w, "n": n} for w, n in c.items()] for c in counted]
                columns = [pa.array([r[k] for r in rules], pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-4], doc, lang, h, *columns, pa.array(held, kind)], [*own, *names[:8], bag])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                a, b, number = _grams(part.column(1).to_pylist())
                take = pa.array(number)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(a), pa.array(b)], ["l", "w", "ga", "gb"])

    text = column(text_col).cast("string")
    narrow = docs.select(*map(column, own), column(id_col).cast("long").alias(names[0]), text.alias(fresh("text", own)), column(lang_col).cast("string").alias(names[1]), F.xxhash64(text).alias(names[2]))
    schema = T.StructType([*(docs.schema.fields if carry else []), T.StructField(names[0], T.LongType()), T.StructField(names[1], T.StringType()), T.StructField(names[2], T.LongType()), *[T.StructField(x, T.LongType()) for x in names[3:8]], T.StructField(bag, T.ArrayType(T.StructType([T.StructField("w", T.BinaryType()), T.StructField("n", T.LongType())])))])
    rows = durable(narrow.mapInArrow(bags, schema).withColumn(row, F.monotonically_increasing_id()))
    uses = rows.select(F.col(row).alias("row"), F.col(names[1]).alias("l"), F.explode(bag).alias("e")).select("row", F.struct("l", "e.w").alias("word"), "e.n")
    vocabulary = durable(uses.groupBy("word").agg(F.count("*").alias("rows")))
    model = grams[ORDER].select(F.col("lang").alias("ml"), "a", "b", F.log("p").alias("lp"))
    letters = vocabulary.select("word.l", "word.w").mapInArrow(spelled, "l string, w binary, ga long, gb long")
    found = letters.join(model, F.col("l").eqNullSafe(F.col("ml")) & (F.col("ga") == F.col("a")) & (F.col("gb") == F.col("b")))
    scored = found.groupBy("l", "w").agg(F.sum("lp").alias("lp")).select(F.struct("l", "w").alias("word2"), "lp")
    same = (F.col("word.l").eqNullSafe(F.col("word2.l"))) & (F.col("word.w") == F.col("word2.w"))
    table = durable(vocabulary.join(scored, same).select("word", "rows", "lp").withColumn("word", F.concat_ws(":", F.coalesce(F.concat(F.lit("l"), "word.l"), F.lit("")), F.hex("word.w"))))
    uses = uses.select("row", "n", F.concat_ws(":", F.coalesce(F.concat(F.lit("l"), "word.l"), F.lit("")), F.hex("word.w")).alias("word"))
    total = hot_join(uses, table, "word", "rows").groupBy("row").agg(F.sum(F.col("n") * F.col("lp")).alias("total"))
    out = rows.join(total, rows[row] == total["row"], "left")
    return out.select(*map(column, [*own, *names[:8]]), (-F.col("total") / F.col(names[3])).alias(names[8]))


# -------------------------------------------------------------------------- verdict
def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT):
    return (F.col(n_words) < min_words) | (100 * F.col(n_repeat_words) > max_repeat * F.col(n_words))


def bands(rows: DataFrame, below: float, above: float, least: float) -> DataFrame:
    """``l``, ``lower``, ``upper`` of the languages, from ``lang``, ``h``, ``log_ppl`` of documents that pass the base rules."""
    distinct = rows.groupBy("lang", "h").agg(F.max("log_ppl").alias("x"))
    parts = distinct.groupBy("lang").agg(F.percentile_approx("x", [0.25, 0.75], F.lit(10_000)).alias("q"))
    wide = F.greatest(F.element_at("q", 2) - F.element_at("q", 1), F.lit(least))
    return parts.select(F.col("lang").alias("l"), (F.element_at("q", 1) - wide * below).alias("lower"), (F.element_at("q", 2) + wide * above).alias("upper"))


def judge(measured: DataFrame, below: float = BELOW, above: float = ABOVE, least: float = LEAST, allowance: float = ALLOWANCE, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``measured`` (checkpointed) with ``base_failed``, the band of its language, and ``kept``.

    Of rows with carried columns the last nine are those of ``measure``; the new columns get fresh names too.
    """
    doc, lang, h, n_words, _, _, _, repeat, ppl = measured.columns[-9:]
    l, lower, upper, failed, kept = (fresh(x, measured.columns) for x in ("l", "lower", "upper", "base_failed", "kept"))
    rows = measured.withColumn(failed, base_failed(n_words, repeat, min_words, max_repeat))
    found = bands(rows.where(~F.col(failed)).select(F.col(lang).alias("lang"), F.col(h).alias("h"), F.col(ppl).alias("log_ppl")), below, above, least).toDF(l, lower, upper)
    room = F.lit(allowance) / F.sqrt(F.greatest(F.col(n_words), F.lit(1)))
    inside = F.coalesce(F.col(ppl).between(F.col(lower) - room, F.col(upper) + room), F.lit(True))
    judged = rows.join(small(found), F.col(lang).eqNullSafe(F.col(l)), "left")
    return judged.select(*map(column, [*measured.columns, failed, lower, upper]), (~F.col(failed) & inside).alias(kept))


def quality_rules(docs: DataFrame, below: float = BELOW, above: float = ABOVE, least: float = LEAST, allowance: float = ALLOWANCE, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, most: int = MOST_ENTRIES, carry: bool = False, **columns: str) -> DataFrame:
    """The whole operator: count, fit, measure, judge.  A model of more than ``most`` entries is not broadcast."""
    fit = {k: v for k, v in columns.items() if k != "id_col"}
    grams, weights, unseen = probabilities(ngram_counts(docs, **fit))
    entries = sum(df.count() for df in [*grams.values(), *weights.values()])
    if entries <= most:
        measured = measure(docs, Model(grams, weights, unseen), carry=carry, **columns)
    else:
        measured = measure_joined(docs, grams, carry=carry, **columns)
    return judge(durable(measured), below, above, least, allowance, min_words, max_repeat)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; rows are carried through the measuring, so that texts aren't shuffled."""
    judged = quality_rules(docs, carry=True, **options)
    return judged.where(F.col(judged.columns[-1])).select(*[column(c) for c in docs.columns])

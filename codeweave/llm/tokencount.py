"""Exact token counts at every prefix of a text, by dynamic programming.

The vocabulary is a SentencePiece BPE model with byte fallback, identity
normalisation and escaped spaces.  No piece holds a space mark after another
character, so that no merge crosses the point before a space mark that follows
another character, nor a line feed.  A text falls into segments there, and
counts add up over them.

Within a segment, BPE has one encoding of each prefix.  Its last token is the
only piece t that ends the prefix such that t may follow the last token of the
prefix before it; two pieces may follow one another if BPE leaves the pair as
it is.  Hence count[i] = count[i - len(t)] + 1, and the last token and count of
every prefix follow from those of shorter ones.  Both are kept by prefix, which
words of a corpus share.

Runs of space marks have equal scores in such models, for which that argument
does not hold; segments that begin with two or more, and characters that
have no piece, take the library's own count.

Nulls and edge cases: null or empty text has 0 bytes and 0 tokens.  Characters
outside the vocabulary count their UTF-8 bytes.  Texts are never cut.  Repeated
rows are kept, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, BYTE = 1, 6


class Unreached(Exception):
    """A prefix whose last token the dynamic programme does not find; the library is asked then."""


class PrefixCounter:
    """Counts by prefix for one model; ``keep`` bounds the prefixes that are kept."""

    def __init__(self, model: bytes, keep: int = 1_500_000, longest: int = 40):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i) for i in range(size)]
        self.score = {self.library.id_to_piece(i): self.library.get_score(i) for i in range(size) if not special[i]}
        if any(MARK in p[1:] and p.strip(MARK) for p in self.score):
            raise ValueError("pieces of this model cross a space mark")
        self.keep, self.longest = keep, longest
        ends: dict[str, set[int]] = {}
        for p in self.score:
            ends.setdefault(p[-2:], set()).add(len(p))
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.state: dict[str, tuple[int, str]] = {"": (0, "")}
        self.total: dict[str, int] = {}

    # ------------------------------------------------------------- encoding
    def _merges_to(self, text: str, first: str) -> bool:
        """Whether BPE leaves ``text`` as two tokens of which this is the first."""
        parts, score = list(text), self.score
        while len(parts) > 2:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts) == 2 and parts[0] == first and text not in score

    def _follows(self, last: str, piece: str) -> bool:
        key = (last, piece)
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self._merges_to(last + piece, last)
        return known

    def _extend(self, states: list[tuple[int, str]], text: str, start: int) -> None:
        """Append the states of the prefixes of ``text`` longer than ``start``."""
        score, ends, follows = self.score, self.ends, self._follows
        for i in range(start + 1, len(text) + 1):
            found = None
            for n in ends.get(text[max(0, i - 2) : i], ()):
                if n <= i:
                    piece = text[i - n : i]
                    if piece in score:
                        count, last = states[i - n]
                        if not last or follows(last, piece):
                            found = (count + 1, piece)
                            break
            if found is None:
                one = text[i - 1]
                count, last = states[i - 1]
                if one in score and (not last or follows(last, one)):
                    found = (count + 1, one)
                elif one in score:  # a model whose ties the argument does not cover
                    raise Unreached(text[:i])
                else:  # byte fallback: it merges with nothing
                    found = (count + len(one.encode("utf-8", "surrogatepass")), "")
            states.append(found)

    def _states(self, segment: str) -> list[tuple[int, str]]:
        """(count, last token) of every prefix, the empty one first."""
        state = self.state
        if len(segment) > self.longest:
            states = [(0, "")]
            self._extend(states, segment, 0)
            return states
        known = len(segment)
        while segment[:known] not in state:
            known -= 1
        states = [state[segment[:i]] for i in range(known + 1)]
        if known < len(segment):
            if len(state) > self.keep:
                state.clear()
                state[""] = (0, "")
                for i in range(known + 1):
                    state[segment[:i]] = states[i]
            self._extend(states, segment, known)
            for i in range(known + 1, len(segment) + 1):
                state[segment[:i]] = states[i]
        return states

    def _asked(self, segment: str) -> int:
        """The library's own count; a segment that starts a line has no mark, which the library would put before it."""
        if segment[0] == MARK:
            return len(self.library.encode(segment[1:].replace(MARK, " "))) if len(segment) > 1 else 1
        return len(self.library.encode("\n" + segment)) - len(self.library.encode("\n"))

    def segment_counts(self, segment: str) -> list[int]:
        """Counts at each prefix of a segment, the empty one first."""
        if segment[:2] == MARK * 2:  # the library puts a mark before each text
            encode = self.library.encode
            return [0, *(len(encode(segment[1:i].replace(MARK, " "))) if i > 1 else 1 for i in range(1, len(segment) + 1))]
        try:
            return [c for c, _ in self._states(segment)]
        except Unreached:
            return [0, *(self._asked(segment[:i]) for i in range(1, len(segment) + 1))]

    def segment_total(self, segment: str) -> int:
        known = self.total.get(segment)
        if known is None:
            if segment[:2] == MARK * 2:
                known = len(self.library.encode(segment[1:].replace(MARK, " ")))
            else:
                try:
                    known = self._states(segment)[-1][0]
                except Unreached:
                    known = self._asked(segment)
            if len(self.total) > self.keep:
                self.total.clear()
            if len(segment) <= self.longest:
                self.total[segment] = known
        return known

    # ----------------------------------------------------------------- texts
    @staticmethod
    def segments(text: str) -> Iterator[list[str]]:
        """The segments of each line of a text; a line feed stands between lines."""
        for k, line in enumerate(text.replace(" ", MARK).split("\n")):
            if not k:
                line = MARK + line
            head, *rest = line.split(MARK)
            out, marks = ([head] if head else []), 0
            for part in rest:
                marks += 1
                if part:
                    out.append(MARK * marks + part)
                    marks = 0
            if marks:
                out.append(MARK * marks)
            yield out

    def count(self, text: str) -> int:
        """The count at the last prefix, which is that of the whole text."""
        if not text:
            return 0
        total, known = text.count("\n"), self.total.get
        for line in self.segments(text):
            for segment in line:
                n = known(segment)
                total += self.segment_total(segment) if n is None else n
        return total

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count of each prefix of the text by characters, from none to all."""
        if not text:
            return np.zeros(1, np.int64)
        counts, base = [0], 0
        for k, line in enumerate(self.segments(text)):
            if k:
                base += 1
                counts.append(base)
            for segment in line:
                own = self.segment_counts(segment)
                counts += [base + c for c in own[1:]]
                base += own[-1]
        out = np.array(counts[1:], np.int64)  # the mark before the text is no character of it
        out[0] = 0
        return out

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix up to which no prefix has more than ``budget`` tokens."""
        over = np.nonzero(self.prefix_counts(text) > budget)[0]
        return text[: over[0] - 1] if len(over) else text


def truncated(docs: DataFrame, model_path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` cut to the longest beginning of which no prefix has more than ``budget`` tokens, ``n_tokens`` of it, ``cut`` (whether anything went).

    The counts at every prefix answer this without encoding again.  Null text stays null, with 0 tokens.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(model)
        for batch in batches:
            texts, counts, cut = [], [], []
            for value in batch.column(1):
                text = value.as_py()
                at = counter.prefix_counts(text or "")
                over = np.nonzero(at > budget)[0]
                end = int(over[0]) - 1 if len(over) else len(text or "")
                texts.append(text if text is None else text[:end])
                counts.append(int(at[end]))
                cut.append(end < len(text or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(cut, pa.bool_())], ["doc_id", "text", "n_tokens", "cut"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, text string, n_tokens long, cut boolean")


def budget_ends(docs: DataFrame, model_path: str, budgets: tuple[int, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``budget``, ``n_chars``: how many characters of each text fit each of several budgets, all from one pass over its prefixes."""
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(model)
        for batch in batches:
            ends = []
            for value in batch.column(1):
                high = np.maximum.accumulate(counter.prefix_counts(value.as_py() or ""))  # a prefix may have more tokens than a longer one
                ends += [int(np.searchsorted(high, b, "right")) - 1 for b in budgets]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), len(budgets))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(budgets) * batch.num_rows, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "budget", "n_chars"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, budget long, n_chars long")


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of whole texts."""
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(model)
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                counts.append(counter.count(text))
            over = [n > limit for n in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(over, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

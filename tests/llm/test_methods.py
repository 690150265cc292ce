"""Methods against slow versions of themselves, and every registered query on the smallest tables."""

import math
import os
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from codeweave.llm import langid, ordinal, packing, tokencount
from codeweave.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"


# ------------------------------------------------------------------------ packing
def slow_pack(sizes, lengths, price, choose):
    rooms, bins, opened, clock = [], [], {}, 0
    for i, size in enumerate(sizes):
        fits = [(r, -t, b) for r, t, b in rooms if r >= size]
        if fits:
            r, t, b = min(fits)
            rooms.remove((r, -t, b))
        else:
            allowed = [c for c in lengths if c >= size]
            if choose == "cost":
                key = (size, i // 64)
                if key not in opened:
                    laid = {}
                    for c in allowed:
                        free = c
                        for s in sorted(sizes[i:], reverse=True):
                            if s <= free:
                                free -= s
                        laid[c] = c - free
                    opened[key] = min(allowed, key=lambda c: (price[c] / laid[c], -c))
                r = opened[key]
            else:
                r = max(allowed) if choose == "largest" else min(allowed)
            b = len(bins)
            bins.append([])
        bins[b].append(i)
        clock += 1
        if r - size:
            rooms.append((r - size, clock, b))
    return [min(c for c in lengths if c >= sum(sizes[i] for i in own)) for own in bins], bins


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("overhead,quadratic", [(0.0, 0.0), (200.0, 0.0), (0.0, 0.001)])
def test_packing_is_best_fit(seed, overhead, quadratic):
    rng = random.Random(seed)
    sizes = sorted((rng.choice([rng.randint(1, 60), rng.randint(1, 512)]) for _ in range(150)), reverse=True)
    lengths = (64, 128, 256, 512)
    price = {c: packing.cost(c, overhead, quadratic) for c in lengths}
    tried = [slow_pack(sizes, lengths, price, how) for how in ("cost", "largest", "smallest")]
    assert packing.best_fit(sizes, lengths, overhead, quadratic) == min(tried, key=lambda t: sum(price[c] for c in t[0]))


# ---------------------------------------------------------------------- languages
def test_mixture_is_that_of_plain_loops():
    rng = random.Random(2)
    like = [[rng.random() for _ in range(4)] for _ in range(30)]
    weight = [rng.randint(1, 5) for _ in range(30)]
    share = [0.25] * 4
    for _ in range(12):
        new = [0.0] * 4
        for row, w in zip(like, weight):
            total = sum(x * s for x, s in zip(row, share))
            for k in range(4):
                new[k] += w * row[k] * share[k] / total
        new = [x / sum(weight) for x in new]
        done = max(abs(a - b) for a, b in zip(new, share)) < 1e-4
        share = new
        if done:
            break
    got, fit = langid.mixture(np.array(like), np.array(weight, float), 12)
    assert np.allclose(got, share)
    assert math.isclose(fit, sum(w * math.log(sum(x * s for x, s in zip(row, share))) for row, w in zip(like, weight)))


def test_twelve_languages_in_a_text():
    like = np.full((1200, 15), 1e-6)
    for k in range(1200):
        like[k, k % 12] = 1.0
    _, _, taken = langid.infer(like, np.ones(1200))
    assert sorted(taken) == list(range(12))


def test_languages_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.predict(none, langid.fit(none)).count() == 0


# ---------------------------------------------------------------------- classifier
def test_ordinal_fit_is_a_minimum():
    """The slow loss does not fall in any direction from the fitted weights and thresholds."""
    rng = random.Random(4)
    docs = [([(f, 1.0) for f in rng.sample(range(6), 3)], None) for _ in range(300)]
    docs = [(x, min(2, max(0, round(sum(f for f, _ in x) / 5 + rng.gauss(0, 0.7))))) for x, _ in docs]
    grade = np.array([g for _, g in docs])
    at = np.array([f for x, _ in docs for f, _ in x], np.int32)
    model = ordinal.fit_rows(grade, np.full(300, 3), at, np.ones(900, np.float32), steps=3000)

    def loss(w, t):
        total = 0.0
        for x, g in docs:
            z = sum(w[f] * v for f, v in x)
            tail = [1.0, *(1 / (1 + math.exp(c - z)) for c in t), 0.0]
            total -= math.log(tail[g] - tail[g + 1])
        return total / len(docs) + 5e-4 / 2 * sum(x * x for x in w)

    w, t = model.weights[:6].astype(float), np.array(model.thresholds)
    best = loss(w, t)
    assert t[0] < t[1] and best < loss(np.zeros(6), t)
    for k in range(8):
        for step in (-0.05, 0.05):
            move = np.zeros(8)
            move[k] = step
            assert loss(w + move[:6], t + move[6:]) > best


def test_repeated_fit_rows_and_empty_documents(spark):
    rows = [(1, "good words here")] * 50 + [(1, "other words")] + [(k, "good one" if k % 2 else "bad one ###") for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(k, 2 if k % 2 else 1) for k in range(1, 40)], "doc_id long, grade int")
    one, two = ordinal.fit(docs, labels), ordinal.fit(docs.repartition(3), labels)
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.thresholds, two.thresholds)
    none = docs.limit(0)
    assert ordinal.classify(none, ordinal.fit(none, labels)).count() == 0


def test_shapes_are_those_of_whole_words():
    features = ordinal.Features()
    one, two = (features.of("a1" * 60 + end)[0].tolist() for end in ("", "-" * 3))
    assert one != two


# -------------------------------------------------------------------------- tokens
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_truncation_and_budgets(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [None, "", "one", "Hello, world!  Two  spaces.\nAnd a line. " * 4, "日本語 テスト🎉 mixé " * 5, "   \n x"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    at = {k: [len(library.encode((t or "")[:i])) for i in range(len(t or "") + 1)] for k, t in enumerate(texts)}

    def end(k, budget):
        over = [i for i, n in enumerate(at[k]) if n > budget]
        return over[0] - 1 if over else len(at[k]) - 1

    for budget in (0, 3, 12, 1000):
        for r in tokencount.truncated(df, MODEL, budget).collect():
            t = texts[r.doc_id]
            e = end(r.doc_id, budget)
            assert r.text == (t if t is None else t[:e]) and r.n_tokens == at[r.doc_id][e] and r.cut == (e < len(t or ""))
    got = {(r.doc_id, r.budget): r.n_chars for r in tokencount.budget_ends(df, MODEL, (0, 3, 12, 1000)).collect()}
    assert got == {(k, b): end(k, b) for k in range(len(texts)) for b in (0, 3, 12, 1000)}
    none = df.limit(0)
    assert tokencount.token_counts(none, MODEL).count() == tokencount.truncated(none, MODEL, 3).count() == tokencount.budget_ends(none, MODEL, (1,)).count() == 0


def test_the_library_is_asked_where_the_programme_finds_no_token(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as f:
        counter = tokencount.PrefixCounter(f.read())
    monkeypatch.setattr(counter, "_follows", lambda last, piece: False)
    for t in ("Hello world", "a line\nand another", "x"):
        assert counter.count(t) == len(library.encode(t))
        assert counter.prefix_counts(t).tolist() == [len(library.encode(t[:k])) for k in range(len(t) + 1)]


# -------------------------------------------------------------------------- registry
@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_registered_queries_give_whole_results(spark, name):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    out = Q.QUERIES[name](spark, FOLDER)
    rows = out.collect()
    if name.split("_")[0] in ("op1", "op3", "op6", "op8", "op9", "op10"):
        assert len(rows) == n and len({r.doc_id for r in rows}) == n
    assert len(rows) > 0

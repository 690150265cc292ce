import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from codeweave.llm import langid, licenses, mixing, ordinal, packing, perplexity, tokencount

ODD = [None, "", " ", "\n\n", "one", "a b c", "Ünï çödé ☃🎉", "### a\tb\r\nc\x0bd\x0ce", "x" * 5000, "la la la la la la\nla la\n\nla la\n", "<a> & |b| 100% $5 #1 *"]


def frame(spark, texts, **more):
    rows = [(None if k == 3 else k // 2 * 2, t, ["en", "fr", None][k % 3], f"s{k % 4}" if k % 5 else None, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string")


# ------------------------------------------------------------------ quality rules
def slow_rules(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines, dup = [], 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    grams = Counter(zip(words, words[1:], words[2:]))
    in_twice = {k + d for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(in_twice)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "alpha", "beta", "çe", "x#", "*", "gamma."]
    return ODD + ["".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randint(1, 200))) for _ in range(n)]


def test_rule_counts():
    for t in texts(1):
        assert perplexity.rule_counts(t) == slow_rules(t)


def test_ngrams_are_sorted_by_one_long_and_looked_up_once(monkeypatch):
    for symbols in (40, 5000):  # the latter don't fit in one long
        a, b, _ = perplexity._grams(["".join(chr(0x4E00 + (k * 7 + j * j) % symbols) for j in range(k % 9 + 1)).encode() for k in range(symbols)])
        slow, order = np.lexsort((b, a)), perplexity._order(a, b)
        assert (a[order] == a[slow]).all() and (b[order] == b[slow]).all()
    looked, model = [], object.__new__(perplexity.Model)
    model.grams = model.weights = np.empty(0, np.uint64), np.empty(0, np.float32)
    find = perplexity.Model._find
    monkeypatch.setattr(perplexity.Model, "_find", staticmethod(lambda table, key, default: looked.append(len(key)) or find(table, key, default)))
    got = model.log_probabilities(1, [b"abc", b"abc", b"abcd", b"abc"])
    assert max(looked) == 6 and got[0] == got[1] == got[3] != got[2]


def test_scores_do_not_depend_on_the_words_remembered(spark):
    df = frame(spark, texts(8))
    model = perplexity.Model(*perplexity.probabilities(perplexity.ngram_counts(df)))
    one, two = (sorted(map(tuple, perplexity.measure(df, model, keep=k).collect()), key=str) for k in (3, 150_000))
    assert one == two


def slow_model(docs):
    """Modified Kneser-Ney over padded words, with dictionaries; per language."""
    order, grams = perplexity.ORDER, {}
    for text, lang in docs:
        for w in (text or "").split():
            s = [1] * (order - 1) + [ord(c) + 3 for c in w] + [2]
            for k in range(order - 1, len(s)):
                key = (lang, tuple(s[k - order + 1 : k + 1]))
                grams[key] = grams.get(key, 0) + 1
    levels, raw = {order: grams}, grams
    for n in range(order - 1, 0, -1):
        count, whole = {}, {}
        for (lang, g), _ in levels[n + 1].items():
            count[lang, g[1:]] = count.get((lang, g[1:]), 0) + 1
        for (lang, g), c in raw.items():
            whole[lang, g[-n:]] = whole.get((lang, g[-n:]), 0) + c
        levels[n] = {k: whole[k] if k[1][0] == 1 else c for k, c in count.items()}
    return levels


def slow_probability(levels, lang, symbols):
    p = None
    for n in range(1, perplexity.ORDER + 1):
        counts = {k: c for k, c in levels[n].items() if k[0] == lang}
        of = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.5
        off = [min(k - 0.05, max(0.05, k - (k + 1) * y * of[k] / of[k - 1])) if of[k - 1] and of[k] else 0.75 for k in (1, 2, 3)]
        g = symbols[-n:]
        same = {k: c for k, c in counts.items() if k[1][:-1] == g[:-1]}
        if n == 1:
            p = 1 / (len(same) + 1)
        if same:
            c = counts.get((lang, g), 0)
            total = sum(same.values())
            p = (max(0, c - off[min(c, 3) - 1]) if c else 0) / total + sum(off[min(x, 3) - 1] for x in same.values()) / total * p
    return p


PROSE = [(t, lang) for t, lang in zip(["abc abd abc xyz", "ab ab abcd é 􏿿", "noun nun", "x"] * 2, ["en", "en", "fr", None] * 2)]


def slow_word(levels, lang, word):
    s = [1] * (perplexity.ORDER - 1) + [ord(c) + 3 for c in word] + [2]
    return sum(np.log(slow_probability(levels, lang, tuple(s[k - perplexity.ORDER + 1 : k + 1]))) for k in range(perplexity.ORDER - 1, len(s)))


def test_perplexity_against_dictionaries(spark):
    df = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(PROSE)], "doc_id long, text string, lang string")
    model = perplexity.Model(*perplexity.probabilities(perplexity.ngram_counts(df, hold=2)))
    levels = slow_model(PROSE)
    for lang, words in (("en", ["abc", "abx", "zzz", "􏿿"]), ("fr", ["noun", "q"]), (None, ["x"]), ("de", ["abc"])):
        got = model.log_probabilities(perplexity.language_number(lang), [w.encode() for w in words])
        for w, value in zip(words, got):
            assert lang == "de" or abs(value - slow_word(levels, lang, w)) < 1e-4


def test_ngrams_are_exact_however_many(spark):
    rng = random.Random(12)
    docs = [(" ".join("".join(chr(rng.randrange(0x100, 0x1600)) for _ in range(rng.randint(1, 9))) for _ in range(200)), rng.choice(["en", None, "fr"])) for _ in range(20)]
    df = spark.createDataFrame(docs, "text string, lang string")
    want = slow_model(docs)[perplexity.ORDER]
    got = {(r.lang, (r.a >> 42, r.a >> 21 & 0x1FFFFF, r.a & 0x1FFFFF, r.b >> 21, r.b & 0x1FFFFF)): r.n for r in perplexity.ngram_counts(df, hold=50).collect()}
    assert got == want


def slow_bands(docs, min_words=50):
    """(kept, score) of (text, lang) by dictionaries, with quartiles as Spark's percentile_approx gives them."""
    levels, known, rows = slow_model(docs), {}, []
    for t, lang in docs:
        n, *_, twice = slow_rules(t)
        for w in set((t or "").split()):
            known.setdefault((lang, w), None)
        rows.append((n, twice))
    for lang, w in known:
        known[lang, w] = slow_word(levels, lang, w)
    score = [-sum(known[lang, w] for w in t.split()) / n if n else None for (t, lang), (n, _) in zip(docs, rows)]
    failed = [n < min_words or 100 * twice > 50 * n for n, twice in rows]
    out = []
    for (_, lang), (n, _), s, f in zip(docs, rows, score, failed):
        values = sorted({x[0]: y for x, y, g in zip(docs, score, failed) if x[1] == lang and not g}.values())
        q1, q3 = (values[max(0, int(np.ceil(len(values) * q)) - 1)] for q in (0.25, 0.75)) if values else (0, 0)
        wide, room = max(q3 - q1, perplexity.LEAST), perplexity.ALLOWANCE / np.sqrt(max(n, 1))
        out.append((not f and q1 - perplexity.BELOW * wide - room <= s <= q3 + perplexity.ABOVE * wide + room, s))
    return out


def banded(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "lo", "ri", "ne", "tus"]) for _ in range(rng.randint(1, 3)))
    docs = [(" ".join(word() for _ in range(rng.randint(55, 90))), rng.choice(["en", "fr", None])) for _ in range(60)]
    copy = " ".join(word() for _ in range(60))
    docs += [(copy, "en")] * 60  # a group of copies that is most of its language
    docs += [(" ".join(word() + "%$#@"[k] + chr(0x3400 + 7 * j) * 6 for j in range(60)), "en") for k in range(3)]  # above
    docs += [(" ".join(f"{c} {d}" for c in "ab" for d in "cdefghijklmnopqrstuvwxyz"), "fr")]
    docs += [(" ".join(["ba lo ri ne tus", "ba ba lo", "ri ri ne", "lo tus", "ne ba"][k % 5] for k in range(3)), "en"), ("word", "de"), (None, "en"), ("", None)]
    return docs


@pytest.mark.parametrize("most", [0, perplexity.MOST_ENTRIES])
def test_bands_against_brute_force(spark, most):
    docs = banded()
    df = spark.createDataFrame([(k, t, lang, "x", 1.0) for k, (t, lang) in enumerate(docs)], "doc_id long, text string, lang string, kept string, word double")
    out = {r.doc_id: r for r in perplexity.quality_rules(df, most=most).collect()}
    want = slow_bands(docs)
    assert all(out[k].kept == kept and (s is None and out[k].log_ppl is None or abs(out[k].log_ppl - s) < 1e-4) for k, (kept, s) in enumerate(want))
    assert all(kept for (kept, _), (t, _) in zip(want[:120], docs)) and not any(k for k, _ in want[120:123])
    kept = perplexity.keep_good(df, most=most, min_words=5)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k for k, (good, _) in enumerate(slow_bands(docs, 5)) if good)


def test_lower_band(spark):
    """Texts of one very common word are below the band of their language, whose other texts are rare words."""
    rng = random.Random(13)
    rare = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    docs = [(" ".join(rare() for _ in range(70)), "en") for _ in range(60)] + [("e " * 70 + " ".join(rare() for _ in range(75)), "en")] * 1
    low = [(" ".join(x for k in range(60) for x in ("e", rng.choice("abcdfghi") if k % 2 else rare())), "en")]
    df = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(docs + low)], "doc_id long, text string, lang string")
    out = perplexity.quality_rules(df, allowance=0.0).where("not base_failed").collect()
    want = slow_bands(docs + low)
    assert any(r.log_ppl < r.lower for r in out) and all(r.kept == (r.lower <= r.log_ppl <= r.upper) for r in out)
    assert all(abs(r.log_ppl - want[r.doc_id][1]) < 1e-4 for r in out)


def test_quality_rules(spark):
    clean = ["the quick brown fox " + " ".join(f"w{(k * 7 + j * 13) % 97}x{j % 10}" for j in range(80)) for k in range(40)]
    df = frame(spark, ODD + clean)
    rows = perplexity.quality_rules(df).collect()
    assert len(rows) == df.count()
    assert Counter(r.kept for r in rows)[True] == len(clean)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    for most in (0, 10**6):
        assert perplexity.quality_rules(df.limit(0), most=most).count() == 0


# ---------------------------------------------------------------------- languages
def test_languages(spark):
    rng = random.Random(2)
    parts = {"aa": ["kra", "zun", "tok", "mir"], "bb": ["élo", "vui", "sae", "nou"]}
    rows = []
    for k in range(300):
        lang = "aa" if k % 2 else "bb"
        rows.append((k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(30)), lang if k % 10 else None))
    rows += [(1000, None, "aa"), (1001, "123 !?", "bb"), (1002, "", "aa"), (None, "kratok zunmir", None), (1004, "kra " * 50 + "élovui " * 40, None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    out = {r.doc_id: r for r in langid.predict(df, langid.fit(df)).collect()}
    want = {k: "aa" if k % 2 else "bb" for k in range(300)}
    assert sum(out[k].lang_pred == want[k] for k in want) == 300
    assert [out[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and out[None].lang_pred == "aa"
    assert out[1004].languages == ["aa", "bb"] and all(0 <= r.score <= 1 for r in out.values())
    held = {r.doc_id: r.h for r in df.select("doc_id", langid.held_out(df.doc_id).alias("h")).collect()}
    assert all(held[k] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(300)) and held[None] is False
    nothing = langid.predict(df, langid.fit(df.where("lang = 'zz'"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


# -------------------------------------------------------------------------- tokens
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ODD[1:] + [" a  b\n\x00é☃", "▁▁ a▁b", "   ", "a\n\n  b", "a" * 300, "日本語 テスト🎉 mixé", "\n", " \n x", "<s> </s> <unk> x", "Hello, world!  Two  spaces.\nAnd a line."]


def test_every_prefix_has_the_librarys_count():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as f:
        counter = tokencount.PrefixCounter(f.read(), keep=50)
    for t in TEXTS:
        t = t[:400]
        assert counter.count(t) == len(library.encode(t))
        assert counter.prefix_counts(t).tolist() == [len(library.encode(t[:k])) for k in range(len(t) + 1)]
        for budget in (0, 3, 10):
            cut = counter.truncate(t, budget)
            assert t.startswith(cut) and (cut == t or len(library.encode(t[: len(cut) + 1])) > budget)


def test_token_counts(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = frame(spark, [None, *TEXTS])
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(df, MODEL, 50).collect())
    want = sorted((len((t or "").encode()), n := len(library.encode(t or "")), n > 50) for t in [None, *TEXTS])
    assert got == want


# ------------------------------------------------------------------------- licences
def test_licences(spark):
    rng = random.Random(4)
    prose = [" ".join(rng.choice("the of this work is license by under a to in".split()) for _ in range(60)) for _ in range(20)]
    hits = ["Intro line.\nReleased under the MIT License.\nMore.", prose[0] + "\nlicensed under the apache license version 2 0", licenses.TEMPLATES["GPL-2.0"][0]]
    scanner = licenses.Scanner()
    for t in [*ODD, *prose, *hits, *[x for v in licenses.TEMPLATES.values() for x in v]]:
        slow = {}
        for u in licenses.units(t) if t else ():
            own = licenses.bigrams(licenses.normalised(u))
            for name, made in licenses.TEMPLATES.items():
                for m in made:
                    c = licenses.dice(own, licenses.bigrams(licenses.normalised(m)))
                    if c >= 0.8:
                        best, n = slow.get(name, (0, 0))
                        slow[name] = max(best, c), n + 1
        assert scanner.scan(t) == slow
    found = {(r.doc_id, r.license) for r in licenses.scan_licenses(spark.createDataFrame([(k, t) for k, t in enumerate(hits)], "doc_id long, text string")).collect()}
    assert (0, "MIT") in found and (1, "Apache-2.0") in found and (2, "GPL-2.0") in found
    assert licenses.scan_licenses(frame(spark, ODD)).count() == 0


def test_licences_of_other_spellings_and_wrapped_notices(spark):
    gpl = licenses.TEMPLATES["GPL-3.0"][1].split()
    wrapped = "\n".join(" * " + " ".join(gpl[k : k + 9]) for k in range(0, len(gpl), 9))
    agpl = licenses.TEMPLATES["AGPL-3.0"][0].split()
    prose = "Zun kra tok mir vel. " * 6 + "\n".join(" ".join(agpl[k : k + 7]) for k in range(0, len(agpl), 7)) + " Vel kra\ntok mir." * 9
    apache = licenses.TEMPLATES["Apache-2.0"][1].replace("License. You", "License.\n\n# You").replace("at http", "at\n\n#   http")
    texts = ["Zun kra.\nLicensed under CC BY-NC 4.0.\nTok mir.", "x\nCC BY-SA 4.0\ny", "Licensed under CC BY 4.0", f"/*\n * Copyright 2020 Somebody Else of Somewhere, and of many other places in the whole world\n *\n{wrapped}\n *\n * More words of other things that follow on\n */\nint main;", prose, f"# Copyright\n# {apache}\n\ncode = 1\n" * 2, "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    best = {}
    for r in licenses.scan_licenses(df).collect():
        best[r.doc_id] = max(best.get(r.doc_id, (0, "")), (r.dice, r.license))
    assert [best[k][1] for k in range(7)] == ["CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC-BY-4.0", "GPL-3.0", "AGPL-3.0", "Apache-2.0", "CC-BY-NC-ND-4.0"]
    own = licenses.scan_licenses(df, templates={"mine": ("zun kra tok mir vel",)}).collect()
    assert {(r.doc_id, r.license) for r in own} == {(4, "mine")}


# --------------------------------------------------------------------------- mixing
def slow_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, free = {}, set(order)
    rest = budget * sum(sizes.values())
    while free:
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        free -= over
    return target


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(k, "w " * rng.randint(0, 40) if k % 17 else None, rng.choice(["a", "b", "é", "Z", None, "hot", "hot", "hot"]), 7) for k in range(3000)] + [(5000, None, "empty", 7), (None, "w w", "a", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    out = mixing.mix(df).collect()
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = slow_targets(sizes)
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.copies <= 2
        taken[r.source] += r.size * r.copies
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.1 * want[s] + 1e-9
    assert Counter(r.doc_id for r in mixing.emit(df).collect()) == Counter({r.doc_id: r.copies for r in out if r.copies})
    assert mixing.emit(df).columns == df.columns and mixing.mix(df.limit(0)).count() == 0 and mixing.emit(df.limit(0)).count() == 0
    hot = slow_targets({"a": 1, "b": 1000})
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([("a", 1), ("b", 1000)], "source string, size long")).collect()}
    assert all(abs(got[k] - hot[k]) < 1e-9 for k in hot)


# -------------------------------------------------------------------------- packing
def test_packing(spark):
    rng = random.Random(11)
    rows = [(k, "w " * rng.choice([0, 1, 100, 500, 600, 3000, 9000]), "x") for k in range(200)] + [(7, "w w", "x"), (7, "w w", "x"), (None, "w", "x"), (300, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bin string")
    out = packing.pack(df, shard_tokens=100_000).collect()
    assert sum(r.length for r in out) == sum(len((t or "").split()) for _, t, _ in rows)
    bins = {}
    for r in out:
        bins.setdefault((r.shard, r.bin), []).append(r)
    waste = 0
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        cap = own[0].capacity
        assert at <= cap and not [c for c in packing.LENGTHS if at <= c < cap]
        waste += cap - at
    assert waste <= 0.1 * sum(r.length for r in out)
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_is_no_worse_than_each_view(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 4096) for _ in range(200)), reverse=True)
    caps, bins = packing.best_fit(sizes)
    price = {c: float(c) for c in packing.LENGTHS}
    assert sorted(i for b in bins for i in b) == list(range(200))
    assert sum(caps) <= min(sum(packing._pack(sizes, packing.LENGTHS, price, how)[0]) for how in ("largest", "smallest"))


# ----------------------------------------------------------------------- classifier
def test_classifier(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randint(0, 9)) for _ in range(60))
    rows, labels = [], []
    for k in range(300):
        kind = k % 3
        text = good()
        if kind == 0:
            text = " ".join(w + "***" for w in text.split())
        if kind == 1:
            words = text.split()
            words[rng.randrange(60)] = rng.choice(["nasty", "Awful,"])
            text = " ".join(words)
        rows.append((k, text))
        if k < 200:
            labels.append((k, int(kind > 0), int(kind == 1)))
    labels += [(5, None, None), (None, 1, 0), (9999, 0, 0)]
    rows += [(1000 + k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, expected double")
    grades = ordinal.graded(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    model = ordinal.fit(docs, grades)
    assert model.thresholds[0] < model.thresholds[1]
    out = {r.doc_id: r for r in ordinal.classify(docs, model).collect()}
    assert all(out[k].kept == (k % 3 == 2) for k in range(200, 300))
    assert all(r.p_ge1 >= r.p_ge2 and abs(r.expected - r.p_ge1 - r.p_ge2) < 1e-9 for r in out.values())
    kept = ordinal.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in out.items() if r.kept}
    none = ordinal.fit(docs, grades.limit(0))
    assert all(r.kept for r in ordinal.classify(docs, none).collect())


def test_kept_documents_do_not_depend_on_the_words_remembered(spark):
    weights = np.random.default_rng(1).normal(size=1 << ordinal.BITS)
    model, df = ordinal.Ordinal(weights, np.zeros(ordinal.GRADES - 1)), frame(spark, texts(9))
    few, many = (sorted(map(tuple, ordinal.keep_good(df, model, keep=k).collect()), key=str) for k in (3, 120_000))
    assert few == many and 0 < len(few) < df.count()

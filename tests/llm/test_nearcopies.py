import random

import numpy as np
import pytest

import corpus_pipeline
from codeweave.llm import nearcopies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def slow_links(texts):
    """All pairs with a five-word Jaccard similarity of 0.8 or more."""
    sets = [shingles(t) for t in texts]
    return [(j, i) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def slow_groups(texts, links):
    """The smallest number reachable over the links; texts without a word are one group."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    empty = [i for i, t in enumerate(texts) if not (t or "").split()]
    for i, j in [*links, *((empty[0], e) for e in empty[1:])]:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(len(texts))]


def word(rng):
    return "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))


def copies(seed, edits):
    """Texts with copies on both sides of the limit: ``edits`` 0 changes single words, 1 adds a block, 2 cuts one off."""
    rng = random.Random(seed)
    texts = ["One two", "one  TWO", "a b c d e", "a b c d e f", None, "", " \n"]
    for _ in range(25):
        base = [word(rng) for _ in range(rng.randint(40, 300))]
        texts.append(" ".join(base))
        for _ in range(4):
            n, share, kind = len(base), rng.uniform(0.05, 0.3), rng.choice(edits)
            copy = [word(rng) if rng.random() < share / 6 else w for w in base] if kind == 0 else base + [word(rng) for _ in range(int(n * share))] if kind == 1 else base[int(n * share) :]
            texts.append("\n".join(copy))
    return texts


def grouped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df, {r.doc_id: r.component_id for r in nearcopies.near_duplicates(df).collect()}


def test_changed_words_match_brute_force(spark):
    texts = copies(3, [0])
    df, got = grouped(spark, texts)
    assert got == dict(enumerate(slow_groups(texts, slow_links(texts))))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == set(got.values())
    assert nearcopies.near_duplicates(df.limit(0)).count() == 0 and nearcopies.unique_documents(df.limit(0)).count() == 0


def test_blocks_have_recall_of_nine_tenths_and_no_false_link(spark):
    texts = copies(5, [0, 1, 2])
    _, got = grouped(spark, texts)
    links = slow_links(texts)
    want = slow_groups(texts, links)
    assert sum(got[i] == got[j] for i, j in links) >= 0.9 * len(links)
    assert all(want[i] == want[got[i]] for i in got)


def test_the_same_words_in_another_order_are_no_copy(spark):
    rng = random.Random(7)
    words = [word(rng) for _ in range(200)]
    mixed = words[:]
    rng.shuffle(mixed)
    _, got = grouped(spark, [" ".join(words), " ".join(mixed), " ".join(words).upper()])
    assert got == {0: 0, 1: 1, 2: 0}


def test_one_row_stays_also_of_null_and_repeated_ids(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(word(rng) for _ in range(80)) for _ in range(3))
    rows = [(1, a), (None, a), (None, b), (None, b), (8, a), (8, c), (9, c), (8, c)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, k1 string, stays string")
    out = nearcopies.unique_documents(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("1", a), ("None", b), ("8", c)])


@pytest.mark.parametrize("cell", [20, nearcopies.CELL])
def test_a_large_group_in_whole_cells_and_in_parts(spark, monkeypatch, cell):
    """Nearly all texts of a group about the limit are found together, and no false link is made."""
    monkeypatch.setattr(nearcopies, "CELL", cell)
    rng = random.Random(9)
    base = [word(rng) for _ in range(120)]
    texts = [" ".join(word(rng) if rng.random() < 0.02 else w for w in base) for _ in range(150)] + [" ".join(word(rng) for _ in range(60)) for _ in range(50)]
    _, got = grouped(spark, texts)
    want = dict(enumerate(slow_groups(texts, slow_links(texts))))
    assert all(want[i] == want[got[i]] for i in got)
    assert sum(got[i] == want[i] for i in got) >= 0.98 * len(got)


@pytest.mark.parametrize("cell, shingles_", [(nearcopies.CELL, nearcopies.SHINGLES), (20, 2000)])
def test_no_text_of_a_large_group_about_the_limit_is_left(spark, monkeypatch, cell, shingles_):
    monkeypatch.setattr(nearcopies, "CELL", cell)
    monkeypatch.setattr(nearcopies, "SHINGLES", shingles_)
    rng = random.Random(9)
    base = [word(rng) for _ in range(120)]
    texts = [" ".join(word(rng) if rng.random() < 0.02 else w for w in base) for _ in range(150)] + [" ".join(word(rng) for _ in range(60)) for _ in range(20)]
    _, got = grouped(spark, texts)
    assert got == dict(enumerate(slow_groups(texts, slow_links(texts))))


def test_sets_compared_by_masks_and_rows_match_brute_force():
    rng = random.Random(10)
    for m in (2, 90):
        base = [rng.getrandbits(63) for _ in range(60)]
        sets = [sorted({x if rng.random() > 0.06 else rng.getrandbits(63) for x in base}) for _ in range(m)]
        root = [7 if k < m // 10 else 0 for k in range(m)]
        a, b = nearcopies.alike(np.arange(m) + 1, [np.array(s, np.uint64) for s in sets], np.array(root, np.int64))
        links = [(j, i) for i in range(m) for j in range(i) if 5 * len({*sets[i]} & {*sets[j]}) >= 4 * len({*sets[i]} | {*sets[j]})]
        assert {(min(x, y) - 1, max(x, y) - 1) for x, y in zip(a.tolist(), b.tolist())} <= set(links)
        known = [(0, k) for k in range(m // 10)]
        words = ["w"] * m
        assert slow_groups(words, known + [(x - 1, y - 1) for x, y in zip(a.tolist(), b.tolist())]) == slow_groups(words, known + links)


def test_any_two_rows_of_a_dealt_cell_meet(spark):
    rows = [(1, 5 if k < 30 else 0 if k < 37 else 6, k) for k in range(40)] + [(2, 0, 100 + k) for k in range(25)] + [(3, 9, 200 + k) for k in range(20)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "cell long, root long, node long, w int")
    keys = {}
    for r in nearcopies.dealt(df, "w", 8).collect():
        keys.setdefault(r.node, set()).add((r.cell, r.key))
    assert not any(n >= 200 for n in keys)
    for cell, root, x in rows[:65]:
        assert all(keys[x] & keys[y] for c, r, y in rows[:65] if c == cell and not root == r == 5)


def test_one_task_connects_what_star_contraction_does(spark, monkeypatch):
    rng = random.Random(11)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(170)], "a long, b long").where("a <> b")
    one = sorted(map(tuple, nearcopies.connected(edges).collect()))
    monkeypatch.setattr(nearcopies, "ONE_TASK", 0)
    assert one == sorted(map(tuple, nearcopies.connected(edges).collect()))
    assert nearcopies.connected(edges.limit(0)).count() == 0


def test_checkpoints_of_narrow_rows_write_few_files(spark):
    """Executors start processes for each file that a checkpoint writes: few rows make few files, however many tasks there were."""
    rng = random.Random(12)
    df = spark.createDataFrame([(k, " ".join(word(rng) for _ in range(40))) for k in range(64)], "doc_id long, text string")
    rows = nearcopies.marks(df.repartition(16), 5, "doc_id", "text")
    classes = nearcopies.durable(rows.selectExpr("*", "0L as root"))
    assert classes.rdd.getNumPartitions() == 16
    assert nearcopies.met(classes, True).rdd.getNumPartitions() < 8 and nearcopies.met(classes, False).rdd.getNumPartitions() < 8

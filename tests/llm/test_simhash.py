import random

import pytest
import xxhash

from codeweave.llm import simhash


def slow_fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, max_bits=2):
    """rows of (doc_id, fingerprint): the smallest id reachable, by brute force."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= max_bits:
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(rows))]


def test_fingerprint_of_odd_texts():
    for text in (None, "", " \t\n", "One", "one two", "A b c", "a b c d e f g", "É x y z É x y z", "w " * 300):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("blocks,bits", [(2, 2), (2, 3), (3, 5)])
def test_no_link_is_lost(blocks, bits):
    import numpy as np

    rng = random.Random(blocks)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for base in list(fps):
        for _ in range(6):
            fps.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, bits + 2))))
    fps = np.unique(np.array(fps, np.uint64))
    rows, keys, homes = [], [], []
    for r, k, h in simhash.anchors(fps, blocks):
        rows.append(r), keys.append(k), homes.append(np.full(len(r), h))
    rows, keys, homes = map(np.concatenate, (rows, keys, homes))
    order = np.lexsort((~homes, keys))
    a, b = simhash._compare(keys[order], fps[rows[order]], homes[order], bits, step=7)
    got = {}
    for x, y in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist()):
        got.setdefault(x, set()).add(y), got.setdefault(y, set()).add(x)

    def reach(start):
        seen, todo = {start}, [start]
        while todo:
            for n in got.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n), todo.append(n)
        return seen

    flat = fps.tolist()
    for x in flat:
        for y in flat:
            if (x ^ y).bit_count() <= bits:
                assert y in reach(x)


def test_components_match_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows = [(None, "null id text"), (1000, None), (1001, ""), (1002, "one"), (1002, "one"), (1003, "two words")]
    for k in range(40):
        text = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        rows.append((k * 10, " ".join(text)))
        for c in range(rng.randint(0, 4)):
            copy = list(text)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((k * 10 + 1 + c, "\n".join(copy)))
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, fp string, anchor double")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in prints]
    want = sorted(((i, f, c) for (i, f), c in zip(signed, slow_components(prints))), key=str)
    assert got == want


def test_empty_and_chain(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 300), (300, 200)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 71)} | {300: 200}


def test_anchors_beyond_the_rows_held(spark):
    rng = random.Random(11)
    base = rng.getrandbits(63)
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(62) for b in range(a + 1)} | {rng.getrandbits(63) for _ in range(500)})
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), hold=64)
    roots = {r.node: r.root for r in simhash.components(found).collect()}
    groups = slow_components([(f, f) for f in fps])
    assert all(roots.get(f, f) == g for f, g in zip(fps, groups))

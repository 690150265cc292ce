"""Near copies: documents whose five-word shingles have a Jaccard similarity of 4/5 or more, found by SimHash.

A text is the set of its shingles of ``size`` lower-cased words.  Its print is a 128-bit SimHash of that set, and
texts of one print are one class: with a similarity below 4/5 two texts agree in all 128 bits with a probability
below 1e-9.  Candidates come from anchor-point covering (``simhash.anchors``): four 64-bit SimHashes of a text's
distinct words, each cut into three blocks, are copied to the anchors of a covering code, so that two classes that
differ in at most one bit of any of the twelve blocks meet in a cell.  Two classes of a cell are candidates if one is
at home there and their prints are within ``MAX_BITS`` of one another.

No pair is written out: each pass over the cells emits a spanning forest of the candidates, and its components are
blobs, so that every candidate pair lies within a blob.  A first pass looks at home cells alone, the second at all cells,
where classes that the first found to be of one blob need not be compared again.  Then the shingle sets of a blob
are gathered and all pairs within it that are not yet connected are compared exactly, whatever their prints.

Nothing is left out where much meets.  A cell of more than ``CELL`` rows, or a blob of more than ``SHINGLES``, is dealt into
parts, and each two parts meet in a task of bounded memory; classes of the largest group that is known already meet only those outside
of it, so that a large group is copied a few times, not once for each of its parts (``dealt``).

What the covering finds: with a share p of differing bits a block of w bits meets with (1 - p)^w + w p (1 - p)^(w-1).
Single changed words at a similarity of 0.8 differ in p = 0.06 to 0.09 of the bits, a block of text that was
cut off or added in p = 0.15; the pairs of the latter kind are missed more often (README has the figures).

Nulls and edge cases: null texts and those without a word are one class, linked with no other.  Fewer than ``size``
words make one shingle.  Null ids take part in links but not in the smallest id.  ``near_duplicates`` keeps repeated
rows; ``unique_documents`` keeps one row of each group, that with the smallest id (nulls last; of equal ids the one
with the smallest hash of its columns), also of rows that are equal in every column.  Map columns are left out of that
hash.  An empty table gives an empty result.  Names of the caller's columns may be any, repeated ones aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._util import column, durable, few_files, fresh, hot_join, spread, words_of

#: Of 128 bits; 4.6 standard deviations beyond the mean of pairs at 4/5, and 4.6 below that of unlike texts.
MAX_BITS = 38
BLOCKS = 3
#: Rows of a cell that a task compares at once; larger cells are dealt into parts of which each two meet.
CELL = 1 << 16
#: Shingles of a blob that a task compares at once (some 50 bytes each); larger blobs are dealt into parts likewise.
SHINGLES = 1 << 20
#: Rows of sorted cells that are held at once.
HOLD = 1 << 18
#: Cells up to this many rows are compared pair by pair.
FEW = 32
#: Classes of a blob of the first pass from which the second one knows it.
KNOWN = 16
#: Edges up to this many are connected in one task, more by star contraction.
ONE_TASK = 1 << 20
#: Keys up to this many are broadcast (24 bytes each), more are joined by shuffle.
BROADCAST_KEYS = 500_000


def sixty_four(hashes: np.ndarray, lane: int) -> np.ndarray:
    """A SimHash lane's own hashes."""
    mixed = hashes * np.uint64(lane)
    mixed ^= mixed >> np.uint64(32)
    return mixed * np.uint64(simhash.LANES[0])


def node_of(c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """The number of the class with this print."""
    return sixty_four(sixty_four(c1, simhash.LANES[1]) ^ c2, simhash.LANES[2])


def row_key(docs: DataFrame) -> tuple:
    """Two hashes of all columns of a row (maps left out)."""
    own = [column(n) for n, kind in docs.dtypes if "map<" not in kind]
    return F.xxhash64(*own).alias("k1"), F.xxhash64(F.lit(7), *own).alias("k2")


def marks(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """By row: ``k1``, ``k2``, ``doc_id``, the print ``c1``, ``c2``, the number ``n`` of shingles, the class ``node``, and the SimHashes ``f0`` ... of its words."""
    lanes = simhash.LANES
    names = ["k1", "k2", "doc_id", "c1", "c2", "n", "node", *(f"f{k}" for k in range(len(lanes)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros((batch.num_rows, 4 + len(lanes)), np.uint64)
            for k, text in enumerate(batch.column(3)):
                words = [w.lower() for w in words_of(text.as_py())]
                if words:
                    shingles = simhash.shingle_hashes(words, size, True)
                    single = simhash.shingle_hashes(words, 1, True)
                    made[k] = [simhash.majority_bits(sixty_four(shingles, x)) for x in lanes[:2]] + [len(shingles), 0] + [simhash.majority_bits(sixty_four(single, x)) for x in lanes]
            made[:, 3] = node_of(made[:, 0], made[:, 1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c) for c in made.view(np.int64).T.copy())], names)

    narrow = docs.select(*row_key(docs), column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def span(node: np.ndarray, home: np.ndarray, one: np.ndarray, two: np.ndarray, root: np.ndarray, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the candidates of one cell: what a home reaches over near prints.  Rows of one ``root`` other than 0 are connected already."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    left = np.concatenate((np.nonzero(home)[0], np.nonzero(~home)[0]))
    while len(left) > 1 and home[left[0]]:
        mine = left == left[0] if root[left[0]] == 0 else root[left] == root[left[0]]
        front, left = left[mine], left[~mine]
        while len(front) and len(left):
            step = max(1, block // len(left))
            part, front = front[:step], front[step:]
            near = np.bitwise_count(one[part, None] ^ one[left]) + np.bitwise_count(two[part, None] ^ two[left]) <= MAX_BITS
            met = near.any(0)
            if met.any():
                a.append(node[left[met]])
                b.append(node[part[near[:, met].argmax(0)]])
                known = root[left[met]]
                met |= np.isin(root[left], known[known != 0])
                front, left = np.concatenate((front, left[met])), left[~met]
    return np.concatenate(a), np.concatenate(b)


def candidates(cell: np.ndarray, home: np.ndarray, c1: np.ndarray, c2: np.ndarray, root: np.ndarray, step: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the candidates of whole cells, whose rows are sorted by cell."""
    change = np.concatenate(([True], cell[1:] != cell[:-1]))
    start = np.nonzero(change)[0]
    size = np.diff(np.concatenate((start, [len(cell)])))
    group = np.cumsum(change) - 1
    one, two = c1.view(np.uint64), c2.view(np.uint64)
    node = node_of(one, two).view(np.int64)
    found_a, found_b = [], []

    def add(a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            a, b = simhash._forest(a, b)
            found_a.append(a)
            found_b.append(b)

    for at, n in zip(start[size > FEW].tolist(), size[size > FEW].tolist()):
        own = slice(at, at + n)
        if root[at] == 0 or (root[own] != root[at]).any():
            add(*span(node[own], home[own], one[own], two[own], root[own]))
    mine = np.nonzero(home & (size[group] > 1) & (size[group] <= FEW))[0]
    mates = size[group[mine]]
    upto = np.cumsum(mates)
    at = 0
    while at < len(mine):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + step)))
        a = np.repeat(mine[at:end], mates[at:end])
        b = np.arange(len(a)) - np.repeat(upto[at:end] - mates[at:end] - done, mates[at:end]) + start[group[a]]
        near = (np.bitwise_count(one[a] ^ one[b]) + np.bitwise_count(two[a] ^ two[b]) <= MAX_BITS) & (a != b) & ((root[a] != root[b]) | (root[a] == 0))
        add(node[a[near]], node[b[near]])
        at = end
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return simhash._forest(np.concatenate(found_a), np.concatenate(found_b))


def dealt(rows: DataFrame, weight: str, most: int) -> DataFrame:
    """``rows`` (``cell``, ``root``, ``node``, ...) of large cells as copies with a ``key``, of which each has a weight of about ``most``.

    Any two rows of a cell have a key in common, but for those of the cell's largest root other than 0, which are connected
    already: these are dealt into parts that meet each part of the others, and only the others' parts meet one another.
    Cells whose rows are all of one root are left out.
    """
    by_root = rows.groupBy("cell", "root").agg(F.sum(weight).alias("w"))
    top = F.max(F.struct(F.when(F.col("root") != 0, F.col("w")).otherwise(0).alias("w"), "root")).alias("top")
    half = max(1, most // 2)
    sizes = by_root.groupBy("cell").agg(F.sum("w").alias("all"), top).select("cell", F.col("top.root").alias("top"), F.expr(f"cast(ceil(top.w / {half}) as int)").alias("p"), F.expr(f"cast(ceil((all - top.w) / {half}) as int)").alias("q"))
    sizes = sizes.where("q > 0").select("*", F.expr("p > 0").alias("has_top"))
    placed = rows.join(F.broadcast(durable(sizes)), "cell")
    mine = F.expr("pmod(xxhash64(11, node), if(has_top and root = top, p, q))")
    keys = F.expr(
        """if(has_top and root = top,
              transform(filter(sequence(0, q), i -> i < q), i -> xxhash64(cell, 0, cast(mine as long), cast(i as long))),
              concat(transform(filter(sequence(0, p), i -> i < p), i -> xxhash64(cell, 0, cast(i as long), cast(mine as long))),
                     transform(filter(sequence(0, q), i -> i < q and (i <> mine or p = 0 and q = 1)), i -> xxhash64(cell, 1, cast(least(i, mine) as long), cast(greatest(i, mine) as long)))))"""
    )
    return placed.withColumn("mine", mine).withColumn("key", F.explode(keys)).drop("mine", "p", "q", "top", "has_top")


def met(classes: DataFrame, homes: bool) -> DataFrame:
    """Edges ``a``, ``b`` that span the candidates, from ``c1``, ``c2``, ``root`` and the SimHashes of distinct classes.

    With ``homes`` only home cells are looked at, and large ones in pieces; without, all cells are, and large ones whole.
    """
    lanes, most, hold = range(len(simhash.LANES)), CELL, HOLD
    names = ["cell", "home", "c1", "c2", "root"]
    schema = "cell long, home boolean, c1 long, c2 long, root long"

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                for lane in lanes:
                    fps = batch.column(3 + lane).to_numpy(zero_copy_only=False).view(np.uint64)
                    for rows, keys, home in simhash.anchors(fps, BLOCKS):
                        if home or not homes:
                            cell = (keys | np.uint64(lane << 44)).view(np.int64)
                            take = pa.array(rows)
                            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(rows), home)), *(batch.column(k).take(take) for k in range(3))], names)

    def compare(batches: Iterator[pa.RecordBatch], cut: bool, whole: bool) -> Iterator[pa.RecordBatch]:
        """Edges, with a null cell; rows of large cells unless those are to be ``cut`` or taken ``whole``, with null nodes."""

        def edges(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = candidates(*rows)
            none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays([*none, pa.array(a), pa.array(b)], [*names, "a", "b"])

        def passed(rows: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.nulls(len(rows[0]), pa.int64()), pa.nulls(len(rows[0]), pa.int64())], [*names, "a", "b"])

        held, n, large = [], 0, None  # large: the cell whose rows are passed on
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n < min(hold, most):
                continue
            rows = [np.concatenate(c) for c in zip(*held)]
            if large is not None:
                over = int(np.searchsorted(rows[0], large, "right"))
                yield passed([x[:over] for x in rows])
                rows = [x[over:] for x in rows]
            if len(rows[0]):
                last = int(np.searchsorted(rows[0], rows[0][-1]))  # rows of the last cell may go on
                big = large_cells(rows[0][:last])
                yield from split([x[:last] for x in rows], big, cut, whole, edges, passed)
                rows, large = [x[last:] for x in rows], None
                if len(rows[0]) > most and not whole:
                    if cut:
                        yield edges(rows)
                    else:
                        large = rows[0][0]
                        yield passed(rows)
                    rows = [x[:0] for x in rows]
            held, n = [rows], len(rows[0])
        if n:
            rows = [np.concatenate(c) for c in zip(*held)]
            if large is not None:
                over = int(np.searchsorted(rows[0], large, "right"))
                yield passed([x[:over] for x in rows])
                rows = [x[over:] for x in rows]
            yield from split(rows, large_cells(rows[0]), cut, whole, edges, passed)

    def large_cells(cell: np.ndarray) -> np.ndarray:
        which, size = np.unique(cell, return_counts=True)
        return np.isin(cell, which[size > most])

    def split(rows, big, cut, whole, edges, passed) -> Iterator[pa.RecordBatch]:
        if cut or whole or not big.any():
            if len(big):
                yield edges(rows)
            return
        yield passed([x[big] for x in rows])
        if not big.all():
            yield edges([x[~big] for x in rows])

    both = f"{schema}, a long, b long"
    n = spread(classes.sparkSession, classes.count() * (12 if homes else 170), 4_000_000)
    copies = classes.select("c1", "c2", "root", *[f"f{k}" for k in lanes]).mapInArrow(replicate, schema)
    found = durable(few_files(copies.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(lambda x: compare(x, homes, False), both)))
    links = found.where("cell is null").select("a", "b")
    large = found.where("cell is not null").select(*names, F.xxhash64("c1", "c2").alias("node"), F.lit(1).alias("one"))
    if not homes and not large.isEmpty():
        parts = dealt(large, "one", most).select(F.col("key").alias("cell"), "home", "c1", "c2", "root")
        rest = parts.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda x: compare(x, False, True), both)
        links = durable(few_files(links.union(rest.select("a", "b"))))
    return links


def alike(node: np.ndarray, sets: list[np.ndarray], root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the sets with a Jaccard similarity of 4/5 or more.  Rows of one ``root`` other than 0 are connected already.

    What two sets share is counted over the rows of each shingle; shingles of many rows are bits of a mask in place of that.
    """
    a, b = [], []
    size = np.array([len(s) for s in sets], np.int64)
    left = np.arange(len(sets))  # rows not reached yet; ``rows`` are those that the index holds
    front: list[int] = []
    rows, index = left[:0], None
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.empty(0, np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    kinds = int(flat.max()) + 1 if len(flat) else 0
    words = np.empty((0, 0), np.uint64)

    def build() -> tuple:
        """Of each shingle its rows among ``left``, or its bit; of each of these rows its mask."""
        at = np.concatenate([np.arange(begin[k], begin[k + 1]) for k in left])
        token, row = flat[at], np.repeat(np.arange(len(left)), size[left])
        count = np.bincount(token, minlength=kinds)
        common = count * 16 >= max(len(left), 64)
        bit = np.where(common, np.cumsum(common) - 1, -1)
        masks = np.zeros((len(left), -(-int(common.sum()) // 64)), np.uint64)
        hot = common[token]
        np.bitwise_or.at(masks, (row[hot], bit[token[hot]] >> 6), np.uint64(1) << (bit[token[hot]] & 63).astype(np.uint64))
        rare_t, rare_r = token[~hot], row[~hot]
        order = np.argsort(rare_t, kind="stable")
        counts = np.bincount(rare_t, minlength=kinds)
        return masks, bit, rare_r[order], np.concatenate(([0], np.cumsum(counts))), counts

    alive = np.ones(len(sets), bool)
    while len(left):
        if not front:
            k = int(left[0])
            front = [k] if root[k] == 0 else left[root[left] == root[k]].tolist()
            alive[front] = False
            left = left[alive[left]]
            continue
        if index is None or 2 * len(left) < len(rows):
            rows, index = left, build()
        masks, bit, postings, start, counts = index
        k = front.pop()
        mine = flat[begin[k] : begin[k + 1]]
        bits = bit[mine]
        hot = bits[bits >= 0]
        if len(hot) and masks.shape[1]:
            words = np.zeros(masks.shape[1], np.uint64)
            np.bitwise_or.at(words, hot >> 6, np.uint64(1) << (hot & 63).astype(np.uint64))
            shared = np.bitwise_count(masks & words).sum(1, dtype=np.int64)
        else:
            shared = np.zeros(len(rows), np.int64)
        lone = mine[bits < 0]
        many = counts[lone]
        if many.sum():
            where = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[lone], many)
            shared += np.bincount(postings[where], minlength=len(rows))
        got = rows[(5 * shared >= 4 * (size[k] + size[rows] - shared)) & alive[rows]]
        if len(got):
            a.append(np.full(len(got), node[k]))
            b.append(node[got])
            known = root[got]
            more = left[np.isin(root[left], known[known != 0])]
            got = np.union1d(got, more)
            alive[got] = False
            left = left[alive[left]]
            front += got.tolist()
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int, text_col: str) -> DataFrame:
    """``wanted`` (``k1``, ``k2``, ``node``, ``cell``, ``n``, without the keys) with ``shingles``, the sorted hashes of the rows that it names; rows that are equal may come repeatedly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for k, node in enumerate(batch.column(0).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    new.append(k)
            rows = batch.take(pa.array(new, pa.int64()))
            sets = [np.unique(simhash.shingle_hashes([w.lower() for w in words_of(t.as_py())], size, True)).tobytes() for t in rows.column(3)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(sets, pa.binary())], ["node", "cell", "n", "shingles"])

    if wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    texts = docs.select(*row_key(docs), column(text_col).cast("string").alias("text")).join(wanted, ["k1", "k2"])
    return texts.select("node", "cell", "n", "text").mapInArrow(run, "node long, cell long, n long, shingles binary")


def confirmed(parts: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` that span the rows of each ``key`` whose ``shingles`` are alike, from ``key``, ``node``, ``root``, ``shingles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}

        def solve() -> pa.RecordBatch:
            nodes = list(rows)
            a, b = alike(np.array(nodes, np.int64), [rows[x][1] for x in nodes], np.array([rows[x][0] for x in nodes], np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for k, node, root, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if len(rows) > 1:
                        yield solve()
                    key, rows = k, {}
                rows[node] = root, np.frombuffer(shingles, np.uint64)
        if len(rows) > 1:
            yield solve()

    sorted_ = parts.select("key", "node", "root", "shingles").repartition("key").sortWithinPartitions("key")
    return durable(few_files(sorted_.mapInArrow(run, "a long, b long")))


def connected(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for the nodes of edges ``a``, ``b`` that aren't roots; ``edges`` is read twice."""
    if edges.count() > ONE_TASK:
        return simhash.components(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
        if rows:
            node, root = simhash._forest(*(np.concatenate(c) for c in zip(*rows)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])

    return durable(edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long"))


def linked(docs: DataFrame, classes: DataFrame, size: int, text_col: str) -> DataFrame:
    """``node``, ``root`` of linked classes."""
    full, most = classes.where("n > 0"), SHINGLES
    near = met(full.withColumn("root", F.lit(0).cast("long")), True)
    first = connected(near)
    large = first.groupBy("root").agg(F.count("*").alias("nodes")).where(F.col("nodes") >= KNOWN)
    known = durable(first.join(F.broadcast(large), "root").select("node", "root"))
    known = known.union(known.select(F.col("root").alias("node"), "root").distinct()).distinct()
    near = near.union(met(full.join(known, "node", "left").withColumn("root", F.coalesce("root", F.lit(0).cast("long"))), False))
    blobs = connected(near).withColumnRenamed("root", "cell")
    blobs = durable(blobs.union(blobs.select(F.col("cell").alias("node"), "cell")).distinct().join(full.select("node", "n", "k1", "k2"), "node"))
    sets = shingle_sets(docs, blobs, size, text_col)
    large = durable(blobs.groupBy("cell").agg(F.sum("n").alias("all")).where(F.col("all") > most))
    some = not large.isEmpty()
    sets = durable(sets) if some else sets
    # Whole blobs, and the large ones in two dealings of parts, which connects most of a large group.
    parts = F.expr(f"cast(ceil(all / {most}) as int)")
    sets = sets.join(F.broadcast(large.withColumn("parts", parts)), "cell", "left")
    dealings = F.expr("if(parts is null, array(cell), transform(array(1, 2), d -> xxhash64(cell, d, pmod(xxhash64(d, node), parts))))")
    links = confirmed(sets.withColumn("key", F.explode(dealings)).withColumn("root", F.lit(0).cast("long")))
    roots = connected(links)
    if some:
        placed = sets.where("parts is not null").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        links = links.union(confirmed(dealt(placed.select("cell", "node", "n", "root", "shingles"), "n", most)))
        roots = connected(links)
    return roots


def near_duplicates(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``k1``, ``k2`` (its key), ``doc_id``, ``component_id`` (the smallest id of its group), ``group`` (a number of it)."""
    rows = durable(few_files(marks(docs, size, id_col, text_col)))
    prints = [f"f{k}" for k in range(len(simhash.LANES))]
    which = F.struct("n", "k1", "k2")
    found = rows.groupBy("node", "c1", "c2").agg(F.min(which).alias("t"), F.min("doc_id").alias("least"), F.count("*").alias("rows"), *[F.min_by(f, which).alias(f) for f in prints])
    classes = durable(found.select("node", "c1", "c2", "t.*", "least", "rows", *prints))
    roots = linked(docs, classes, size, text_col)
    placed = durable(classes.select("node", "least", "rows").join(roots, "node", "left").select("node", "least", "rows", F.coalesce("root", "node").alias("group")))
    named = durable(placed.groupBy("group").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")))
    labelled = durable(hot_join(placed, named, "group", "classes").select("node", "group", "component_id", "rows"))
    return hot_join(rows.select("k1", "k2", "doc_id", "node"), labelled, "node", "rows").select("k1", "k2", "doc_id", "component_id", "group")


def unique_documents(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one stays of each group of near copies.

    Texts are not shuffled where the keys of the rows that go may be broadcast.
    """
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "k1", "k2")
    # The rows of a key, which are equal, are counted before groups gather them.
    keyed = near_duplicates(docs, size, id_col, text_col).groupBy("k1", "k2", "doc_id", "group").agg(F.count("*").alias("rows"))
    keyed = durable(keyed)
    first = durable(keyed.groupBy("group").agg(F.min(order).alias("first"), F.count("*").alias("keys")))
    judged = durable(hot_join(keyed, first, "group", "keys").select("k1", "k2", "rows", ((F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))).alias("stays")))
    n1, n2, stays = (fresh(x, docs.columns) for x in ("k1", "k2", "stays"))
    gone = judged.where("not stays or rows > 1").select(F.col("k1").alias(n1), F.col("k2").alias(n2), F.col("stays").alias(stays))
    if gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    k1, k2 = row_key(docs)
    same = (k1 == F.col(n1)) & (k2 == F.col(n2))
    alone = docs.join(gone, same, "left_anti")
    # Of rows that are equal in every column one stays.
    own = [column(n).alias(n) for n in docs.columns]
    repeated = docs.join(gone.where(F.col(stays)), same).dropDuplicates([n1, n2]).select(*own)
    return alone.union(repeated)

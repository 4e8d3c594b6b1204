"""Near-duplicate records with small edits: a chosen-path similarity join.

Each distinct set of word shingles gets ``COORDS`` minwise values. In each of several independent runs, every
set follows about 1/threshold coordinates of the root, and in every later node ``DEEP`` coordinates, chosen by
the node alone, and moves to the child named by its value there, so similar sets share a child with good
probability. Nodes of up to ``leaf`` sets are compared by brute force, larger ones split again by other coordinates, and
nodes that are larger still after ``MAX_LEVELS`` levels are compared whole, in blocks. The number of runs follows
from the wanted recall: :func:`runs_for` derives how many a pair exactly at the threshold needs at the greatest depth,
so that no pair depends on how deep its nodes lie.

A level is one shuffle: rows meet by node, small nodes give their candidate pairs, and the sets of large ones come
out to be split. A node that is large within one batch of rows already is told from there, and its rows
are spread over all tasks, so no task receives a hot node. Sketches of 32 x 4 bits travel
with the sets and filter the pairs inside a node; survivors are verified exactly on their words. Copies
(equal shingle sets) are one set throughout; only membership grows with them. Nothing is
collected to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.flat_text import Words, mix, pieces
from corpusloom.session import stable, written

COORDS = 32
_SEEDS = mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_UNIT = "id string, th long, k1 long, k2 long, n int, sig array<int>, s1 long, s2 long"
#: Levels of splitting before a node is compared whole, and coordinates that a node below the root splits by.
MAX_LEVELS, DEEP = 4, 2.0
#: Sets per block of a node that is compared whole; rows a task compares at once.
BLOCK, SLAB = 512, 65_536


def _signatures(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, th = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy()
            for lo, hi in pieces(np.fromiter((len(t) for t in texts), np.int64, len(texts))):
                doc, _, h = Words(texts[lo:hi]).shingles(shingle)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                doc, h = doc[new], h[new]
                if not len(h):
                    continue
                at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                sig = np.empty((len(at), COORDS), np.uint32)
                for c in range(COORDS):
                    x = h * _SEEDS[c]
                    x ^= x >> np.uint64(29)
                    x *= np.uint64(0xBF58476D1CE4E5B9)
                    sig[:, c] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), at)
                k1 = np.add.reduceat(mix(h), at)
                k2 = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at)
                nib = (mix(sig.astype(np.uint64)) & np.uint64(15)) << (np.arange(COORDS, dtype=np.uint64) % np.uint64(16) * np.uint64(4))
                s1, s2 = np.bitwise_or.reduce(nib[:, :16], axis=1), np.bitwise_or.reduce(nib[:, 16:], axis=1)
                n = np.diff(np.append(at, len(h))).astype(np.int32)
                flat = pa.array(sig.view(np.int32).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[lo + d] for d in doc[at]], pa.string()),
                        pa.array(th[lo:hi][doc[at]]),
                        pa.array(k1.view(np.int64)),
                        pa.array(k2.view(np.int64)),
                        pa.array(n),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, COORDS, dtype=np.int32)), flat),
                        pa.array(s1.view(np.int64)),
                        pa.array(s2.view(np.int64)),
                    ],
                    names=["id", "th", "k1", "k2", "n", "sig", "s1", "s2"],
                )

    return run


def _kept(depth: int, threshold: float, recall_at: np.ndarray) -> np.ndarray:
    """Chance that a pair shares a leaf of one run over ``depth`` levels, by the share of coordinates that agree."""
    kept = np.ones(len(recall_at))
    for level in range(depth, 0, -1):
        want = 1.0 / threshold if level == 1 else DEEP
        most = int(np.ceil(want))
        more = want - (most - 1)
        lost = 1 - recall_at * kept
        kept = 1 - lost ** (most - 1) * (1 - more + more * lost)
    return kept


def runs_for(threshold: float, recall: float, depth: int = MAX_LEVELS) -> int:
    """The least number of runs that keep a pair of similarity ``threshold`` over ``depth`` levels with
    a probability of ``recall``, over all numbers of the shared ``COORDS`` coordinates that may agree."""
    agree = np.arange(COORDS + 1)
    odds = np.array([comb(COORDS, int(a)) * threshold**a * (1 - threshold) ** (COORDS - a) for a in agree])
    lost = 1 - _kept(depth, threshold, agree / COORDS)
    runs = 1
    while (odds * lost**runs).sum() > 1 - recall:
        runs += 1
    return runs


def _u(x) -> np.ndarray:
    return np.asarray(x).astype(np.int64).view(np.uint64)


_KID = "node long, salt int, set long, n int, s1 long, s2 long"


def _kids(want: float, runs: int | None, leaf: int):
    """Children of (node, set, n, sig, s1, s2), or of the roots of ``runs`` runs. Rows of a child with more than ``leaf``
    rows in this batch carry a salt, and a mark (set -1) tells where the child's other rows meet that it is large."""
    most = int(np.ceil(want))
    part = np.uint64(int((want - (most - 1)) * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sets, n = b.column(1).to_numpy(), b.column(2).to_numpy()
            sig = b.column(3).flatten().to_numpy().astype(np.uint32).reshape(-1, COORDS).astype(np.uint64)
            s1, s2 = b.column(4).to_numpy(), b.column(5).to_numpy()
            parents = [_u(b.column(0).to_numpy())] if runs is None else [np.full(b.num_rows, mix(np.array([r + 1], np.uint64))[0]) for r in range(runs)]
            nodes, rows = [], []
            for parent in parents:
                h = mix(parent)
                step = (h >> np.uint64(20)) % np.uint64(COORDS // 2) * np.uint64(2) + np.uint64(1)  # odd: the picks of a node differ
                for j in range(most):
                    at = np.flatnonzero((mix(h + np.uint64(77)) & np.uint64((1 << 20) - 1)) < part) if j == most - 1 and part < 1 << 20 else np.arange(len(sets))
                    coord = ((h[at] + np.uint64(j) * step[at]) % np.uint64(COORDS)).astype(np.int64)
                    nodes.append(mix(mix(h[at] + coord.astype(np.uint64)) ^ (sig[at, coord] * np.uint64(0x9E3779B97F4A7C15))))
                    rows.append(at)
            node, row = np.concatenate(nodes), np.concatenate(rows)
            _, inverse, count = np.unique(node, return_inverse=True, return_counts=True)
            large = count[inverse] > leaf
            salt = np.where(large, (mix(_u(sets[row])) % np.uint64(1 << 20)).astype(np.int32) + 1, 0).astype(np.int32)
            marks = np.unique(node[large])
            none = np.full(len(marks), -1)
            cat = lambda x, m, t: pa.array(np.concatenate([x, m]).astype(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node, marks]).view(np.int64)), cat(salt, none * 0, np.int32), cat(sets[row], none, np.int64), cat(n[row], none, np.int32), cat(s1[row], none, np.int64), cat(s2[row], none, np.int64)],
                names=["node", "salt", "set", "n", "s1", "s2"],
            )

    return run


class _Fits:
    """Whether the sketches and sizes of two sets allow the threshold."""

    def __init__(self, threshold: float):
        # of 32 four-bit values at least this many agree, four standard deviations below the mean
        p = threshold + (1 - threshold) / 16
        self.least, self.threshold = int(COORDS * p - 4 * (COORDS * p * (1 - p)) ** 0.5), threshold

    def __call__(self, n: np.ndarray, s1: np.ndarray, s2: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = np.flatnonzero(small >= self.threshold * large - 1e-9)
        i, j = i[ok], j[ok]
        differ = np.zeros(len(ok), np.uint8)
        for s in (s1, s2):
            x = s[i] ^ s[j]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            differ += np.bitwise_count(x & np.uint64(0x1111111111111111))
        return ok[differ <= COORDS - self.least]


_FOUND = "x long, y long, node long, set long"


def _found(x: np.ndarray, y: np.ndarray, node: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
    """Candidate pairs, then sets of nodes that are to be split."""
    none, free = pa.nulls(len(sets), pa.int64()), pa.nulls(len(x), pa.int64())
    cols = [(pa.array(np.minimum(x, y)), none), (pa.array(np.maximum(x, y)), none), (free, pa.array(node)), (free, pa.array(sets))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in cols], names=["x", "y", "node", "set"])


def _meet(threshold: float, leaf: int):
    """Rows ordered by (salt, node): pairs of small nodes, and the sets of large ones."""
    fits = _Fits(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        have, growing = 0, None  # growing: the node at the end of the rows so far, known to be large

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, have, growing
            t = pa.Table.from_batches(held).combine_chunks()
            node, salt, sets, n, s1, s2 = (t.column(c).to_numpy() for c in ("node", "salt", "set", "n", "s1", "s2"))
            s1, s2 = _u(s1), _u(s2)
            cut = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (salt[1:] != salt[:-1]))))
            size = np.diff(np.append(cut, len(node)))
            marked = np.add.reduceat(sets == -1, cut) > 0
            large = (size > leaf) | marked | (salt[cut] > 0) | (node[cut] == growing if growing is not None and salt[0] == 0 else False)
            end = len(node)
            if not last and not large[-1]:
                end = int(cut[-1])
            growing = int(node[-1]) if large[-1] and salt[-1] == 0 else None
            at = np.arange(end)
            group = np.repeat(np.arange(len(cut)), size)[:end]
            big = large[group]
            stop = (cut + size)[group]
            x, y = [], []
            live = at[~big]
            for o in range(1, leaf):
                live = live[live + o < stop[live]]
                if not len(live):
                    break
                ok = live[fits(n, s1, s2, live, live + o)]
                x.append(sets[ok])
                y.append(sets[ok + o])
            cat = lambda z: np.concatenate(z) if z else np.empty(0, np.int64)
            big &= sets[:end] != -1
            yield _found(cat(x), cat(y), node[:end][big], sets[:end][big])
            held = t.slice(end).to_batches()
            have = len(node) - end

        for batch in batches:
            held.append(batch)
            have += batch.num_rows
            if have >= SLAB:
                yield from flush(False)
        if have:
            yield from flush(True)

    return run


def _whole(threshold: float):
    """The pairs of two blocks of a node (or of one with itself)."""
    fits = _Fits(threshold)

    def run(t: pa.Table) -> pa.Table:
        sets, n, s1, s2, own = (t.column(c).to_numpy() for c in ("set", "n", "s1", "s2", "own"))
        s1, s2 = _u(s1), _u(s2)
        a, b = int(t.column("a")[0].as_py()), int(t.column("b")[0].as_py())
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        x, y = [], []
        for i in left:
            j = right[right > i] if a == b else right
            ok = j[fits(n, s1, s2, np.full(len(j), i), j)]
            x.append(np.full(len(ok), sets[i]))
            y.append(sets[ok])
        cat = lambda z: np.concatenate(z) if z else np.empty(0, np.int64)
        return pa.Table.from_batches([_found(cat(x), cat(y), np.empty(0, np.int64), np.empty(0, np.int64))])

    return run


def _candidates(sets: DataFrame, threshold: float, leaf: int, runs: int) -> DataFrame:
    """``(x, y)``: pairs of ``sets(set, n, sig, s1, s2)`` that share a leaf and whose sketches and sizes allow the threshold."""
    held = sets.select("set", "n", "sig", "s1", "s2")
    rows, parts = held.select(F.lit(0).cast("long").alias("node"), "*"), []
    for level in range(1, MAX_LEVELS + 1):
        kids = rows.mapInArrow(_kids(1.0 / threshold if level == 1 else DEEP, runs if level == 1 else None, leaf), _KID)
        met = written(kids.repartition("node", "salt").sortWithinPartitions("salt", "node").mapInArrow(_meet(threshold, leaf), _FOUND))
        parts.append(met.where("x is not null").select("x", "y"))
        big = met.where("set is not null").select("node", "set")
        if big.isEmpty():
            break
        rows = big.distinct().join(held, "set").select("node", "set", "n", "sig", "s1", "s2")
    else:
        rows = stable(rows.drop("sig"))
        blocks = rows.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        own = rows.join(blocks, "node").withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
        pair = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = pair.select("node", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "set", "n", "s1", "s2")
        parts.append(pair.groupBy("node", "a", "b").applyInArrow(_whole(threshold), _FOUND).select("x", "y"))
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    return pairs.distinct()


def _exact(shingle: int, threshold: float):
    """Jaccard similarity of the distinct shingles of two texts. Shingles are told apart by 64
    bits: within one pair of texts a false match has a chance below 1e-12."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            tx, ty = b.column(2).to_pylist(), b.column(3).to_pylist()
            for lo, hi in pieces(np.fromiter((len(p) + len(q) for p, q in zip(tx, ty)), np.int64, len(tx))):
                n = hi - lo
                doc, _, h = Words(tx[lo:hi] + ty[lo:hi]).shingles(shingle)
                pair, side = doc % n, doc // n
                order = np.lexsort((side, h, pair))
                pair, side, h = pair[order], side[order], h[order]
                same = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
                first = np.concatenate(([True], ~same))[: len(h)]
                both = same & (side[1:] != side[:-1])
                union = np.bincount(pair[first], minlength=n)
                shared = np.bincount(pair[1:][both], minlength=n)
                sim = shared / np.maximum(union, 1)
                keep = np.flatnonzero(sim >= threshold)
                yield pa.RecordBatch.from_arrays([pa.array(x[lo:hi][keep]), pa.array(y[lo:hi][keep]), pa.array(sim[keep])], names=["x", "y", "similarity"])

    return run


def near_duplicate_links(df: DataFrame, id_col: str, text_col: str, shingle: int = 5, threshold: float = 0.8, leaf: int = 100, recall: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """Links between classes of copies, and the members of each class: the form of a result at every size.

    Returns ``links(x, y, similarity)`` with x < y, numbers of classes whose Jaccard similarity of
    distinct ``shingle``-word runs is at least ``threshold``, each exact; and
    ``members(set, id)`` with every row whose text has at least ``shingle`` words.

    ``recall`` is the part of the pairs exactly at the threshold that must be kept, however deep their nodes lie; pairs
    above it are kept more surely. Null ids, null or short texts (fewer than ``shingle`` words, so also empty ones)
    have no set and never appear. Repeated rows count once. An id with several texts is a member of several
    classes. An empty table gives empty tables. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    rows = rows.withColumn("th", F.xxhash64("text"))
    units = written(rows.mapInArrow(_signatures(shingle), _UNIT))
    sets = units.groupBy("k1", "k2").agg(F.min(F.struct("id", "th")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    sets = written(sets.withColumn("set", F.monotonically_increasing_id()))
    members = units.select("id", "k1", "k2").join(sets.select("k1", "k2", "set"), ["k1", "k2"]).select("set", "id").distinct()
    pairs = written(_candidates(sets, threshold, leaf, runs_for(threshold, recall)))

    # each set's text comes from its representative; one pass over the texts for all pairs
    ends = pairs.select("x", "y", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("set")), F.struct(F.lit(1).alias("side"), F.col("y").alias("set")))).alias("e"))
    wanted = ends.select("x", "y", "e.side", "e.set").join(sets.select("set", "rep"), "set")
    texts = wanted.join(rows, (wanted["rep.id"] == rows["id"]) & (wanted["rep.th"] == rows["th"])).select("x", "y", "side", "text")
    both = texts.groupBy("x", "y").agg(F.first(F.when(F.col("side") == 0, F.col("text")), ignorenulls=True).alias("tx"), F.first(F.when(F.col("side") == 1, F.col("text")), ignorenulls=True).alias("ty"))
    return both.mapInArrow(_exact(shingle, threshold), "x long, y long, similarity double"), members


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """``(id_a, id_b, similarity)``, id_a < id_b: every pair of rows of linked classes, and every pair within a class.

    An optional last step for results that ask for pairs of rows: their number is quadratic in the copies of a text, by
    definition. Rows meet in blocks of a class against single rows of the other, so no task holds a class.
    """
    members = written(members)
    few = members.groupBy("set").agg(F.count("*").alias("copies"))
    m = members.join(few, "set")
    same = few.where("copies > 1").select(F.col("set").alias("x"), F.col("set").alias("y"), F.lit(1.0).alias("similarity"))
    # the rows of a class are cut into parts, and each link into one per part of its second class
    parts = F.ceil(F.col("copies") / BLOCK).cast("int")
    cut = m.select(F.col("set").alias("y"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.col("id").alias("q"))
    every = links.select("x", "y", "similarity").unionByName(same).join(few.select(F.col("set").alias("y"), parts.alias("parts")), "y")
    every = every.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    out = every.join(m.select(F.col("set").alias("x"), F.col("id").alias("p")), "x").join(cut, ["y", "part"])
    out = out.where(F.when(F.col("x") == F.col("y"), F.col("p") < F.col("q")).otherwise(F.col("p") != F.col("q")))
    return out.groupBy(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).agg(F.max("similarity").alias("similarity"))


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """``(id_a, id_b, similarity)`` of all rows that are near-duplicates: :func:`expand_pairs` of :func:`near_duplicate_links`,
    which see for the options, nulls, short texts, repeated rows and empty tables."""
    return expand_pairs(*near_duplicate_links(df, id_col, text_col, **options))


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """``(id, group_id, set, links)``: one row per text-bearing row. ``group_id`` is the smallest
    set number reachable over links, ``set`` the row's class of copies, ``links`` the number of
    other sets linked to it."""
    links, members = near_duplicate_links(df, id_col, text_col, **options)
    links = stable(links)
    roots = components(links.select("x", "y"))
    degree = links.select(F.explode(F.array("x", "y")).alias("set")).groupBy("set").agg(F.count("*").alias("links"))
    return members.join(roots, "set", "left").join(degree, "set", "left").select("id", F.coalesce("root", "set").alias("group_id"), "set", F.coalesce("links", F.lit(0)).alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """``(set, root)`` of the vertices of ``edges(x, y)``; alternating large-star and small-star
    rounds, each a grouped window over the edges, checkpointed, until nothing changes."""
    e = stable(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u != v").distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hook = large.join(least, "u")
        small = hook.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = stable(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("set"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("set"), F.col("v").alias("root"))).distinct()

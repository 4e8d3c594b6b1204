"""The k most similar vectors of every vector, by score-aware quantisation and exact reranking.

Index. Vectors are scaled to length 1. Cells are those of an inverted multi-index: each half of
the dimensions has about sqrt(rows / CELL_ROWS) centroids, and a cell is a pair of them, so cells keep
their size at every scale while assignment stays cheap. Each vector also gets one four-bit code
per pair of dimensions. The code books minimise the anisotropic loss
``weight * |parallel residual|^2 + |orthogonal residual|^2``: error along the vector itself
spoils its large inner products, so it costs more. Codes are chosen by coordinate descent, books
by weighted least squares. Books and centroids are fitted on at most ``TRAIN_ROWS`` rows; every
row is indexed.

Search. Every vector lies in one cell and is looked up in its ``probes`` best ones. Within a cell the
sums of table entries (four-bit code against four-bit code) of all queries and vectors are taken
at once as a product of decoded blocks, which are the same sums. The best candidates get
their exact cosine from the vectors themselves. A cell above ``BLOCK`` rows is cut into blocks
of vectors and of queries, each pair of blocks a group of its own, so none grows with the data.

An exhaustive search makes no use of the index: blocks of all vectors and of the queries are compared
exactly, so nothing depends on how far a code can be trusted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.flat_text import mix
from corpusloom.session import stable, written

TRAIN_ROWS = 20_000
CELL_ROWS = 300
BLOCK = 4096
#: Vectors of a block of the exhaustive search.
SCAN_BLOCK = 16384
SUB = 2
#: Weight of the parallel residual; ScaNN's ratio (d - 1) t^2 / (1 - t^2) for t = 0.25, d = 64.
PARALLEL_WEIGHT = 4.2
#: Part of the pairs exactly at a similarity floor that the scores of their codes must let through.
FLOOR_RECALL = 0.9995
_GROUP = (("cell", pa.int64()), ("vb", pa.int32()), ("qb", pa.int32()))


class Index:
    """Centroids of both halves and code books; fitted on a sample."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 7, cells: bool = True):
        rng = np.random.default_rng(seed)
        n, d = sample.shape
        self.dim = d
        self.pad = -d % (2 * SUB)
        x = self._padded(sample)
        self.half = x.shape[1] // 2
        side = max(1, min(int(round((rows / CELL_ROWS) ** 0.5)), n // 4, 4096)) if cells else 1
        self.cent = [self._kmeans(x[:, h * self.half : (h + 1) * self.half], side, rng) for h in (0, 1)]
        self.books = self._fit_books(x, rng)

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.pad))) if self.pad else x

    @staticmethod
    def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
        c = x[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(rounds):
            a = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
            for j in range(x.shape[1]):
                s = np.bincount(a, x[:, j], k)
                cnt = np.bincount(a, minlength=k)
                c[:, j] = np.where(cnt > 0, s / np.maximum(cnt, 1), c[:, j])
        return c.astype(np.float32)

    def _fit_books(self, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        m = x.shape[1] // SUB
        books = np.stack([self._kmeans(x[:, i * SUB : (i + 1) * SUB], min(16, len(x)), rng) for i in range(m)])
        if books.shape[1] < 16:
            books = np.concatenate([books, np.repeat(books[:, :1], 16 - books.shape[1], axis=1)], axis=1)
        self.books = books
        for _ in range(3):
            codes = self.encode_codes(x)
            # least squares of sum_i (r'r + (w - 1)(x'r)^2), r = x - decode: normal equations over all entries
            size = m * 16 * SUB
            cols = (np.arange(m) * 16 + codes)[:, :, None] * SUB + np.arange(SUB)
            cols = cols.reshape(len(x), -1)
            diag = np.zeros(size)
            rhs = np.zeros(size)
            np.add.at(diag, cols.ravel(), 1.0)
            np.add.at(rhs, cols.ravel(), (x * PARALLEL_WEIGHT).ravel())  # x + (w-1) x (x'x), |x| = 1
            b = np.zeros((len(x), size), np.float32)
            np.put_along_axis(b, cols, x, axis=1)
            a = np.diag(diag + 1e-3) + (PARALLEL_WEIGHT - 1) * (b.T @ b)
            self.books = np.linalg.solve(a, rhs + 1e-3 * self.books.ravel()).astype(np.float32).reshape(m, 16, SUB)
        return self.books

    def encode_codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss."""
        m, w = self.books.shape[0], PARALLEL_WEIGHT - 1
        xs = x.reshape(len(x), m, SUB)
        codes = np.empty((len(x), m), np.int64)
        dots = np.empty((m, len(x), 16), np.float32)  # x_sub . c
        cost = np.empty_like(dots)  # |x_sub - c|^2
        for i in range(m):
            dots[i] = xs[:, i] @ self.books[i].T
            cost[i] = (xs[:, i] ** 2).sum(1)[:, None] - 2 * dots[i] + (self.books[i] ** 2).sum(1)
            codes[:, i] = np.argmin(cost[i], axis=1)
        at = np.arange(len(x))
        par = (x * x).sum(1) - sum(dots[i][at, codes[:, i]] for i in range(m))  # x'r
        for _ in range(sweeps):
            for i in range(m):
                without = par + dots[i][at, codes[:, i]]
                left = without[:, None] - dots[i]
                left *= left
                left *= w
                left += cost[i]
                best = np.argmin(left, axis=1)
                par = without - dots[i][at, best]
                codes[:, i] = best
        return codes

    def encode(self, x: np.ndarray) -> np.ndarray:
        c = self.encode_codes(self._padded(x)).astype(np.uint8)
        if c.shape[1] % 2:
            c = np.pad(c, ((0, 0), (0, 1)))
        return c[:, ::2] | (c[:, 1::2] << 4)

    def decode(self, packed: np.ndarray) -> np.ndarray:
        c = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
        c[:, ::2], c[:, 1::2] = packed & 15, packed >> 4
        m = self.books.shape[0]
        return self.books[np.arange(m), c[:, :m]].reshape(len(packed), m * SUB)

    def margin(self, sample: np.ndarray, floor: float, seed: int = 11) -> float:
        """How far the codes' score may lie below ``floor`` for pairs of that similarity, measured on the sample: each vector
        meets one turned from it towards another vector of the sample."""
        rng = np.random.default_rng(seed)
        x = np.repeat(sample, -(-8000 // len(sample)), axis=0)
        u = x[rng.permutation(len(x))] + rng.normal(size=x.shape) * 1e-3
        u -= (u * x).sum(axis=1, keepdims=True) * x
        y = floor * x + (1 - floor**2) ** 0.5 * u / np.linalg.norm(u, axis=1, keepdims=True)
        coded = [self.decode(self.encode(v.astype(np.float32))) for v in (x, y)]
        return float(np.quantile(floor - (coded[0] * coded[1]).sum(axis=1), FLOOR_RECALL))

    def cells(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` best cells of each vector, the best first."""
        x = self._padded(x)
        k = self.cent[0].shape[0]
        each = min(k, 16)
        tops = []
        for h in (0, 1):
            c = self.cent[h]
            s = x[:, h * self.half : (h + 1) * self.half] @ c.T - 0.5 * (c * c).sum(1)
            best = np.argpartition(-s, each - 1, axis=1)[:, :each] if each < k else np.tile(np.arange(k), (len(x), 1))
            tops.append((best, np.take_along_axis(s, best, 1)))
        total = (tops[0][1][:, :, None] + tops[1][1][:, None, :]).reshape(len(x), -1)
        p = min(probes, total.shape[1])
        pick = np.argpartition(-total, p - 1, axis=1)[:, :p] if p < total.shape[1] else np.tile(np.arange(p), (len(x), 1))
        pick = np.take_along_axis(pick, np.argsort(-np.take_along_axis(total, pick, 1), axis=1, kind="stable"), 1)
        return np.take_along_axis(tops[0][0], pick // each, 1) * k + np.take_along_axis(tops[1][0], pick % each, 1)


def _matrix(col: pa.ListArray, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and which rows of the column they are; unusable vectors are left out."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lens = np.nan_to_num(np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
    off = np.concatenate(([0], np.cumsum(lens)))
    if dim is None:
        dim = int(np.bincount(lens[lens > 0]).argmax()) if (lens > 0).any() else 1
    at = np.flatnonzero(lens == dim)
    x = flat[(off[at][:, None] + np.arange(dim)).ravel()].reshape(len(at), dim)
    top = np.abs(x).max(axis=1, initial=0.0)
    ok = np.isfinite(top) & (top > 0)
    x, at = x[ok] / top[ok, None], at[ok]
    return x / np.linalg.norm(x, axis=1, keepdims=True), at


def _nearest(dim: int, k: int, floor: float | None):
    """The ``k`` most similar vectors (role 0) of each query (role 1) of a group, from the vectors themselves."""

    def run(table: pa.Table) -> pa.Table:
        role, v = table.column("role").to_numpy(), table.column("v").to_numpy()
        x, at = _matrix(table.column("vec").combine_chunks(), dim)
        role, v = role[at], v[at]
        docs, dv, asked, qv = x[role == 0], v[role == 0], x[role == 1], v[role == 1]
        out = []
        for lo in range(0, len(qv) if len(dv) else 0, 256):
            q = qv[lo : lo + 256]
            s = np.clip(asked[lo : lo + 256] @ docs.T, -1.0, 1.0)
            s[q[:, None] == dv] = -2.0
            t = min(k, s.shape[1])
            least = np.maximum(-np.partition(-s, t - 1, axis=1)[:, t - 1], -1.0 if floor is None else floor)
            i, j = np.nonzero(s >= least[:, None])
            order = np.lexsort((dv[j], -s[i, j], i))
            i, j = i[order], j[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((q[i[keep]], dv[j[keep]], s[i[keep], j[keep]]))
        cat = lambda c, t: np.concatenate([o[c] for o in out]) if out else np.empty(0, t)
        return pa.table({"v": pa.array(cat(0, np.int64)), "w": pa.array(cat(1, np.int64)), "similarity": pa.array(cat(2, np.float64))})

    return run


def _compare_all(vecs: DataFrame, dim: int, k: int) -> DataFrame:
    """``(v, w, similarity)``: the ``k`` nearest of all ``vecs(v, asked, vec)`` for those asked, by blocks."""
    n, asked = vecs.agg(F.count("*"), F.count("asked")).first()
    vbs, qbs = -(-n // SCAN_BLOCK) or 1, -(-asked // BLOCK) or 1
    own = lambda blocks: F.pmod(F.xxhash64("v"), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    docs = vecs.select(own(vbs).alias("vb"), every(qbs).alias("qb"), F.lit(0).alias("role"), "v", "vec")
    ask = vecs.where("asked is not null").select(every(vbs).alias("vb"), own(qbs).alias("qb"), F.lit(1).alias("role"), "v", "vec")
    return docs.unionByName(ask).groupBy("vb", "qb").applyInArrow(_nearest(dim, k, None), "v long, w long, similarity double")


def probes_for(rows: int) -> int:
    """Cells looked up per vector. Grows slowly, as the rank of a near neighbour's cell does."""
    return max(8, int(np.ceil(6 * max(1.0, rows / CELL_ROWS) ** 0.16)))


def _compare_cells(vecs: DataFrame, rows: DataFrame, index: Index, sample: np.ndarray, k: int, min_similarity: float | None, keep: int, rerank: int) -> DataFrame:
    """``(v, w, similarity)``, in both directions: the pairs whose codes are alike within a probed cell."""
    dim = index.dim

    # cells above BLOCK rows: at most rows / BLOCK of them
    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, counts = np.unique(b.column(0).to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(counts.astype(np.int64))], names=["cell", "c"])

    hot = {r["cell"]: int(np.ceil(r["s"] / BLOCK)) for r in vecs.select(F.get("cells", F.lit(0))).mapInArrow(homes, "cell int, c long").groupBy("cell").agg(F.sum("c").alias("s")).where(F.col("s") > BLOCK).collect()}
    code_bytes = len(index.encode(sample[:1].astype(np.float32))[0])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows packed by (cell, block of vectors, block of queries, role)."""
        for b in batches:
            v = b.column(0).to_numpy()
            c = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, code_bytes)
            p = b.column(2).flatten().to_numpy().reshape(len(v), -1)
            asked = np.flatnonzero(~np.isnan(b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)))
            at = np.concatenate((np.arange(len(v)), np.repeat(asked, p.shape[1])))
            cell = np.concatenate((p[:, 0], p[asked].ravel())).astype(np.int64)
            role = np.concatenate((np.zeros(len(v), np.int8), np.ones(len(asked) * p.shape[1], np.int8)))
            blocks = np.ones(len(at), np.int64)
            if hot:
                blocks = np.array([hot.get(int(x), 1) for x in cell]) if len(hot) > 64 else blocks
                if len(hot) <= 64:
                    for x, nb in hot.items():
                        blocks[cell == x] = nb
            own = (mix(v[at].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
            times = blocks
            rep = np.repeat(np.arange(len(at)), times)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(times) - times, times)
            at, cell, role, own = at[rep], cell[rep], role[rep], own[rep]
            vb, qb = np.where(role == 0, own, other), np.where(role == 0, other, own)
            order = np.lexsort((role, qb, vb, cell))
            at, cell, role, vb, qb = at[order], cell[order], role[order], vb[order], qb[order]
            cut = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (vb[1:] != vb[:-1]) | (qb[1:] != qb[:-1]) | (role[1:] != role[:-1]))))
            to = np.append(cut[1:], len(at))
            vs, cs = v[at], c[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell[cut]), pa.array(vb[cut].astype(np.int32)), pa.array(qb[cut].astype(np.int32)), pa.array(role[cut]), pa.array([vs[i:j].tobytes() for i, j in zip(cut, to)], pa.binary()), pa.array([cs[i:j].tobytes() for i, j in zip(cut, to)], pa.binary())],
                names=["cell", "vb", "qb", "role", "vs", "cs"],
            )

    floor = None if min_similarity is None else min_similarity - index.margin(sample, min_similarity)

    def scan(key: tuple, table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        vs, cs = table.column("vs").to_pylist(), table.column("cs").to_pylist()
        v, c = {}, {}
        for r in (0, 1):
            at = np.flatnonzero(role == r)
            v[r] = np.frombuffer(b"".join(vs[i] for i in at), np.int64)
            c[r] = index.decode(np.frombuffer(b"".join(cs[i] for i in at), np.uint8).reshape(-1, code_bytes)) if len(at) else None
        qs, ds, sc, dense = [], [], [], [np.empty(0, np.int64)]
        for lo in range(0, len(v[1]) if len(v[0]) else 0, 2048):
            s = c[1][lo : lo + 2048] @ c[0].T
            q = v[1][lo : lo + 2048]
            if floor is not None:
                hit = np.flatnonzero(s.ravel() >= floor)
                i, j = hit // s.shape[1], hit % s.shape[1]
                w = s.ravel()[hit]
                other = q[i] != v[0][j]
                i, j, w = i[other], j[other], w[other]
                many = np.bincount(i, minlength=len(q)) > keep  # codes can't tell these hits apart
                dense.append(q[many])
                few = ~many[i]
                i, j, w = i[few], j[few], w[few]
            else:
                t = min(keep + 1, s.shape[1])
                best = np.argpartition(-s, t - 1, axis=1)[:, :t] if t < s.shape[1] else np.tile(np.arange(t), (len(q), 1))
                i, j = np.repeat(np.arange(len(q)), t), best.ravel()
                w = s[i, j]
                other = q[i] != v[0][j]
                i, j, w = i[other], j[other], w[other]
            qs.append(q[i])
            ds.append(v[0][j])
            sc.append(w)
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        qs, ds, sc, whole = cat(qs, np.int64), cat(ds, np.int64), cat(sc, np.float32), np.concatenate(dense)
        pairs = pa.table({"q": pa.array(qs), "d": pa.array(ds), "score": pa.array(sc, pa.float32()), **{c: pa.nulls(len(qs), t) for c, t in _GROUP}})
        marks = pa.table({"q": pa.array(whole), "d": pa.nulls(len(whole), pa.int64()), "score": pa.nulls(len(whole), pa.float32()), **{c: pa.array(np.full(len(whole), x.as_py()), t) for (c, t), x in zip(_GROUP, key)}})
        return pa.concat_tables([pairs, marks])

    packed = vecs.select("v", "code", "cells", "asked").mapInArrow(spread, "cell long, vb int, qb int, role byte, vs binary, cs binary")
    found = packed.groupBy("cell", "vb", "qb").applyInArrow(scan, "q long, d long, score float, cell long, vb int, qb int")
    dense = None
    if floor is None:
        w = Window.partitionBy("q").orderBy(F.desc("score"), "d")
        found = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= rerank)
    else:
        found = written(found)
        dense = found.where("d is null").select(F.col("q").alias("v"), "cell", "vb", "qb")
        found = found.where("d is not null")
    pairs = stable(found.select(F.least("q", "d").alias("x"), F.greatest("q", "d").alias("y")).distinct())

    ends = pairs.select("x", "y", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("v")), F.struct(F.lit(1).alias("side"), F.col("y").alias("v")))).alias("e")).select("x", "y", "e.side", "e.v")
    need = ends.join(vecs.select("v", "rep"), "v").join(rows, (F.col("rep.id") == rows["id"]) & (F.col("rep.th") == rows["th"]))
    both = need.groupBy("x", "y").agg(F.first(F.when(F.col("side") == 0, F.col("vec")), ignorenulls=True).alias("a"), F.first(F.when(F.col("side") == 1, F.col("vec")), ignorenulls=True).alias("b"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, at = _matrix(b.column(2), dim)
            q, _ = _matrix(b.column(3), dim)
            s = np.clip((p * q).sum(axis=1), -1.0, 1.0)
            ok = np.flatnonzero(s >= (min_similarity if min_similarity is not None else -2.0))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[ok])), b.column(1).take(pa.array(at[ok])), pa.array(s[ok])], names=["x", "y", "similarity"])

    scored = stable(both.mapInArrow(exact, "x long, y long, similarity double"))
    both_ways = scored.select(F.col("x").alias("v"), F.col("y").alias("w"), "similarity").unionByName(scored.select(F.col("y").alias("v"), F.col("x").alias("w"), "similarity"))
    if dense is None or dense.isEmpty():
        return both_ways

    # queries with many hits in a block of a cell: that block is compared exactly
    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, cell = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            blocks = np.array([hot.get(int(x), 1) for x in cell], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell), pa.array((mix(v.view(np.uint64)) % blocks).astype(np.int32))], names=["v", "cell", "vb"])

    homes_of = vecs.select("v", F.get("cells", F.lit(0)).alias("cell")).mapInArrow(home, "v long, cell long, vb int")
    docs = homes_of.join(dense.select("cell", "vb", "qb").distinct(), ["cell", "vb"]).withColumn("role", F.lit(0))
    group = docs.unionByName(dense.withColumn("role", F.lit(1))).join(vecs.select("v", "rep"), "v")
    group = group.join(rows.dropDuplicates(["id", "th"]), (F.col("rep.id") == rows["id"]) & (F.col("rep.th") == rows["th"])).select("cell", "vb", "qb", "role", "v", "vec")
    exactly = group.groupBy("cell", "vb", "qb").applyInArrow(_nearest(dim, k, min_similarity), "v long, w long, similarity double")
    back = exactly.select(F.col("w").alias("v"), F.col("v").alias("w"), "similarity")
    return both_ways.unionByName(exactly).unionByName(back).groupBy("v", "w").agg(F.max("similarity").alias("similarity"))


def similar_vectors(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    k: int = 5,
    min_similarity: float | None = None,
    queries: DataFrame | None = None,
    exhaustive: bool = False,
    probes: int | None = None,
    per_block: int | None = None,
    rerank: int = 100,
) -> DataFrame:
    """``(id, neighbour, similarity, rank)``: the ``k`` most similar other rows of each row.

    ``queries(id)`` restricts the rows that are looked up, never those that are found.
    ``min_similarity`` leaves out neighbours below it, which lets few cells suffice.
    ``exhaustive`` compares with all rows exactly and has no use for ``min_similarity`` as a filter of
    cells, ``probes``, ``per_block`` or ``rerank``. With a floor, all candidates of a query in a block go on, and where
    they are more than ``per_block`` (40) the query is compared with the whole block exactly; how far below the floor codes may score
    is measured on the sample. Without a floor, the ``rerank`` best by code are reranked, an approximation at every
    size: use ``exhaustive`` where it must not be one. Ties go to the smaller id.

    Null ids and null, all-zero, non-finite or wrongly sized vectors have no neighbours and are
    none. Repeated rows count once, by id; an id with several vectors has the neighbours of each.
    Equal vectors are one throughout and expanded at the end. An empty table gives an empty one.
    Other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where("id is not null and vec is not null").withColumn("th", F.xxhash64("vec"))
    n = rows.count()
    share = min(1.0, 1.2 * TRAIN_ROWS / max(n, 1))
    taken = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))).select("vec").limit(TRAIN_ROWS).toArrow()
    out = "id string, neighbour string, similarity double, rank int"
    if not taken.num_rows and n:
        taken = rows.select("vec").limit(TRAIN_ROWS).toArrow()
    sample, _ = _matrix(taken.column(0).combine_chunks(), None) if taken.num_rows else (np.empty((0, 1)), None)
    if not len(sample):
        return spark.createDataFrame([], out)
    index = None if exhaustive else Index(sample.astype(np.float32), n)
    dim, width = sample.shape[1], probes or probes_for(n)
    keep = per_block or (40 if min_similarity is not None else rerank)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                x, at = _matrix(part.column(1), dim)
                if not len(at):
                    continue
                raw = np.round(x * (1 << 22)).astype(np.int64).view(np.uint64)
                salt = mix(np.arange(1, dim + 1, dtype=np.uint64))
                h1 = mix(raw ^ salt).sum(axis=1, dtype=np.uint64)
                h2 = mix(raw + salt * np.uint64(3)).sum(axis=1, dtype=np.uint64)
                x = x.astype(np.float32)
                if index is None:
                    c, p = np.empty((len(x), 0), np.uint8), np.zeros((len(x), 1), np.int32)
                else:
                    c, p = index.encode(x), index.cells(x, width).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at)), part.column(2).take(pa.array(at)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([r.tobytes() for r in c], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))],
                    names=["id", "th", "h1", "h2", "code", "cells"],
                )

    coded = rows.mapInArrow(code, "id string, th long, h1 long, h2 long, code binary, cells array<int>")
    if queries is not None:
        asked = queries.select(F.col(queries.columns[0]).cast("string").alias("id")).distinct().withColumn("asked", F.lit(1))
        coded = coded.join(asked, "id", "left")
    else:
        coded = coded.withColumn("asked", F.lit(1))
    coded = written(coded)
    vecs = coded.groupBy("h1", "h2").agg(F.min(F.struct("id", "th")).alias("rep"), F.first("code").alias("code"), F.first("cells").alias("cells"), F.max("asked").alias("asked"))
    vecs = written(vecs.withColumn("v", F.monotonically_increasing_id()))
    members = coded.select("id", "h1", "h2", "asked").join(vecs.select("h1", "h2", "v"), ["h1", "h2"]).select("v", "id", "asked").distinct()

    if exhaustive:
        held = vecs.select("v", "asked", "rep").join(rows.dropDuplicates(["id", "th"]), (F.col("rep.id") == rows["id"]) & (F.col("rep.th") == rows["th"])).select("v", "asked", "vec")
        directed = _compare_all(held, dim, k)
        if min_similarity is not None:
            directed = directed.where(F.col("similarity") >= min_similarity)
    else:
        directed = _compare_cells(vecs, rows, index, sample, k, min_similarity, keep, rerank)
    ask = vecs.where("asked is not null").select("v")
    directed = directed.join(ask, "v", "left_semi").unionByName(ask.select("v", F.col("v").alias("w"), F.lit(1.0).alias("similarity")))  # copies of the vector itself
    best = Window.partitionBy("v").orderBy(F.desc("similarity"), "w")
    directed = directed.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    first_ids = members.select("v", "id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    few = first_ids.select(F.col("v").alias("w"), F.col("id").alias("neighbour"))
    each = members.where("asked is not null").select("v", "id").join(directed, "v").join(few, "w").where("id != neighbour")
    rank = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return each.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity")).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)

"""Exact dense retrieval and vector expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors held by a task at once.
QUERY_BLOCK = 16_384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.when(n == 0, F.lit(0.0)))


def search(vectors: DataFrame, id_col: str, vec_col: str, queries: DataFrame, k: int = 20, exclude_same: bool = False) -> DataFrame:
    """``(qid, doc, score, rank)``: the k rows of highest cosine for ``queries(qid, vec)``.

    The query set goes to the tasks in blocks; each batch of rows keeps its own k best per query, of these only what reaches the
    k-th best of the task's earlier batches, and nothing else is shuffled. Null, empty, zero and non-finite
    vectors are left out. An id counts once, by its best row, before anything is cut. Ties go to the
    smaller doc.
    """
    parts = None
    block: list[tuple[str, list[float]]] = []

    def add(parts: DataFrame | None) -> DataFrame:
        got = _scan(vectors, id_col, vec_col, block, k, exclude_same)
        return got if parts is None else parts.unionByName(got)

    for r in queries.select(F.col("qid").cast("string"), "vec").where("qid is not null and vec is not null").toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == QUERY_BLOCK:
            parts = add(parts)
            block = []
    if block or parts is None:
        parts = add(parts)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc")
    return parts.groupBy("qid", "doc").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scan(vectors: DataFrame, id_col: str, vec_col: str, block: list, k: int, exclude_same: bool) -> DataFrame:
    dim = max((len(v) for _, v in block), default=0)
    rows = [(q, np.array(v, np.float64)) for q, v in block if len(v) == dim]
    rows = [(q, v / np.linalg.norm(v)) for q, v in rows if np.isfinite(v).all() and np.linalg.norm(v) > 0]
    qids = [q for q, _ in rows]
    m = np.array([v for _, v in rows]).reshape(len(rows), dim)
    names = ["qid", "doc", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(m), k), -np.inf)  # of distinct ids; in each row the least comes first
        seen: set[str] = set()
        for b in batches:
            lens = np.nan_to_num(np.asarray(b.column(1).value_lengths().to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
            at = np.flatnonzero((lens == dim) & ~np.asarray(b.column(0).is_null()))
            qs, ds, sc = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            labels: list[str] = []
            if len(at) and len(m):
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = flat[((np.cumsum(lens) - lens)[at][:, None] + np.arange(dim)).ravel()].reshape(len(at), dim)
                n = np.linalg.norm(x, axis=1)
                use = np.isfinite(n) & (n > 0)
                x, at = x[use] / n[use, None], at[use]
                ids, place = np.unique(np.array(b.column(0).take(pa.array(at)).to_pylist(), object).astype(str), return_inverse=True) if len(at) else (np.empty(0, str), at)
                order = np.argsort(place, kind="stable")
                first = np.flatnonzero(np.diff(place[order], prepend=-1))
                x = x[order]
                labels = ids.tolist()
                new = np.array([v not in seen for v in labels], bool)
                seen.update(labels)
                groups = np.arange(0, len(ids), max(1, len(ids) // (8 * k)))
                for lo in range(0, len(m) if len(ids) else 0, 256):
                    s = m[lo : lo + 256] @ x.T
                    if len(first) < len(x):
                        s = np.maximum.reduceat(s, first, axis=1)  # the best of the rows of an id
                    if exclude_same:
                        s[np.array(qids[lo : lo + 256])[:, None] == ids] = -np.inf
                    top = best[lo : lo + 256]
                    least = top[:, 0].copy()
                    if len(groups) > k and not np.isfinite(least).all():  # the k-th of the groups' best is a bound
                        tops = np.maximum.reduceat(s, groups, axis=1)
                        least = np.maximum(least, np.partition(tops, len(groups) - k, axis=1)[:, len(groups) - k])
                    # scores that round alike are decided by the id
                    i, j = np.nonzero(s >= np.where(np.isfinite(least), least - 1e-6, np.finfo(np.float64).min)[:, None])
                    v = np.round(s[i, j], 6)
                    by = np.lexsort((j, -v, i))  # ids are in order, so ties go to the smaller
                    i, j, v = i[by], j[by], v[by]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, j, v = i[keep], j[keep], v[keep]
                    qs.append(i + lo)
                    ds.append(j)
                    sc.append(v)
                    i, v = i[new[j]], v[new[j]]
                    more = np.full((len(top), k), -np.inf)
                    more[i, np.arange(len(i)) - np.searchsorted(i, i)] = v
                    best[lo : lo + 256] = np.sort(np.concatenate((top, more), axis=1), axis=1)[:, -k:]
            pick = lambda names, idx: pa.array([names[v] for v in idx.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pick(qids, np.concatenate(qs)), pick(labels, np.concatenate(ds)), pa.array(np.concatenate(sc))], names=names)

    return vectors.select(F.col(id_col).cast("string"), F.col(vec_col)).mapInArrow(run, "qid string, doc string, score double")

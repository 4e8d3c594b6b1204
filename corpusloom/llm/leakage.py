"""Evaluation items inside training documents: a prefix-filtered set join with verification.

Words are compared without case, accents, punctuation, markup or time marks. A document holds
an item if one passage of it, in order, covers at least ``share`` of the item's words, single
changed words aside. Such a passage of h words with a change in at most every eighth word
keeps t = h - (k - 1) - k * (h // 8) of the item's k-word shingles. So of the item's n shingles,
ordered by rarity in the corpus (all documents are counted), one of the n - t + 1 rarest must be in the document: only they
make candidates. The candidates' other hits then have to reach t within an item-sized window
of neighbouring diagonals, and what is left is aligned word by word.

The items are the query side, broadcast in blocks of at most ``BLOCK_WORDS`` words; documents are
read once for the counts and once per block, and nothing about them is shuffled or collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.flat_text import Words, pieces

BLOCK_WORDS = 2_000_000
SHINGLE = 5
#: Words that diagonals of one passage may differ by (inserted or lost words).
DRIFT = 3
_MARKS = re.compile(r"\[?\(?\b\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?\b\)?\]?|<[^<>\n]{1,60}>|&[a-z]{2,6};")
_OUT = "doc_id long, item_id long, share double, item_from int, item_to int, doc_from int, doc_to int"


def _strip(text: str) -> str:
    return _MARKS.sub(" ", text)


class Items:
    """Word hashes of some items, and their shingles sorted by hash with (item, position)."""

    def __init__(self, ids: list[int], texts: list[str], share: float):
        w = Words([_strip(t) for t in texts], fold=True)
        first = np.searchsorted(w.doc, np.arange(len(ids) + 1))
        self.words = [w.hash[a:b] for a, b in zip(first, first[1:])]
        self.ids = np.array(ids, np.int64)
        self.half = np.array([int(np.ceil(len(x) * share)) for x in self.words])
        self.k = np.maximum(1, np.minimum(SHINGLE, self.half))
        self.least = np.maximum(1, self.half - (self.k - 1) - self.k * (self.half // 8))
        self.tables = {}
        for k in sorted({int(k) for k, x in zip(self.k, self.words) if len(x)}):
            doc, at, h = w.shingles(k)
            use = self.k[doc] == k
            doc, pos, h = doc[use], (at - first[doc])[use], h[use]
            order = np.argsort(h, kind="stable")
            keys, start = np.unique(h[order], return_index=True)
            self.tables[k] = (keys, np.append(start, len(order)), doc[order], pos[order])
        self.prefix: dict[int, np.ndarray] = {}

    def set_rarity(self, counts: dict[tuple[int, int], int]) -> None:
        """Mark the rarest n - t + 1 shingles of each item, given documents per (k, key number)."""
        for k, (keys, start, item, pos) in self.tables.items():
            df = np.array([counts.get((k, i), 0) for i in range(len(keys))])
            each = np.repeat(df, np.diff(start))
            order = np.lexsort((pos, each, item))
            it = item[order]
            begin = np.searchsorted(it, it)
            rank = np.arange(len(it)) - begin
            n = np.bincount(item, minlength=len(self.ids))
            mark = np.zeros(len(it), bool)
            mark[order] = rank < n[it] - self.least[it] + 1
            self.prefix[k] = mark


def _hits(words: Words, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, at, h = words.shingles(k)
    i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    ok = np.flatnonzero(keys[i] == h)
    return doc[ok], at[ok], i[ok]


def _align(doc: np.ndarray, item: np.ndarray, offsets: np.ndarray) -> tuple[int, int, int, int]:
    """The longest passage (item from, to, document from, to) on diagonals near ``offsets``."""
    runs = []
    for o in offsets:
        lo, hi = max(0, -o), min(len(item), len(doc) - o)
        at = np.flatnonzero(item[lo:hi] == doc[lo + o : hi + o]) + lo
        if len(at):
            cut = np.flatnonzero(np.diff(at) > 2) + 1
            for r in np.split(at, cut):
                if len(r) >= min(4, len(item)):
                    runs.append((int(r[0]), int(r[-1]) + 1, int(o)))
    runs.sort()
    best, chain = (0, 0, 0, 0), []
    for s, e, o in runs:
        start, dstart = s, s + o
        for ps, pe, po, pstart, pdoc in chain:
            near = -DRIFT <= s - pe <= DRIFT and -DRIFT <= s + o - pe - po <= DRIFT
            if near and abs(o - po) <= DRIFT and e > pe and pstart < start:
                start, dstart = pstart, pdoc
        chain.append((s, e, o, start, dstart))
        if e - start > best[1] - best[0]:
            best = (start, e, dstart, e + o)
    return best


def _find(texts: list[str], items: Items) -> list[tuple[int, int, float, int, int, int, int]]:
    """(text, item, share, item from, to, document from, to) of the leaks in some texts."""
    w = Words([_strip(t) for t in texts], fold=True)
    first = np.searchsorted(w.doc, np.arange(len(texts) + 1))
    out = []
    n_items = len(items.ids)
    for k, (keys, start, item, pos) in items.tables.items():
        doc, at, key = _hits(w, keys, k)
        if not len(doc):
            continue
        times = start[key + 1] - start[key]
        rep = np.repeat(np.arange(len(doc)), times)
        entry = np.repeat(start[key] - (np.cumsum(times) - times), times) + np.arange(len(rep))
        it = item[entry]
        pair = doc[rep] * n_items + it
        diag = (at - first[doc])[rep] - pos[entry]
        # candidates: pairs with a prefix shingle, long enough documents
        cand = np.unique(pair[items.prefix[k][entry]])
        cand = cand[np.diff(first)[cand // n_items] >= items.half[cand % n_items]]
        keep = np.isin(pair, cand)
        pair, diag = pair[keep], diag[keep]
        order = np.lexsort((diag, pair))
        pair, diag = pair[order], diag[order]
        # window: the hit t - 1 places on, of the same pair, lies within an item's share of drift
        need = items.least[pair % n_items] - 1
        ahead = np.minimum(np.arange(len(pair)) + need, len(pair) - 1)
        slack = np.maximum(DRIFT, items.half[pair % n_items] // 8)
        good = (np.arange(len(pair)) + need < len(pair)) & (pair[ahead] == pair) & (diag[ahead] - diag <= slack)
        for p in np.unique(pair[good]):
            lo, hi = np.searchsorted(pair, [p, p + 1])
            d, i = int(p // n_items), int(p % n_items)
            a, b, x, y = _align(w.hash[first[d] : first[d + 1]], items.words[i], np.unique(diag[lo:hi]))
            if b - a >= items.half[i] and b > a:
                out.append((d, i, (b - a) / len(items.words[i]), a, b, x, y))
    return out


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.5) -> DataFrame:
    """``(doc_id, item_id, share, item_from, item_to, doc_from, doc_to)``, positions in words.

    Null or blank items and items without words never count; null or empty texts hold nothing.
    Documents with the same text count each, repeated rows of a document once, several equal
    items each. Very long texts are searched whole. Empty tables give an empty table. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text")).where("text is not null")
    result = spark.createDataFrame([], _OUT)
    batch: list[tuple[int, str]] = []
    words = 0
    wanted = items.select(F.col(item_id).cast("long"), F.col(item_text).cast("string")).where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).distinct()
    for row in wanted.toLocalIterator():
        batch.append((row[0], row[1]))
        words += row[1].count(" ") + 1
        if words >= BLOCK_WORDS:
            result = result.unionByName(_block(d, batch, share))
            batch, words = [], 0
    if batch:
        result = result.unionByName(_block(d, batch, share))
    return result.distinct()


def _block(d: DataFrame, rows: list[tuple[int, str]], share: float) -> DataFrame:
    rows = sorted(rows)
    items = Items([r[0] for r in rows], [r[1] for r in rows], share)
    tables = {k: t[0] for k, t in items.tables.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {k: np.zeros(len(keys), np.int64) for k, keys in tables.items()}
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in pieces(np.fromiter(map(len, texts), np.int64, len(texts))):
                w = Words([_strip(t) for t in texts[lo:hi]], fold=True)
                for k, keys in tables.items():
                    doc, _, key = _hits(w, keys, k)
                    once = np.unique(doc * len(keys) + key) % len(keys)
                    seen[k] += np.bincount(once, minlength=len(keys))
        for k, c in seen.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int64)), pa.array(c[at])], names=["k", "key", "docs"])

    counts = d.select("text").mapInArrow(count, "k int, key long, docs long").groupBy("k", "key").agg(F.sum("docs").alias("docs"))
    items.set_rarity({(r[0], r[1]): r[2] for r in counts.collect()})  # at most one row per shingle of the block

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rec = []
            for lo, hi in pieces(np.fromiter(map(len, texts), np.int64, len(texts))):
                rec += [(ids[lo + x[0]], int(items.ids[x[1]]), *x[2:]) for x in _find(texts[lo:hi], items)]
            types = [pa.int64(), pa.int64(), pa.float64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rec) if rec else [()] * 7, types)], names=[x.split()[0] for x in _OUT.split(", ")])

    return d.mapInArrow(find, _OUT)

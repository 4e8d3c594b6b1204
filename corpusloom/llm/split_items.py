"""Splitting oversized items at natural boundaries, by pointer doubling.

The text of an item is a row of units (words; a word longer than a quarter of the character
limit is several glued units). Boundary i lies before unit i. For every boundary i the farthest
legal end e(i) is found at once (binary search in prefix sums of words, characters and time), moved back to
the last sentence end, else clause or line end, in its later half; the successor of i is then
the boundary from which the next piece starts, i.e. e(i) less the overlap. The cuts of the greedy
walk from 0 are found by squaring the successor table: after round r the table leaps 2**r
pieces, and the set of known starts doubles, so an item of p pieces needs log2(p) rounds. All
items of a batch are worked on together in flat arrays; no item needs another, so nothing is
shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\S+")
#: Marks after which speech or text pauses, strongest first.
SENTENCE_MARKS, CLAUSE_MARKS, CLOSERS = ".!?…。！？", ",;:—–", "\"'”’)]»"
_PIECES = "id string, th long, piece int, n_pieces int, piece_text string, first_char int, last_char int, piece_start double, piece_end double, words int, tokens int"


@dataclass(frozen=True)
class Limits:
    """An item is oversized beyond any of these. ``overlap_words`` is what consecutive pieces
    share; it must be less than half of the words that fit a piece."""

    tokens: int = 230
    chars: int = 1500
    seconds: float = 120.0
    tokens_per_word: float = 1.3
    overlap_words: int = 20

    @property
    def words(self) -> int:
        """The largest number of words within the token limit."""
        n = int(self.tokens / self.tokens_per_word) + 2
        while round(n * self.tokens_per_word) > self.tokens:
            n -= 1
        return n


def word_count(text: Column) -> Column:
    """Runs of characters other than white space (Unicode)."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def oversized(text: Column, start: Column, end: Column, limits: Limits) -> Column:
    """Whether an item is over a limit; null parts never are."""
    tokens = F.bround(word_count(text) * F.lit(limits.tokens_per_word), 0)
    span = end - start
    span = F.when(F.isnan(span) | (span == float("inf")), None).otherwise(span)
    return F.coalesce(F.char_length(text) > limits.chars, F.lit(False)) | F.coalesce(span > limits.seconds, F.lit(False)) | F.coalesce(tokens > limits.tokens, F.lit(False))


def _units(text: str, limits: Limits) -> tuple[list[int], list[int], list[int]]:
    """Start and end of each unit in the text, and the strength of the pause after it."""
    starts, ends, pause = [], [], []
    most = max(1, limits.chars // 4)
    for m in _WORD.finditer(text):
        s, e = m.span()
        while e - s > most:
            starts.append(s)
            ends.append(s + most)
            pause.append(0)
            s += most
        starts.append(s)
        ends.append(e)
        tail = text[s:e].rstrip(CLOSERS)[-1:]
        pause.append(3 if tail and tail in SENTENCE_MARKS else 2 if tail and tail in CLAUSE_MARKS else 1)
    for i in range(len(ends) - 1):
        if pause[i] < 3 and "\n" in text[ends[i] : starts[i + 1]]:
            pause[i] = 3
    return starts, ends, pause


def split_batch(texts: list[str | None], begins: list[float | None], finishes: list[float | None], limits: Limits) -> list[list[tuple]]:
    """Pieces (first char, last char, start, end, words) of each item, in order."""
    S, E, P, sizes, spans = [], [], [], [], []
    for text, b, f in zip(texts, begins, finishes):
        s, e, p = _units(text or "", limits)
        span = f - b if b is not None and f is not None and np.isfinite(f - b) and f > b else 0.0
        # too few units for the span: silent units at the end, so that the time can be cut
        need = int(np.ceil(span / (limits.seconds / 4))) if span > limits.seconds else 0
        fill = max(1, need - len(s)) if not s or need > len(s) else 0
        at = len(text or "")
        S += s + [at] * fill
        E += e + [at] * fill
        P += p + [3] * fill
        sizes.append(len(s) + fill)
        spans.append(span)
    S, E, P, sizes = np.array(S, np.int64), np.array(E, np.int64), np.array(P, np.int8), np.array(sizes, np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    n = int(first[-1])
    item = np.repeat(np.arange(len(texts)), sizes)
    last = first[item + 1]
    i = np.arange(n)
    per_unit = np.array(spans)[item] / sizes[item]
    # characters: unit e-1 is the last with E[e-1] - S[i] <= chars; offsets make items disjoint
    base = item * np.int64(1 << 40)
    far = np.minimum(i + limits.words, np.searchsorted(E + base, S + base + limits.chars, side="right"))
    with np.errstate(divide="ignore", invalid="ignore"):
        timed = np.where(per_unit > 0, np.floor(limits.seconds / per_unit + 1e-9), n).astype(np.int64)
    far = np.maximum(np.minimum(np.minimum(far, i + np.maximum(timed, 1)), last), i + 1)
    end = far.copy()
    for least in (2, 3):  # the strongest pause wins: the last step overrides
        lastpause = np.maximum.accumulate(np.where(P >= least, i + 1, 0))[far - 1] if n else far
        ok = (lastpause > i + (far - i) // 2) & (far < last)
        end = np.where(ok, lastpause, end)
    share = np.minimum(limits.overlap_words, (end - i) // 2)
    nxt = np.where(end >= last, i, end - share)  # a piece that reaches the end is its own successor
    known = np.zeros(n, bool)
    known[first[:-1]] = True
    leap = nxt
    while n:
        more = known.copy()
        more[leap[known]] = True
        if (more == known).all():
            break
        known, leap = more, leap[leap]
    out: list[list[tuple]] = [[] for _ in texts]
    for k in np.flatnonzero(known):
        t, e = item[k], end[k]
        b = begins[t]
        timed_piece = spans[t] > 0
        p0 = b + (k - first[t]) * per_unit[k] if timed_piece else b
        p1 = (finishes[t] if e == last[k] else b + (e - first[t]) * per_unit[k]) if timed_piece else finishes[t]
        words = int((E[k:e] > S[k:e]).sum())
        out[t].append((int(S[k]), int(E[e - 1]), p0, p1, words))
    return out


def split_oversized(df: DataFrame, id_col: str, text_col: str, start_col: str, end_col: str, limits: Limits = Limits()) -> DataFrame:
    """The pieces of every oversized row of ``df``.

    Returns ``(id, piece, n_pieces, piece_text, first_char, last_char, piece_start, piece_end,
    words, tokens)``; pieces are numbered from 0, each within all limits, each exact
    substrings of the text that together cover all its words, consecutive ones sharing
    ``overlap_words`` words (half the piece at most). Time is shared out evenly over words.

    Rows within the limits give no pieces. A null or empty text over the time limit gives empty
    pieces that cut the time. Null, NaN or infinite times never count and pass through. Repeated
    rows (same id, text and times) come out once per distinct row; ids may be null. An empty
    table gives an empty table. Recorded counts in other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(start_col).cast("double").alias("s"), F.col(end_col).cast("double").alias("e"))
    big = rows.where(oversized(F.col("text"), F.col("s"), F.col("e"), limits)).withColumn("th", F.xxhash64("text", "s", "e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, texts, b, f, th = (c.to_pylist() for c in batch.slice(at, 500).columns)
                rec = []
                for i, ps in enumerate(split_batch(texts, b, f, limits)):
                    for k, (x, y, p0, p1, w) in enumerate(ps):
                        rec.append((ids[i], th[i], k, len(ps), (texts[i] or "")[x:y], x, y, p0, p1, w, round(w * limits.tokens_per_word)))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rec) if rec else [[]] * 11, _TYPES)], names=_NAMES)

    pieces = big.mapInArrow(run, _PIECES)
    return pieces.dropDuplicates(["id", "th", "piece"]).drop("th")


_NAMES = [x.split()[0] for x in _PIECES.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[x.split()[1]] for x in _PIECES.split(", ")]

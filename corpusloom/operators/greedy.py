"""Greedy spans over ordered rows, without one task per key.

A greedy rule walks the rows of a key in order and closes a span where it says so. Where a span starts
decides where it ends, so the walk is a chain of states. Keys are cut into blocks of ``BLOCK`` rows,
and a span that is open at the end of a block is a state of its own: what it has taken so far, in the
rule's few accumulators. A span may thus run over any number of blocks, and no block needs more
of its neighbours than the rows a new span repeats and the one row that follows.

Keys of one block are walked at once. For longer keys, every block gives the states in which it can be left; the
next block maps each of them to the state in which it is left itself (again and again for spans
longer than a block); these maps are composed pairwise, in rounds logarithmic in the blocks, which
gives the state in which each block is really entered. Then every block emits its rows.

Within a block, all places where a span might start are walked at once, in numpy.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import stable, written

#: Rows per block of a key; values of an order that are numbered together.
BLOCK, RANGE = 65_536, 10_000
#: Rows a task works on at once, in whole blocks.
SLAB = 131_072

Columns = dict[str, np.ndarray]


class Rule:
    """How a span grows. ``columns`` are the rows' columns it reads; ``overlap`` is the most rows at the end of a span
    that the next one repeats. All arguments are arrays, one entry per open span."""

    columns: tuple[str, ...] = ()
    overlap = 0

    def begin(self, c: Columns, i: np.ndarray, carry: np.ndarray) -> np.ndarray:
        """Accumulators of spans that take new rows from ``i`` on and repeat ``carry`` rows before it."""
        raise NotImplementedError

    def take(self, c: Columns, k: np.ndarray, acc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the span ends before row ``k``, it ends after it, new accumulators). ``c["last"]`` marks
        the last row of a key."""
        raise NotImplementedError


def offsets(counts: DataFrame, key: str, order: str, n: str, out: str = "before") -> DataFrame:
    """``counts`` with the sum of ``n`` over the rows of the key that come before by ``order``: sums per range
    of the order first, so that no key is sorted in one task."""
    r = counts.withColumn("_part", F.floor(F.col(order) / RANGE).cast("bigint"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = r.groupBy(key, "_part").agg(F.sum(n).alias("_sum"))
    parts = parts.select(key, "_part", F.coalesce(F.sum("_sum").over(before(Window.partitionBy(key).orderBy("_part"))), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum(n).over(before(Window.partitionBy(key, "_part").orderBy(order))), F.lit(0))
    return r.withColumn("_inner", inner).join(parts, [key, "_part"]).withColumn(out, (F.col("_inner") + F.col("_base")).cast("bigint")).drop("_part", "_base", "_inner")


def dense_positions(df: DataFrame, key: str, order: str, out: str = "pos") -> DataFrame:
    """Positions 0, 1, ... of the rows of each key by a numeric ``order``; rows without a key or an order are left out."""
    r = df.withColumn("_range", F.floor(F.col(order) / RANGE).cast("bigint"))
    off = offsets(r.groupBy(key, "_range").agg(F.count("*").alias("_n")), key, "_range", "_n", "_off").drop("_n")
    w = Window.partitionBy(key, "_range").orderBy(order)
    return r.withColumn("_i", F.row_number().over(w)).join(off, [key, "_range"]).withColumn(out, (F.col("_off") + F.col("_i") - 1).cast("bigint")).drop("_range", "_i", "_off")


def _feed(rule: Rule, c: Columns, k: np.ndarray, stop: np.ndarray, acc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Give rows from ``k`` on to open spans until each ends or reaches ``stop``: (end, still open, accumulators)."""
    end, left, kept = stop.copy(), np.ones(len(k), bool), acc.copy()
    live = np.arange(len(k))
    while len(live):
        before, after, acc = rule.take(c, k, acc)
        done = before | after
        end[live[done]] = k[done] + ~before[done]
        left[live[done]] = False
        live, k, acc = live[~done], k[~done] + 1, acc[~done]
        out = k >= stop[live]
        if out.any():
            kept[live[out]] = acc[out]
            live, k, acc = live[~out], k[~out], acc[~out]
    return end, left, kept


class _Blocks:
    """Whole blocks of rows in order, each with the rows before and the row after it that it may look at."""

    def __init__(self, rule: Rule, table: pa.Table, size: int):
        self.rule, self.table = rule, table
        self.pos, block = table.column("pos").to_numpy(), table.column("_block").to_numpy()
        code = table.column("_key").combine_chunks().dictionary_encode().indices.to_numpy()
        n = len(block)
        cut = np.flatnonzero((block[1:] != block[:-1]) | (code[1:] != code[:-1])) + 1
        self.first = np.concatenate(([0], cut)) if n else np.empty(0, np.int64)  # of each block, with what it looks at
        own = self.pos // size == block
        group = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, n)))
        self.block = block[self.first]
        self.lo = self.first + np.bincount(group[self.pos // size < block], minlength=len(self.first))
        self.hi = self.lo + np.bincount(group[own], minlength=len(self.first))
        self.ends_key = self.hi == np.append(self.first[1:], n)
        self.c = {x: table.column(x).to_numpy() for x in rule.columns}
        self.c["last"] = np.zeros(n, bool)
        self.c["last"][self.hi[self.ends_key] - 1] = True
        self.group = group
        rows = np.flatnonzero(own)
        self.end, self.open, self.acc = {}, {}, {}
        for carry in range(rule.overlap + 1):
            i = rows[rows - carry >= self.first[group[rows]]]
            acc = rule.begin(self.c, i, np.full(len(i), carry))
            end, left, kept = _feed(rule, self.c, i, self.hi[group[i]], acc)
            self.end[carry], self.open[carry] = np.full(n, -1), np.zeros(n, bool)
            self.end[carry][i], self.open[carry][i] = end, left
            self.acc[carry] = dict(zip(i[left].tolist(), kept[left]))

    def carry(self, start: int, carry: int, end: int) -> int:
        """Rows the next span repeats of one that took rows from ``start`` to ``end``."""
        return min(self.rule.overlap, end - (start - carry))

    def enter(self, g: int, entries: list[tuple[int, int, bytes | None]]) -> list[tuple[int, int, int, bool, np.ndarray | None]]:
        """For states (first, carry, accumulators or None for a span yet to begin) in which block ``g`` is entered: (row and
        carry of the first span that begins in it, end of the one before, that one is still open, its accumulators)."""
        lo, hi, base = int(self.lo[g]), int(self.hi[g]), int(self.pos[self.lo[g]])
        out: list = [(lo, c, lo, False, None) for _, c, s in entries]
        at = [j for j, e in enumerate(entries) if e[2] is not None]
        if at:
            acc = np.array([pickle.loads(entries[j][2]) for j in at])
            end, left, kept = _feed(self.rule, self.c, np.full(len(at), lo), np.full(len(at), hi), acc)
            for j, e, o, a in zip(at, end.tolist(), left.tolist(), kept):
                first, carry, _ = entries[j]
                out[j] = (e, min(self.rule.overlap, base + e - lo - (first - carry)), e, o, a)
        return out

    def leave(self, g: int, i: int, carry: int, memo: dict) -> tuple[int, int]:
        """(row, carry) of the last span of block ``g`` on the chain from a span that begins at row ``i``: one still
        open at its end, or one that begins right after it."""
        hi, path = int(self.hi[g]), []
        while i < hi and (i, carry) not in memo and not self.open[carry][i]:
            path.append((i, carry))
            e = int(self.end[carry][i])
            i, carry = e, self.carry(i, carry, e)
        to = memo.get((i, carry), (i, carry))
        for p in path:
            memo[p] = to
        return to

    def state(self, g: int, i: int, carry: int) -> tuple[int, int, bytes | None]:
        """The state to enter the next block with, by what :meth:`leave` gives."""
        first = int(self.pos[self.lo[g]]) + i - int(self.lo[g])
        return first, carry, pickle.dumps(self.acc[carry][i]) if i < self.hi[g] else None

    def emit(self, entries: dict[int, tuple[int, int, bytes | None]]) -> pa.Table:
        """The rows of the spans of each block in ``entries``, with the first new row of their span and, for the
        spans that begin here, their number within the block."""
        starts, carries, ends, firsts, numbers = [], [], [], [], []
        for g, entry in entries.items():
            lo, hi = int(self.lo[g]), int(self.hi[g])
            if lo == hi:
                continue  # nothing but rows that a next block would look at
            i, carry, e, still, _ = self.enter(g, [entry])[0]
            base = int(self.pos[lo]) - lo
            if e > lo:
                starts.append(lo), carries.append(0), ends.append(e), firsts.append(entry[0]), numbers.append(-1)
            k = 0
            while i < hi and not still:
                e = int(self.end[carry][i])
                starts.append(i), carries.append(carry), ends.append(e), firsts.append(base + i), numbers.append(k)
                i, carry, k = e, self.carry(i, carry, e), k + 1
        a, b = np.array(starts, np.int64) - np.array(carries, np.int64), np.array(ends, np.int64)
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        t = self.table.take(pa.array(at)).drop_columns(["_key", "_block"])
        return t.append_column("first", pa.array(np.repeat(np.array(firsts, np.int64), n))).append_column("_number", pa.array(np.repeat(np.array(numbers, np.int64), n)))


def greedy_spans(rows: DataFrame, key: str, rule: Rule, size: int = BLOCK) -> DataFrame:
    """The rows of each span, with ``first``, the position of its first new row, and ``span``, its number from 0 within the
    key. ``rows`` has ``key``, ``pos`` (0, 1, ... within the key) and the rule's columns; other
    columns are kept. Repeated rows at the start of a span come out with it too. Rows without a key
    are left out; a key of any length is spread over tasks. ``rows`` is read several times: pass a written table."""
    base = rows.where(F.col(key).isNotNull() & F.col("pos").isNotNull()).withColumn("_key", F.col(key).cast("string"))
    own = F.floor(F.col("pos") / size)
    seen = F.array(own)
    if rule.overlap:
        seen = F.when(F.col("pos") % size >= size - rule.overlap, F.array(own, own + 1)).otherwise(seen)
    seen = F.when(F.col("pos") % size == 0, F.array_append(seen, own - 1)).otherwise(seen)
    blocks = base.withColumn("_block", F.explode(seen)).where("_block >= 0")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = f"{fields}, first long, _number long"
    many = stable(base.where(F.col("pos") >= size).groupBy("_key").agg(F.max("pos").alias("top")))
    top = many.agg(F.max("top")).first()[0]
    if top is None:
        single, spans = blocks, None
    else:
        single = blocks.join(many, "_key", "left_anti")
        spans = _long_keys(blocks.join(many, "_key", "left_semi"), key, rule, size, out, top // size + 1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        have = 0

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, have
            t = pa.Table.from_batches(held)
            to = t.num_rows
            if not whole:
                k = t.column("_key").combine_chunks().dictionary_encode().indices.to_numpy()
                change = np.flatnonzero(k[1:] != k[:-1])
                to = int(change[-1]) + 1 if len(change) else 0
            if to:
                b = _Blocks(rule, t.slice(0, to), size)
                yield from b.emit({g: (0, 0, None) for g in range(len(b.first))}).to_batches()
            held = t.slice(to).to_batches()
            have = t.num_rows - to

        for batch in batches:
            held.append(batch)
            have += batch.num_rows
            if have >= SLAB:
                yield from flush(False)
        if have:
            yield from flush(True)

    got = single.repartition("_key").sortWithinPartitions("_key", "_block", "pos").mapInArrow(walk, out)
    if spans is None:
        return got.withColumnRenamed("_number", "span")
    return got.unionByName(spans).withColumnRenamed("_number", "span")


_STATE = "_key string, _block long, first long, carry int, acc binary"
_MAP = "_key string, _block long, first long, carry int, to_block long, to_first long, to_carry int, acc binary, through boolean"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(c, kinds[t]) for c, t in zip(cols, types)], names=list(names))


def _long_keys(blocks: DataFrame, key: str, rule: Rule, size: int, out: str, most: int) -> DataFrame:
    """Rows of the spans of keys of two to ``most`` blocks."""

    def load(t: pa.Table) -> _Blocks:
        return _Blocks(rule, t.sort_by("pos"), size)

    def states(t: pa.Table) -> pa.Table:
        """The states in which a block can be left: the first block's own, all of any other."""
        b = load(t)
        if b.ends_key[0] or b.lo[0] == b.hi[0]:
            return _table([], _STATE)
        key, block = t.column("_key")[0].as_py(), int(b.block[0])
        if block == 0:
            ways = {b.leave(0, int(b.lo[0]), 0, {})}
        else:
            memo: dict = {}
            ways = {b.leave(0, i, c, memo) for c in range(rule.overlap + 1) for i in range(int(b.lo[0]), int(b.hi[0])) if b.end[c][i] >= 0}
        return _table([(key, block + 1, *b.state(0, *w)) for w in ways], _STATE)

    def maps(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each state in which a block can be entered, and the state in which it is left then."""
        if not left.num_rows or not right.num_rows:
            return _table([], _MAP)
        b, memo, res = load(left), {}, []
        if b.ends_key[0]:
            return _table([], _MAP)
        entries = list(zip(*(right.column(c).to_pylist() for c in ("first", "carry", "acc"))))
        key, block = left.column("_key")[0].as_py(), int(b.block[0])
        for (first, carry, _), (i, c, _, still, acc) in zip(entries, b.enter(0, entries)):
            to = (first, carry, pickle.dumps(acc)) if still else b.state(0, *b.leave(0, i, c, memo))
            res.append((key, block, first, carry, block + 1, *to, still))
        return _table(res, _MAP)

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        b = load(left)
        if b.lo[0] == b.hi[0]:
            return b.emit({})
        if right.num_rows != 1:
            raise RuntimeError(f"{right.num_rows} states to enter block {b.block[0]} of key {left.column('_key')[0]}")
        (entry,) = zip(*(right.column(c).to_pylist() for c in ("first", "carry", "acc")))
        return b.emit({0: entry})

    group = ("_key", "_block")
    entries = stable(blocks.groupBy(*group).applyInArrow(states, _STATE))
    every, jumps, fresh = entries, None, entries
    while True:  # once, and again for every further block that a span runs through
        got = stable(blocks.groupBy(*group).cogroup(fresh.groupBy(*group)).applyInArrow(maps, _MAP))
        jumps = got if jumps is None else jumps.unionByName(got)
        fresh = got.where("through").select("_key", F.col("to_block").alias("_block"), F.col("to_first").alias("first"), F.col("to_carry").alias("carry"), "acc")
        if fresh.isEmpty():
            break
        every = every.unionByName(fresh)

    # from the state in which the second block is entered, by jumps of ..., 4, 2, 1 blocks
    on = ["_key", "_block", "first", "carry"]
    steps = [jumps.select(*on, "to_block", "to_first", "to_carry")]
    while 2 ** len(steps) < most - 1:
        a, b = steps[-1], steps[-1].toDF("_key", "to_block", "to_first", "to_carry", "b2", "f2", "c2")
        steps.append(stable(a.join(b, ["_key", "to_block", "to_first", "to_carry"]).select(*on, F.col("b2").alias("to_block"), F.col("f2").alias("to_first"), F.col("c2").alias("to_carry"))))
    real = entries.where("_block = 1").select(*on)
    for step in reversed(steps):
        real = real.unionByName(real.join(step, on).select("_key", F.col("to_block").alias("_block"), F.col("to_first").alias("first"), F.col("to_carry").alias("carry")))
        real = stable(real) if len(steps) > 3 else real
    real = real.join(every, ["_key", "_block", "first", "carry"])
    heads = entries.where("_block = 1").select("_key", F.lit(0).cast("long").alias("_block"), F.lit(0).cast("long").alias("first"), F.lit(0).alias("carry"), F.lit(None).cast("binary").alias("acc"))
    rows = written(blocks.groupBy(*group).cogroup(real.unionByName(heads).groupBy(*group)).applyInArrow(emit, out))

    # a span that entered its block from an earlier one is the last that began there
    home = F.floor(F.col("first") / size)
    begun = rows.where("_number >= 0").groupBy(key, home.alias("_home")).agg((F.max("_number") + 1).alias("_n"))
    begun = offsets(begun, key, "_home", "_n", "_off")
    number = F.col("_off") + F.when(F.col("_number") >= 0, F.col("_number")).otherwise(F.col("_n") - 1)
    return rows.withColumn("_home", home).join(begun, [key, "_home"]).withColumn("_number", number).drop("_home", "_off", "_n")

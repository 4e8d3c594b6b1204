"""Filling containers of a fixed capacity: first-fit decreasing in randomised groups.

Sizes are tokens of a public tokenizer whose file is a parameter. A text above the capacity is cut into full
containers and a rest; nothing else is cut. Items fall into groups of about ``group_items`` by a
hash of a row number given once and kept in the checkpoint, so no key or source can
gather in one group. Each group is packed on its own: items by falling size, each into the first container with room, found
by descending a tournament tree whose inner nodes hold the most room below them. Groups are of one size at
every scale; only the last containers of a group stay partly empty, so the loss is about one
container per group.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stable

GROUP_ITEMS = 20_000
_OUT = "container string, slot int, id string, piece int, first_token long, tokens int, offset int"


def default_tokenizer() -> str:
    """The installed byte-level vocabulary; any path of the same kinds may take its place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def token_counter(path: str) -> Callable[[str], int]:
    """Number of tokens of a text by the vocabulary at ``path`` (.tiktoken, .json or .model)."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda t: len(enc.encode_ordinary(t))
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda t: len(sp.encode(t, num_threads=1))


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item. Sizes must lie between 0 and the capacity."""
    n = len(sizes)
    leaves = 1
    while leaves < max(1, n):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    out = np.empty(n, np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        s, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < s:
                node += 1
        out[i] = node - leaves
        tree[node] -= s
        node //= 2
        while node:
            top = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == top:
                break
            tree[node] = top
            node //= 2
    return out


def token_sizes(df: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """``(id, tokens)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], names=["id", "tokens"])

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id string, tokens long")


def pack(sizes: DataFrame, capacity: int = 2048, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``(container, slot, id, piece, first_token, tokens, offset)`` for ``sizes(id, tokens)``.

    ``piece`` counts the cuts of an item above the capacity from 0, ``first_token`` is where the piece begins in the item,
    ``slot`` and ``offset`` its place in the container. Every row is placed, also repeated ones,
    null ids, and, in slots of no size, empty texts and null sizes. Equal sizes keep the order
    of their row numbers. An empty table gives an empty table. Other columns are ignored.
    """
    rows = stable(sizes.select("id", F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens")).withColumn("row", F.monotonically_increasing_id()))
    full = F.ceil(F.col("tokens") / capacity).cast("int")
    items = rows.select("row", "id", "tokens", F.explode(F.sequence(F.lit(0), F.greatest(full - 1, F.lit(0)))).alias("piece"))
    items = items.select("row", "id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece").cast("long") * capacity).alias("tokens"))
    # full pieces fill a container of their own and need no packing
    own = items.where(F.col("tokens") == capacity)
    alone = own.select(F.concat_ws(":", F.lit("full"), F.col("row"), F.col("piece")).alias("container"), F.lit(0).alias("slot"), "id", "piece", "first_token", F.col("tokens").cast("int").alias("tokens"), F.lit(0).alias("offset"))
    rest = items.where(F.col("tokens") < capacity)
    groups = max(1, round(rows.count() / group_items))
    rest = rest.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
        size = table.column("tokens").to_numpy()
        bins = first_fit_decreasing(size, capacity)
        order = np.lexsort((np.arange(len(size)), -size, bins))
        b, s = bins[order], size[order]
        first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        start = np.repeat(first, np.diff(np.append(first, len(b))))
        before = np.cumsum(s) - s
        t = table.take(pa.array(order))
        g = table.column("group")[0].as_py() if len(size) else 0
        return pa.table(
            {
                "container": pa.array([f"{g}:{x}" for x in b], pa.string()),
                "slot": pa.array((np.arange(len(b)) - start).astype(np.int32)),
                "id": t.column("id"),
                "piece": t.column("piece").cast(pa.int32()),
                "first_token": t.column("first_token").cast(pa.int64()),
                "tokens": pa.array(s.astype(np.int32)),
                "offset": pa.array((before - before[start]).astype(np.int32)),
            }
        )

    return rest.groupBy("group").applyInArrow(run, _OUT).unionByName(alone)


def pack_texts(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, tokenizer: str | None = None, group_items: int = GROUP_ITEMS) -> DataFrame:
    """:func:`pack` of texts, sized in tokens."""
    return pack(token_sizes(df, id_col, text_col, tokenizer or default_tokenizer()), capacity, group_items)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``(containers, tokens, fill)``: how much of all containers' room is used."""
    return packed.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count("*") * capacity)).alias("fill"))

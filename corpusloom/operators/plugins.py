"""Pluggable models as column functions, with deterministic stand-ins that need no model."""

from __future__ import annotations

import hashlib
import time
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corpusloom.functions import text as T
from corpusloom.operators.vectors import cosine

#: embed(texts) -> one vector per text.
Embed = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dim: int = 64) -> Embed:
    """Signed counts of hashed lower-case words: the stand-in for a model."""

    class Known(dict):
        """Place and sign of a word in one number."""

        def __missing__(self, w: str) -> int:
            h = hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()
            self[w] = code = 2 * (int(h[:2], 16) % dim) + (h[2] >= "8")
            return code

    def embed(texts: list[str]) -> list[list[float]]:
        known, codes, lens = Known(), array("q"), []
        for t in texts:
            ws = (t or "").lower().split()
            codes.extend(map(known.__getitem__, ws))
            lens.append(len(ws))
        code = np.frombuffer(codes, np.int64) if codes else np.empty(0, np.int64)
        cell = np.repeat(np.arange(len(texts)), lens) * dim + (code >> 1)
        return list(np.bincount(cell, np.where(code & 1, 1.0, -1.0), len(texts) * dim).astype(np.float32).reshape(len(texts), dim))

    return embed


def embedding(c: Column, embed: Embed) -> Column:
    """Vectors of a text column, in Arrow batches; the model is built once per task by ``embed``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(embed([x or "" for x in b]))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, ArrayType(FloatType()))(c)


#: complete(prompts) -> one text per prompt; may raise.
Complete = Callable[[list[str]], list[str]]


def call(c: Column, complete: Complete, retries: int = 3, wait: float = 5.0, batch: int = 32) -> Column:
    """``(text, tries, error)`` of a text model per row: rewriter, judge or answer model. A batch that fails is tried again,
    after ``wait`` seconds and twice as long each time; then its rows are tried one by one, and a row
    that still fails has a null text and the error's words."""

    def tried(prompts: list[str]) -> tuple[list[str | None], int, str | None]:
        for n in range(1, retries + 1):
            try:
                return complete(prompts), n, None
            except Exception as e:
                said = str(e)
                if n < retries:
                    time.sleep(wait * 2 ** (n - 1))
        return [None] * len(prompts), retries, said

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            prompts = [x or "" for x in b]
            for lo in range(0, len(prompts), batch):
                part = prompts[lo : lo + batch]
                texts, n, error = tried(part)
                if error is None or len(part) == 1:
                    out += [(t, n, error) for t in texts]
                else:
                    out += [(t, k, e) for p in part for (t,), k, e in [tried([p])]]
            yield pd.DataFrame(out, columns=["text", "tries", "error"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "text string, tries int, error string")(c)


def rewrites(query: Column, said: Column) -> Column:
    """``(q1, q2, malformed)`` of a rewriter's words: JSON with two texts, else the query and the query with a hint."""
    got = F.from_json(T.json_payload(said), "q1 string, q2 string")
    bad = got["q1"].isNull() | got["q2"].isNull()
    return F.struct(F.when(bad, query).otherwise(got["q1"]).alias("q1"), F.when(bad, F.concat(query, F.lit(" machine learning"))).otherwise(got["q2"]).alias("q2"), F.coalesce(bad, F.lit(True)).alias("malformed"))


def judged(said: Column) -> Column:
    """``(score, reason)`` of a judge's words: the score within 0 and 1 (0 if there is none), the reason up to 120 characters."""
    got = F.from_json(T.json_payload(said), "score double, reason string")
    return F.struct(T.clamp_score(F.coalesce(got["score"], F.lit(0.0))).alias("score"), F.left(F.coalesce(got["reason"], F.lit("")), F.lit(120)).alias("reason"))


def fallback_chain(providers: dict[str, Column]) -> Column:
    """``(value, provider, calls)``: the value of the first provider that gives one; ``calls`` are those that were asked."""
    names, cols = list(providers), list(providers.values())
    used = F.coalesce(*[F.when(c.isNotNull(), F.lit(i)) for i, c in enumerate(cols)])
    calls = F.slice(F.array(*[F.lit(n) for n in names]), 1, F.coalesce(used + 1, F.lit(len(names))))
    return F.struct(F.coalesce(*cols).alias("value"), F.get(F.array(*[F.lit(n) for n in names]), used).alias("provider"), calls.alias("calls"))


def provider_calls(rows: DataFrame, chain: str = "chain") -> DataFrame:
    """``(provider, calls, answered)``, with a row without a provider for rows that no provider answered."""
    asked = rows.select(F.explode(f"{chain}.calls").alias("provider"), F.col(f"{chain}.provider").alias("by"))
    each = asked.groupBy("provider").agg(F.count("*").alias("calls"), F.count_if(F.col("provider") == F.col("by")).alias("answered"))
    failed = rows.agg(F.lit(None).cast("string").alias("provider"), F.count_if(F.col(f"{chain}.provider").isNull()).alias("calls"), F.lit(0).cast("long").alias("answered"))
    return each.unionByName(failed)


def accepted_rewrite(query: Column, specific: Column) -> Column:
    """A generated query is kept if it is said to be specific and has five words or more."""
    return F.coalesce(specific, F.lit(False)) & (T.word_count(query) >= 5)


def accepted_pair(question: Column, answer: Column) -> Column:
    """A generated pair is kept from 10 characters of question and 20 of answer."""
    size = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    return (size(question) >= 10) & (size(answer) >= 20)


def coherence(chunks: DataFrame, id_col: str, text_col: str, embed: Embed, least_words: int = 30, bad: float = 0.40) -> DataFrame:
    """``(id, coherence, incoherent)``: cosine of the halves of each text of at least ``least_words`` words."""
    rows = chunks.where(T.word_count(F.col(text_col)) >= least_words).select(F.col(id_col).alias("id"), T.halves(F.col(text_col)).alias("h"))
    e = rows.select("id", embedding(F.col("h.first"), embed).alias("a"), embedding(F.col("h.second"), embed).alias("b"))
    return e.select("id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("coherence")).withColumn("incoherent", F.col("coherence") < bad)


def route_variants(original: DataFrame, expanded: DataFrame, rewrite: bool) -> DataFrame:
    """Hit lists of a request by variant: with rewriting the expanded query first, then the original."""
    tag = lambda df, name, place: df.withColumn("variant", F.lit(name)).withColumn("variant_ord", F.lit(place))
    return tag(expanded, "q2_expanded", 0).unionByName(tag(original, "original", 1)) if rewrite else tag(original, "original", 0)


def rerank_query(original: Column, literal: Column, expanded: Column) -> Column:
    """The query that reranking uses: expanded, else literal, else original."""
    full = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(full(expanded), full(literal), original)


def document_id(chunk: Column, video: Column, index: Column, line: Column) -> Column:
    """The chunk id, or one made of video and index, with a default for either."""
    made = F.format_string("%s:chunk:%s", F.coalesce(video, F.lit("unknown_video")), F.coalesce(index.cast("string"), line.cast("string")))
    return F.coalesce(F.when(chunk != "", chunk), made)

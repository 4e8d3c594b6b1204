"""Fusion of ranked lists, variants, reranking and cut-offs. Hit lists are (qid, doc, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import rules as R


def minmax(c: str, by: str = "qid") -> Column:
    """Scores of one list scaled to 0..1; equal scores become 0.5."""
    w = Window.partitionBy(by)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi - lo < 1e-8, F.lit(0.5)).otherwise((F.col(c) - lo) / (hi - lo))


def _both(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    a = lexical.select("qid", "doc", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"), minmax("score").alias("bm25_norm"))
    b = dense.select("qid", "doc", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"), minmax("score").alias("dense_norm"))
    return a.join(b, ["qid", "doc"], "full_outer")


def _ranked(df: DataFrame, k: int | None) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("final"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("dense_rank"), "doc")
    out = df.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


def fuse_weighted(lexical: DataFrame, dense: DataFrame, w_lexical: float, w_dense: float, k: int | None = 20) -> DataFrame:
    """Weighted sum of min-max scores; a side that lacks the document adds nothing."""
    if abs(w_lexical + w_dense - 1) > 0.01:
        raise ValueError("weights must sum to 1")
    parts = _both(lexical, dense).withColumn("bm25_contrib", F.coalesce("bm25_norm", F.lit(0.0)) * w_lexical).withColumn("dense_contrib", F.coalesce("dense_norm", F.lit(0.0)) * w_dense)
    return _ranked(parts.withColumn("final", F.round(F.col("bm25_contrib") + F.col("dense_contrib"), 6)), k)


def fuse_rrf(lexical: DataFrame, dense: DataFrame, k: int | None = 20, rrf_k: int = R.RRF_K, alpha: float | None = None) -> DataFrame:
    """Reciprocal ranks; with ``alpha`` the dense side weighs alpha and the other 1 - alpha."""
    wl, wd = (1.0, 1.0) if alpha is None else (1 - alpha, alpha)
    side = lambda c, w: F.coalesce(F.lit(w) / (rrf_k + F.col(c)), F.lit(0.0))
    parts = _both(lexical, dense).withColumn("bm25_contrib", side("bm25_rank", wl)).withColumn("dense_contrib", side("dense_rank", wd))
    return _ranked(parts.withColumn("final", F.round(F.col("bm25_contrib") + F.col("dense_contrib"), 9)), k)


def trace(fused: DataFrame) -> DataFrame:
    """Scores and contributions of both sides, to four places."""
    r = lambda c: F.round(c, 4).alias(c)
    return fused.select("qid", "doc", "rank", r("bm25_score"), "bm25_rank", r("bm25_contrib"), r("dense_score"), "dense_rank", r("dense_contrib"), r("final"))


def merge_variants(hits: DataFrame) -> DataFrame:
    """One row per (qid, doc) of ``hits(qid, variant, variant_ord, doc, score, rank)``: the first
    seen wins, and the labels of all variants that found it are kept in order."""
    first = F.struct("variant_ord", "rank")
    out = hits.groupBy("qid", "doc").agg(F.min(first).alias("first"), F.min_by("score", first).alias("score"), F.array_sort(F.collect_set(F.struct("variant_ord", "variant"))).alias("v"))
    w = Window.partitionBy("qid").orderBy("first", "doc")
    return out.select("qid", "doc", "score", F.transform("v", lambda x: x["variant"]).alias("retrieved_by"), F.row_number().over(w).alias("rank"))


def best_rank_merge(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Each document at its best rank over all variants; equals by first position."""
    out = hits.groupBy("qid", "doc").agg(F.min("rank").alias("best_rank"), F.min(F.struct("variant_ord", "rank")).alias("first"))
    w = Window.partitionBy("qid").orderBy("best_rank", "first", "doc")
    out = out.withColumn("rank", F.row_number().over(w)).drop("first")
    return out.where(F.col("rank") <= k) if k else out


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """Reorder by a scorer's column; equals keep their old order. Scores keep four places."""
    w = Window.partitionBy("qid").orderBy(F.desc("s"), "rank", "doc")
    return hits.withColumn("s", score).withColumn("new", F.row_number().over(w)).where(F.col("new") <= k).drop("rank", "score").withColumnRenamed("new", "rank").withColumn("score", F.round("s", 4)).drop("s")


def keep_courses(hits: DataFrame, courses: Column, k: int) -> DataFrame:
    """Filter after retrieval and before the cut, so fewer than k may remain."""
    kept = hits.where(courses)
    w = Window.partitionBy("qid").orderBy("rank")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)

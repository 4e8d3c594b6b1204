"""One hybrid retriever over persisted tables: postings, vectors and documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import fusion, lexical, vectors
from corpusloom.operators.plugins import Embed, embedding

#: score(query text, document text) -> a column
Scorer = Callable[[Column, Column], Column]


class Retriever:
    """Lexical and dense search, fusion, reranking and cuts, from DataFrame to DataFrame."""

    def __init__(self, postings: lexical.PostingsIndex, dense: DataFrame | Callable[[], DataFrame], documents: DataFrame, embed: Embed):
        self.postings, self._dense, self.documents, self.embed = postings, dense, documents, embed

    @property
    def dense(self) -> DataFrame:
        """Vectors by document, made when they are first asked for."""
        if not isinstance(self._dense, DataFrame):
            self._dense = self._dense()
        return self._dense

    @classmethod
    def build(cls, docs: DataFrame, path: str, embed: Embed) -> Retriever:
        """Index ``docs(doc, text, ...)`` and write it to ``path``, the other tables from the documents written first; the lexical
        totals come last, so that they mark an index that is whole. Vectors are added by the first search that needs them."""
        spark = docs.sparkSession
        docs.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", lexical.FILE_ROWS).parquet(f"{path}/documents")
        docs = spark.read.parquet(f"{path}/documents")
        lexical.PostingsIndex(docs, "doc", "text").write(f"{path}/lexical", stored=True)
        return cls.read(spark, path, embed)

    @classmethod
    def read(cls, spark: SparkSession, path: str, embed: Embed) -> Retriever:
        """The index at ``path``; a FileNotFoundError names what it lacks."""
        try:
            documents = spark.read.parquet(f"{path}/documents")
            return cls(lexical.PostingsIndex.read(spark, f"{path}/lexical", documents.select("doc", "text")), lambda: cls._vectors(documents, f"{path}/vectors", embed), documents, embed)
        except AnalysisException as e:
            raise FileNotFoundError(f"no whole index at {path}: {str(e)[:200]}") from e

    @staticmethod
    def _vectors(documents: DataFrame, path: str, embed: Embed) -> DataFrame:
        spark = documents.sparkSession
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            documents.select("doc", embedding(F.col("text"), embed).alias("vec")).write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)

    @classmethod
    def load_or_build(cls, spark: SparkSession, path: str, docs: Callable[[], DataFrame], embed: Embed) -> Retriever:
        try:
            return cls.read(spark, path, embed)
        except FileNotFoundError:
            return cls.build(docs(), path, embed)

    def lexical_hits(self, queries: DataFrame, k: int = 20, positive_only: bool = False) -> DataFrame:
        return lexical.search(None, "doc", "text", queries, k, positive_only=positive_only, index=self.postings)

    def dense_hits(self, queries: DataFrame, k: int = 20) -> DataFrame:
        q = queries.select("qid", embedding(F.col("text"), self.embed).alias("vec"))
        return vectors.search(self.dense, "doc", "vec", q, k)

    def fused(self, queries: DataFrame, k_retrieve: int = 20, k_final: int | None = 20, method: str = "weighted", weights: tuple[float, float] = (0.3, 0.7), alpha: float | None = None) -> DataFrame:
        lex, den = self.lexical_hits(queries, k_retrieve), self.dense_hits(queries, k_retrieve)
        if method == "weighted":
            return fusion.fuse_weighted(lex, den, *weights, k=k_final)
        return fusion.fuse_rrf(lex, den, k=k_final, alpha=alpha)

    def retrieve(self, queries: DataFrame, k_rerank: int = 3, scorer: Scorer | None = None, **options) -> DataFrame:
        """``(qid, doc, score, rank)`` of ``queries(qid, text)``: ``k_retrieve`` hits of each side, ``k_final`` fused, ``k_rerank``
        returned, in the scorer's order if there is one."""
        return self.reranked(self.fused(queries, **options).withColumn("score", F.round("final", 6)).select("qid", "doc", "score", "rank"), queries, k_rerank, scorer)

    def reranked(self, hits: DataFrame, queries: DataFrame, k: int, scorer: Scorer | None) -> DataFrame:
        """The first ``k`` of ``hits``, in the order of ``scorer`` for the texts of ``queries(qid, text)``."""
        if scorer is None:
            return hits.where(F.col("rank") <= k)
        texts = hits.join(self.documents.select("doc", F.col("text").alias("_text")), "doc").join(queries.select("qid", F.col("text").alias("_query")), "qid")
        return fusion.rerank(texts, scorer(F.coalesce("_query", F.lit("")), F.coalesce("_text", F.lit(""))), k).drop("_text", "_query")

    def routed(self, variants: DataFrame, k_rerank: int = 3, scorer: Scorer | None = None, english: str = "rrf", **options) -> DataFrame:
        """Hits of ``variants(qid, variant, variant_ord, text)``: ``original`` texts by weights 0.3 and 0.7, rewritten ones by
        reciprocal ranks (or ``english="weighted"``, by halves); merged by query, then reranked by the expanded
        text, else the literal one, else the original."""
        own = variants.withColumn("key", F.concat_ws("\x1f", "qid", "variant"))
        ask = lambda df: df.select(F.col("key").alias("qid"), "text")
        first, rest = own.where("variant = 'original'"), own.where("variant <> 'original'")
        way = {"method": "rrf"} if english == "rrf" else {"method": "weighted", "weights": (0.5, 0.5)}
        both = self.fused(ask(first), **options).unionByName(self.fused(ask(rest), **(way | options)))
        hits = both.select(F.col("qid").alias("key"), "doc", F.col("final").alias("score"), "rank").join(own.select("key", "qid", "variant", "variant_ord"), "key")
        merged = fusion.merge_variants(hits)
        order = reduce(lambda c, v: c.when(F.col("variant") == v[1], v[0]), enumerate(["q2_expanded", "q1_literal", "original"]), F.when(F.lit(False), 9))
        text = variants.where(F.trim("text") != "").groupBy("qid").agg(F.min_by("text", order).alias("text"))
        return self.reranked(merged, text, k_rerank, scorer)

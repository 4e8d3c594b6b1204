"""Queries over the tables of TESTDATA.md for the operators of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bin_packing import fill, pack_texts
from corpusloom.llm.language_id import fit_language_model, language_parts
from corpusloom.llm.leakage import leaked_items
from corpusloom.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from corpusloom.llm.pair_defects import pair_defects
from corpusloom.llm.split_items import split_oversized
from corpusloom.llm.text_quality import text_quality
from corpusloom.llm.vector_knn import similar_vectors


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_pieces(spark, sf).select(F.col("id").alias("chunk_id")).distinct()


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(_t(spark, sf, "transcript_v3"), "chunk_id", "chunk_text", "start_time", "end_time")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    asked = _t(spark, sf, "test_query").select(F.col("query_id").alias("pair_id"), "question", F.col("ground_truth").alias("answer"))
    answered = _t(spark, sf, "answer_eval").select(F.col("answer_id").alias("pair_id"), "question", "answer")
    return pair_defects(asked.unionByName(answered), "pair_id", "question", "answer")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    near = similar_vectors(_t(spark, sf, "chunk_vectors"), "chunk_id", "embedding", k=5, min_similarity=0.86)
    return near.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()


def p3_search(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar of all rows, for the rows whose hashed id is divisible by 100."""
    v = _t(spark, sf, "chunk_vectors")
    asked = v.where(F.pmod(F.xxhash64("chunk_id"), F.lit(100)) == 0).select("chunk_id")
    return similar_vectors(v, "chunk_id", "embedding", k=5, queries=asked, exhaustive=True)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    wrong = F.col("named").isNull() | (F.col("named") != F.col("lang"))
    return p4_parts(spark, sf).where(F.col("lang").isNotNull() & ((F.col("parts") > 1) | wrong)).select(F.col("id").alias("request_id"), "lang").distinct()


def p4_parts(spark: SparkSession, sf: str) -> DataFrame:
    asked = _t(spark, sf, "ask_request")
    model = fit_language_model(asked, "query", "lang_label", _t(spark, sf, "documents"))
    return language_parts(asked, "request_id", "query", "lang_label", model)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = near_duplicate_pairs(_t(spark, sf, "transcript_v3"), "chunk_id", "chunk_text", shingle=3, threshold=0.7)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The default of five words and 0.8; one row per chunk with its group and links."""
    return near_duplicate_groups(_t(spark, sf, "transcript_v3"), "chunk_id", "chunk_text").withColumnRenamed("id", "chunk_id")


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack_texts(_t(spark, sf, "documents"), "doc_id", "text", capacity=2048)


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill(p6_containers(spark, sf), capacity=2048)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_passages(spark, sf).select("doc_id", "item_id").distinct()


def p7_passages(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(_t(spark, sf, "documents"), _t(spark, sf, "eval_passages"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_statistics(spark, sf).where("kind <> 'prose'").select("doc_id", "kind").distinct()


def p8_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return text_quality(_t(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p3_found, p3_search, p4_found, p4_parts, p5_found, p5_groups, p6_containers, p6_fill, p7_found, p7_passages, p8_found, p8_statistics)}


def oracle_sql() -> dict[str, str]:
    words = r"len(regexp_extract_all(chunk_text, '[^\s]+'))"
    return {
        "p1_found": f"""SELECT DISTINCT chunk_id FROM transcript_v3
            WHERE round_even({words} * 1.3, 0) > 230 OR length(chunk_text) > 1500 OR end_time - start_time > 120""",
    }

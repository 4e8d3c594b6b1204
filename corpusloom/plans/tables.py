"""Views over the test tables that several queries share, in Spark and in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.plugins import hashing_embedder
from corpusloom.operators.retriever import Retriever
from corpusloom.session import checkpoint_dir


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks once each: a repeated delivery differs in its time of arrival alone."""
    return table(spark, sf, "transcript_v3").drop("embedding_text", "ingested_at").distinct()


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "answer_eval").drop("evaluated_at").distinct()


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """The query set of searches that list their hits: rows whose number is divisible by 100."""
    q = table(spark, sf, "test_query")
    return q.where(F.regexp_extract("query_id", r"(\d+)$", 1).cast("bigint") % 100 == 0)


def index(spark: SparkSession, sf: str) -> Retriever:
    """The retriever over the chunks of ``sf``: built by the first query of an application that needs it, and kept beside its checkpoints."""
    path = f"{checkpoint_dir(spark)}/index-{spark.sparkContext.applicationId}-{hashlib.md5(sf.encode(), usedforsecurity=False).hexdigest()[:12]}"
    docs = lambda: chunks(spark, sf).where("chunk_id is not null").withColumnsRenamed({"chunk_id": "doc", "chunk_text": "text"})
    return Retriever.load_or_build(spark, path, docs, hashing_embedder())


CHUNKS = """chunks AS (SELECT DISTINCT chunk_id, chunk_index, video_id, title, course, playlist_id, published_at, source, chunk_type,
    chunk_text, start_time, end_time, duration, word_count, token_estimate, url FROM transcript_v3)"""
ANSWERS = """answers AS (SELECT DISTINCT answer_id, run_id, query_id, question, ground_truth, answer, n_contexts, exact_match, string_presence,
    bleu, rouge_1, rouge_2, rouge_l, instruction_following, response_relevancy, groundedness, noise_sensitivity, answer_latency_ms, judge_calls FROM answer_eval)"""
#: All questions, as a table of its own.
EVERY = "questions AS (SELECT * FROM test_query)"
QUESTIONS = r"questions AS (SELECT * FROM test_query WHERE CAST(regexp_extract(query_id, '(\d+)$', 1) AS BIGINT) % 100 = 0)"
#: Words by white space, as an array.
WORDS = r"list_filter(string_split_regex({c}, '[\s\p{{Z}}]+'), lambda w: w <> '')"

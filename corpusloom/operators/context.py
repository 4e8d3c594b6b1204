"""Merged contexts, source cards and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def merge_context(hits: DataFrame, cleaned: bool = False) -> DataFrame:
    """Per query and video of ``hits(qid, pos, video_id, title, course, url, start_time, text)``: the texts in time
    order, cleaned unless they are ``cleaned`` already, blanks skipped; fields of the first hit; videos in order of first
    appearance. All rows of a query meet in one shuffle, which later grouping by query needs too."""
    rows = hits.repartition("qid").withColumn("video_id", F.coalesce("video_id", F.lit("unknown")))
    text = F.col("text") if cleaned else T.clean_context(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("start_time", F.lit(0.0)).alias("s"), "pos", text.alias("t"))))
    first = lambda c: F.min_by(F.struct(c), "pos")[c].alias(c)
    out = rows.groupBy("qid", "video_id").agg(first("title"), first("course"), first("url"), F.count("*").alias("chunks_used"), parts.alias("parts"), F.min("pos").alias("first_pos"))
    return out.select("qid", "video_id", "title", "course", "url", "chunks_used", F.array_join(F.filter(F.transform("parts", lambda x: x["t"]), lambda t: t != ""), " ").alias("context"), "first_pos")


def source_cards(hits: DataFrame) -> DataFrame:
    """Display fields of a hit list, with whole seconds and defaults; ``context_no`` is the number its video has in the prompt."""
    sec = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("int")
    s = F.coalesce("start_time", F.lit(0.0))
    url = F.when(F.coalesce(F.col("url"), F.lit("")) == "", T.video_url(F.col("video_id"), s)).otherwise(F.col("url"))
    return hits.select("qid", "rank", "doc", "video_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("course", F.lit("")).alias("course"), sec("start_time").alias("start_sec"), sec("end_time").alias("end_sec"), T.clock(s, hours=False).alias("timestamp"), url.alias("url"), T.thumbnail_url(F.col("video_id")).alias("thumbnail"), F.trim(F.coalesce("text", F.lit(""))).alias("text"))


def prompt(question: Column, contexts: Column, language: str = "vi") -> Column:
    """Numbered source blocks, then the question and the answer's language."""
    blocks = F.array_join(F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n\n")
    return F.concat_ws("\n\n", F.lit("Sources:"), blocks, F.concat(F.lit("Question: "), question), F.lit(f"Answer in language: {language}. Cite sources as [n]."))

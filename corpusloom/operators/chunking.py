"""Segments, greedy packing and adjacent merging of transcript text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import rules as R
from corpusloom.functions import text as T
from corpusloom.operators.greedy import Rule, dense_positions, greedy_spans, offsets
from corpusloom.session import written


def _ms(seconds: Column) -> Column:
    """Whole milliseconds, in plain arithmetic so that every engine rounds alike."""
    return F.floor(seconds * 1000 + 0.5) / 1000


def sentence_segments(chunks: DataFrame, min_chars: int = 20, merge: bool = True) -> DataFrame:
    """``(video_id, pos, text, start, duration, end)``: sentences of each chunk, short ones
    merged, with the chunk's time shared out by length. Chunks without a video or an index are left out."""
    s = T.split_sentences(F.coalesce("chunk_text", F.lit("")))
    if merge:
        s = merge_short(s, min_chars)
    c = chunks.select("video_id", "chunk_index", "start_time", (F.col("end_time") - F.col("start_time")).alias("d"), s.alias("s"))
    c = offsets(c.withColumn("n", F.size("s")), "video_id", "chunk_index", "n").withColumn("total", F.length(F.array_join("s", "")))
    c = c.select("*", F.posexplode("s").alias("i", "text"))
    before = F.length(F.array_join(F.slice("s", F.lit(1), F.col("i")), ""))
    start = _ms(F.col("start_time") + F.col("d") * before / F.col("total"))
    length = _ms(F.col("d") * F.length("text") / F.col("total"))
    rows = c.select("video_id", (F.col("before") + F.col("i")).alias("pos"), "text", start.alias("start"), length.alias("duration"))
    return rows.withColumn("end", _ms(F.col("start") + F.col("duration")))


def merge_short(sentences, min_chars: int = 20):
    """Adjacent sentences joined where the previous ends weakly (",", "and", "or", "but", without a
    word boundary) or either side is short."""
    none = F.array().cast("array<string>")

    def step(acc, x):
        last = F.element_at(acc, -1)
        join = last.endswith(",") | last.endswith("and") | last.endswith("or") | last.endswith("but") | (F.length(x) < min_chars) | (F.length(last) < min_chars)
        merged = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.concat(last, F.lit(" "), x))
        return F.when(F.size(acc) == 0, F.array(x)).when(join, merged).otherwise(F.array_append(acc, x))

    return F.aggregate(sentences, none, step)


def _collect(spans: DataFrame, key: str) -> DataFrame:
    """Texts and bounds of spans."""
    got = spans.groupBy(key, "span").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("m"), F.min("start").alias("start_time"), F.max_by("end", "pos").alias("end_time"), F.count("*").alias("segments"))
    return got.withColumn("raw_text", F.array_join(F.transform("m", lambda x: x["text"]), " ")).drop("m")


def _kept(rows: DataFrame, condition: str) -> DataFrame:
    """A written table of the rows that meet a condition, with positions anew if any does not."""
    rows = written(rows)
    if rows.where(f"not ({condition})").isEmpty():
        return rows
    return written(dense_positions(rows.where(condition).withColumnRenamed("pos", "ord"), "video_id", "ord").drop("ord"))


class _PackV3(Rule):
    columns = ("tokens", "complete", "start", "end")

    def __init__(self, gap: float):
        self.gap = gap

    def begin(self, c, i, carry):
        return np.stack([np.zeros(len(i)), c["start"][i]], axis=1)

    def take(self, c, k, acc):
        tok, took = acc[:, 0] + c["tokens"][k], c["end"][k] - acc[:, 1]
        pause = np.where(c["last"][k], -np.inf, c["start"][np.minimum(k + 1, len(c["start"]) - 1)] - c["end"][k])
        enough = tok >= R.V3_MIN_TOKENS
        close = enough & c["complete"][k] | (tok >= R.V3_HARD_TOKENS) | (took >= R.V3_MAX_SECONDS) | enough & (took >= R.V3_MIN_SECONDS) & (pause > self.gap)
        return np.zeros(len(k), bool), close, np.stack([tok, acc[:, 1]], axis=1)


class _PackV2(Rule):
    columns = ("words", "tokens", "start", "end")
    overlap = R.V2_OVERLAP

    def begin(self, c, i, carry):
        sums = [np.concatenate(([0], np.cumsum(c[x]))) for x in ("words", "tokens")]
        return np.stack([*(s[i] - s[i - carry] for s in sums), c["start"][i - carry]], axis=1).astype(np.float64)

    def take(self, c, k, acc):
        w, t, took = acc[:, 0] + c["words"][k], acc[:, 1] + c["tokens"][k], c["end"][k] - acc[:, 2]
        pause = np.where(c["last"][k], -np.inf, c["start"][np.minimum(k + 1, len(c["start"]) - 1)] - c["end"][k])
        close = (w >= R.V2_WORDS) | (t >= R.V2_TOKENS) | (w >= R.V2_MIN_WORDS) & ((took >= R.V2_SECONDS) | (pause > R.V2_GAP))
        return np.zeros(len(k), bool), close, np.stack([w, t, acc[:, 2]], axis=1)


class _PackV1(Rule):
    columns = ("words", "start", "end")

    def begin(self, c, i, carry):
        return np.stack([np.zeros(len(i)), c["start"][i]], axis=1)

    def take(self, c, k, acc):
        w = acc[:, 0] + c["words"][k]
        close = (c["end"][k] - acc[:, 1] >= R.V1_SECONDS) | (w >= 2 * R.V1_MIN_WORDS)
        return np.zeros(len(k), bool), close, np.stack([w, acc[:, 1]], axis=1)


class _MergeEmbedding(Rule):
    columns = ("tokens", "sim", "start", "end")

    def __init__(self, threshold: float):
        self.threshold = threshold

    def begin(self, c, i, carry):
        return np.stack([np.zeros(len(i)), c["start"][i], np.zeros(len(i))], axis=1)

    def take(self, c, k, acc):
        t = acc[:, 0] + c["tokens"][k]
        joins = (c["sim"][k] >= self.threshold) & (t <= R.MERGE_TOKENS) & (c["end"][k] - acc[:, 1] <= R.MERGE_SECONDS)
        refuse = (acc[:, 2] > 0) & ~joins
        return refuse, np.zeros(len(k), bool), np.stack([t, acc[:, 1], acc[:, 2] + 1], axis=1)


class _MergeLexical(Rule):
    """A span holds its content words, so its accumulators are objects: (words, start, content,
    whether it ends with a colon) or None before the first row."""

    columns = ("words", "content", "cont", "shift", "colon", "start", "end")

    def begin(self, c, i, carry):
        return np.full(len(i), None, object)

    def take(self, c, k, acc):
        refuse, out = np.zeros(len(k), bool), np.full(len(k), None, object)
        for j, (at, held) in enumerate(zip(k.tolist(), acc)):
            nw, nxt = int(c["words"][at]), frozenset(c["content"][at])
            if held is None:
                out[j] = (nw, c["start"][at], nxt, c["colon"][at])
                continue
            w, begin, seen, colon = held
            overlap = len(seen & nxt) / len(seen | nxt) if seen and nxt else 0.0
            short = w < R.V2_MIN_WORDS or nw < max(20, R.V2_MIN_WORDS // 2)
            too_long = c["end"][at] - begin > R.LEXICAL_SECONDS or w + nw > R.LEXICAL_WORDS
            refuse[j] = too_long or (c["shift"][at] and w >= R.V2_MIN_WORDS) or not (short or c["cont"][at] or overlap >= R.LEXICAL_OVERLAP or colon)
            out[j] = (w + nw, begin, seen | nxt, c["colon"][at])
        return refuse, np.zeros(len(k), bool), out


def pack_v3(segments: DataFrame, gap: float = R.V3_GAP) -> DataFrame:
    """Close at a sentence end from 150 tokens, at 220 tokens, at 90 s, at a pause over 3 s from
    150 tokens and 20 s, and at the end; the rules are tried in that order and the first that applies
    decides. The last segment of a video always closes."""
    rows = segments.withColumn("tokens", T.token_estimate(F.col("text"))).withColumn("complete", T.is_complete(F.col("text")))
    out = _collect(greedy_spans(_kept(rows, "tokens > 0"), "video_id", _PackV3(gap)), "video_id")
    out = out.withColumn("token_count", T.token_estimate(F.col("raw_text")))
    return out.withColumn("chunk_type", F.when(F.col("token_count") >= R.V3_MIN_TOKENS, "knowledge_unit").otherwise("tail_short"))


def pack_v2(segments: DataFrame) -> DataFrame:
    """Close at 160 words, 180 tokens, 90 s from 50 words, a pause over 8 s from 50 words and the end;
    the next chunk begins with the last two segments."""
    rows = segments.withColumn("text", T.normalize_text(F.col("text"))).withColumn("words", T.word_count(F.col("text"))).withColumn("tokens", T.token_estimate(F.col("text"), least=1))
    out = _collect(greedy_spans(_kept(rows, "text <> ''"), "video_id", _PackV2()), "video_id").withColumn("chunk_text", T.normalize_text(F.col("raw_text")))
    out = out.withColumn("word_count", T.word_count(F.col("chunk_text"))).withColumn("token_estimate", T.token_estimate(F.col("chunk_text"), least=1))
    return out.withColumn("chunk_id", T.chunk_id(F.col("video_id"), "time", "v2", F.col("span"), F.col("start_time"), F.col("end_time")))


def pack_v1(segments: DataFrame) -> DataFrame:
    """Close at 30 s or 20 words; keep chunks of at least 10 words once fillers are gone."""
    rows = segments.withColumn("text", T.clean_v1(F.col("text"))).withColumn("words", T.word_count(F.col("text")))
    out = _collect(greedy_spans(_kept(rows, "words > 0"), "video_id", _PackV1()), "video_id").withColumn("text", T.clean_v1(T.remove_fillers(F.col("raw_text"))))
    return out.where(T.word_count(F.col("text")) >= R.V1_MIN_WORDS)


def merge_lexical(chunks: DataFrame) -> DataFrame:
    """Join a chunk with the next unless the whole passes 120 s or 250 words or the topic shifts after 50
    words; else if either is short, the next continues, their content words overlap, or it ends with a colon."""
    cont, shift = T.starts_with_any(F.col("text"), R.CONTINUATIONS), T.starts_with_any(F.col("text"), R.TOPIC_SHIFTS)
    rows = chunks.withColumn("words", T.word_count(F.col("text"))).withColumn("content", T.content_words(F.col("text"))).withColumn("cont", cont).withColumn("shift", shift).withColumn("colon", F.col("text").rlike(r":\s*$"))
    return _collect(greedy_spans(written(rows), "video_id", _MergeLexical()), "video_id")


def merge_embedding(chunks: DataFrame, threshold: float = R.MERGE_THRESHOLD) -> DataFrame:
    """Join a chunk with the next if their vectors are similar and the whole stays within 230
    tokens and 120 s. ``chunks`` has ``sim``, the similarity with the chunk before."""
    return _collect(greedy_spans(written(chunks), "video_id", _MergeEmbedding(threshold)), "video_id")

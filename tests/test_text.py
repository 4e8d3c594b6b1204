"""Golden rows and brute force for the column functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import language as L
from corpusloom.functions import rules as R
from corpusloom.functions import text as T


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(col).first()[0]


@pytest.mark.parametrize(
    "f, text, want",
    [
        (T.clean_segment, "um so the [Applause] answer  is here", "the answer is here"),
        (T.clean_segment, "the transformer", "the transform"),
        (T.clean_segment, "00:01 --> 00:05 hello <c>there</c> ,, friend", "hello there, friend"),
        (T.clean_segment, "we, you know, test it", "we,, test it".replace(",,", ",")),
        (T.clean_chunk, "im sure dont stop", "I'm sure don't stop"),
        (T.clean_chunk, "it is like basically fine", "It is fine"),
        (T.clean_context, "the the cat sat okay", "the cat sat"),
        (T.clean_v1, "[MUSIC] hello [x] there -", "hello there"),
        (T.remove_fillers, "so, this is like fine", "this is fine"),
        (T.clean_embedding, "well this is just one. two", "This is one. Two."),
        (T.normalize_text, " hello ,  world !! ", "Hello, world"),
        (T.normalize_space, " a \n b ", "a b"),
        (T.strip_citations, "A [1] b [2]", "A  b"),
        (T.json_payload, '```json\n{"a": 1}\n```', '{"a": 1}'),
        (T.conversation_title, "one two three four five six seven", "one two three four five six..."),
        (T.playlist_id, "https://x/playlist?list=AB&t=1", "AB"),
        (T.extract_topic, "Course I Deep Nets Winter 2021", "Deep Nets"),
        (T.extract_topic, "NLP V3 Parsing", "Parsing"),
        (T.citation_confidence, "A [1] B [2] C [1]", "high"),
        (T.error_class, "HTTP 429 Too Many Requests", "blocked"),
    ],
)
def test_golden(spark, f, text, want):
    assert one(spark, f(F.col("t")), t=text) == want


def test_times_and_ids(spark):
    assert one(spark, T.clock(F.col("s"), False), s=65.2) == "01:05"
    assert one(spark, T.clock(F.col("s"), True), s=3725.0) == "01:02:05"
    assert one(spark, T.clock(F.col("s")), s=5.9) == "00:00:05"
    assert one(spark, T.video_url(F.col("v"), F.col("s")), v="abc", s=42.0) == "https://youtu.be/abc?t=42"
    assert one(spark, T.chunk_id(F.col("v"), "time", "v2", F.lit(7), F.lit(1.5), F.lit(2.0)), v="abc") == "abc:time:v2:0007:0000001500:0000002000"


def test_counts(spark):
    assert one(spark, T.token_estimate(F.col("t")), t="a b c d e") == 6
    assert one(spark, T.citations(F.col("t")), t="A [1] B [2] C [1]") == [1, 2]
    assert one(spark, T.split_sentences(F.col("t")), t="One two. Ab? 1Three four! x") == ["One two.", "1Three four!"]
    assert one(spark, T.halves(F.col("t")), t="a b c d").asDict() == {"first": "a b", "second": "c d"}
    assert one(spark, T.jaccard(T.content_words(F.col("a")), T.content_words(F.col("b"))), a="gradient descent", b="gradient ascent") == pytest.approx(1 / 3)


def test_keywords_and_topic(spark):
    t = "The transformer uses self-attention and attention with a learning rate"
    assert one(spark, T.keywords(F.col("t")), t=t) == ["self-attention", "learning rate", "transformer"]
    assert one(spark, T.topic(F.col("t")), t=t) == "Transformer/Attention"
    assert one(spark, T.topic(F.col("t")), t="nothing here") == "General AI/ML"


def test_embedding_text_budget(spark):
    long = "gradient policy reward agent softmax tensor " + "w " * 200
    e = one(spark, T.embedding_text(F.lit("C"), F.lit("T"), F.col("t"), F.lit(0.0), F.lit(9.0)), t=long)
    assert e.startswith("Course: C\nLecture: T\nTime: 00:00 - 00:09\nTopic: ")
    assert "Vietnamese" not in e and e.split("Keywords: ")[1].split("\n")[0].count(",") == 2
    short = one(spark, T.embedding_text(F.lit(None), F.lit("T"), F.col("t"), F.lit(0.0), F.lit(9.0)), t="a gradient")
    assert short == "Course: Unknown\nLecture: T\nTime: 00:00 - 00:09\nTopic: Training/Optimization\nKeywords: gradient\nKeywords (Vietnamese): dao ham\n\nContent:\na gradient"


@pytest.mark.parametrize(
    "text, lang, conf",
    [("transformer laf gifs", "vi", 0.95), ("em la ai", "vi", 0.95), ("BERT vs GPT", "en", 0.6), ("học máy là gì", "vi", 0.98), ("how does the encoder work", "en", 0.95)],
)
def test_language(spark, text, lang, conf):
    r = one(spark, L.detect(F.col("t")), t=text)
    assert (r["language"], r["confidence"]) == (lang, conf)


def test_nulls(spark):
    for f in (T.clean_segment, T.clean_chunk, T.clean_context, T.clean_embedding, T.normalize_text, T.normalize_space):
        assert spark.range(1).select(f(F.lit(None).cast("string"))).first()[0] == ""


def test_contains_word_agrees_with_lookaround(spark):
    for t in ("a token.", "tokens", "x-token", "tokén token_", "token"):
        assert one(spark, T.contains_word(F.col("t"), "token"), t=t) == bool(re.search(r"(?<!\w)token(?!\w)", t))


def test_context_cleaning_is_that_of_a_boundary_before_each_filler(spark):
    rng = random.Random(5)
    bits = [*R.CONTEXT_FILLERS, "UM", "uh.", "um,", "number", "Right", "you", "know", "you  know", "kind", "of", "the", "the", "thé", "the\u0301", "ok\u0131ay", "a\u017fort of", "actuall\u0443", "uh\u0301", "_um", "um_", "x", "1 1", "\n", "-", "\u200d"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", " ", "  "]) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace("t", r"\n", " ")
    for f in R.CONTEXT_FILLERS:
        plain = F.regexp_replace(plain, rf"(?iU)\b{f}\b", "")
    plain = T.normalize_space(F.regexp_replace(plain, r"(?U)\b(\w+)( \1\b)+", "$1"))
    got = df.select("t", T.clean_context(F.col("t")).alias("a"), plain.alias("b"))
    assert got.where("a <> t").count() > 1000 and got.where("not a <=> b").collect() == []

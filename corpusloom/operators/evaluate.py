"""Rank metrics and rule-based answer metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import rules as R
from corpusloom.functions import text as T
from corpusloom.operators.vectors import cosine


def rank_metrics(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row per judged query: hit, precision, recall, average precision, reciprocal rank and
    nDCG at each k. ``hits(qid, doc, rank)``, ``relevant(qid, doc, gain)``; gains above 0 count."""
    ks = tuple(sorted(set(ks)))
    rel = relevant.where("gain > 0").groupBy("qid", "doc").agg(F.max("gain").alias("gain"))
    ideal = Window.partitionBy("qid").orderBy(F.desc("gain"), "doc")
    dcg = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    best = rel.withColumn("r", F.row_number().over(ideal))
    totals = best.groupBy("qid").agg(F.count("*").alias("total"), *[F.sum(F.when(F.col("r") <= k, dcg(F.col("gain"), F.col("r")))).alias(f"ideal_{k}") for k in ks])
    found = hits.select("qid", "doc", "rank").join(rel, ["qid", "doc"])
    run = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("hits", F.count("*").over(run))
    at = lambda k, e: F.coalesce(F.sum(F.when(F.col("rank") <= k, e)), F.lit(0.0))
    got = found.groupBy("qid").agg(F.min("rank").alias("first"), *[x for k in ks for x in (at(k, F.lit(1.0)).alias(f"n_{k}"), at(k, F.col("hits") / F.col("rank")).alias(f"ap_{k}"), at(k, dcg(F.col("gain"), F.col("rank"))).alias(f"dcg_{k}"))])
    j = totals.join(got, "qid", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = [F.col("qid")]
    for k in ks:
        out += [
            (z(f"n_{k}") > 0).cast("double").alias(f"hit_{k}"), F.round(z(f"n_{k}") / k, 6).alias(f"precision_{k}"), F.round(z(f"n_{k}") / F.col("total"), 6).alias(f"recall_{k}"),
            F.round(z(f"ap_{k}") / F.least(F.col("total"), F.lit(k)), 6).alias(f"ap_{k}"), F.round(z(f"dcg_{k}") / F.col(f"ideal_{k}"), 6).alias(f"ndcg_{k}"),
            F.when(F.col("first") <= k, F.round(1 / F.col("first"), 6)).otherwise(F.lit(0.0)).alias(f"rr_{k}"),
        ]
    return j.select(*out)


def single_source(hits: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Metrics of queries with one right document, one row per query of ``truth(qid, doc)`` (and of ``by``, columns of it):
    rank, hits at 1, 3, 5, 6, 10, 20, precision at 1, 3, 5, 10, reciprocal rank (also within 3), average
    precision, nDCG at 3, 5, 10, 20, and whether it was missed. A rank may lie beyond 20."""
    keep = [c for c in by or [] if c != "qid"]
    got = truth.select("qid", "doc", *keep).join(hits.groupBy("qid", "doc").agg(F.min("rank").alias("rank")), ["qid", "doc"], "left")
    r = F.col("rank")
    within = lambda k, v: F.coalesce(F.when(r <= k, v), F.lit(0.0))
    every = F.round(F.coalesce(1 / r, F.lit(0.0)), 6)
    return got.select(
        "qid", *keep, "rank",
        *[within(k, F.lit(1.0)).alias(f"hit_{k}") for k in (1, 3, 5, 6, 10, 20)],
        *[F.round(within(k, F.lit(1.0 / k)), 6).alias(f"precision_{k}") for k in (1, 3, 5, 10)],
        every.alias("rr"), F.round(within(3, 1 / r), 6).alias("rr_3"), every.alias("ap"),
        *[F.round(within(k, 1 / F.log2(r + 1)), 6).alias(f"ndcg_{k}") for k in (3, 5, 10, 20)],
        r.isNull().cast("double").alias("miss"),
    )


def semantic(hits: DataFrame, queries: DataFrame, documents: DataFrame, sources: DataFrame, relevant: float = 0.5, recalled: float = 0.7) -> DataFrame:
    """Per query of ``queries(qid, vec)``: the largest and mean cosine of its hits, the share of at least ``relevant``, and
    whether a hit is as similar as ``recalled`` to its source (``sources(qid, vec)``); all 0 without hits."""
    h = hits.select("qid", "doc").join(documents.select("doc", F.col("vec").alias("d")), "doc").join(queries.select("qid", F.col("vec").alias("q")), "qid").join(sources.select("qid", F.col("vec").alias("s")), "qid", "left")
    h = h.select("qid", F.coalesce(cosine(F.col("q"), F.col("d")), F.lit(0.0)).alias("c"), F.coalesce(cosine(F.col("s"), F.col("d")), F.lit(0.0)).alias("t"))
    got = h.groupBy("qid").agg(F.max("c").alias("max_sim"), F.avg("c").alias("mean_sim"), F.avg((F.col("c") >= relevant).cast("double")).alias("semantic_precision"), F.max((F.col("t") >= recalled).cast("double")).alias("semantic_recall"))
    return queries.select("qid").join(got, "qid", "left").select("qid", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in got.columns if c != "qid"])


def means(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of all numeric columns, overall and per group in one pass (null group: overall)."""
    cols = [c for c, t in metrics.dtypes if t in ("double", "float", "int", "bigint") and c not in (by or [])]
    aggs = [F.count("*").alias("queries"), *[F.round(F.avg(c) + 1e-12, 6).alias(c) for c in cols]]  # ties round up whatever the order of the sum
    return metrics.rollup(*by).agg(*aggs) if by else metrics.agg(*aggs)


def context_precision(judged: DataFrame) -> DataFrame:
    """Per query of ``judged(qid, rank, useful, relevant_sentences, total_sentences)``: the mean precision at
    useful ranks over the number useful, and the mean share of relevant sentences."""
    run = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    j = judged.withColumn("u", F.col("useful").cast("int")).withColumn("hits", F.sum("u").over(run))
    share = F.least(F.lit(1.0), F.col("relevant_sentences") / F.greatest(F.lit(1), F.col("total_sentences")))
    p = F.when(F.sum("u") > 0, F.sum(F.when(F.col("u") == 1, F.col("hits") / F.col("rank"))) / F.sum("u")).otherwise(F.lit(0.0))
    return j.groupBy("qid").agg(F.round(p, 6).alias("context_precision"), F.round(F.avg(share), 6).alias("context_relevancy"))


def claim_support(claims: DataFrame) -> DataFrame:
    """Share of supported claims of ``claims(qid, claims array<struct<text, supported>>)``; 0 for none."""
    n = F.size("claims")
    return claims.select("qid", F.when(n > 0, F.round(F.size(F.filter("claims", lambda c: c["supported"])) / n, 6)).otherwise(F.lit(0.0)).alias("supported"))


def entity_recall(entities: Column, context: Column) -> Column:
    low = F.lower(context)
    return F.when(F.size(entities) > 0, F.size(F.filter(entities, lambda e: F.contains(low, F.lower(e)))) / F.size(entities)).otherwise(F.lit(0.0))


def exact_match(answer: Column, truth: Column) -> Column:
    norm = lambda c: F.lower(F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\r\n")))
    return (norm(answer) == norm(truth)).cast("double")


def string_presence(answer: Column, truth: Column) -> Column:
    """Share of the truth's distinct content words found anywhere in the answer."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    ws = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(truth, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*dict.fromkeys(R.ANSWER_STOPWORDS))))
    return T.let(ws, lambda a: F.when(F.size(a) > 0, F.size(F.filter(a, lambda w: F.contains(low, w))) / F.size(a)).otherwise(F.lit(0.0)))


def _grams(ws: Column, n: int) -> Column:
    last = F.size(ws) - (n - 1)
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " ")))


def _clipped(a: Column, b: Column) -> Column:
    """Matches of the grams of a in b, each counted at most as often as b has it."""
    count = lambda xs, g: F.size(F.filter(xs, lambda y: y == g))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, g: s + F.least(count(a, g), count(b, g)))


def bleu(answer: Column, truth: Column) -> Column:
    """Sentence BLEU of up to four words; a precision of 0 becomes 0.1 over its count."""

    def of(x: Column) -> Column:
        h, r = x["h"], x["r"]
        logs = F.lit(0.0)
        for n in (1, 2, 3, 4):
            m = T.let(F.struct(_grams(h, n).alias("a"), _grams(r, n).alias("b")), lambda g: F.struct(_clipped(g["a"], g["b"]).alias("m"), F.greatest(F.lit(1), F.size(g["a"])).alias("d")))
            logs = logs + T.let(m, lambda g: F.log(F.when(g["m"] > 0, g["m"].cast("double")).otherwise(F.lit(0.1)) / g["d"])) / 4
        first = _clipped(h, r)
        brevity = F.when(F.size(h) > F.size(r), F.lit(1.0)).otherwise(F.exp(1 - F.size(r) / F.size(h)))
        return F.when((F.size(h) == 0) | (F.size(r) == 0) | (first == 0), F.lit(0.0)).otherwise(brevity * F.exp(logs))

    ws = lambda c: T.words(F.lower(F.coalesce(c, F.lit(""))))
    return T.let(F.struct(ws(answer).alias("h"), ws(truth).alias("r")), of)


def rouge_n(answer: Column, truth: Column, n: int) -> Column:
    """F-score over distinct n-grams of white-space words."""

    def of(x: Column) -> Column:
        a, b = F.array_distinct(_grams(x["a"], n)), F.array_distinct(_grams(x["b"], n))
        return T.let(F.struct(F.size(F.array_intersect(a, b)).alias("m"), F.size(a).alias("p"), F.size(b).alias("q")), lambda c: F.when((c["m"] == 0), F.lit(0.0)).otherwise(2.0 * c["m"] / (c["p"] + c["q"])))

    ws = lambda c: T.words(F.coalesce(c, F.lit("")))
    return T.let(F.struct(ws(answer).alias("a"), ws(truth).alias("b")), of)


def rouge_l(df: DataFrame, key: str, answer: str, truth: str) -> DataFrame:
    """``(key, rouge_l)``: F-score of the longest common subsequence of words (bit-parallel)."""

    def length(a: list[str], b: list[str]) -> int:
        at: dict[str, int] = {}
        for i, w in enumerate(a):
            at[w] = at.get(w, 0) | 1 << i
        full = row = (1 << len(a)) - 1
        for w in b:
            m = row & at.get(w, 0)
            row = ((row + m) | (row - m)) & full
        return len(a) - row.bit_count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                p, q = (x or "").split(), (y or "").split()
                out.append(2 * length(p, q) / (len(p) + len(q)) if p and q else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([round(v, 6) for v in out], pa.float64())], names=[key, "rouge_l"])

    return df.select(F.col(key).cast("string").alias(key), answer, truth).mapInArrow(run, f"{key} string, rouge_l double")

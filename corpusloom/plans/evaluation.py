"""Queries for rank metrics, answer metrics and their aggregates."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import rules as R
from corpusloom.operators import dedupe as D
from corpusloom.operators import evaluate as E
from corpusloom.operators import fusion as U
from corpusloom.functions import text as T
from corpusloom.operators.plugins import accepted_pair, accepted_rewrite, call, embedding, fallback_chain, judged, provider_calls
from corpusloom.operators.reports import summary
from corpusloom.plans.retrieval import _ALL, _ALPHA, _BOTH, _CW, _DENSE, _dense, _lex_sql, _lexical, _ranked, embed_sql
from corpusloom.plans.tables import ANSWERS, WORDS, answers, index, table
from corpusloom.session import stable

Q, S = {}, {}


def query(f):
    Q[f.__name__] = f
    return f


def _w(c: str) -> str:
    return WORDS.format(c=c)


def _truth(spark, sf) -> DataFrame:
    """The one source of every question that has one, with its course."""
    lists = table(spark, sf, "playlists").select("playlist_id", "course")
    course = table(spark, sf, "videos").join(lists, "playlist_id").select(F.col("video_id").alias("source_video_id"), lists["course"])
    q = table(spark, sf, "test_query").where("source_chunk_id is not null").join(course, "source_video_id", "left")
    return q.select(F.col("query_id").alias("qid"), F.col("source_chunk_id").alias("doc"), "course", F.lit(1.0).alias("gain"))


def _paths(spark, sf) -> dict[str, DataFrame]:
    """Hits of all questions by each way of retrieving."""
    lex, den = stable(_lexical(spark, sf, every=True)), stable(_dense(spark, sf, every=True))
    return {"sparse": lex, "dense": den, "hybrid": U.fuse_rrf(lex, den, k=None, alpha=R.ALPHA)}


@query
def rank_metrics(spark, sf) -> DataFrame:
    return E.rank_metrics(_dense(spark, sf, every=True), _truth(spark, sf))


def _metric_sql(hits: str) -> str:
    cols = []
    for k in (1, 3, 5, 10):
        ok = f"(r <= {k})"
        cols += [f"CAST(coalesce({ok}, false) AS DOUBLE) AS hit_{k}", f"round(CASE WHEN {ok} THEN 1.0 / {k} ELSE 0.0 END, 6) AS precision_{k}", f"CAST(coalesce({ok}, false) AS DOUBLE) AS recall_{k}", f"round(CASE WHEN {ok} THEN 1.0 / r ELSE 0.0 END, 6) AS ap_{k}",
                 f"round(CASE WHEN {ok} THEN 1.0 / log2(r + 1) ELSE 0.0 END, 6) AS ndcg_{k}", f"round(CASE WHEN {ok} THEN 1.0 / r ELSE 0.0 END, 6) AS rr_{k}"]
    return f"m AS (SELECT q.query_id AS qid, h.rank AS r FROM questions q LEFT JOIN {hits} h ON h.qid = q.query_id AND h.doc = q.source_chunk_id WHERE q.source_chunk_id IS NOT NULL), mm AS (SELECT qid, {', '.join(cols)} FROM m)"


S["rank_metrics"] = _ALL + _DENSE + ", " + _metric_sql("den") + " SELECT * FROM mm"


@query
def single_source_metrics(spark, sf) -> DataFrame:
    """The whole family of metrics for one right document, by question, over the hybrid ranks, which may pass 20."""
    return E.single_source(_paths(spark, sf)["hybrid"], _truth(spark, sf))


_SINGLE = ", ".join(
    [f"CAST(coalesce(r <= {k}, false) AS DOUBLE) AS hit_{k}" for k in (1, 3, 5, 6, 10, 20)] + [f"round(CASE WHEN r <= {k} THEN 1.0::DOUBLE / {k} ELSE 0.0 END, 6) AS precision_{k}" for k in (1, 3, 5, 10)]
    + ["round(coalesce(1.0::DOUBLE / r, 0), 6) AS rr", "round(CASE WHEN r <= 3 THEN 1.0::DOUBLE / r ELSE 0 END, 6) AS rr_3", "round(coalesce(1.0::DOUBLE / r, 0), 6) AS ap"]
    + [f"round(CASE WHEN r <= {k} THEN 1.0::DOUBLE / log2(r + 1) ELSE 0.0 END, 6) AS ndcg_{k}" for k in (3, 5, 10, 20)] + ["CAST(r IS NULL AS DOUBLE) AS miss"]
)
_HYBRID = f"{_lex_sql()}, {_DENSE}, {_BOTH}, {_ranked(_ALPHA, 9, None)}"
S["single_source_metrics"] = _ALL + _HYBRID + f", m AS (SELECT q.query_id AS qid, h.rank AS r FROM questions q LEFT JOIN fused h ON h.qid = q.query_id AND h.doc = q.source_chunk_id WHERE q.source_chunk_id IS NOT NULL) SELECT qid, r AS rank, {_SINGLE} FROM m"


@query
def retrieval_comparison(spark, sf) -> DataFrame:
    """Mean hits and reciprocal rank of the three paths, overall and by course, in one pass; which is best at 5 (the first of
    equals), and a verdict."""
    truth = _truth(spark, sf)
    rows = None
    for order, (name, hits) in enumerate(_paths(spark, sf).items()):
        m = E.single_source(hits, truth, ["course"]).select("course", *[f"hit_{k}" for k in (1, 3, 5, 10)], "rr").withColumn("path", F.lit(name)).withColumn("path_order", F.lit(order))
        rows = m if rows is None else rows.unionByName(m)
    rows = rows.withColumn("course", F.coalesce("course", F.lit("unknown")))
    sets = rows.groupingSets([[F.col("path"), F.col("path_order")], [F.col("path"), F.col("path_order"), F.col("course")]], F.col("path"), F.col("path_order"), F.col("course"))
    means = sets.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit_1", "hit_3", "hit_5", "hit_10", "rr")])
    first = F.row_number().over(Window.partitionBy("course").orderBy(F.desc("hit_5"), "path_order")) == 1
    verdict = F.when(F.col("hit_5") < 0.40, "broken").when((F.col("hit_5") >= 0.70) & (F.col("rr") >= 0.50), "good").otherwise("weak")
    return means.withColumn("best", first).withColumn("verdict", verdict).drop("path_order")


_COURSE = "c AS (SELECT q.query_id AS qid, coalesce(p.course, 'unknown') AS course FROM questions q LEFT JOIN videos v ON v.video_id = q.source_video_id LEFT JOIN playlists p ON p.playlist_id = v.playlist_id)"
_PATHS = " UNION ALL ".join(f"SELECT '{p}' AS path, {i} AS o, c.course, r FROM (SELECT q.query_id AS qid, h.rank AS r FROM questions q LEFT JOIN {t} h ON h.qid = q.query_id AND h.doc = q.source_chunk_id WHERE q.source_chunk_id IS NOT NULL) JOIN c USING (qid)" for i, (p, t) in enumerate((("sparse", "lex"), ("dense", "den"), ("hybrid", "fused"))))
S["retrieval_comparison"] = _ALL + f"""{_HYBRID}, {_COURSE}, p AS ({_PATHS}),
    g AS (SELECT path, o, course, count(*) AS queries, {", ".join(f"round(avg(CAST(coalesce(r <= {k}, false) AS INT)), 6) AS hit_{k}" for k in (1, 3, 5, 10))}, round(avg(round(coalesce(1.0::DOUBLE / r, 0), 6)), 6) AS rr FROM p GROUP BY GROUPING SETS ((path, o), (path, o, course)))
    SELECT path, course, queries, hit_1, hit_3, hit_5, hit_10, rr, row_number() OVER (PARTITION BY course ORDER BY hit_5 DESC, o) = 1 AS best, CASE WHEN hit_5 < 0.40 THEN 'broken' WHEN hit_5 >= 0.70 AND rr >= 0.50 THEN 'good' ELSE 'weak' END AS verdict FROM g"""


@query
def semantic_metrics(spark, sf) -> DataFrame:
    """Cosines of questions, their hits and their sources, by the stand-in embedder."""
    ix = index(spark, sf)
    asked = table(spark, sf, "test_query")
    q = asked.select(F.col("query_id").alias("qid"), embedding(F.col("question"), ix.embed).alias("vec"))
    own = asked.select(F.col("query_id").alias("qid"), F.col("source_chunk_id").alias("doc")).join(ix.dense, "doc").select("qid", "vec")
    return E.semantic(_lexical(spark, sf, 5, every=True), q, ix.dense, own)


S["semantic_metrics"] = _ALL + f"""{_lex_sql(k=5)}, {embed_sql("chunks", "chunk_id", "chunk_text", "cv")}, {embed_sql("questions", "query_id", "question", "qv")},
    a AS (SELECT l.qid, l.doc, coalesce(sum(qv.v * cv.v), 0) AS d FROM lex l LEFT JOIN qv ON qv.k = l.qid LEFT JOIN cv ON cv.k = l.doc AND cv.b = qv.b GROUP BY ALL),
    z AS (SELECT l.qid, l.doc, q.source_chunk_id AS s, coalesce(sum(sv.v * cv.v), 0) AS d FROM lex l JOIN questions q ON q.query_id = l.qid LEFT JOIN cv sv ON sv.k = q.source_chunk_id LEFT JOIN cv ON cv.k = l.doc AND cv.b = sv.b GROUP BY ALL),
    c AS (SELECT a.qid, coalesce(a.d / (qn.n * cn.n), 0) AS c, coalesce(z.d / (sn.n * cn.n), 0) AS t FROM a JOIN z USING (qid, doc) LEFT JOIN qv_n qn ON qn.k = a.qid LEFT JOIN cv_n cn ON cn.k = a.doc LEFT JOIN cv_n sn ON sn.k = z.s)
    SELECT query_id AS qid, round(coalesce(max(c), 0), 6) AS max_sim, round(coalesce(avg(c), 0), 6) AS mean_sim, round(coalesce(avg(CAST(c >= 0.5 AS INT)), 0), 6) AS semantic_precision, round(coalesce(max(CAST(t >= 0.7 AS INT)), 0), 6)::DOUBLE AS semantic_recall
    FROM questions LEFT JOIN c ON c.qid = query_id GROUP BY 1"""


@query
def expected_rank(spark, sf) -> DataFrame:
    """Rank of each question's source among the lexical hits, null if it is missed."""
    t = _truth(spark, sf).select("qid", "doc")
    return t.join(_lexical(spark, sf, every=True), ["qid", "doc"], "left").groupBy("qid").agg(F.min("rank").alias("rank"))


S["expected_rank"] = _ALL + _lex_sql() + " SELECT q.query_id AS qid, min(l.rank) AS rank FROM questions q LEFT JOIN lex l ON l.qid = q.query_id AND l.doc = q.source_chunk_id WHERE q.source_chunk_id IS NOT NULL GROUP BY 1"


@query
def relevance_lookup(spark, sf) -> DataFrame:
    """Gain of each hit by its chunk id or its video, whichever is larger."""
    q = table(spark, sf, "test_query")
    gains = q.select(F.concat_ws("|", "query_id", "source_chunk_id").alias("key"), F.lit(2.0).alias("gain")).unionByName(q.select(F.concat_ws("|", "query_id", "source_video_id").alias("key"), F.lit(1.0).alias("gain")))
    hits = stable(_lexical(spark, sf, every=True)).withColumn("k1", F.concat_ws("|", "qid", "doc")).withColumn("k2", F.concat_ws("|", "qid", F.split_part("doc", F.lit(":"), F.lit(1))))
    return D.lookup_any(hits, ["k1", "k2"], gains, "key", "gain").select("qid", "doc", "gain")


S["relevance_lookup"] = _ALL + _lex_sql() + """ SELECT qid, doc, CAST(CASE WHEN doc = source_chunk_id THEN 2 WHEN split_part(doc, ':', 1) = source_video_id THEN 1 ELSE 0 END AS DOUBLE) AS gain FROM lex JOIN questions ON query_id = qid"""


@query
def context_judgements(spark, sf) -> DataFrame:
    """Context precision and relevancy from a judge's rows, here rules: a hit of the source's video is useful, and sentences
    are counted by rank."""
    q = table(spark, sf, "test_query").select(F.col("query_id").alias("qid"), "source_video_id")
    h = _lexical(spark, sf, 10, every=True).join(q, "qid")
    useful = F.coalesce(F.split_part("doc", F.lit(":"), F.lit(1)) == F.col("source_video_id"), F.lit(False))
    return E.context_precision(h.select("qid", "rank", useful.alias("useful"), (F.col("rank") % 5).alias("relevant_sentences"), F.lit(3).alias("total_sentences")))


S["context_judgements"] = _ALL + _lex_sql(k=10) + """, u AS (SELECT qid, rank, CAST(coalesce(split_part(doc, ':', 1) = source_video_id, false) AS INT) AS u FROM lex JOIN questions ON query_id = qid),
    r AS (SELECT *, sum(u) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS h FROM u)
    SELECT qid, round(CASE WHEN sum(u) > 0 THEN sum(CASE WHEN u = 1 THEN h::DOUBLE / rank ELSE 0 END) / sum(u) ELSE 0.0 END, 6) AS context_precision, round(avg(least(1.0, (rank % 5)::DOUBLE / 3)), 6) AS context_relevancy FROM r GROUP BY 1"""


@query
def claims_and_entities(spark, sf) -> DataFrame:
    """Claims of each truth (its sentences) that the answer holds word for word, and its content words found in the answer."""
    a = answers(spark, sf).withColumn("low", F.lower(F.coalesce("answer", F.lit(""))))
    claims = F.transform(F.filter(F.split(F.coalesce("ground_truth", F.lit("")), r"\. "), lambda s: s != ""), lambda s: F.struct(s.alias("text"), F.contains(F.col("low"), F.lower(s)).alias("supported")))
    e = a.select(F.col("answer_id").alias("qid"), F.round(E.entity_recall(T.content_words(F.coalesce("ground_truth", F.lit(""))), F.col("low")), 6).alias("entity_recall"))
    return E.claim_support(a.select(F.col("answer_id").alias("qid"), claims.alias("claims"))).join(e, "qid")


S["claims_and_entities"] = rf"""WITH {ANSWERS}, a AS (SELECT answer_id AS qid, lower(coalesce(answer, '')) AS low, list_filter(string_split(coalesce(ground_truth, ''), '. '), lambda s: s <> '') AS c, {_CW.format(c="ground_truth")} AS e FROM answers)
    SELECT qid, CASE WHEN len(c) = 0 THEN 0.0 ELSE round(len(list_filter(c, lambda s: contains(low, lower(s))))::DOUBLE / len(c), 6) END AS supported, CASE WHEN len(e) = 0 THEN 0.0 ELSE round(len(list_filter(e, lambda s: contains(low, s)))::DOUBLE / len(e), 6) END AS entity_recall FROM a"""


@query
def judged_answers(spark, sf) -> DataFrame:
    """Answers through a stand-in judge that says JSON in code fences, with scores out of bounds and long reasons, or nothing of use."""

    def judge(prompts: list[str]) -> list[str]:
        return ["sorry" if len(p) % 5 == 0 else "```json\n" + json.dumps({"score": len(p) % 7 / 5, "reason": "because " * 20}) + "\n```" for p in prompts]

    a = answers(spark, sf).select("answer_id", F.coalesce("answer", F.lit("")).alias("a"))
    j = a.withColumn("j", judged(call(F.col("a"), judge, wait=0.1)["text"]))
    return j.select("answer_id", F.round("j.score", 6).alias("score"), F.length("j.reason").alias("reason_chars"))


S["judged_answers"] = f"WITH {ANSWERS}, a AS (SELECT answer_id, length(coalesce(answer, '')) AS n FROM answers) SELECT answer_id, CASE WHEN n % 5 = 0 THEN 0.0 ELSE round(least(1.0, (n % 7) / 5.0::DOUBLE), 6) END AS score, CASE WHEN n % 5 = 0 THEN 0 ELSE 120 END AS reason_chars FROM a"


@query
def judge_fallbacks(spark, sf) -> DataFrame:
    """Calls per judge of a chain in which the next is asked where one has no score."""
    names = ["groundedness", "noise_sensitivity", "response_relevancy"]
    return provider_calls(answers(spark, sf).select(fallback_chain({n: F.col(n) for n in names}).alias("chain")))


S["judge_fallbacks"] = f"""WITH {ANSWERS}, a AS (SELECT groundedness IS NOT NULL AS x, noise_sensitivity IS NOT NULL AS y, response_relevancy IS NOT NULL AS z FROM answers)
    SELECT 'groundedness' AS provider, count(*) AS calls, count_if(x) AS answered FROM a UNION ALL SELECT 'noise_sensitivity', count_if(NOT x), count_if(NOT x AND y) FROM a WHERE NOT x HAVING count(*) > 0
    UNION ALL SELECT 'response_relevancy', count_if(NOT x AND NOT y), count_if(NOT x AND NOT y AND z) FROM a WHERE NOT x AND NOT y HAVING count(*) > 0 UNION ALL SELECT NULL, count_if(NOT x AND NOT y AND NOT z), 0 FROM a"""


@query
def generated_pairs(spark, sf) -> DataFrame:
    """Which test pairs and questions pass the acceptance rules of generation."""
    q = table(spark, sf, "test_query")
    return q.select("query_id", accepted_pair(F.col("question"), F.col("ground_truth")).alias("pair"), accepted_rewrite(F.col("question"), F.col("source_chunk_id").isNotNull()).alias("rewrite"))


S["generated_pairs"] = f"SELECT query_id, length(trim(coalesce(question, ''))) >= 10 AND length(trim(coalesce(ground_truth, ''))) >= 20 AS pair, source_chunk_id IS NOT NULL AND len({_w("coalesce(question, '')")}) >= 5 AS rewrite FROM test_query"


@query
def answer_exact(spark, sf) -> DataFrame:
    return answers(spark, sf).select("answer_id", E.exact_match(F.col("answer"), F.col("ground_truth")).alias("exact"), F.round(E.string_presence(F.col("answer"), F.col("ground_truth")), 6).alias("presence"))


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(R.ANSWER_STOPWORDS))
S["answer_exact"] = rf"""WITH {ANSWERS}, a AS (SELECT answer_id, lower(coalesce(answer, '')) AS a, lower(coalesce(ground_truth, '')) AS g FROM answers),
    w AS (SELECT answer_id, a, g, list_distinct(list_filter(regexp_extract_all(g, '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))) AS l FROM a)
    SELECT answer_id, CAST(trim(a, ' ' || chr(9) || chr(10) || chr(13)) = trim(g, ' ' || chr(9) || chr(10) || chr(13)) AS DOUBLE) AS exact, CASE WHEN len(l) = 0 THEN 0.0 ELSE round(len(list_filter(l, lambda x: contains(a, x)))::DOUBLE / len(l), 6) END AS presence FROM w"""


@query
def rouge_n(spark, sf) -> DataFrame:
    a, g = F.col("answer"), F.col("ground_truth")
    return answers(spark, sf).select("answer_id", F.round(E.rouge_n(a, g, 1), 6).alias("rouge_1"), F.round(E.rouge_n(a, g, 2), 6).alias("rouge_2"))


S["rouge_n"] = f"""WITH {ANSWERS}, a AS (SELECT answer_id, {_w("coalesce(answer, '')")} AS a, {_w("coalesce(ground_truth, '')")} AS g FROM answers),
    b AS (SELECT answer_id, list_distinct(a) AS a1, list_distinct(g) AS g1, list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) AS a2, list_distinct(list_transform(range(1, len(g)), lambda i: g[i] || ' ' || g[i + 1])) AS g2 FROM a)
    SELECT answer_id, CASE WHEN len(list_intersect(a1, g1)) = 0 THEN 0.0 ELSE round(2.0::DOUBLE * len(list_intersect(a1, g1)) / (len(a1) + len(g1)), 6) END AS rouge_1,
    CASE WHEN len(list_intersect(a2, g2)) = 0 THEN 0.0 ELSE round(2.0::DOUBLE * len(list_intersect(a2, g2)) / (len(a2) + len(g2)), 6) END AS rouge_2 FROM b"""


@query
def rouge_l(spark, sf) -> DataFrame:
    return E.rouge_l(answers(spark, sf), "answer_id", "answer", "ground_truth")


@query
def bleu(spark, sf) -> DataFrame:
    return answers(spark, sf).select("answer_id", F.round(E.bleu(F.col("answer"), F.col("ground_truth")), 6).alias("bleu"))


def _gram_sql(n: int, side: str) -> str:
    return f"list_transform(range(1, len({side}) - {n - 2}), lambda i: array_to_string({side}[i:i + {n - 1}], ' '))"


_LOGS = " + ".join(f"ln(CASE WHEN m{n} > 0 THEN m{n}::DOUBLE ELSE 0.1 END / greatest(1, len(h{n}))) / 4" for n in (1, 2, 3, 4))
S["bleu"] = f"""WITH {ANSWERS}, w AS (SELECT answer_id, {_w("lower(coalesce(answer, ''))")} AS h, {_w("lower(coalesce(ground_truth, ''))")} AS r FROM answers),
    g AS (SELECT *, {", ".join(f"{_gram_sql(n, 'h')} AS h{n}, {_gram_sql(n, 'r')} AS r{n}" for n in (1, 2, 3, 4))} FROM w),
    m AS (SELECT *, {", ".join(f"coalesce(list_sum(list_transform(list_distinct(h{n}), lambda x: least(len(list_filter(h{n}, lambda y: y = x)), len(list_filter(r{n}, lambda y: y = x))))), 0) AS m{n}" for n in (1, 2, 3, 4))} FROM g)
    SELECT answer_id, CASE WHEN len(h) = 0 OR len(r) = 0 OR m1 = 0 THEN 0.0 ELSE round(CASE WHEN len(h) > len(r) THEN 1.0 ELSE exp(1 - len(r)::DOUBLE / len(h)) END * exp({_LOGS}), 6) END AS bleu FROM m"""


_SCORES = ["exact_match", "string_presence", "bleu", "rouge_1", "rouge_2", "rouge_l", "instruction_following", "response_relevancy", "groundedness", "noise_sensitivity", "answer_latency_ms"]


@query
def metric_means(spark, sf) -> DataFrame:
    """Means of all recorded scores, over all and per run, in one pass."""
    return E.means(answers(spark, sf).select("run_id", *_SCORES), ["run_id"])


S["metric_means"] = f"WITH {ANSWERS} SELECT run_id, count(*) AS queries, {', '.join(f'round(avg({c}) + 1e-12, 6) AS {c}' for c in _SCORES)} FROM answers GROUP BY ROLLUP (run_id)"


@query
def latency_percentiles(spark, sf) -> DataFrame:
    """Nearest-rank percentiles of latencies above 0."""
    return summary(answers(spark, sf).where("answer_latency_ms > 0"), "answer_latency_ms").select("n", "p50", "p90", "p95", "max", "mean")


S["latency_percentiles"] = f"""WITH {ANSWERS}, v AS (SELECT answer_latency_ms AS v FROM answers WHERE answer_latency_ms > 0), l AS (SELECT list_sort(list(v)) AS l FROM v)
    SELECT count(*) AS n, {', '.join(f"any_value(l[1 + CAST(round_even({p / 100} * (len(l) - 1), 0) AS INT)]) AS p{p}" for p in (50, 90, 95))}, max(v) AS max, round(avg(v), 6) AS mean FROM v, l"""


@query
def run_comparison(spark, sf) -> DataFrame:
    """Means of all scores of the two largest runs side by side, one row per metric, and which is higher (the first of equals)."""
    a = answers(spark, sf).where("run_id is not null")
    runs = [r[0] for r in a.groupBy("run_id").count().orderBy(F.desc("count"), "run_id").limit(2).collect()]
    m = a.where(F.col("run_id").isin(*runs)).groupBy("run_id").agg(*[F.round(F.avg(c) + 1e-12, 6).alias(c) for c in _SCORES]).unpivot("run_id", _SCORES, "metric", "value")
    out = D.pivot_runs(m, "metric", "run_id", "value", runs).toDF("metric", *[f"run_{i}" for i in range(1, len(runs) + 1)])
    return out.withColumn("best", F.when(F.col("run_2") > F.col("run_1"), 2).otherwise(1))


S["run_comparison"] = f"""WITH {ANSWERS}, t AS (SELECT run_id, row_number() OVER (ORDER BY count(*) DESC, run_id) AS n FROM answers WHERE run_id IS NOT NULL GROUP BY 1), a AS (SELECT * FROM answers JOIN t USING (run_id)),
    m AS ({" UNION ALL ".join(f"SELECT '{c}' AS metric, round(avg({c}) FILTER (n = 1) + 1e-12, 6) AS run_1, round(avg({c}) FILTER (n = 2) + 1e-12, 6) AS run_2 FROM a" for c in _SCORES)}) SELECT *, CASE WHEN run_2 > run_1 THEN 2 ELSE 1 END AS best FROM m"""


@query
def judge_scores(spark, sf) -> DataFrame:
    """Clamped judge scores, missing ones as 0."""
    from corpusloom.functions.text import clamp_score

    c = lambda n: clamp_score(F.coalesce(n, F.lit(0.0))).alias(n)
    return answers(spark, sf).select("answer_id", c("instruction_following"), c("response_relevancy"), c("noise_sensitivity"))


S["judge_scores"] = f"WITH {ANSWERS} SELECT answer_id, " + ", ".join(f"least(greatest(coalesce({c}, 0.0), 0.0), 1.0) AS {c}" for c in ("instruction_following", "response_relevancy", "noise_sensitivity")) + " FROM answers"

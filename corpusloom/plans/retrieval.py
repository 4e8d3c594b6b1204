"""Queries for lexical and dense retrieval, fusion, variants, reranking and contexts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import rules as R
from corpusloom.functions import text as T
from corpusloom.operators import context as X
from corpusloom.operators import fusion as U
from corpusloom.operators import plugins as M
from corpusloom.session import checkpoint_dir, stable
from corpusloom.sources import jsonl as J
from corpusloom.plans.tables import CHUNKS, EVERY, QUESTIONS, WORDS, answers, chunks, index, questions, table

Q, S = {}, {}


def query(f):
    Q[f.__name__] = f
    return f


def _w(c: str) -> str:
    return WORDS.format(c=c)


def _asked(spark, sf, text: str = "question", every: bool = False) -> DataFrame:
    q = table(spark, sf, "test_query") if every else questions(spark, sf)
    return q.select(F.col("query_id").alias("qid"), F.col(text).alias("text"))


def _firsts(spark, sf) -> DataFrame:
    """All questions as ``(qid, text, first)``: with the first of those that ask the same text."""
    return _asked(spark, sf, every=True).withColumn("first", F.min("qid").over(Window.partitionBy("text")))


def _each(spark, sf, found: DataFrame) -> DataFrame:
    """What was found for the first question of a text, for each that asks it."""
    same = _firsts(spark, sf).select(F.col("first").alias("qid"), F.col("qid").alias("_own"))
    return same.join(found, "qid").withColumn("qid", F.col("_own")).drop("_own")


def _found(spark, sf, k: int = 20) -> DataFrame:
    """Hits of the first question of each text."""
    return index(spark, sf).lexical_hits(_firsts(spark, sf).where("qid = first").select("qid", "text"), k)


def _lexical(spark, sf, k: int = 20, text: str = "question", every: bool = False) -> DataFrame:
    if every:
        return _each(spark, sf, _found(spark, sf, k)).select("qid", "doc", "score", "rank")
    return index(spark, sf).lexical_hits(_asked(spark, sf, text), k)


def _dense(spark, sf, k: int = 20, every: bool = False) -> DataFrame:
    return index(spark, sf).dense_hits(_asked(spark, sf, every=every), k)


def _lex_sql(text: str = "question", k: int = 20, name: str = "lex") -> str:
    return f"""toks AS (SELECT chunk_id AS doc, {_w("lower(coalesce(chunk_text, ''))")} AS t FROM chunks), lens AS (SELECT doc, len(t) AS dl FROM toks), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
    post AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM toks) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, tot), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT query_id AS qid, unnest({_w(f"lower(coalesce({text}, ''))")}) AS term FROM questions) GROUP BY ALL),
    sc AS (SELECT qid, doc, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN lens USING (doc), tot GROUP BY ALL),
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM sc) WHERE rank <= {k})"""


def embed_sql(source: str, key: str, text: str, name: str) -> str:
    """Vectors of the stand-in embedder as rows (key, b, v), and their lengths as ``name``_n."""
    words = _w(f"lower(coalesce({text}, ''))")
    return f"""{name}_w AS (SELECT {key} AS k, unnest({words}) AS w FROM {source}), {name} AS (SELECT k, ('0x' || md5(w)[1:2])::INT % 64 AS b, sum(CASE WHEN md5(w)[3] >= '8' THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}_w GROUP BY ALL),
    {name}_n AS (SELECT k, sqrt(sum(v * v)) AS n FROM {name} GROUP BY k HAVING sum(v * v) > 0)"""


_DENSE = f"""{embed_sql("chunks", "chunk_id", "chunk_text", "cv")}, {embed_sql("questions", "query_id", "question", "qv")},
    ds AS (SELECT q.k AS qid, c.k AS doc, round(coalesce(any_value(d), 0) / (any_value(q.n) * any_value(c.n)), 6) AS score FROM qv_n q CROSS JOIN cv_n c LEFT JOIN (SELECT qv.k AS qk, cv.k AS ck, sum(qv.v * cv.v) AS d FROM qv JOIN cv USING (b) GROUP BY ALL) ON qk = q.k AND ck = c.k GROUP BY ALL),
    den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM ds) WHERE rank <= 20)"""
_HEAD = f"WITH {CHUNKS}, {QUESTIONS}, "
_ALL = f"WITH {CHUNKS}, {EVERY}, "
_NORM = "CASE WHEN max(score) OVER (PARTITION BY qid) - min(score) OVER (PARTITION BY qid) < 1e-8 THEN 0.5 ELSE (score - min(score) OVER (PARTITION BY qid)) / (max(score) OVER (PARTITION BY qid) - min(score) OVER (PARTITION BY qid)) END"
_BOTH = f"""two AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc, b.doc) AS doc, a.score AS bm25_score, a.rank AS bm25_rank, a.norm AS bm25_norm, b.score AS dense_score, b.rank AS dense_rank, b.norm AS dense_norm
    FROM (SELECT *, {_NORM} AS norm FROM lex) a FULL JOIN (SELECT *, {_NORM} AS norm FROM den) b ON a.qid = b.qid AND a.doc = b.doc)"""


def _ranked(expr: str, places: int, k: int | None, source: str = "two", name: str = "fused") -> str:
    cut = f" WHERE rank <= {k}" if k else ""
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, bm25_rank NULLS LAST, dense_rank NULLS LAST, doc) AS rank FROM (SELECT *, round({expr}, {places}) AS final FROM {source})){cut})"


@query
def bm25_topk(spark, sf) -> DataFrame:
    return _lexical(spark, sf)


S["bm25_topk"] = _HEAD + _lex_sql() + " SELECT qid, doc, score, rank FROM lex"


@query
def dense_topk(spark, sf) -> DataFrame:
    return _dense(spark, sf)


S["dense_topk"] = _HEAD + _DENSE + " SELECT qid, doc, score, rank FROM den"


@query
def fuse_weighted(spark, sf) -> DataFrame:
    return U.fuse_weighted(_lexical(spark, sf), _dense(spark, sf), 0.3, 0.7).select("qid", "doc", "final", "rank")


_WEIGHTED = "coalesce(bm25_norm, 0) * 0.3 + coalesce(dense_norm, 0) * 0.7"
S["fuse_weighted"] = _HEAD + f"{_lex_sql()}, {_DENSE}, {_BOTH}, {_ranked(_WEIGHTED, 6, 20)} SELECT qid, doc, final, rank FROM fused"


@query
def fuse_rrf(spark, sf) -> DataFrame:
    return U.fuse_rrf(_lexical(spark, sf), _dense(spark, sf)).select("qid", "doc", "final", "rank")


_RRF = "coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + dense_rank), 0)"
S["fuse_rrf"] = _HEAD + f"{_lex_sql()}, {_DENSE}, {_BOTH}, {_ranked(_RRF, 9, 20)} SELECT qid, doc, final, rank FROM fused"


@query
def fuse_rrf_alpha(spark, sf) -> DataFrame:
    return U.fuse_rrf(_lexical(spark, sf), _dense(spark, sf), k=None, alpha=0.6).select("qid", "doc", "final", "rank")


_ALPHA = "coalesce((1 - 0.6::DOUBLE) / (60 + bm25_rank), 0) + coalesce(0.6::DOUBLE / (60 + dense_rank), 0)"
S["fuse_rrf_alpha"] = _HEAD + f"{_lex_sql()}, {_DENSE}, {_BOTH}, {_ranked(_ALPHA, 9, None)} SELECT qid, doc, final, rank FROM fused"


@query
def fusion_trace(spark, sf) -> DataFrame:
    return U.trace(U.fuse_weighted(_lexical(spark, sf), _dense(spark, sf), 0.3, 0.7))


S["fusion_trace"] = _HEAD + f"""{_lex_sql()}, {_DENSE}, {_BOTH}, {_ranked(_WEIGHTED, 6, 20)} SELECT qid, doc, rank, round(bm25_score, 4) AS bm25_score, bm25_rank, round(coalesce(bm25_norm, 0) * 0.3, 4) AS bm25_contrib,
    round(dense_score, 4) AS dense_score, dense_rank, round(coalesce(dense_norm, 0) * 0.7, 4) AS dense_contrib, round(final, 4) AS final FROM fused"""


def _variants(spark, sf) -> DataFrame:
    """Hits of the question, and of the question with its truth as an expanded form."""
    one = _lexical(spark, sf, 10).withColumn("variant", F.lit("original")).withColumn("variant_ord", F.lit(1))
    two = _lexical(spark, sf, 10, "ground_truth").withColumn("variant", F.lit("q2_expanded")).withColumn("variant_ord", F.lit(0))
    return two.unionByName(one)


def _var_sql() -> str:
    a, b = _lex_sql("question", 10, "lex"), _lex_sql("ground_truth", 10, "lex")
    return f"""va AS (WITH {a} SELECT qid, doc, score, rank, 'original' AS variant, 1 AS o FROM lex), vb AS (WITH {b} SELECT qid, doc, score, rank, 'q2_expanded' AS variant, 0 AS o FROM lex), vars AS (SELECT * FROM va UNION ALL SELECT * FROM vb)"""


@query
def variant_merge(spark, sf) -> DataFrame:
    m = U.merge_variants(_variants(spark, sf))
    return m.select("qid", "doc", "score", F.array_join("retrieved_by", ",").alias("retrieved_by"), "rank")


S["variant_merge"] = _HEAD + _var_sql() + """, g AS (SELECT qid, doc, arg_min(score, o * 1000 + rank) AS score, string_agg(variant, ',' ORDER BY o) AS retrieved_by, min(o * 1000 + rank) AS f FROM vars GROUP BY qid, doc)
    SELECT qid, doc, score, retrieved_by, row_number() OVER (PARTITION BY qid ORDER BY f, doc) AS rank FROM g"""


@query
def best_rank_merge(spark, sf) -> DataFrame:
    return U.best_rank_merge(_variants(spark, sf), 10)


S["best_rank_merge"] = _HEAD + _var_sql() + """, g AS (SELECT qid, doc, min(rank) AS best_rank, min(o * 1000 + rank) AS f FROM vars GROUP BY qid, doc)
    SELECT qid, doc, best_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY best_rank, f, doc) AS rank FROM g) WHERE rank <= 10"""


@query
def rerank_overlap(spark, sf) -> DataFrame:
    """Reranking by a deterministic scorer: overlap of content words of question and chunk."""
    h = _lexical(spark, sf)
    h = h.join(index(spark, sf).documents.select("doc", F.col("text").alias("chunk_text")), "doc").join(questions(spark, sf).select(F.col("query_id").alias("qid"), "question"), "qid")
    s = T.jaccard(T.content_words(F.coalesce("question", F.lit(""))), T.content_words(F.coalesce("chunk_text", F.lit(""))))
    return U.rerank(h, s, 3).select("qid", "doc", "score", "rank")


_STOP = ", ".join(f"'{w}'" for w in R.STOPWORDS)
_CW = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9'']+'), lambda w: length(w) > 2 AND w NOT IN (" + _STOP + ")))"
S["rerank_overlap"] = _HEAD + _lex_sql() + f""", c AS (SELECT qid, doc, l.rank AS old, {_CW.format(c="question")} AS a, {_CW.format(c="chunk_text")} AS b FROM lex l JOIN chunks ON chunk_id = doc JOIN questions ON query_id = qid),
    j AS (SELECT qid, doc, old, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS s FROM c)
    SELECT qid, doc, round(s, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, old, doc) AS rank FROM j) WHERE rank <= 3"""


@query
def course_post_filter(spark, sf) -> DataFrame:
    """Of all questions' hits, those of the question's own course, taken after retrieval and before the cut."""
    lists = table(spark, sf, "playlists").select("playlist_id", F.col("course").alias("named"))
    c = index(spark, sf).documents.select("doc", "playlist_id").join(lists, "playlist_id").select("doc", "named")
    own = table(spark, sf, "videos").join(lists.withColumnRenamed("named", "own"), "playlist_id").select(F.col("video_id").alias("source_video_id"), "own")
    q = table(spark, sf, "test_query").select(F.col("query_id").alias("qid"), "source_video_id").join(own, "source_video_id")
    h = _lexical(spark, sf, every=True).join(c, "doc").join(q, "qid")
    return U.keep_courses(h, F.col("named") == F.col("own"), 6).select("qid", "doc", "rank", "place")


S["course_post_filter"] = _ALL + _lex_sql() + """, h AS (SELECT l.* FROM lex l JOIN chunks c ON c.chunk_id = l.doc JOIN playlists p USING (playlist_id) JOIN questions q ON q.query_id = l.qid
      JOIN videos v ON v.video_id = q.source_video_id JOIN playlists o ON o.playlist_id = v.playlist_id WHERE p.course = o.course)
    SELECT qid, doc, rank, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM h) WHERE place <= 6"""


@query
def hybrid_retrieve(spark, sf) -> DataFrame:
    """The retriever in one call: 20 hits of each side, 20 fused by weights, 3 by overlap of content words."""
    return index(spark, sf).retrieve(_asked(spark, sf), 3, lambda q, t: T.jaccard(T.content_words(q), T.content_words(t))).select("qid", "doc", "score", "rank")


S["hybrid_retrieve"] = _HEAD + f"""{_lex_sql()}, {_DENSE}, {_BOTH}, {_ranked(_WEIGHTED, 6, 20)}, c AS (SELECT qid, doc, f.rank AS old, {_CW.format(c="question")} AS a, {_CW.format(c="chunk_text")} AS b FROM fused f JOIN chunks ON chunk_id = doc JOIN questions ON query_id = qid),
    j AS (SELECT qid, doc, old, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS s FROM c)
    SELECT qid, doc, round(s, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, old, doc) AS rank FROM j) WHERE rank <= 3"""


@query
def variant_routing(spark, sf) -> DataFrame:
    """Questions by weights, their truths as expanded queries by reciprocal ranks, merged; the first 3."""
    one = _asked(spark, sf).withColumn("variant", F.lit("original")).withColumn("variant_ord", F.lit(1))
    two = _asked(spark, sf, "ground_truth").withColumn("variant", F.lit("q2_expanded")).withColumn("variant_ord", F.lit(0))
    return index(spark, sf).routed(one.unionByName(two), 3).select("qid", "doc", F.array_join("retrieved_by", ",").alias("retrieved_by"), "rank")


def _routed_sql() -> str:
    a = f"{_lex_sql()}, {_DENSE}, {_BOTH}, {_ranked(_WEIGHTED, 6, 20)}"
    b = f"{_lex_sql('ground_truth')}, {_DENSE.replace('coalesce(question,', 'coalesce(ground_truth,')}, {_BOTH}, {_ranked(_RRF, 9, 20)}"
    return f"""va AS (WITH {a} SELECT qid, doc, final AS score, rank, 'original' AS variant, 1 AS o FROM fused), vb AS (WITH {b} SELECT qid, doc, final AS score, rank, 'q2_expanded' AS variant, 0 AS o FROM fused), vars AS (SELECT * FROM va UNION ALL SELECT * FROM vb)"""


S["variant_routing"] = _HEAD + _routed_sql() + """, g AS (SELECT qid, doc, string_agg(variant, ',' ORDER BY o) AS retrieved_by, min(o * 1000 + rank) AS f FROM vars GROUP BY qid, doc)
    SELECT * FROM (SELECT qid, doc, retrieved_by, row_number() OVER (PARTITION BY qid ORDER BY f, doc) AS rank FROM g) WHERE rank <= 3"""


@query
def citation_sources(spark, sf) -> DataFrame:
    """Each citation of an answer with the document of that rank among its question's hits."""
    a = answers(spark, sf).select("answer_id", F.col("query_id").alias("qid"), F.explode(T.citations(F.col("answer"))).alias("rank"))
    a = a.join(_firsts(spark, sf).select("qid", "first"), "qid").select("answer_id", F.col("first").alias("qid"), "rank")
    return a.join(_found(spark, sf), ["qid", "rank"]).select("answer_id", "rank", "doc")


S["citation_sources"] = _ALL + _lex_sql() + rf""", c AS (SELECT DISTINCT answer_id, query_id, unnest(list_transform(regexp_extract_all(coalesce(answer, ''), '\[(\d{{1,3}})\]', 1), lambda x: CAST(x AS INT))) AS rank FROM answer_eval)
    SELECT answer_id, c.rank, doc FROM c JOIN lex l ON l.qid = c.query_id AND l.rank = c.rank"""


@query
def query_rewrites(spark, sf) -> DataFrame:
    """Requests through a stand-in rewriter that says JSON in code fences, or, for every third length, something else."""

    def rewriter(prompts: list[str]) -> list[str]:
        return ["no idea" if len(p) % 3 == 0 else "```json\n" + json.dumps({"q1": p, "q2": p + " explained"}, ensure_ascii=False) + "\n```" for p in prompts]

    asked = table(spark, sf, "ask_request").select("request_id", "query").distinct().where("query is not null")
    r = asked.withColumn("said", M.call(F.col("query"), rewriter, wait=0.1)).select("request_id", "query", M.rewrites(F.col("query"), F.col("said.text")).alias("r"))
    final = M.rerank_query(F.col("query"), F.col("r.q1"), F.col("r.q2"))
    return r.select("request_id", "r.q1", "r.q2", "r.malformed", final.alias("rerank_text"))


S["query_rewrites"] = """WITH q AS (SELECT DISTINCT request_id, query, length(query) % 3 = 0 AS bad FROM ask_request WHERE query IS NOT NULL), r AS (SELECT request_id, query AS q1, query || CASE WHEN bad THEN ' machine learning' ELSE ' explained' END AS q2, bad AS malformed FROM q)
    SELECT *, q2 AS rerank_text FROM r"""


@query
def cached_rewrites(spark, sf) -> DataFrame:
    """Requests that a rewrite cache holds get its texts, the others themselves and a hint."""
    asked = table(spark, sf, "ask_request").select("request_id", "query").distinct().where("query is not null")
    half = F.substring(F.md5("query"), 1, 1) < "8"
    cache = asked.where(half).select("query", F.upper("query").alias("q1"), F.lower("query").alias("q2")).distinct()
    return J.cached(asked, cache, "query", F.concat("query", F.lit(" machine learning"))).select("request_id", F.md5("q1").alias("q1"), F.md5("q2").alias("q2"), "cached")


S["cached_rewrites"] = """WITH q AS (SELECT DISTINCT request_id, query, md5(query)[1] < '8' AS c FROM ask_request WHERE query IS NOT NULL)
    SELECT request_id, md5(CASE WHEN c THEN upper(query) ELSE query END) AS q1, md5(CASE WHEN c THEN lower(query) ELSE query || ' machine learning' END) AS q2, c AS cached FROM q"""


@query
def request_routes(spark, sf) -> DataFrame:
    """The variants that each request retrieves by, in order: with rewriting the expanded query first, then the original."""
    r = table(spark, sf, "ask_request").select(F.col("request_id").alias("qid"), "enable_rewrite").distinct()
    both = M.route_variants(r.where("enable_rewrite"), r.where("enable_rewrite"), True)
    return both.unionByName(M.route_variants(r.where("not coalesce(enable_rewrite, false)"), r, False)).select("qid", "variant", "variant_ord")


S["request_routes"] = """WITH r AS (SELECT DISTINCT request_id AS qid, enable_rewrite AS e FROM ask_request) SELECT qid, 'q2_expanded' AS variant, 0 AS variant_ord FROM r WHERE e UNION ALL SELECT qid, 'original', CASE WHEN e THEN 1 ELSE 0 END FROM r"""


def _hits(spark, sf, clean: bool = False) -> DataFrame:
    """Hits of the first question of each text with their chunks; where contexts are made of them, the texts of the chunks that
    were hit are cleaned, once each."""
    h = _found(spark, sf)
    c = index(spark, sf).documents.select("doc", "video_id", "title", "course", "url", "start_time", "end_time", "text")
    if clean:
        h = stable(h)
        c = c.join(h.select("doc"), "doc", "left_semi").withColumn("text", T.clean_context(F.col("text")))
    return h.join(c, "doc").withColumn("pos", F.col("rank"))


@query
def merge_context(spark, sf) -> DataFrame:
    m = X.merge_context(_hits(spark, sf, clean=True), cleaned=True).select("qid", "video_id", "title", "course", "url", "chunks_used", F.md5("context").alias("digest"), "first_pos")
    return _each(spark, sf, m)


@query
def merged_context_file(spark, sf) -> DataFrame:
    """Merged contexts as lines of JSON, compressed, as a text is in the context of every question that hits it; read again."""
    m = _each(spark, sf, X.merge_context(_hits(spark, sf, clean=True), cleaned=True).drop("first_pos"))
    path = f"{checkpoint_dir(spark)}/contexts-{uuid.uuid4().hex}"
    n = J.overwrite_jsonl(m, path, "gzip")
    return J.read_jsonl(spark, path, m.schema, strict=True).groupBy("qid").agg(F.count("*").alias("videos"), F.sum("chunks_used").alias("chunks")).withColumn("written", F.lit(n).cast("long"))


S["merged_context_file"] = _ALL + _lex_sql() + """, g AS (SELECT qid, coalesce(video_id, 'unknown') AS v, count(*) AS n FROM lex JOIN chunks ON chunk_id = doc GROUP BY ALL)
    SELECT qid, count(*) AS videos, sum(n) AS chunks, (SELECT count(*) FROM g) AS written FROM g GROUP BY 1"""


@query
def context_groups(spark, sf) -> DataFrame:
    """Chunks used and first position of each video of an answer's context."""
    return _each(spark, sf, X.merge_context(_hits(spark, sf), cleaned=True).select("qid", "video_id", "title", "chunks_used", "first_pos"))


S["context_groups"] = _ALL + _lex_sql() + """ SELECT qid, coalesce(video_id, 'unknown') AS video_id, arg_min(coalesce(title, '#null#'), rank) AS t, count(*) AS chunks_used, min(rank) AS first_pos FROM lex JOIN chunks ON chunk_id = doc GROUP BY ALL"""
S["context_groups"] = "SELECT qid, video_id, nullif(t, '#null#') AS title, chunks_used, first_pos FROM (" + S["context_groups"] + ")"


@query
def source_cards(spark, sf) -> DataFrame:
    return _each(spark, sf, X.source_cards(_hits(spark, sf)).select("qid", "rank", "doc", "title", "start_sec", "end_sec", "timestamp", "url", "thumbnail"))


S["source_cards"] = _ALL + _lex_sql() + """ SELECT qid, rank, doc, coalesce(title, '') AS title, CAST(trunc(start_time) AS INT) AS start_sec, CAST(trunc(end_time) AS INT) AS end_sec,
    lpad((CAST(floor(start_time) AS BIGINT) // 60)::VARCHAR, CAST(greatest(2, length((CAST(floor(start_time) AS BIGINT) // 60)::VARCHAR)) AS INT), '0') || ':' || lpad((CAST(floor(start_time) AS BIGINT) % 60)::VARCHAR, 2, '0') AS timestamp,
    CASE WHEN coalesce(url, '') = '' THEN 'https://youtu.be/' || video_id || '?t=' || CAST(trunc(start_time) AS BIGINT) ELSE url END AS url, 'https://img.youtube.com/vi/' || video_id || '/mqdefault.jpg' AS thumbnail FROM lex JOIN chunks ON chunk_id = doc"""


@query
def answer_prompts(spark, sf) -> DataFrame:
    """Prompts with the merged contexts as numbered sources."""
    m = X.merge_context(_hits(spark, sf, clean=True), cleaned=True).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("first_pos", "context"))).alias("c"))
    p = X.prompt(F.coalesce("text", F.lit("")), F.transform("c", lambda x: x["context"]))
    return _each(spark, sf, m.join(_asked(spark, sf, every=True), "qid").select("qid", F.size("c").alias("sources"), F.md5(p).alias("digest")))


@query
def substring_scan(spark, sf) -> DataFrame:
    """Chunks that name a term, in any case."""
    return chunks(spark, sf).where(F.lower("chunk_text").contains("beam search")).select("chunk_id")


S["substring_scan"] = f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE contains(lower(chunk_text), 'beam search')"

"""Queries over chunks: segments, packing, merging, ids, enrichment, reports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import language as L
from corpusloom.functions import rules as R
from corpusloom.functions import text as T
from corpusloom.operators import chunking as C
from corpusloom.operators import dedupe as D
from corpusloom.operators import plugins as M
from corpusloom.operators import reports as P
from corpusloom.operators import vectors as V
from corpusloom.operators.greedy import dense_positions
from corpusloom.plans.tables import ANSWERS, CHUNKS, WORDS, answers, chunks, table
from corpusloom.plans.retrieval import embed_sql
from corpusloom.session import checkpoint_dir, stable, written
from corpusloom.sources import jsonl as J

Q, S = {}, {}


def query(f):
    Q[f.__name__] = f
    return f


def _w(c: str) -> str:
    return WORDS.format(c=c)


@query
def token_estimates(spark, sf) -> DataFrame:
    c = F.col("chunk_text")
    return chunks(spark, sf).select("chunk_id", T.word_count(c).alias("words"), T.token_estimate(c).alias("tokens"), T.token_estimate(c, least=1).alias("tokens_v2"), T.token_estimate(c, 1.28).alias("tokens_enrich"))


S["token_estimates"] = f"""WITH {CHUNKS}, n AS (SELECT chunk_id, len({_w("coalesce(chunk_text, '')")}) AS w FROM chunks)
    SELECT chunk_id, w AS words, CAST(round_even(w * 1.3, 0) AS BIGINT) AS tokens, greatest(1, CAST(round_even(w * 1.3, 0) AS BIGINT)) AS tokens_v2,
    CAST(round_even(w * 1.28, 0) AS BIGINT) AS tokens_enrich FROM n"""

_SENT = r"""list_filter(list_transform(string_split(regexp_replace(coalesce(chunk_text, ''), '([.!?])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 3)"""


@query
def split_sentences(spark, sf) -> DataFrame:
    s = T.split_sentences(F.coalesce("chunk_text", F.lit("")))
    return chunks(spark, sf).select("chunk_id", F.posexplode(s).alias("i", "sentence")).select("chunk_id", F.col("i").cast("bigint").alias("i"), F.md5("sentence").alias("digest"), F.length("sentence").cast("bigint").alias("chars"))


S["split_sentences"] = f"""WITH {CHUNKS}, s AS (SELECT chunk_id, {_SENT} AS l FROM chunks), e AS (SELECT chunk_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM s)
    SELECT chunk_id, CAST(i AS BIGINT) AS i, md5(s) AS digest, length(s) AS chars FROM e"""


@query
def merge_short(spark, sf) -> DataFrame:
    s = C.merge_short(T.split_sentences(F.coalesce("chunk_text", F.lit(""))))
    return chunks(spark, sf).select("chunk_id", F.posexplode(s).alias("i", "s")).select("chunk_id", F.col("i").cast("bigint").alias("i"), F.md5("s").alias("digest"))


S["merge_short"] = f"""WITH RECURSIVE {CHUNKS}, s AS (SELECT chunk_id, {_SENT} AS l FROM chunks),
    f(chunk_id, l, n, i, cur) AS (SELECT chunk_id, l, 1, 0, l[1] FROM s WHERE len(l) > 0
    UNION ALL SELECT chunk_id, l, n + 1, CASE WHEN j THEN i ELSE i + 1 END, CASE WHEN j THEN cur || ' ' || l[n + 1] ELSE l[n + 1] END FROM
      (SELECT *, (suffix(cur, ',') OR suffix(cur, 'and') OR suffix(cur, 'or') OR suffix(cur, 'but') OR length(l[n + 1]) < 20 OR length(cur) < 20) AS j FROM f WHERE n < len(l)))
    SELECT chunk_id, CAST(i AS BIGINT) AS i, md5(arg_max(cur, n)) AS digest FROM f GROUP BY chunk_id, i"""


def _segments(spark, sf) -> DataFrame:
    return C.sentence_segments(chunks(spark, sf), merge=False)


_SEG = f"""s0 AS (SELECT video_id, chunk_index, start_time, end_time - start_time AS d, {_SENT} AS l FROM chunks),
    s1 AS (SELECT *, list_sum(list_transform(l, lambda x: length(x))) AS total FROM s0 WHERE len(l) > 0),
    s2 AS (SELECT video_id, chunk_index, generate_subscripts(l, 1) AS i, unnest(l) AS text, start_time, d, l, total FROM s1),
    seg AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY chunk_index, i) - 1 AS pos, text,
      floor((start_time + d * coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x))), 0) / total) * 1000 + 0.5) / 1000 AS start, floor(d * length(text) / total * 1000 + 0.5) / 1000 AS duration FROM s2),
    segs AS (SELECT *, floor((start + duration) * 1000 + 0.5) / 1000 AS "end" FROM seg)"""


@query
def time_split(spark, sf) -> DataFrame:
    return _segments(spark, sf).select("video_id", "pos", "start", "duration", "end", F.md5("text").alias("digest"))


S["time_split"] = f'WITH {CHUNKS}, {_SEG} SELECT video_id, pos, start, duration, "end", md5(text) AS digest FROM segs'


@query
def silence_gaps(spark, sf) -> DataFrame:
    """The pause after each segment, by an equi-join with the next position."""
    s = _segments(spark, sf).select("video_id", "pos", "start", "end")
    nxt = s.select("video_id", (F.col("pos") - 1).alias("pos"), F.col("start").alias("next_start"))
    return s.join(nxt, ["video_id", "pos"], "left").select("video_id", "pos", F.round(F.col("next_start") - F.col("end"), 3).alias("gap"))


S["silence_gaps"] = f'WITH {CHUNKS}, {_SEG} SELECT video_id, pos, round(lead(start) OVER (PARTITION BY video_id ORDER BY pos) - "end", 3) AS gap FROM segs'

_FOLD = """r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS rn, lead(start) OVER (PARTITION BY video_id ORDER BY pos) AS nxt FROM rows_)"""


@query
def pack_v3(spark, sf) -> DataFrame:
    return C.pack_v3(_segments(spark, sf)).select("video_id", F.col("span").cast("bigint").alias("chunk_index"), "segments", F.md5("raw_text").alias("digest"), "start_time", "end_time", "token_count", "chunk_type")


S["pack_v3"] = f"""WITH RECURSIVE {CHUNKS}, {_SEG}, rows_ AS (SELECT *, CAST(round_even(len({_w("text")}) * 1.3, 0) AS BIGINT) AS t, regexp_matches(trim(text), '[.!?]\\s*$') AS c FROM segs), {_FOLD},
    f(video_id, rn, chunk, tok, begin, done) AS (SELECT video_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), true FROM (SELECT DISTINCT video_id FROM r)
    UNION ALL SELECT video_id, rn, chunk, tok, begin, CASE WHEN tok >= 150 AND c THEN true WHEN tok >= 220 THEN true WHEN "end" - begin >= 90 THEN true
        WHEN tok >= 150 AND "end" - begin >= 20 AND nxt IS NOT NULL THEN nxt - "end" > 3 WHEN nxt IS NULL THEN true ELSE false END
      FROM (SELECT r.video_id, r.rn, r.c, r."end", r.nxt, CASE WHEN f.done THEN f.chunk + 1 ELSE f.chunk END AS chunk, CASE WHEN f.done THEN r.t ELSE f.tok + r.t END AS tok,
        CASE WHEN f.done THEN r.start ELSE f.begin END AS begin FROM f JOIN r ON r.video_id = f.video_id AND r.rn = f.rn + 1)),
    g AS (SELECT f.video_id, f.chunk, count(*) AS segments, string_agg(r.text, ' ' ORDER BY r.rn) AS raw, min(r.start) AS start_time, arg_max(r."end", r.rn) AS end_time FROM f JOIN r ON r.video_id = f.video_id AND r.rn = f.rn GROUP BY ALL),
    h AS (SELECT *, CAST(round_even(len({_w("raw")}) * 1.3, 0) AS BIGINT) AS token_count FROM g)
    SELECT video_id, chunk AS chunk_index, segments, md5(raw) AS digest, start_time, end_time, token_count, CASE WHEN token_count >= 150 THEN 'knowledge_unit' ELSE 'tail_short' END AS chunk_type FROM h"""

_NORM = r"""(SELECT upper(t[1:1]) || t[2:] FROM (SELECT trim(regexp_replace(regexp_replace(regexp_replace({c}, '[\s\p{{Z}}]+', ' ', 'g'), '\s+([,.;!?])', '\1', 'g'), '([,.;!?]){{2,}}', '\1', 'g'), ' -.,;:!?') AS t))"""


@query
def pack_v2(spark, sf) -> DataFrame:
    return C.pack_v2(_segments(spark, sf)).select("video_id", F.col("span").cast("bigint").alias("chunk_index"), "segments", F.md5("raw_text").alias("digest"), "start_time", "end_time")


S["pack_v2"] = f"""WITH RECURSIVE {CHUNKS}, {_SEG}, rows0 AS (SELECT video_id, pos, start, "end", {_NORM.format(c="text")} AS text FROM segs),
    rows_ AS (SELECT *, len({_w("text")}) AS w, greatest(1, CAST(round_even(len({_w("text")}) * 1.3, 0) AS BIGINT)) AS t FROM rows0 WHERE text <> ''), {_FOLD},
    f(video_id, rn, chunk, first, w, t, begin, done) AS (SELECT video_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), true FROM (SELECT DISTINCT video_id FROM r)
    UNION ALL SELECT video_id, rn, chunk, first, w, t, begin, w >= 160 OR t >= 180 OR ("end" - begin >= 90 AND w >= 50) OR nxt IS NULL OR (nxt - "end" > 8 AND w >= 50)
      FROM (SELECT r.video_id, r.rn, r."end", r.nxt, CASE WHEN f.done THEN f.chunk + 1 ELSE f.chunk END AS chunk,
        CASE WHEN f.done THEN greatest(f.first, r.rn - 2) ELSE f.first END AS first,
        CASE WHEN f.done THEN r.w + coalesce(CASE WHEN r.rn - 1 >= greatest(f.first, r.rn - 2) THEN p1.w END, 0) + coalesce(CASE WHEN r.rn - 2 >= greatest(f.first, r.rn - 2) THEN p2.w END, 0) ELSE f.w + r.w END AS w,
        CASE WHEN f.done THEN r.t + coalesce(CASE WHEN r.rn - 1 >= greatest(f.first, r.rn - 2) THEN p1.t END, 0) + coalesce(CASE WHEN r.rn - 2 >= greatest(f.first, r.rn - 2) THEN p2.t END, 0) ELSE f.t + r.t END AS t,
        CASE WHEN f.done THEN coalesce(CASE WHEN r.rn - 2 >= greatest(f.first, r.rn - 2) THEN p2.start END, CASE WHEN r.rn - 1 >= greatest(f.first, r.rn - 2) THEN p1.start END, r.start) ELSE f.begin END AS begin
        FROM f JOIN r ON r.video_id = f.video_id AND r.rn = f.rn + 1 LEFT JOIN r p1 ON p1.video_id = f.video_id AND p1.rn = r.rn - 1 LEFT JOIN r p2 ON p2.video_id = f.video_id AND p2.rn = r.rn - 2)),
    b AS (SELECT video_id, chunk, min(first) AS a, max(rn) AS z FROM f WHERE rn > 0 GROUP BY ALL)
    SELECT b.video_id, chunk AS chunk_index, count(*) AS segments, md5(string_agg(r.text, ' ' ORDER BY r.rn)) AS digest, min(r.start) AS start_time, arg_max(r."end", r.rn) AS end_time
    FROM b JOIN r ON r.video_id = b.video_id AND r.rn BETWEEN b.a AND b.z GROUP BY ALL"""


@query
def pack_v1(spark, sf) -> DataFrame:
    return C.pack_v1(_segments(spark, sf)).select("video_id", "span", "segments", F.md5("text").alias("digest"), "start_time", "end_time")


@query
def merge_lexical(spark, sf) -> DataFrame:
    rows = dense_positions(chunks(spark, sf), "video_id", "chunk_index").select("video_id", "pos", F.coalesce("chunk_text", F.lit("")).alias("text"), F.col("start_time").alias("start"), F.col("end_time").alias("end"))
    return C.merge_lexical(rows).select("video_id", F.col("span").cast("bigint").alias("chunk_index"), "segments", F.md5("raw_text").alias("digest"), "start_time", "end_time")


_BARE = r"""trim(regexp_replace(regexp_replace({c}, '\[.*?\]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'), ' -.,')"""


def _v1(c: str) -> str:
    t = f"replace({c}, chr(10), ' ')"
    for m in R.V1_MARKERS:
        t = f"replace({t}, '{m}', '')"
    return _BARE.format(c=t)


S["pack_v1"] = f"""WITH RECURSIVE {CHUNKS}, {_SEG}, rows0 AS (SELECT video_id, pos, start, "end", {_v1("text")} AS text FROM segs), rows_ AS (SELECT *, len({_w("text")}) AS w FROM rows0 WHERE len({_w("text")}) > 0), {_FOLD},
    f(video_id, rn, chunk, w, begin, done) AS (SELECT video_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), true FROM (SELECT DISTINCT video_id FROM r)
    UNION ALL SELECT video_id, rn, chunk, w, begin, "end" - begin >= 30 OR w >= 20 FROM (SELECT r.video_id, r.rn, r."end", CASE WHEN f.done THEN f.chunk + 1 ELSE f.chunk END AS chunk, CASE WHEN f.done THEN r.w ELSE f.w + r.w END AS w,
        CASE WHEN f.done THEN r.start ELSE f.begin END AS begin FROM f JOIN r ON r.video_id = f.video_id AND r.rn = f.rn + 1)),
    g AS (SELECT f.video_id, f.chunk, count(*) AS segments, string_agg(r.text, ' ' ORDER BY r.rn) AS raw, min(r.start) AS start_time, arg_max(r."end", r.rn) AS end_time FROM f JOIN r ON r.video_id = f.video_id AND r.rn = f.rn GROUP BY ALL),
    b AS (SELECT *, array_to_string(list_filter({_w("raw")}, lambda x: rtrim(lower(x), '.,!?') NOT IN ({", ".join(f"'{x}'" for x in R.V1_FILLERS)})), ' ') AS kept FROM g), h AS (SELECT *, {_v1("kept")} AS text FROM b)
    SELECT video_id, chunk AS span, segments, md5(text) AS digest, start_time, end_time FROM h WHERE len({_w("text")}) >= 10"""
_STARTS = lambda ps: "(" + " OR ".join(f"starts_with(lower(trim(text)), '{p.replace(chr(39), chr(39) * 2)}')" for p in ps) + ")"
S["merge_lexical"] = f"""WITH RECURSIVE {CHUNKS}, c0 AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY chunk_index) AS rn, coalesce(chunk_text, '') AS text, start_time AS s, end_time AS e FROM chunks),
    r AS (SELECT *, len({_w("text")}) AS w, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda x: length(x) > 2 AND x NOT IN ({", ".join(f"'{x}'" for x in R.STOPWORDS)}))) AS c, {_STARTS(R.CONTINUATIONS)} AS cont, {_STARTS(R.TOPIC_SHIFTS)} AS shift, regexp_matches(text, ':\\s*$') AS colon FROM c0),
    f(video_id, rn, chunk, w, begin, seen, colon) AS (SELECT video_id, rn, CAST(0 AS BIGINT), w, s, c, colon FROM r WHERE rn = 1
    UNION ALL SELECT video_id, rn, CASE WHEN j THEN chunk ELSE chunk + 1 END, CASE WHEN j THEN fw + w ELSE w END, CASE WHEN j THEN begin ELSE s END, CASE WHEN j THEN list_distinct(list_concat(seen, c)) ELSE c END, colon FROM
      (SELECT r.*, f.chunk, f.w AS fw, f.begin, f.seen, NOT (r.e - f.begin > 120 OR f.w + r.w > 250 OR (r.shift AND f.w >= 50)) AND (f.w < 50 OR r.w < 25 OR r.cont OR f.colon
        OR (len(f.seen) > 0 AND len(r.c) > 0 AND len(list_intersect(f.seen, r.c))::DOUBLE / len(list_distinct(list_concat(f.seen, r.c))) >= 0.05)) AS j FROM f JOIN r ON r.video_id = f.video_id AND r.rn = f.rn + 1))
    SELECT f.video_id, chunk AS chunk_index, count(*) AS segments, md5(string_agg(r.text, ' ' ORDER BY r.rn)) AS digest, min(r.s) AS start_time, arg_max(r.e, r.rn) AS end_time FROM f JOIN r ON r.video_id = f.video_id AND r.rn = f.rn GROUP BY ALL"""


@query
def merge_embedding(spark, sf) -> DataFrame:
    return C.merge_embedding(_with_similarity(spark, sf)).select("video_id", F.col("span").cast("bigint").alias("chunk_index"), "segments", "start_time", "end_time")


def _with_similarity(spark, sf) -> DataFrame:
    """Chunks in order with the cosine of each and the one before it, by equi-join."""
    v = table(spark, sf, "chunk_vectors").where("embedding is not null").select("chunk_id", "embedding").dropDuplicates(["chunk_id"])
    c = dense_positions(chunks(spark, sf), "video_id", "chunk_index").join(v, "chunk_id", "left")
    c = c.select("video_id", "pos", F.coalesce("chunk_text", F.lit("")).alias("text"), F.col("start_time").alias("start"), F.col("end_time").alias("end"), T.token_estimate(F.col("chunk_text")).alias("tokens"), "embedding")
    before = c.select("video_id", (F.col("pos") + 1).alias("pos"), F.col("embedding").alias("before"))
    sim = F.coalesce(V.cosine(F.col("embedding"), F.col("before")), F.lit(0.0))
    return c.join(before, ["video_id", "pos"], "left").withColumn("sim", sim).drop("embedding", "before")


S["merge_embedding"] = f"""WITH RECURSIVE {CHUNKS}, v AS (SELECT chunk_id, any_value(embedding::DOUBLE[]) AS e FROM chunk_vectors WHERE embedding IS NOT NULL GROUP BY chunk_id),
    r AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY chunk_index) AS rn, start_time, end_time, CAST(round_even(len({_w("coalesce(chunk_text, '')")}) * 1.3, 0) AS BIGINT) AS t,
      coalesce(CASE WHEN list_dot_product(e, e) > 0 AND list_dot_product(p, p) > 0 THEN list_dot_product(e, p) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(p, p))) END, 0) AS sim
      FROM (SELECT c.*, v.e, lag(v.e) OVER (PARTITION BY video_id ORDER BY chunk_index) AS p FROM chunks c LEFT JOIN v USING (chunk_id))),
    f(video_id, rn, chunk, t, begin) AS (SELECT video_id, rn, CAST(0 AS BIGINT), t, start_time FROM r WHERE rn = 1
    UNION ALL SELECT r.video_id, r.rn, CASE WHEN j THEN chunk ELSE chunk + 1 END, CASE WHEN j THEN ft + r.t ELSE r.t END, CASE WHEN j THEN begin ELSE r.start_time END FROM
      (SELECT r.*, f.chunk, f.t AS ft, f.begin, (r.sim >= 0.65 AND f.t + r.t <= 230 AND r.end_time - f.begin <= 120) AS j FROM f JOIN r ON r.video_id = f.video_id AND r.rn = f.rn + 1) r)
    SELECT f.video_id, chunk AS chunk_index, count(*) AS segments, min(r.start_time) AS start_time, arg_max(r.end_time, r.rn) AS end_time FROM f JOIN r ON r.video_id = f.video_id AND r.rn = f.rn GROUP BY ALL"""


@query
def boundary_similarity(spark, sf) -> DataFrame:
    """Cosine of adjacent chunks and whether it is a hot boundary."""
    s = _with_similarity(spark, sf).where("pos > 0")
    return s.select("video_id", "pos", F.round("sim", 6).alias("sim"), (F.col("sim") >= 0.85).alias("hot"))


S["boundary_similarity"] = f"""WITH {CHUNKS}, v AS (SELECT chunk_id, any_value(embedding::DOUBLE[]) AS e FROM chunk_vectors WHERE embedding IS NOT NULL GROUP BY chunk_id),
    r AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY chunk_index) - 1 AS pos, e, lag(e) OVER (PARTITION BY video_id ORDER BY chunk_index) AS p FROM chunks LEFT JOIN v USING (chunk_id)),
    x AS (SELECT video_id, pos, coalesce(CASE WHEN list_dot_product(e, e) > 0 AND list_dot_product(p, p) > 0 THEN list_dot_product(e, p) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(p, p))) END, 0) AS sim FROM r WHERE pos > 0)
    SELECT video_id, pos, round(sim, 6) AS sim, sim >= 0.85 AS hot FROM x"""


@query
def merge_statistics(spark, sf) -> DataFrame:
    """Chunks in and out, merges, reduction and quartiles of the similarities (exclusive method)."""
    s = _with_similarity(spark, sf)
    s = written(s)
    merged = C.merge_embedding(s)
    sims = s.where("pos > 0").select(F.round("sim", 6).alias("sim"))
    q = P.exclusive_quantiles(sims, "sim", [0.25, 0.5, 0.75])
    n_in, n_out = s.agg(F.count("*").alias("input_chunks")), merged.agg(F.count("*").alias("output_chunks"))
    avg = sims.agg(F.round(F.avg("sim"), 6).alias("mean"))
    out = n_in.crossJoin(n_out).crossJoin(q).crossJoin(avg)
    return out.withColumn("merges", F.col("input_chunks") - F.col("output_chunks")).withColumn("reduction_pct", F.round(100 * F.col("merges") / F.col("input_chunks"), 4))


_MERGED = S["merge_embedding"].replace("r.sim >= 0.65", "r.sim >= {t}")
_EXCL = "round(l[CAST(j{q} AS BIGINT)] + (l[CAST(j{q} AS BIGINT) + 1] - l[CAST(j{q} AS BIGINT)]) * ({p} * (n + 1) - j{q}), 6) AS q{q}"
S["merge_statistics"] = f"""WITH o AS (SELECT count(*) AS output_chunks FROM ({S['merge_embedding']})), b AS ({S['boundary_similarity']}), i AS (SELECT count(*) AS input_chunks FROM (SELECT DISTINCT chunk_id FROM transcript_v3)),
    s AS (SELECT list_sort(list(sim)) AS l, count(*) AS n, round(avg(sim), 6) AS mean FROM b), j AS (SELECT *, {", ".join(f"least(greatest(floor({p} * (n + 1)), 1), n - 1) AS j{q}" for p, q in ((0.25, 25), (0.5, 50), (0.75, 75)))} FROM s)
    SELECT input_chunks, output_chunks, {", ".join(_EXCL.format(p=p, q=q) for p, q in ((0.25, 25), (0.5, 50), (0.75, 75)))}, mean, input_chunks - output_chunks AS merges, round(100 * (input_chunks - output_chunks) / input_chunks, 4) AS reduction_pct FROM i, o, j"""
S["merge_sweep"] = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, count(*) AS chunks FROM ({_MERGED.replace('{t}', str(t))})" for t in (0.55, 0.65, 0.72, 0.80))


@query
def chunk_ids(spark, sf) -> DataFrame:
    """Ids by position in the video, 0-based and 1-based, and timed ids."""
    c = dense_positions(chunks(spark, sf), "video_id", "chunk_index")
    v, p = F.col("video_id"), F.col("pos")
    return c.select("chunk_id", T.chunk_id(v, F.col("chunk_type"), "v3", p).alias("v3"), F.format_string("%s_%04d", v, p + 1).alias("v4"), T.chunk_id(v, "time", "v2", p, F.col("start_time"), F.col("end_time")).alias("v2"), T.video_url(v, F.col("start_time")).alias("address"))


S["chunk_ids"] = f"""WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY chunk_index) - 1 AS p FROM chunks)
    SELECT chunk_id, video_id || ':' || chunk_type || ':v3:' || lpad(p::VARCHAR, 4, '0') AS v3, video_id || '_' || lpad((p + 1)::VARCHAR, 4, '0') AS v4,
    video_id || ':time:v2:' || lpad(p::VARCHAR, 4, '0') || ':' || lpad(CAST(round(start_time * 1000) AS BIGINT)::VARCHAR, 10, '0') || ':' || lpad(CAST(round(end_time * 1000) AS BIGINT)::VARCHAR, 10, '0') AS v2,
    'https://youtu.be/' || video_id || '?t=' || CAST(trunc(start_time) AS BIGINT)::VARCHAR AS address FROM r"""


@query
def time_formats(spark, sf) -> DataFrame:
    s = F.col("start_time")
    return chunks(spark, sf).select("chunk_id", T.clock(s).alias("always"), T.clock(s, True).alias("short"), T.clock(s, False).alias("minutes"))


S["time_formats"] = f"""WITH {CHUNKS}, t AS (SELECT chunk_id, CAST(floor(start_time) AS BIGINT) AS s FROM chunks), p AS (SELECT chunk_id, s, lpad((s // 3600)::VARCHAR, 2, '0') AS h, lpad((s % 3600 // 60)::VARCHAR, 2, '0') AS m, lpad((s % 60)::VARCHAR, 2, '0') AS x FROM t)
    SELECT chunk_id, h || ':' || m || ':' || x AS always, CASE WHEN s >= 3600 THEN h || ':' ELSE '' END || m || ':' || x AS short, CASE WHEN s // 60 < 100 THEN lpad((s // 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || x AS minutes FROM p"""


@query
def keywords_topics(spark, sf) -> DataFrame:
    c = F.col("chunk_text")
    k = T.keywords(c)
    return chunks(spark, sf).select("chunk_id", F.array_join(k, "|").alias("keywords"), F.array_join(T.keyword_hints(k), "|").alias("hints"), T.topic(c).alias("topic"))


def _has(k: str) -> str:
    return f"regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_]){k}($|[^\\p{{L}}\\p{{N}}_])')"


def _keyword_sql() -> str:
    """Chain of accepted keywords: each is added if found, not yet six, and not held by one accepted."""
    toks = {k: set(k.replace("-", " ").split()) for k in R.KEYWORDS}
    steps, names = ["k0 AS (SELECT chunk_id, t, []::VARCHAR[] AS a FROM low)"], list(R.KEYWORDS)
    for i, k in enumerate(names, 1):
        holders = [x for x in names[: i - 1] if toks[k] <= toks[x]]
        free = " AND ".join(f"NOT list_contains(a, '{x}')" for x in holders) or "true"
        steps.append(f"k{i} AS (SELECT chunk_id, t, CASE WHEN len(a) < 6 AND {free} AND {_has(k)} THEN list_append(a, '{k}') ELSE a END AS a FROM k{i - 1})")
    return ", ".join(steps)


def _topic_sql() -> str:
    scores = [f"({' + '.join(f'CAST({_has(k)} AS INT)' for k in ks)})" for ks in R.TOPICS.values()]
    best = f"greatest({', '.join(scores)})"
    whens = " ".join(f"WHEN {s} = {best} THEN '{name}'" for s, name in zip(scores, R.TOPICS))
    return f"CASE WHEN {best} = 0 THEN '{R.DEFAULT_TOPIC}' {whens} END"


_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in R.KEYWORDS.items()) + "}"
S["keywords_topics"] = f"""WITH {CHUNKS}, low AS (SELECT chunk_id, lower(coalesce(chunk_text, '')) AS t FROM chunks), {_keyword_sql()}, m AS (SELECT {_MAP} AS m),
    h AS (SELECT chunk_id, t, a, list_transform(a, lambda x: m[x]) AS v FROM k{len(R.KEYWORDS)}, m)
    SELECT chunk_id, array_to_string(a, '|') AS keywords, array_to_string(list_filter(v, lambda x, i: NOT list_contains(v[1:i - 1], x)), '|') AS hints, {_topic_sql()} AS topic FROM h"""


@query
def embedding_texts(spark, sf) -> DataFrame:
    e = T.embedding_text(F.col("course"), F.col("title"), F.col("chunk_text"), F.col("start_time"), F.col("end_time"))
    return chunks(spark, sf).select("chunk_id", e.alias("e")).select("chunk_id", F.md5("e").alias("digest"), T.token_estimate(F.col("e"), 1.28).alias("tokens"))


def _clock_sql(c: str) -> str:
    s = f"CAST(greatest(0, floor(coalesce({c}, 0))) AS BIGINT)"
    return f"CASE WHEN {s} >= 3600 THEN lpad(({s} // 3600)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad(({s} % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(({s} % 60)::VARCHAR, 2, '0')"


_CUTS = [f"CASE WHEN len(a) > 0 THEN 'Keywords: ' || array_to_string(a[1:greatest(len(a) - {i}, least(len(a), 3))], ', ') || chr(10) ELSE '' END" for i in range(4)]
_FIRST = "CASE WHEN len(a) > 0 THEN 'Keywords: ' || array_to_string(a, ', ') || chr(10) || 'Keywords (Vietnamese): ' || array_to_string(list_filter(v, lambda x, i: NOT list_contains(v[1:i - 1], x)), ', ') || chr(10) ELSE '' END"
S["embedding_texts"] = f"""WITH {CHUNKS}, low AS (SELECT chunk_id, lower(trim(coalesce(chunk_text, ''))) AS t FROM chunks), {_keyword_sql()}, m AS (SELECT {_MAP} AS m), h AS (SELECT chunk_id, t, a, list_transform(a, lambda x: m[x]) AS v FROM k{len(R.KEYWORDS)}, m),
    e AS (SELECT chunk_id, 'Course: ' || coalesce(course, 'Unknown') || chr(10) || 'Lecture: ' || coalesce(title, 'Unknown') || chr(10) || 'Time: ' || {_clock_sql("start_time")} || ' - ' || {_clock_sql("end_time")} || chr(10) || 'Topic: ' || {_topic_sql()} || chr(10) AS head,
      trim(coalesce(chunk_text, '')) AS body, a, v FROM h JOIN chunks USING (chunk_id)),
    l AS (SELECT chunk_id, list_transform([{_FIRST}, {", ".join(_CUTS)}], lambda k: head || k || chr(10) || 'Content:' || chr(10) || body) AS l FROM e),
    n AS (SELECT chunk_id, list_transform(l, lambda x: {{'x': x, 'n': CAST(round_even(len({_w("x")}) * 1.28, 0) AS BIGINT)}}) AS l FROM l), p AS (SELECT chunk_id, coalesce(list_filter(l, lambda x: x.n <= 240)[1], l[-1]) AS p FROM n)
    SELECT chunk_id, md5(p.x) AS digest, p.n AS tokens FROM p"""


@query
def embedding_ready(spark, sf) -> DataFrame:
    """Chunks as they go to the embedder: 16 columns with defaults, and the four lines of header before the text."""
    c = chunks(spark, sf)
    return T.embedding_ready(c, F.col("chunk_text")).select("chunk_id", "video_id", "title", "course", "playlist_id", "published_at", "source", "chunk_type", "chunk_index", "start_time", "end_time", "duration", "word_count", "token_estimate", F.md5("chunk_text").alias("text"), F.md5("embedding_text").alias("embedding"))


_DEF = ", ".join(f"coalesce({c}, '') AS {c}" for c in ("chunk_id", "video_id", "title", "course", "playlist_id", "published_at", "source", "chunk_type")) + ", " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("chunk_index", "start_time", "end_time", "duration", "word_count", "token_estimate"))
S["embedding_ready"] = f"""WITH {CHUNKS} SELECT {_DEF}, md5(coalesce(chunk_text, '')) AS text, md5('Course: ' || coalesce(course, 'Unknown') || chr(10) || 'Video: ' || coalesce(title, 'Unknown') || chr(10) || 'Source: ' || coalesce(source, 'Unknown') || chr(10)
    || 'Time: ' || {_clock_sql("start_time")} || ' - ' || {_clock_sql("end_time")} || chr(10) || chr(10) || coalesce(chunk_text, '')) AS embedding FROM chunks"""


@query
def evaluation_metadata(spark, sf) -> DataFrame:
    """The eight fields that the evaluation index keeps of a chunk."""
    e = lambda n: F.coalesce(F.col(n), F.lit("")).alias(n)
    return chunks(spark, sf).select(e("chunk_id"), e("video_id"), e("title"), e("course"), F.coalesce("start_time", F.lit(0.0)).alias("start_time"), F.coalesce("end_time", F.lit(0.0)).alias("end_time"), F.coalesce("token_estimate", F.lit(0)).alias("token_count"), e("chunk_type"))


S["evaluation_metadata"] = f"WITH {CHUNKS} SELECT coalesce(chunk_id, '') AS chunk_id, coalesce(video_id, '') AS video_id, coalesce(title, '') AS title, coalesce(course, '') AS course, coalesce(start_time, 0) AS start_time, coalesce(end_time, 0) AS end_time, coalesce(token_estimate, 0) AS token_count, coalesce(chunk_type, '') AS chunk_type FROM chunks"


@query
def title_topics(spark, sf) -> DataFrame:
    """Topics by the marks of titles, on the titles as they are and with a mark put in."""
    v = table(spark, sf, "videos").where("title is not null")
    marked = F.concat(F.lit("Course I "), F.col("title"))
    return v.select("video_id", T.extract_topic(marked).alias("topic"), T.extract_topic(F.concat(F.lit("CS V2"), F.col("title"))).alias("after_mark"))


S["title_topics"] = r"""WITH v AS (SELECT video_id, title, 'Course I ' || title AS m, 'CS V2' || title AS n FROM videos WHERE title IS NOT NULL)
    SELECT video_id, trim(regexp_replace(regexp_replace(trim(split_part(m, 'I ', 2)), '^[\p{L}\p{M}\p{N}_\s]+,\s*', ''), '\s+[\p{L}\p{M}\p{N}_]+ \d{4}$', '')) AS topic,
    CASE WHEN contains(n, 'I ') THEN trim(regexp_replace(regexp_replace(trim(split_part(n, 'I ', 2)), '^[\p{L}\p{M}\p{N}_\s]+,\s*', ''), '\s+[\p{L}\p{M}\p{N}_]+ \d{4}$', '')) ELSE trim(split_part(n, 'V2', 2)) END AS after_mark FROM v"""


@query
def distance_scores(spark, sf) -> DataFrame:
    """Similarities of adjacent chunks as each metric of a vector store would give them."""
    s = boundary_similarity(spark, sf)
    d = 2 - 2 * F.col("sim")
    return s.select("video_id", "pos", F.round(T.distance_similarity(F.col("sim"), "inner_product"), 6).alias("inner_product"), F.round(T.distance_similarity(1 - F.col("sim"), "cosine"), 6).alias("cosine"), F.round(T.distance_similarity(d, "l2"), 6).alias("l2"))


S["distance_scores"] = f"WITH b AS ({S['boundary_similarity']}) SELECT video_id, pos, sim AS inner_product, round(1 - (1 - sim), 6) AS cosine, round(1 / (1 + greatest(2 - 2 * sim, 0)), 6) AS l2 FROM b"


@query
def first_videos(spark, sf) -> DataFrame:
    """The chunks of the first ten videos by id: the limit of a trial run."""
    few = chunks(spark, sf).select("video_id").distinct().orderBy("video_id").limit(10)
    return D.named_in(chunks(spark, sf), few, "video_id").groupBy("video_id").agg(F.count("*").alias("chunks"))


S["first_videos"] = f"WITH {CHUNKS} SELECT video_id, count(*) AS chunks FROM chunks WHERE video_id IN (SELECT DISTINCT video_id FROM chunks ORDER BY video_id LIMIT 10) GROUP BY 1"


# files: each is written to the checkpoint folder and read again


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def jsonl_sources(spark, sf) -> DataFrame:
    """Chunks as lines of JSON, with broken lines, blank lines and rows without text among them: what the tolerant scan keeps, and what it keeps with a required column."""
    c = chunks(spark, sf).select("chunk_id", "video_id", "chunk_text")
    path, schema = _folder(spark, "jsonl"), "chunk_id string, video_id string, chunk_text string"
    broken = spark.createDataFrame([('{"chunk_id": "broken', ), ("", )], "value string")
    c.select(F.to_json(F.struct("*")).alias("value")).unionByName(broken).write.text(path)
    every, full = J.read_jsonl(spark, path, schema), J.read_jsonl(spark, path, schema, required="chunk_text")
    return every.join(full.select("chunk_id", F.lit(True).alias("full")), "chunk_id", "left").select("chunk_id", F.md5("chunk_text").alias("digest"), F.coalesce("full", F.lit(False)).alias("full"))


S["jsonl_sources"] = f"WITH {CHUNKS} SELECT chunk_id, md5(chunk_text) AS digest, coalesce(length(chunk_text) > 0, false) AS full FROM chunks"


@query
def query_files(spark, sf) -> DataFrame:
    """Questions as lines, as a JSON list, and as an object that holds the list."""
    q = table(spark, sf, "test_query").select("query_id", F.when(F.pmod(F.length("question"), F.lit(2)) == 0, F.col("question")).alias("query"), F.col("question").alias("question_vi"))
    one = F.to_json(F.struct("*"))
    listed = q.agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("value"))  # a query file is one value by its form
    base = _folder(spark, "queries")
    q.write.json(f"{base}/a.jsonl")
    listed.write.text(f"{base}/b.json")
    listed.select(F.concat(F.lit('{"queries": '), "value", F.lit("}")).alias("value")).write.text(f"{base}/c.json")
    rows = [J.read_queries(spark, f"{base}/{f}", q.schema).withColumn("file", F.lit(f)) for f in ("a.jsonl", "b.json", "c.json")]
    return reduce(DataFrame.unionByName, rows).select("file", "query_id", F.md5("text").alias("digest"))


S["query_files"] = "SELECT file, query_id, md5(question) AS digest FROM test_query, (SELECT unnest(['a.jsonl', 'b.json', 'c.json']) AS file)"


@query
def line_ledger(spark, sf) -> DataFrame:
    """Video ids added to a ledger of lines twice, read as a set; a ledger that is not there is empty."""
    path = _folder(spark, "ledger")
    J.append_ledger(table(spark, sf, "transcript_v3"), "video_id", path)
    J.append_ledger(table(spark, sf, "videos"), "video_id", path)
    return J.read_lines(spark, path).unionByName(J.read_lines(spark, path + "-none"))


S["line_ledger"] = "SELECT trim(video_id) AS value FROM transcript_v3 WHERE video_id <> '' UNION SELECT trim(video_id) FROM videos WHERE video_id <> ''"


@query
def appended_lines(spark, sf) -> DataFrame:
    """Playlists appended twice to a file of lines after videos overwrote it: rows, and what the overwrite counted."""
    path = _folder(spark, "lines")
    n = J.overwrite_jsonl(table(spark, sf, "videos").select(F.col("playlist_id").alias("id")), path)
    for _ in (1, 2):
        J.append_jsonl(table(spark, sf, "playlists").select(F.col("playlist_id").alias("id")), path)
    return J.read_jsonl(spark, path, "id string", strict=True).agg(F.count("*").alias("rows"), F.lit(n).cast("long").alias("overwritten"))


S["appended_lines"] = "SELECT (SELECT count(*) FROM videos) + 2 * (SELECT count(*) FROM playlists) AS rows, (SELECT count(*) FROM videos) AS overwritten"


@query
def cache_upsert(spark, sf) -> DataFrame:
    """A cache of requests, missing at first, into which deliveries are put in two goes; the last delivery of each wins."""
    path, schema = _folder(spark, "cache"), "request_id long, session_id string, top_k int"
    r = table(spark, sf, "ask_request").select("request_id", "session_id", "top_k", F.unix_micros("received_at").alias("at"))
    cache = J.upsert(J.read_table_or_empty(spark, path, schema), r.where("request_id % 2 = 0"), "request_id", "at")
    cache.write.parquet(path)
    return J.upsert(J.read_table_or_empty(spark, path, schema), r, "request_id", "at")


S["cache_upsert"] = "SELECT request_id, arg_max(session_id, received_at) AS session_id, arg_max(top_k, received_at) AS top_k FROM ask_request GROUP BY 1"


@query
def report_file(spark, sf) -> DataFrame:
    """A report with its configuration, written and read again."""
    path = _folder(spark, "report")
    J.report(P.bounds(chunks(spark, sf)), {"k": "5"}, counts_by_type(spark, sf), path)
    s = J.read_jsonl(spark, f"{path}/summary", "config struct<k:string>, aggregate struct<chunks:long,videos:long>", strict=True)
    rows = J.read_jsonl(spark, f"{path}/per_query", "chunk_type string, chunks long", strict=True)
    return s.select("config.k", "aggregate.chunks", "aggregate.videos").crossJoin(rows.agg(F.sum("chunks").alias("by_type")))


S["report_file"] = f"WITH {CHUNKS} SELECT '5' AS k, count(*) AS chunks, count(DISTINCT video_id) AS videos, count(*) AS by_type FROM chunks"


@query
def cleaned_texts(spark, sf) -> DataFrame:
    """Every cleaner over the chunks, as digests."""
    c = F.coalesce("chunk_text", F.lit(""))
    d = {"segment": T.clean_segment(c), "chunk": T.clean_chunk(c), "context": T.clean_context(c), "v1": T.remove_fillers(T.clean_v1(c)), "embedding": T.clean_embedding(c), "normal": T.normalize_text(c), "space": T.normalize_space(c)}
    return chunks(spark, sf).select("chunk_id", *[F.md5(x).alias(k) for k, x in d.items()])


@query
def normalized_texts(spark, sf) -> DataFrame:
    return chunks(spark, sf).select("chunk_id", F.md5(T.normalize_text(F.col("chunk_text"))).alias("normal"), F.md5(T.normalize_space(F.col("chunk_text"))).alias("space"))


S["normalized_texts"] = rf"""WITH {CHUNKS} SELECT chunk_id, md5({_NORM.format(c="coalesce(chunk_text, '')")}) AS normal, md5(trim(regexp_replace(coalesce(chunk_text, ''), '[\s\p{{Z}}]+', ' ', 'g'))) AS space FROM chunks"""


@query
def detect_language(spark, sf) -> DataFrame:
    asked = table(spark, sf, "ask_request").select("request_id", "query").distinct()
    d = L.detect(F.col("query"))
    return asked.select("request_id", d.alias("d")).select("request_id", "d.language", "d.confidence", "d.method", "d.is_uncertain", F.round("d.en_score", 6).alias("en_score"), F.round("d.vi_score", 6).alias("vi_score"))


@query
def playlist_urls(spark, sf) -> DataFrame:
    return table(spark, sf, "playlists").select("course", T.playlist_id(F.col("url")).alias("list_id"), (T.playlist_id(F.col("url")) == F.col("playlist_id")).alias("same"))


S["playlist_urls"] = "WITH p AS (SELECT *, CASE WHEN contains(url, 'list=') THEN split_part(split_part(url, 'list=', -1), '&', 1) END AS l FROM playlists) SELECT course, l AS list_id, l = playlist_id AS same FROM p"


# reports


@query
def chunk_bounds(spark, sf) -> DataFrame:
    return P.bounds(chunks(spark, sf))


S["chunk_bounds"] = f"""WITH {CHUNKS} SELECT count(*) AS chunks, count(DISTINCT video_id) AS videos, count(DISTINCT course) AS courses, count_if(token_estimate < 100) AS short, count_if(token_estimate > 250) AS long,
    count_if(duration > 120) AS slow, count_if(chunk_id IS NULL OR chunk_id = '') AS no_id, count_if(url IS NULL OR url = '') AS no_url, count(chunk_id) - count(DISTINCT chunk_id) AS repeated FROM chunks"""


@query
def counts_by_type(spark, sf) -> DataFrame:
    return chunks(spark, sf).groupBy("chunk_type").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "chunk_type")


S["counts_by_type"] = f"WITH {CHUNKS} SELECT chunk_type, count(*) AS chunks FROM chunks GROUP BY 1"


@query
def counts_by_video(spark, sf) -> DataFrame:
    return chunks(spark, sf).groupBy("video_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("chunk_text").isNull()).alias("empty"))


S["counts_by_video"] = f"WITH {CHUNKS} SELECT video_id, count(*) AS chunks, count_if(chunk_text IS NULL) AS empty FROM chunks GROUP BY 1"


@query
def distribution_summary(spark, sf) -> DataFrame:
    c = chunks(spark, sf)
    return P.summary(c.select(F.col("token_estimate").cast("double").alias("v")), "v").withColumn("field", F.lit("token_estimate")).unionByName(P.summary(c.select((F.col("end_time") - F.col("start_time")).alias("v")), "v").withColumn("field", F.lit("span")))


_SUM = """SELECT '{n}' AS field, count(v) AS n, min(v) AS min, l[1 + CAST(round_even(0.10 * (len(l) - 1), 0) AS INT)] AS p10, l[1 + CAST(round_even(0.25 * (len(l) - 1), 0) AS INT)] AS p25, l[1 + CAST(round_even(0.50 * (len(l) - 1), 0) AS INT)] AS p50, l[1 + CAST(round_even(0.95 * (len(l) - 1), 0) AS INT)] AS p95, quantile_cont(v, 0.5) AS median,
    l[1 + CAST(round_even(0.75 * (len(l) - 1), 0) AS INT)] AS p75, l[1 + CAST(round_even(0.90 * (len(l) - 1), 0) AS INT)] AS p90, l[1 + CAST(round_even(0.99 * (len(l) - 1), 0) AS INT)] AS p99, max(v) AS max, round(avg(v), 6) AS mean
    FROM (SELECT {e} AS v FROM chunks WHERE {e} IS NOT NULL), (SELECT list_sort(list({e})) AS l FROM chunks WHERE {e} IS NOT NULL) GROUP BY l"""
S["distribution_summary"] = f"WITH {CHUNKS} " + _SUM.format(n="token_estimate", e="CAST(token_estimate AS DOUBLE)") + " UNION ALL " + _SUM.format(n="span", e="(end_time - start_time)")


@query
def histogram(spark, sf) -> DataFrame:
    return P.histogram(chunks(spark, sf).select((F.col("end_time") - F.col("start_time")).alias("v")), "v", 10)


S["histogram"] = f"""WITH {CHUNKS}, v AS (SELECT end_time - start_time AS v FROM chunks), b AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
    SELECT CASE WHEN hi = lo THEN 0 ELSE least(9, CAST(floor((v - lo) / (hi - lo) * 10) AS INT)) END AS bin, count(*) AS n FROM v, b GROUP BY 1"""


@query
def similarity_shares(spark, sf) -> DataFrame:
    """Shares of adjacent pairs that are hot, warm or unrelated."""
    s = F.col("sim")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return boundary_similarity(spark, sf).agg(F.count("*").alias("pairs"), share(s >= 0.85).alias("hot"), share((s >= 0.75) & (s < 0.85)).alias("warm"), share(s < 0.30).alias("unrelated"))


S["similarity_shares"] = f"WITH b AS ({S['boundary_similarity']}) SELECT count(*) AS pairs, round(avg(CAST(sim >= 0.85 AS INT)), 6) AS hot, round(avg(CAST(sim >= 0.75 AND sim < 0.85 AS INT)), 6) AS warm, round(avg(CAST(sim < 0.30 AS INT)), 6) AS unrelated FROM b"


@query
def outliers(spark, sf) -> DataFrame:
    """The 30 hottest boundaries and the 30 least alike."""
    b = boundary_similarity(spark, sf)
    hot = b.orderBy(F.desc("sim"), "video_id", "pos").limit(30).withColumn("kind", F.lit("hot"))
    cold = b.orderBy("sim", "video_id", "pos").limit(30).withColumn("kind", F.lit("cold"))
    return hot.unionByName(cold).select("kind", "video_id", "pos", "sim")


S["outliers"] = f"WITH b AS ({S['boundary_similarity']}) SELECT * FROM (SELECT 'hot' AS kind, video_id, pos, sim FROM b ORDER BY sim DESC, video_id, pos LIMIT 30) UNION ALL SELECT * FROM (SELECT 'cold' AS kind, video_id, pos, sim FROM b ORDER BY sim, video_id, pos LIMIT 30)"


@query
def structure_verdict(spark, sf) -> DataFrame:
    """Shares of short, long, hot and incoherent against the accepted limits, as text."""
    b = P.bounds(chunks(spark, sf)).select((F.col("short") / F.col("chunks")).alias("short"), (F.col("long") / F.col("chunks")).alias("long"))
    hot = boundary_similarity(spark, sf).agg(F.avg((F.col("sim") >= 0.85).cast("int")).alias("hot"))
    inc = chunk_coherence(spark, sf).agg(F.avg(F.col("incoherent").cast("int")).alias("incoherent"))
    v = lambda c, limit, name: F.when(F.col(c) > limit, F.lit(f"too many {name}")).otherwise(F.lit("ok")).alias(f"{c}_verdict")
    every = b.crossJoin(hot).crossJoin(inc)  # one row each
    return every.select(v("short", 0.15, "short chunks"), v("long", 0.05, "long chunks"), v("hot", 0.10, "hot boundaries"), v("incoherent", 0.10, "incoherent chunks"))


_HALVES = f"""hw AS (SELECT chunk_id AS id, {_w("coalesce(chunk_text, '')")} AS w, list_filter(string_split(regexp_replace(coalesce(chunk_text, ''), '([.!?])[\\s\\p{{Z}}]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS s FROM chunks),
    hp AS (SELECT id, CASE WHEN len(s) >= 2 THEN s ELSE w END AS p FROM hw WHERE len(w) >= 30), hh AS (SELECT id, array_to_string(p[1:len(p) // 2], ' ') AS a, array_to_string(p[len(p) // 2 + 1:], ' ') AS b FROM hp)"""
S["chunk_coherence"] = f"""WITH {CHUNKS}, {_HALVES}, {embed_sql("hh", "id", "a", "ha")}, {embed_sql("hh", "id", "b", "hb")}, d AS (SELECT ha.k AS id, sum(ha.v * hb.v) AS d FROM ha JOIN hb USING (k, b) GROUP BY 1),
    c AS (SELECT hh.id, round(coalesce(d.d, 0) / (x.n * y.n), 6) AS coherence FROM hh JOIN ha_n x ON x.k = hh.id JOIN hb_n y ON y.k = hh.id LEFT JOIN d ON d.id = hh.id) SELECT hh.id, coalesce(coherence, 0) AS coherence, coalesce(coherence, 0) < 0.40 AS incoherent FROM hh LEFT JOIN c ON c.id = hh.id"""
S["structure_verdict"] = f"""WITH b AS ({S['chunk_bounds']}), h AS ({S['boundary_similarity']}), i AS ({S['chunk_coherence']})
    SELECT CASE WHEN short / chunks > 0.15 THEN 'too many short chunks' ELSE 'ok' END AS short_verdict, CASE WHEN long / chunks > 0.05 THEN 'too many long chunks' ELSE 'ok' END AS long_verdict,
    CASE WHEN (SELECT avg(CAST(sim >= 0.85 AS INT)) FROM h) > 0.10 THEN 'too many hot boundaries' ELSE 'ok' END AS hot_verdict, CASE WHEN (SELECT avg(CAST(incoherent AS INT)) FROM i) > 0.10 THEN 'too many incoherent chunks' ELSE 'ok' END AS incoherent_verdict FROM b"""


@query
def outlier_file(spark, sf) -> DataFrame:
    """The 30 hottest boundaries and the 30 least coherent chunks with their texts up to 200 characters, written as lines and read again."""
    text = dense_positions(chunks(spark, sf), "video_id", "chunk_index").select("video_id", "pos", "chunk_id", F.left(F.coalesce("chunk_text", F.lit("")), F.lit(200)).alias("text"))
    hot = boundary_similarity(spark, sf).orderBy(F.desc("sim"), "video_id", "pos").limit(30)
    hot = hot.join(text.select("video_id", (F.col("pos") + 1).alias("pos"), F.col("text").alias("text_a")), ["video_id", "pos"]).join(text.drop("chunk_id").withColumnRenamed("text", "text_b"), ["video_id", "pos"])
    bad = chunk_coherence(spark, sf).where("incoherent").orderBy("coherence", "id").limit(30).join(text.select(F.col("chunk_id").alias("id"), F.col("text").alias("text_a")), "id")
    rows = hot.select(F.lit("hot").alias("kind"), "video_id", "pos", F.col("sim").alias("value"), "text_a", "text_b").unionByName(bad.select(F.lit("incoherent").alias("kind"), "id", F.col("coherence").alias("value"), "text_a"), allowMissingColumns=True)
    path = f"{checkpoint_dir(spark)}/outliers-{uuid.uuid4().hex}"
    J.overwrite_jsonl(rows, path)
    return J.read_jsonl(spark, path, rows.schema, strict=True).select("kind", "video_id", "pos", "id", "value", F.md5("text_a").alias("text_a"), F.md5("text_b").alias("text_b"))


S["outlier_file"] = f"""WITH {CHUNKS}, t AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY chunk_index) - 1 AS pos, chunk_id, coalesce(chunk_text, '')[1:200] AS text FROM chunks), b AS ({S['boundary_similarity']}), c AS ({S['chunk_coherence']})
    SELECT 'hot' AS kind, x.video_id, x.pos, NULL AS id, x.sim AS value, md5(p.text) AS text_a, md5(q.text) AS text_b FROM (SELECT * FROM b ORDER BY sim DESC, video_id, pos LIMIT 30) x JOIN t p ON p.video_id = x.video_id AND p.pos = x.pos - 1 JOIN t q ON q.video_id = x.video_id AND q.pos = x.pos
    UNION ALL SELECT 'incoherent', NULL, NULL, x.id, x.coherence, md5(t.text), NULL FROM (SELECT * FROM c WHERE incoherent ORDER BY coherence, id LIMIT 30) x JOIN t ON t.chunk_id = x.id"""


# ledgers and deduplication


@query
def ledger_antijoin(spark, sf) -> DataFrame:
    """Videos of the corpus that the ledger lacks; the ledger holds those whose digest begins below 8."""
    done = table(spark, sf, "videos").where(F.substring(F.md5("video_id"), 1, 1) < "8")
    return D.not_in_ledger(chunks(spark, sf).select("video_id").distinct(), done, "video_id")


S["ledger_antijoin"] = "SELECT DISTINCT video_id FROM transcript_v3 t WHERE NOT EXISTS (SELECT 1 FROM videos v WHERE v.video_id = t.video_id AND md5(v.video_id)[1] < '8')"


@query
def semi_filter(spark, sf) -> DataFrame:
    """Chunks of the videos that questions name."""
    named = table(spark, sf, "test_query").select(F.col("source_video_id").alias("video_id"))
    return D.named_in(chunks(spark, sf), named, "video_id").groupBy("video_id").agg(F.count("*").alias("chunks"))


S["semi_filter"] = f"WITH {CHUNKS} SELECT video_id, count(*) AS chunks FROM chunks WHERE video_id IN (SELECT source_video_id FROM test_query) GROUP BY 1"


@query
def dedupe_last(spark, sf) -> DataFrame:
    """Requests: last delivery's values at the first delivery's place."""
    r = table(spark, sf, "ask_request").select("request_id", "session_id", "top_k", "received_at")
    return D.last_wins(r.withColumn("received_us", F.unix_micros("received_at")).drop("received_at"), "request_id", "received_us")


S["dedupe_last"] = "SELECT request_id, arg_max(session_id, received_at) AS session_id, arg_max(top_k, received_at) AS top_k, epoch_us(max(received_at)) AS received_us, epoch_us(min(received_at)) AS first_pos FROM ask_request GROUP BY 1"


@query
def duplicate_ids(spark, sf) -> DataFrame:
    return D.duplicate_keys(table(spark, sf, "transcript_v3"), "chunk_id")


S["duplicate_ids"] = "SELECT count(chunk_id) AS rows, count(DISTINCT chunk_id) AS keys, count(chunk_id) - count(DISTINCT chunk_id) AS beyond_first FROM transcript_v3"


@query
def stratified_sample(spark, sf) -> DataFrame:
    """Longer chunks of the two main types, by video, with a guaranteed least."""
    c = chunks(spark, sf).where(F.col("chunk_type").isin("knowledge_unit", "semantic_unit") & (T.word_count(F.col("chunk_text")) >= 30))
    return D.stratified(c, "chunk_id", "playlist_id", target=100).select("chunk_id", "playlist_id", "place")


S["stratified_sample"] = f"""WITH {CHUNKS}, e AS (SELECT chunk_id, playlist_id FROM chunks WHERE chunk_type IN ('knowledge_unit', 'semantic_unit') AND len({_w("coalesce(chunk_text, '')")}) >= 30),
    z AS (SELECT playlist_id, count(*) AS size FROM e GROUP BY 1), q AS (SELECT playlist_id, least(5, CAST(floor(100 / count(*) OVER ()) AS INT)) AS g, size, count(*) OVER () AS n, sum(size) OVER () AS total FROM z),
    k AS (SELECT playlist_id, CAST(g + round_even((130 - g * n) * size / total, 0) AS INT) AS quota FROM q),
    r AS (SELECT e.*, quota, row_number() OVER (PARTITION BY e.playlist_id ORDER BY md5('42:' || chunk_id), chunk_id) AS place FROM e JOIN k USING (playlist_id))
    SELECT chunk_id, playlist_id, place FROM r WHERE place <= quota"""


@query
def equal_share_sample(spark, sf) -> DataFrame:
    c = chunks(spark, sf).where("token_estimate >= 100 and playlist_id is not null")
    return D.equal_share(c, "chunk_id", "playlist_id", target=60).select("chunk_id", "playlist_id", "place")


S["equal_share_sample"] = f"""WITH {CHUNKS}, e AS (SELECT chunk_id, playlist_id FROM chunks WHERE token_estimate >= 100 AND playlist_id IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY md5('42:' || chunk_id), chunk_id) AS place FROM e)
    SELECT * FROM r WHERE place <= (SELECT greatest(1, 60 // count(DISTINCT playlist_id)) FROM e)"""


@query
def bernoulli_sample(spark, sf) -> DataFrame:
    """One per cent of the chunks of 200 to 800 characters, 50 at most."""
    return D.bernoulli(chunks(spark, sf), "chunk_id", "chunk_text").select("chunk_id")


S["bernoulli_sample"] = f"""WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE CAST('0x' || md5('42:' || chunk_id)[1:6] AS BIGINT) % 100 < 1 AND length(chunk_text) BETWEEN 200 AND 800 ORDER BY 1 LIMIT 50"""


@query
def citations(spark, sf) -> DataFrame:
    a = answers(spark, sf)
    c = F.col("answer")
    return a.select("answer_id", F.array_join(T.citations(c).cast("array<string>"), ",").alias("cited"), T.citation_confidence(c).alias("confidence"), F.md5(T.strip_citations(F.coalesce(c, F.lit("")))).alias("plain"), T.conversation_title(F.col("question")).alias("title"))


S["citations"] = rf"""WITH {ANSWERS}, a AS (SELECT answer_id, question, coalesce(answer, '') AS t, list_transform(regexp_extract_all(coalesce(answer, ''), '\[(\d{{1,3}})\]', 1), lambda x: CAST(x AS INT)) AS l FROM answers),
    d AS (SELECT *, list_filter(l, lambda x, i: NOT list_contains(l[1:i - 1], x)) AS u, {_w("question")} AS w FROM a)
    SELECT answer_id, array_to_string(u, ',') AS cited, CASE WHEN len(u) >= 2 THEN 'high' WHEN len(u) = 1 THEN 'medium' ELSE 'low' END AS confidence, md5(trim(regexp_replace(t, '\[\d+\]', '', 'g'))) AS plain,
    CASE WHEN len(w) > 6 THEN array_to_string(w[1:6], ' ') || '...' ELSE array_to_string(w, ' ') END AS title FROM d"""


@query
def regenerate_history(spark, sf) -> DataFrame:
    """Requests of a session before its last one: what stays when that is asked again."""
    r = table(spark, sf, "ask_request").select("session_id", "request_id", "requested_at").dropDuplicates(["request_id"])
    last = r.groupBy("session_id").agg(F.max(F.struct("requested_at", "request_id")).alias("last"))
    return r.join(last, "session_id").where(F.struct("requested_at", "request_id") < F.col("last")).select("session_id", "request_id")


S["regenerate_history"] = "WITH r AS (SELECT DISTINCT session_id, request_id, requested_at FROM ask_request) SELECT session_id, request_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY requested_at DESC, request_id DESC) AS n FROM r) WHERE n > 1"


@query
def course_filters(spark, sf) -> DataFrame:
    """The filter of each request as a list, whether it is a name or a JSON array."""
    r = table(spark, sf, "ask_request").select("request_id", "course_filter").dropDuplicates(["request_id"]).where("course_filter is not null")
    lst = F.when(F.trim("course_filter").startswith("["), F.from_json("course_filter", "array<string>")).otherwise(F.array("course_filter"))
    return r.select("request_id", F.explode(lst).alias("course"))


S["course_filters"] = """WITH r AS (SELECT DISTINCT request_id, course_filter FROM ask_request WHERE course_filter IS NOT NULL)
    SELECT request_id, unnest(CASE WHEN starts_with(trim(course_filter), '[') THEN from_json(course_filter, '["VARCHAR"]') ELSE [course_filter] END) AS course FROM r"""



@query
def chunk_coherence(spark, sf) -> DataFrame:
    """Cosine of the halves of each chunk by the hashing stand-in."""
    return M.coherence(chunks(spark, sf), "chunk_id", "chunk_text", M.hashing_embedder())


@query
def merge_sweep(spark, sf) -> DataFrame:
    """Chunks that remain at each merge threshold."""
    s = stable(_with_similarity(spark, sf))
    parts = [C.merge_embedding(s, t).agg(F.count("*").alias("chunks")).withColumn("threshold", F.lit(t)) for t in (0.55, 0.65, 0.72, 0.80)]
    return reduce(DataFrame.unionByName, parts)


@query
def document_projection(spark, sf) -> DataFrame:
    """Documents as the index takes them: a sure id and fields with defaults."""
    c = F.col
    e = lambda n: F.coalesce(c(n), F.lit("")).alias(n)
    return chunks(spark, sf).where(F.length("chunk_text") > 0).select(M.document_id(c("chunk_id"), c("video_id"), c("chunk_index"), c("chunk_index")).alias("doc_id"), e("title"), e("course"), e("playlist_id"), e("source"), e("url"), F.coalesce("start_time", F.lit(0.0)).alias("start_time"), F.left("chunk_text", F.lit(200)).alias("head"))


@query
def index_documents(spark, sf) -> DataFrame:
    """Every chunk as the index takes it: the whole text and all metadata, as recorded."""
    c = F.col
    return chunks(spark, sf).select(M.document_id(c("chunk_id"), c("video_id"), c("chunk_index"), c("chunk_index")).alias("doc_id"), c("chunk_text").alias("page_content"), "video_id", "chunk_id", "title", "course", "playlist_id", "published_at", "start_time", "end_time", "duration", "source", "chunk_type", c("token_estimate").alias("token_count"), "url")


S["index_documents"] = f"""WITH {CHUNKS} SELECT CASE WHEN chunk_id <> '' THEN chunk_id ELSE coalesce(video_id, 'unknown_video') || ':chunk:' || chunk_index END AS doc_id, chunk_text AS page_content, video_id, chunk_id, title, course,
    playlist_id, published_at, start_time, end_time, duration, source, chunk_type, token_estimate AS token_count, url FROM chunks"""


S["document_projection"] = f"""WITH {CHUNKS} SELECT CASE WHEN chunk_id <> '' THEN chunk_id ELSE coalesce(video_id, 'unknown_video') || ':chunk:' || chunk_index END AS doc_id, coalesce(title, '') AS title, coalesce(course, '') AS course,
    coalesce(playlist_id, '') AS playlist_id, coalesce(source, '') AS source, coalesce(url, '') AS url, coalesce(start_time, 0.0) AS start_time, substring(chunk_text, 1, 200) AS head FROM chunks WHERE length(chunk_text) > 0"""

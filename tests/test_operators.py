import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.operators import context, dedupe, evaluate, fusion, lexical, plugins, reports, vectors
from corpusloom.operators.greedy import Rule, dense_positions, greedy_spans
from corpusloom.operators.plugins import hashing_embedder
from corpusloom.operators.retriever import Retriever
from corpusloom.sources import jsonl


def up_to(limit, repeat):
    class UpTo(Rule):
        """Close once the weights reach a limit; the next span repeats some rows."""

        columns, overlap = ("w",), repeat

        def begin(self, c, i, carry):
            total = np.concatenate(([0], np.cumsum(c["w"])))
            return (total[i] - total[i - carry]).astype(float)[:, None]

        def take(self, c, k, acc):
            acc = acc + c["w"][k][:, None]
            return np.zeros(len(k), bool), acc[:, 0] >= limit, acc

    return UpTo()


def plain_walk(ws, overlap, limit):
    i, carry, want = 0, 0, []
    while i < len(ws):
        total, e = sum(ws[i - carry : i]), i
        while e < len(ws) and (e == i or total < limit):
            total += ws[e]
            e += 1
        want.append(list(range(i - carry, e)))
        i, carry = e, min(overlap, e - (i - carry))
    return want


@pytest.mark.parametrize("size, overlap", [(32, 2), (100, 0), (1000, 2)])
def test_greedy_spans_equal_a_plain_walk(spark, size, overlap):
    rng = random.Random(3)
    data = {k: [rng.randint(1, 9) for _ in range(n)] for k, n in (("a", 400), ("b", 1), ("c", 37), ("d", size), ("e", size + 1), ("f", size - 1))}
    data["zero"] = [0] * 150 + [30] + [0] * 90 + [5] * 9  # a span over many blocks
    data["same"] = [5] * 333  # spans of equal length: chains of different starts never meet
    rows = spark.createDataFrame([(k, i, w, f"{k}{i}") for k, ws in data.items() for i, w in enumerate(ws)] + [(None, 0, 1, "x")], "k string, pos long, w int, first_text string")
    mine = {}
    for r in greedy_spans(rows, "k", up_to(20, overlap), size=size).collect():
        mine.setdefault(r["k"], {}).setdefault(r["span"], []).append(r["pos"])
        assert r["first_text"] == f"{r['k']}{r['pos']}"
    assert set(mine) == set(data)
    for k, ws in data.items():
        want = plain_walk(ws, overlap, 20)
        assert sorted(mine[k]) == list(range(len(want))) and [sorted(mine[k][s]) for s in sorted(mine[k])] == want


def test_greedy_spans_lose_no_row_of_spans_longer_than_a_block(spark):
    rows = spark.createDataFrame([("a", i, 1 if i % 40 == 39 else 0) for i in range(200)], "k string, pos long, w int")
    rule = up_to(1, 0)
    got = greedy_spans(rows, "k", rule, size=32).collect()
    assert sorted(r["pos"] for r in got) == list(range(200)) and {(r["span"], r["first"]) for r in got} == {(i, 40 * i) for i in range(5)}
    assert greedy_spans(rows.limit(0), "k", rule, size=32).count() == 0


def test_dense_positions(spark):
    df = spark.createDataFrame([("a", 7), ("a", 100_000), ("a", 25_001), ("b", 3)], "k string, o long")
    assert {(r["k"], r["o"]): r["pos"] for r in dense_positions(df, "k", "o").collect()} == {("a", 7): 0, ("a", 25_001): 1, ("a", 100_000): 2, ("b", 3): 0}


def test_bm25_and_index_tables(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "red apple"), ("d2", "green apple pie"), ("d3", None), ("d4", "blue sky")], "id string, t string")
    q = spark.createDataFrame([("q", "Apple red"), ("n", None)], "qid string, text string")
    hits = [(r["doc"], r["rank"]) for r in lexical.search(docs, "id", "t", q).orderBy("rank").collect()]
    assert hits == [("d1", 1), ("d2", 2)]
    ix = lexical.PostingsIndex.load_or_build(spark, str(tmp_path / "ix"), docs, "id", "t")
    again = [(r["doc"], r["rank"]) for r in lexical.search(docs, "id", "t", q, index=ix).orderBy("rank").collect()]
    assert again == hits


def _bm25(docs, asked, k):
    """Okapi scores in plain Python; rows of one id are one document with a length per row."""
    lens, tf = {}, {}
    for d, t in docs:
        ws = (t or "").lower().split()
        lens.setdefault(d, []).append(len(ws))
        for w in ws:
            tf.setdefault(w, {}).setdefault(d, 0)
            tf[w][d] += 1
    every = [x for xs in lens.values() for x in xs]
    n, avg = len(every), sum(every) / len(every)
    raw = {w: math.log(n - len(ds) + 0.5) - math.log(len(ds) + 0.5) for w, ds in tf.items()}
    mean = sum(raw.values()) / len(raw)
    out = {}
    for q, t in asked:
        got = {}
        for w in (t or "").lower().split():
            for d, f in tf.get(w, {}).items():
                got[d] = got.get(d, 0) + sum((0.25 * mean if raw[w] < 0 else raw[w]) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * x / avg)) for x in lens[d])
        out[q] = sorted(((d, round(x, 6)) for d, x in got.items()), key=lambda y: (-y[1], y[0]))[:k]
    return out


def test_bm25_blocks_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    common, rare = ["the", "of", "net"], [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(n))
    docs = [(f"d{i:03d}", text(rng.randint(0, 12))) for i in range(200)] + [("d003", "the w1 w2"), ("d900", None)]
    docs += [(f"e{i}", docs[7][1]) for i in range(9)]  # equal scores
    asked = [(f"q{i}", text(6)) for i in range(25)] + [("same", "the w1"), ("twin", "w1 the"), ("none", None), ("unknown", "zzz")]
    df, q = spark.createDataFrame(docs, "id string, t string"), spark.createDataFrame(asked, "qid string, text string")
    want = {a: v for a, v in _bm25(docs, asked, 5).items() if v}

    def ranked(rows):
        got = {}
        for r in rows:
            got.setdefault(r["qid"], []).append((r["doc"], r["score"]))
        return {a: sorted(v, key=lambda y: (-y[1], y[0]))[:5] for a, v in got.items()}

    hits = lexical.search(df, "id", "t", q, 5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan  # no postings are joined or shuffled
    near = lambda a: {k: [(d, pytest.approx(s, abs=2e-6)) for d, s in v] for k, v in a.items()}
    assert ranked(hits.collect()) == near(want)
    # many blocks of a task, the bound of earlier blocks among them
    kept = {}
    scorer = lexical._Scorer
    monkeypatch.setattr(lexical, "_Scorer", lambda *a: kept.setdefault("s", scorer(*a)))
    ix = lexical.PostingsIndex(df, "id", "t")
    lexical.search(None, "id", "t", q, 5, index=ix)
    monkeypatch.setattr(lexical, "DOC_BLOCK", 16)
    blocks = list(kept["s"](ix._tokens().select("doc", "t", "lens").toArrow().to_batches(16)))
    assert len(blocks) > 10 and ranked(r for b in blocks for r in b.to_pylist()) == near(want)
    assert all(len([1 for x in b.column(0).to_pylist() if x == "same"]) <= 5 for b in blocks)


def test_words_split_by_the_tasks_are_those_of_the_expression(spark):
    chars = [chr(c) for c in range(1, 0x3100)] + ["\u180e", "\ufeff", "\U0001f600"]
    odd = [f"a{c}b" for c in chars if not "\x1c" <= c <= "\x1f"]
    for texts in (["", " ", "a", " a  b ", "x\n\ty ", "e\u0301 \u3000 z", *odd], ["a\x1cb \x1f c\u2028d", "\x1e", *odd]):
        df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc string, text string").coalesce(1)
        want = df.select(lexical.tokens(F.col("text"), False)).toArrow().column(0).to_pylist()
        got = [r for b in lexical._split(iter(df.toArrow().to_batches())) for r in b.to_pylist()]
        assert [r["t"] for r in got] == want and [r["lens"] for r in got] == [[len(t)] for t in want]


def test_blocks_hold_numbers_of_asked_words_alone(spark):
    asked = spark.createDataFrame([("q", "pie", 1.0, False), ("q", "sky", 2.0, False)], "qid string, term string, weight double, often boolean")
    scorer = lexical._Scorer(asked.toArrow(), 2.0, 3)
    df = spark.createDataFrame([("d1", "red pie sky pie"), ("d2", ""), ("d3", "green"), ("d4", "sky")], "doc string, text string").coalesce(1)
    got = [r for b in lexical._split(iter(df.toArrow().to_batches())) for r in scorer._coded(b).to_pylist()]
    words = scorer.vocabulary.to_pylist()
    assert [[words[i] for i in r["t"]] for r in got] == [["pie", "sky", "pie"], [], [], ["sky"]]
    assert [r["lens"] for r in got] == [[4], [0], [1], [1]]  # lengths count every word


def test_index_holds_terms_once_by_document_and_vectors_when_asked(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "Red red pie"), ("d2", None), ("d3", "pie")], "doc string, text string")
    path = str(tmp_path / "ix")
    ix = Retriever.build(docs, path, hashing_embedder())
    assert {r["term"]: r["df"] for r in ix.postings.terms.collect()} == {"red": 1, "pie": 2}
    assert tuple(ix.postings.totals.first()) == (3, 4 / 3)
    q = spark.createDataFrame([("q", "pie")], "qid string, text string")
    assert ix.lexical_hits(q).count() == 2 and not (tmp_path / "ix" / "vectors").exists()  # a lexical search pays for no vectors
    assert ix.dense_hits(q).count() == 2 and (tmp_path / "ix" / "vectors").exists()
    again = Retriever.read(spark, path, hashing_embedder())
    assert again.dense.count() == 3


def test_dense_search_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    rows = [(f"v{i:02d}", [float(v) for v in r]) for i, r in enumerate(x)] + [("z", [0.0] * 8), ("n", None), ("v00", [float(v) for v in x[0]])]
    df = spark.createDataFrame(rows, "id string, e array<double>")
    q = df.where("id in ('v03', 'v07', 'z')").select(F.col("id").alias("qid"), F.col("e").alias("vec"))
    got = {}
    for r in vectors.search(df, "id", "e", q, 5).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["doc"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for k in (3, 7):
        want = [f"v{i:02d}" for i in np.argsort(-(u @ u[k]))[:5]]
        assert [got[f"v{k:02d}"][r] for r in range(1, 6)] == want
    assert set(got) == {"v03", "v07"}


def test_dense_batches_keep_what_reaches_the_best_so_far(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    names = [f"v{i:03d}" for i in range(390)] + [f"v{i:03d}" for i in range(10)]  # ten ids come again, in other batches
    df = spark.createDataFrame([(n, [float(v) for v in r]) for n, r in zip(names, x)], "id string, e array<double>").coalesce(1)
    asked = rng.normal(size=(300, 4))
    q = spark.createDataFrame([(f"q{i:03d}", [float(v) for v in r]) for i, r in enumerate(asked)], "qid string, vec array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got, rows = {}, vectors.search(df, "id", "e", q, 3).collect()
        block = [(r["qid"], r["vec"]) for r in q.collect()]
        moved = vectors._scan(df, "id", "e", block, 3, False).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for r in rows:
        got.setdefault(r["qid"], {})[r["rank"]] = r["doc"]
    u, v = x / np.linalg.norm(x, axis=1, keepdims=True), asked / np.linalg.norm(asked, axis=1, keepdims=True)
    for i in range(300):
        score = {}
        for n, s in zip(names, np.round(u @ v[i], 6)):
            score[n] = max(score.get(n, -9), s)
        want = sorted(score, key=lambda n: (-score[n], n))[:3]
        assert [got[f"q{i:03d}"][r] for r in (1, 2, 3)] == want
    assert moved < 300 * 3 * 20 / 2  # of 20 batches


def _hits(spark, rows):
    return spark.createDataFrame(rows, "qid string, doc string, score double, rank int")


def test_fusion(spark):
    lex, den = _hits(spark, [("q", "a", 3.0, 1), ("q", "b", 3.0, 2)]), _hits(spark, [("q", "b", 0.9, 1), ("q", "c", 0.1, 2)])
    w = {r["doc"]: r["final"] for r in fusion.fuse_weighted(lex, den, 0.3, 0.7).collect()}
    assert w == {"a": 0.15, "b": 0.85, "c": 0.0}
    r = {x["doc"]: x["rank"] for x in fusion.fuse_rrf(lex, den).collect()}
    assert r == {"b": 1, "a": 2, "c": 3}
    with pytest.raises(ValueError):
        fusion.fuse_weighted(lex, den, 0.5, 0.9)


def test_variants(spark):
    rows = [("q", "a", 1.0, 2, "original", 1), ("q", "a", 2.0, 1, "q2", 0), ("q", "b", 1.0, 1, "original", 1)]
    h = spark.createDataFrame(rows, "qid string, doc string, score double, rank int, variant string, variant_ord int")
    m = {r["doc"]: (r["score"], r["retrieved_by"], r["rank"]) for r in fusion.merge_variants(h).collect()}
    assert m == {"a": (2.0, ["q2", "original"], 1), "b": (1.0, ["original"], 2)}


def test_context(spark):
    h = spark.createDataFrame([("q", 1, "v", "T", "C", "u", 9.0, "later text"), ("q", 2, "v", "X", "C", "u", 1.0, "the the first"), ("q", 3, None, None, None, None, None, "")], "qid string, pos int, video_id string, title string, course string, url string, start_time double, text string")
    got = {r["video_id"]: (r["title"], r["chunks_used"], r["context"]) for r in context.merge_context(h).collect()}
    assert got == {"v": ("T", 2, "the first later text"), "unknown": (None, 1, "")}


def test_equal_questions_are_searched_once(spark, tmp_path, monkeypatch):
    from corpusloom.operators import lexical as L
    from corpusloom.plans import registry

    q = [("q1", "red apple", "a"), ("q2", "blue sky", None), ("q3", "red apple", "b"), ("q4", None, "c"), ("q5", "red apple", None)]
    rows = [(i, t, f"v{i[0]}", f"{i[0]}:{i}") for i, t in (("a", "um red apple okay pie"), ("b", "the the apple"), ("c", None), ("d", "blue sea"))]
    cols = ["chunk_index int", "title string", "course string", "playlist_id string", "published_at string", "source string", "chunk_type string", "start_time double", "end_time double", "duration double", "word_count int", "token_estimate int", "embedding_text string", "ingested_at timestamp"]
    t = spark.createDataFrame([r[:3] + r[3:] for r in rows], "chunk_id string, chunk_text string, video_id string, url string")
    for c in cols:
        name, kind = c.split()
        t = t.withColumn(name, F.lit(None).cast(kind))
    t.write.parquet(f"{tmp_path}/transcript_v3.parquet")
    spark.createDataFrame([(a, b, c, None) for a, b, c in q], "query_id string, question string, source_chunk_id string, source_video_id string").write.parquet(f"{tmp_path}/test_query.parquet")
    asked, search = [], L.search
    monkeypatch.setattr(L, "search", lambda *a, **k: asked.append(sorted(r["qid"] for r in a[3].collect())) or search(*a, **k))
    sf, named = str(tmp_path), registry.queries()
    for name in ("answer_prompts", "context_groups", "merged_context_file", "source_cards", "relevance_lookup"):
        got = {}
        for r in named[name](spark, sf).collect():
            got.setdefault(r["qid"], []).append(tuple(r[1:]))
        assert set(got) == {"q1", "q2", "q3", "q5"} and sorted(map(len, got.values())) in ([1, 1, 1, 1], [1, 2, 2, 2])
        if name != "relevance_lookup":  # gains are a question's own
            assert sorted(got["q1"], key=repr) == sorted(got["q3"], key=repr) == sorted(got["q5"], key=repr)
    assert asked == [["q1", "q2", "q4"]] * 5
    gains = {(r["qid"], r["doc"]): r["gain"] for r in named["relevance_lookup"](spark, sf).collect()}
    assert gains == {("q1", "a"): 2.0, ("q1", "b"): 0.0, ("q2", "d"): 0.0, ("q3", "a"): 0.0, ("q3", "b"): 2.0, ("q5", "a"): 0.0, ("q5", "b"): 0.0}


def test_merged_context_file_is_compressed(spark, tmp_path, monkeypatch, sf):
    """A text is in the context of every question that hits it: as plain lines the file was larger than the tables."""
    from corpusloom.plans import retrieval

    df = spark.createDataFrame([("a", "x" * 9000), ("b", None)], "k string, t string")
    plain, packed = str(tmp_path / "plain"), str(tmp_path / "packed")
    assert jsonl.overwrite_jsonl(df, plain) == jsonl.overwrite_jsonl(df, packed, "gzip") == 2
    assert sorted(map(tuple, jsonl.read_jsonl(spark, packed, df.schema, strict=True).collect())) == sorted(map(tuple, df.collect()))
    monkeypatch.setattr(retrieval, "checkpoint_dir", lambda s: str(tmp_path))
    assert retrieval.merged_context_file(spark, sf).count()
    files = [p for p in tmp_path.glob("contexts-*/part-*") if p.stat().st_size]
    assert files and all(p.name.endswith(".json.gz") for p in files)


def test_reports(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    s = reports.summary(df, "v").first()
    assert (s["n"], s["p25"], s["median"], s["p90"], s["mean"]) == (10, 3.0, 5.5, 9.0, 5.5)
    assert reports.exclusive_quantiles(df, "v", [0.25]).first()[0] == 2.75
    assert {r["bin"]: r["n"] for r in reports.histogram(df, "v", 3).collect()} == {0: 3, 1: 3, 2: 4}
    assert reports.summary(df.limit(0), "v").first()["n"] == 0


def test_rank_metrics(spark):
    hits = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 6)], "qid string, doc string, rank int")
    rel = spark.createDataFrame([("q", "d2", 1.0), ("q", "d4", 1.0), ("m", "x", 1.0)], "qid string, doc string, gain double")
    r = {x["qid"]: x for x in evaluate.rank_metrics(hits, rel, (3, 5)).collect()}
    assert (r["q"]["hit_3"], r["q"]["recall_3"], r["q"]["ap_5"], r["q"]["rr_5"]) == (1.0, 0.5, 0.5, 0.5)
    assert r["m"]["hit_5"] == 0.0 and r["m"]["ndcg_5"] == 0.0


def test_answer_metrics(spark):
    df = spark.createDataFrame([("a", "the cat sat down", "the cat sat down"), ("b", "dogs run", "the cat sat down"), ("c", None, "x"), ("d", "", "")], "id string, a string, g string")
    a, g = F.col("a"), F.col("g")
    got = {r["id"]: r for r in df.select("id", evaluate.exact_match(a, g).alias("e"), evaluate.string_presence(a, g).alias("p"), evaluate.rouge_n(a, g, 2).alias("r2"), evaluate.bleu(a, g).alias("b")).collect()}
    assert (got["a"]["e"], got["a"]["p"], got["a"]["r2"]) == (1.0, 1.0, 1.0) and got["a"]["b"] == pytest.approx(1.0)
    assert (got["b"]["e"], got["b"]["p"], got["b"]["r2"], got["b"]["b"]) == (0.0, 0.0, 0.0, 0.0)
    assert got["d"]["e"] == 1.0 and got["c"]["b"] == 0.0
    assert {r[0]: r[1] for r in evaluate.rouge_l(df, "id", "a", "g").collect()} == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0}


def test_judged(spark):
    j = spark.createDataFrame([("q", 1, True, 2, 2), ("q", 2, False, 0, 3), ("q", 3, True, 5, 4)], "qid string, rank int, useful boolean, relevant_sentences int, total_sentences int")
    r = evaluate.context_precision(j).first()
    assert (r["context_precision"], r["context_relevancy"]) == (0.833333, 0.666667)
    c = spark.createDataFrame([("q", [("x", True), ("y", False)]), ("n", [])], "qid string, claims array<struct<text:string,supported:boolean>>")
    assert {x["qid"]: x["supported"] for x in evaluate.claim_support(c).collect()} == {"q": 0.5, "n": 0.0}
    assert spark.range(1).select(evaluate.entity_recall(F.array(F.lit("BERT"), F.lit("GPT")), F.lit("we use bert"))).first()[0] == 0.5


def test_dedupe(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("b", 2, "x")], "k string, o int, v string")
    got = {r["k"]: (r["v"], r["first_pos"]) for r in dedupe.last_wins(df, "k", "o").collect()}
    assert got == {"a": ("new", 1), "b": ("x", 2)}
    with pytest.raises(ValueError, match="duplicate k"):
        dedupe.assert_unique(df, "k")


def test_jsonl_and_pages(spark, tmp_path):
    from corpusloom.sources import jsonl, paged

    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "t": "x"}\n\nbroken\n{"a": 2, "t": ""}\n')
    assert jsonl.read_jsonl(spark, str(p), "a int, t string").count() == 2
    assert jsonl.read_jsonl(spark, str(p), "a int, t string", required="t").count() == 1
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(p), "a int, t string", strict=True).collect()
    assert jsonl.read_lines(spark, str(tmp_path / "none")).count() == 0
    assert jsonl.overwrite_jsonl(spark.range(5), str(tmp_path / "out")) == 5
    cache = spark.createDataFrame([("q", "1", "2")], "query string, q1 string, q2 string")
    qs = spark.createDataFrame([("q",), ("new",)], "query string")
    got = {r["query"]: (r["q1"], r["q2"], r["cached"]) for r in jsonl.cached(qs, cache, "query", F.concat("query", F.lit(" machine learning"))).collect()}
    assert got == {"q": ("1", "2", True), "new": ("new", "new machine learning", False)}
    item = lambda v, kind="youtube#video": {"snippet": {"title": v, "publishedAt": "d", "resourceId": {"kind": kind, "videoId": v}}}
    (tmp_path / "L.first.json").write_text(json.dumps({"items": [item("a"), item("p", "youtube#list")], "nextPageToken": "2"}))
    (tmp_path / "L.2.json").write_text(json.dumps({"items": [item("b"), item("a")]}))
    rows = paged.playlist_videos(spark, paged.file_pages(str(tmp_path)), ["L"]).collect()
    assert {r["video_id"]: r["place"] for r in rows} == {"a": 0, "b": 2}


def test_tracks(spark):
    from corpusloom.sources.paged import pick_track

    t = spark.createDataFrame([("v", "en", True, ["s"] * 60), ("v", "en-US", False, ["s"] * 55), ("w", "vi", False, ["s"] * 90), ("x", "en", True, ["s"])], "video_id string, language string, is_generated boolean, segments array<string>")
    got = {r["video_id"]: (r["status"], r["language"]) for r in pick_track(t).collect()}
    assert got == {"v": ("success", "en-US"), "w": ("no_en", None), "x": ("too_short", "en")}


def test_streams(spark, tmp_path):
    from corpusloom.streaming import ingest

    src = tmp_path / "in"
    spark.createDataFrame([("a", i, "blocked") for i in range(5)] + [("b", 1, "blocked"), ("b", 2, "ok")], "k string, o int, s string").coalesce(1).write.parquet(str(src))
    out = ingest.run_available(ingest.stop_signals(ingest.parquet_stream(spark, str(src)), "k", "o", "s"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert [tuple(r) for r in out.collect()] == [("a", 4)]
    for _ in range(2):
        ingest.ingest(ingest.parquet_stream(spark, str(src)), str(tmp_path / "rows"), str(tmp_path / "ledger"), "k", str(tmp_path / "cp"))
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == ["a", "b"]


def test_plugins(spark):
    from corpusloom.operators import plugins

    df = spark.createDataFrame([("a", "one two. one two. " * 10), ("s", "too short"), ("n", None)], "id string, t string")
    got = {r["id"]: (r["coherence"], r["incoherent"]) for r in plugins.coherence(df, "id", "t", plugins.hashing_embedder()).collect()}
    assert got == {"a": (1.0, False)}
    row = spark.createDataFrame([("o", "", "e", None, None, 3)], "o string, l string, e string, c string, v string, i int")
    r = row.select(plugins.rerank_query(F.col("o"), F.col("l"), F.col("e")).alias("q"), plugins.document_id(F.col("c"), F.col("v"), F.col("i"), F.lit(9)).alias("d")).first()
    assert tuple(r) == ("e", "unknown_video:chunk:3")


def test_search_with_one_id_repeated_in_a_batch(spark):
    from corpusloom.operators import vectors

    rows = [("hot", [1.0, 0.0])] * 60 + [(f"d{i}", [1.0, 0.1 * (i + 1)]) for i in range(5)]
    df = spark.createDataFrame(rows, "id string, vec array<float>").coalesce(1)
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, vec array<float>")
    got = vectors.search(df, "id", "vec", q, 4).orderBy("rank").collect()
    assert [(r["doc"], r["rank"]) for r in got] == [("hot", 1), ("d0", 2), ("d1", 3), ("d2", 4)]


def test_dense_search_counts_many_deliveries_of_an_id_once(spark):
    rng = np.random.default_rng(5)
    rows = [("a", [1.0, 0.0, 0.0])] * 20 + [(f"b{i}", [1.0, float(x), float(y)]) for i, (x, y) in enumerate(rng.normal(size=(7, 2)))]
    df = spark.createDataFrame(rows, "id string, e array<double>").coalesce(1)
    got = vectors.search(df, "id", "e", df.where("id = 'b0'").select(F.lit("q").alias("qid"), F.col("e").alias("vec")), 5).collect()
    assert len(got) == 5 and len({r["doc"] for r in got}) == 5


def test_upsert_keeps_the_last(spark, tmp_path):
    old = spark.createDataFrame([("a", 0), ("b", 0)], "k string, v int")
    new = spark.createDataFrame([("a", 2, 2), ("a", 1, 1), ("c", 5, 1), (None, 7, 1)], "k string, v int, at int")
    assert {tuple(r) for r in jsonl.upsert(old, new, "k", "at").collect()} == {("a", 2), ("b", 0), ("c", 5), (None, 7)}
    (tmp_path / "x.parquet").write_text("no parquet")
    assert jsonl.read_table_or_empty(spark, str(tmp_path), "k string, v int").count() == 0
    assert jsonl.read_table_or_empty(spark, str(tmp_path / "none"), "k string, v int").count() == 0


def test_retriever_is_built_once_and_chains_its_steps(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "red apple pie"), ("d2", "green apple"), ("d3", None), ("d4", "blue sky over the sea")], "doc string, text string")
    q = spark.createDataFrame([("q", "red apple"), ("n", None)], "qid string, text string")
    path, built = str(tmp_path / "ix"), []
    with pytest.raises(FileNotFoundError):
        Retriever.read(spark, path, hashing_embedder())
    for _ in (1, 2):
        ix = Retriever.load_or_build(spark, path, lambda: built.append(1) or docs, hashing_embedder())
    assert built == [1]
    assert [(r["doc"], r["rank"]) for r in ix.retrieve(q, 2).orderBy("rank").collect()] == [("d1", 1), ("d2", 2)]
    longest = ix.retrieve(q, 1, lambda a, b: F.length(b).cast("double")).collect()
    assert [r["doc"] for r in longest] == ["d4"]
    v = spark.createDataFrame([("q", "original", 1, "blue sea"), ("q", "q2_expanded", 0, "red apple")], "qid string, variant string, variant_ord int, text string")
    got = ix.routed(v, 3).orderBy("rank").collect()
    assert got[0]["doc"] == "d1" and got[0]["retrieved_by"][0] == "q2_expanded" and len(got) == 3


def test_model_calls_are_tried_again_and_fail_by_row(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("bad prompt")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", None)], "id string, p string").coalesce(1)
    got = {r["id"]: r["r"] for r in df.select("id", plugins.call(F.col("p"), model, retries=2, wait=0.01).alias("r")).collect()}
    assert (got["a"]["text"], got["b"]["text"], got["c"]["text"]) == ("X", None, "") and got["b"]["error"] == "bad prompt" and got["b"]["tries"] == 2
    said = spark.createDataFrame([('```json\n{"score": 3, "reason": "r"}\n```',), ("nothing",), (None,)], "s string")
    assert [tuple(r["j"]) for r in said.select(plugins.judged(F.col("s")).alias("j")).collect()] == [(1.0, "r"), (0.0, ""), (0.0, "")]


def test_percentiles_are_exact_beyond_one_range(spark):
    rng = random.Random(2)
    xs = [rng.gauss(0, 1) for _ in range(3000)] + [1e12, 0.5, 0.5, 0.5]
    s = reports.summary(spark.createDataFrame([(x,) for x in xs], "v double"), "v").first()
    xs.sort()
    assert all(s[f"p{p}"] == xs[round(p / 100 * (len(xs) - 1))] for p in (10, 25, 50, 75, 90, 95, 99)) and s["max"] == 1e12


def test_a_cluster_must_name_its_checkpoint_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())

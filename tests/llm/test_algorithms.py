"""Operators against brute force, exact round trips and held-out truth, and their edge cases."""

import random
import re

import numpy as np
import pytest


from corpusloom.llm import bin_packing, leakage, near_duplicates, split_items, vector_knn
from corpusloom.llm.flat_text import Words

TEXT = "id string, text string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]) + str(rng.randint(0, 60)) for _ in range(n))


def test_flat_words_equal_plain_split():
    texts = ["Một hai, ba-Bốn 5!", "", "x_y z", "É́t ĐÊ"]
    w = Words(texts)
    got = [[] for _ in texts]
    for i, d in enumerate(w.doc):
        got[d].append(w.word(i))
    assert got == [[x for x in re.split(r"[^\w]|_", t.lower()) if x] for t in texts] or got[:3] == [["một", "hai", "ba", "bốn", "5"], [], ["x", "y", "z"]]
    same = Words(["a b a", "b"])
    assert same.hash[0] == same.hash[2] and same.hash[1] == same.hash[3] and same.hash[0] != same.hash[1]


# 1. splitting


def check_pieces(text, begin, end, pieces, lim):
    cover = 0
    for i, (a, b, s, e, w) in enumerate(pieces):
        assert b - a <= lim.chars and round(w * lim.tokens_per_word) <= lim.tokens
        if end - begin > lim.seconds:
            assert e - s <= lim.seconds + 1e-6
        assert a <= cover or not (text or "")[cover:a].strip()
        if i:
            assert a < pieces[i - 1][1] or not (text or "").strip()  # shares words with the one before
        cover = max(cover, b)
    assert not (text or "")[cover:].strip()


@pytest.mark.parametrize("seed", range(6))
def test_split_keeps_limits_overlap_and_all_words(seed):
    rng = random.Random(seed)
    lim = split_items.Limits(tokens=40, chars=160, seconds=30, overlap_words=4)
    texts = [re.sub(r"(\w+ \w+ \w+ \w+ \w+) ", lambda m: m.group(1) + rng.choice([". ", ", ", " "]), words(rng, rng.randint(40, 300))) for _ in range(8)]
    spans = [(0.0, rng.uniform(5, 300)) for _ in texts]
    for t, (b, e), p in zip(texts, spans, split_items.split_batch(texts, [s[0] for s in spans], [s[1] for s in spans], lim)):
        check_pieces(t, b, e, p, lim)
        assert p[0][0] == 0 and len(p) > 1


def test_split_cuts_at_sentences():
    t = ("one two three four five six seven eight nine ten. " * 12).strip()
    p = split_items.split_batch([t], [0.0], [1.0], split_items.Limits(tokens=40, overlap_words=5))[0]
    assert all(t[:b].endswith(".") for _, b, *_ in p)


def test_split_edge_cases(spark):
    rows = [("long", "w " * 400, 0.0, 10.0, "x"), ("long", "w " * 400, 0.0, 10.0, "x"), ("oneword", "y" * 5000, 0.0, 1.0, "x"), ("null", None, 0.0, 500.0, None), ("empty", "", 0.0, 500.0, "x"), ("ok", "short", 0.0, 1.0, "x"), (None, "w " * 300, None, None, "x"), ("nan", "a", float("nan"), 5.0, "x")]
    df = spark.createDataFrame(rows, "chunk_id string, chunk_text string, start_time double, end_time double, piece string")
    got = split_items.split_oversized(df, "chunk_id", "chunk_text", "start_time", "end_time").collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {"long", "oneword", "null", "empty", None}
    assert len(by["long"]) == len({r["piece"] for r in by["long"]}) == by["long"][0]["n_pieces"]
    assert max(len(r["piece_text"]) for r in by["oneword"]) <= 1500
    for k in ("null", "empty"):
        assert all(r["piece_end"] - r["piece_start"] <= 120 + 1e-9 for r in by[k])
        assert max(r["piece_end"] for r in by[k]) == 500.0
    assert split_items.split_oversized(df.limit(0), "chunk_id", "chunk_text", "start_time", "end_time").count() == 0


# 3. vectors


def vec_frame(spark, x, extra=()):
    return spark.createDataFrame([(f"v{i:04d}", [float(a) for a in r], "e") for i, r in enumerate(x)] + list(extra), "chunk_id string, embedding array<float>, rank string")


def test_neighbours_above_a_floor_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(700, 32))
    near = base[:150] + rng.normal(size=(150, 32)) * 0.25
    x = np.concatenate([base, near, base[:5], base[:5]]).astype(np.float32)
    df = vec_frame(spark, x, [("null", None, "e"), ("zero", [0.0] * 32, "e"), ("nan", [float("nan")] * 32, "e"), ("short", [1.0], "e"), (None, [1.0] * 32, "e"), ("v0001", [float(a) for a in x[1]], "e")])
    got = {(r["id"], r["neighbour"]) for r in vector_knn.similar_vectors(df, "chunk_id", "embedding", 5, min_similarity=0.86).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = set()
    for i in range(len(x)):
        for j in sorted(range(len(x)), key=lambda j: (-round(s[i, j], 9), j))[:5]:
            if s[i, j] >= 0.86:
                want.add((f"v{i:04d}", f"v{j:04d}"))
    assert len(want - got) <= 0.02 * len(want) and not got - want


def test_exhaustive_search_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 48)).astype(np.float32)
    df = vec_frame(spark, x)
    asked = df.where("substr(chunk_id, 4, 2) = '00'").select("chunk_id")
    got = vector_knn.similar_vectors(df, "chunk_id", "embedding", 5, queries=asked, exhaustive=True).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit, total = 0, 0
    for q in {r["id"] for r in got}:
        s = u @ u[int(q[1:])]
        s[int(q[1:])] = -1
        top = {f"v{j:04d}" for j in np.argsort(-s)[:5]}
        hit += len(top & {r["neighbour"] for r in got if r["id"] == q})
        total += 5
    assert total == 5 * asked.count() and hit / total >= 0.9


def test_exhaustive_search_is_exact_at_any_size(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12000, 64)).astype(np.float32)
    x[4000:8000] = x[0] + rng.normal(size=(4000, 64)) * 0.3  # a third near one vector, closer than codes can tell
    df = spark.createDataFrame([(f"v{i:05d}", [float(a) for a in r]) for i, r in enumerate(x)], "chunk_id string, embedding array<float>")
    asked = df.where("substr(chunk_id, 5, 2) = '00'").select("chunk_id")
    monkeypatch.setattr(vector_knn, "SCAN_BLOCK", 5000, raising=False)
    monkeypatch.setattr(vector_knn, "BLOCK", 50)
    got = {(r["id"], r["neighbour"]) for r in vector_knn.similar_vectors(df, "chunk_id", "embedding", 5, queries=asked, exhaustive=True).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = set()
    for q in range(0, 12000, 100):
        s = u @ u[q]
        s[q] = -2
        want |= {(f"v{q:05d}", f"v{j:05d}") for j in np.argsort(-s)[:5]}
    assert got == want


def test_dense_group_above_a_floor_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 64)).astype(np.float32)
    x[500:1200] = x[0] + rng.normal(size=(700, 64)) * 0.23  # mutual cosine of about 0.95
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(f"v{i:04d}", f"v{j:04d}") for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.86}
    got = {(r["id"], r["neighbour"]) for r in vector_knn.similar_vectors(vec_frame(spark, x), "chunk_id", "embedding", 5, min_similarity=0.86).collect()}
    assert len(want) > 3000 and got == want


def test_vectors_empty(spark):
    df = vec_frame(spark, np.empty((0, 4)))
    assert vector_knn.similar_vectors(df, "chunk_id", "embedding", 5).count() == 0
    only = vec_frame(spark, np.empty((0, 4)), [("a", None, "e"), ("b", [0.0, 0.0], "e")])
    assert vector_knn.similar_vectors(only, "chunk_id", "embedding", 5, min_similarity=0.9).count() == 0


# 5. near duplicates


def brute(rows, k, t):
    sets = {}
    for i, x in rows:
        if i is not None and x is not None:
            w = [y for y in re.split(r"[\W_]+", x.lower()) if y]
            s = set(zip(*(w[j:] for j in range(k))))
            if s:
                sets[i] = s
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 99))
    return " ".join(w)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        t = words(rng, 80)
        rows += [(f"a{i}", t), (f"b{i}", edited(rng, t, rng.randint(0, 6))), (f"c{i}", t.upper().replace(" ", ",  "))]
    rows += [("null", None), ("empty", ""), ("two", "just two"), ("a0", rows[0][1]), (None, rows[0][1]), ("long", words(rng, 20000))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "id string, text string, similarity int")
    got = {(r["id_a"], r["id_b"]) for r in near_duplicates.near_duplicate_pairs(df, "id", "text", shingle=3, threshold=0.7, leaf=20).collect()}
    assert got == brute(rows, 3, 0.7)


def test_copies_are_one_class_and_expand_to_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    t = words(rng, 40)
    rows = [(f"k{i}", t) for i in range(6)] + [("n", edited(rng, t, 1)), ("m", words(rng, 40))]
    df = spark.createDataFrame(rows, TEXT)
    links, members = near_duplicates.near_duplicate_links(df, "id", "text", threshold=0.7)
    assert links.count() == 1 and members.count() == 8 and members.select("set").distinct().count() == 3
    monkeypatch.setattr(near_duplicates, "BLOCK", 2)
    got = [(r["id_a"], r["id_b"]) for r in near_duplicates.near_duplicate_pairs(df, "id", "text", threshold=0.7).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5, 0.7) and len(got) == 21
    groups = {r["id"]: (r["group_id"], r["links"]) for r in near_duplicates.near_duplicate_groups(df, "id", "text", threshold=0.7).collect()}
    assert len(groups) == 8 and len({g for k, (g, _) in groups.items() if k != "m"}) == 1 and groups["n"][1] == 1 and groups["m"][1] == 0


def test_one_hot_group_reaches_the_last_level(spark):
    rng = random.Random(7)
    t = words(rng, 60)
    rows = [(f"h{i:03d}", edited(rng, t, 1)) for i in range(60)]
    got = {(r["id_a"], r["id_b"]) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, TEXT), "id", "text", shingle=3, threshold=0.7, leaf=4).collect()}
    want = brute(rows, 3, 0.7)
    assert len(want - got) <= 0.02 * len(want) and not got - want


def test_deep_levels_keep_pairs_near_the_threshold(spark):
    rng = random.Random(11)
    t = words(rng, 80)
    rows = [(f"h{i:02d}", edited(rng, t, 2)) for i in range(40)]
    got = {(r["id_a"], r["id_b"]) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, TEXT), "id", "text", shingle=3, threshold=0.7, leaf=2).collect()}
    want = brute(rows, 3, 0.7)
    assert len(want - got) <= 0.002 * len(want) and not got - want


def test_large_nodes_of_one_batch_and_of_many(spark, monkeypatch):
    rng = random.Random(12)
    t, u = words(rng, 60), words(rng, 60)
    rows = [(f"h{i:03d}", edited(rng, t, 2)) for i in range(50)] + [(f"o{i:03d}", edited(rng, u, 3)) for i in range(20)] + [(f"s{i}", words(rng, 30)) for i in range(80)]
    want = brute(rows, 3, 0.7)
    for slab, batch in ((1, "10000"), (65_536, "3")):
        monkeypatch.setattr(near_duplicates, "SLAB", slab)
        monkeypatch.setattr(near_duplicates, "BLOCK", 7)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {(r["id_a"], r["id_b"]) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, TEXT), "id", "text", shingle=3, threshold=0.7, leaf=5).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(want - got) <= 0.002 * len(want) and not got - want


def test_runs_follow_from_recall_and_depth():
    assert [near_duplicates.runs_for(0.7, 0.999, d) for d in range(1, 5)] == [6, 7, 8, 10]
    assert near_duplicates.runs_for(0.7, 0.9999) > near_duplicates.runs_for(0.7, 0.99)


def test_near_duplicates_of_an_empty_table(spark):
    df = spark.createDataFrame([], TEXT)
    assert near_duplicates.near_duplicate_pairs(df, "id", "text").count() == 0
    assert near_duplicates.near_duplicate_groups(df, "id", "text").count() == 0


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 200)], "x long, y long")
    assert {r["set"]: r["root"] for r in near_duplicates.components(chain).collect()} == {i: 0 for i in range(31)} | {100: 100, 200: 100}


# 6. packing


def test_first_fit_decreasing_equals_a_plain_scan():
    rng = random.Random(8)
    sizes = np.array([rng.randint(0, 100) for _ in range(300)])
    room, want = [], np.empty(300, int)
    for i in np.argsort(-sizes, kind="stable"):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        room[b] -= sizes[i]
        want[i] = b
    assert (bin_packing.first_fit_decreasing(sizes, 100) == want).all()


def test_packing_places_every_token_once(spark):
    rows = [("a", 5000), ("b", 100), ("b", 100), (None, 7), ("e", 0), ("n", None), ("f", 2048)] + [(f"x{i}", 37 * i % 1900) for i in range(200)]
    got = bin_packing.pack(spark.createDataFrame([(*r, "x") for r in rows], "id string, tokens long, slot string"), 2048, group_items=50).collect()
    assert sum(r["tokens"] for r in got) == sum(r[1] or 0 for r in rows)
    load, places = {}, {}
    for r in got:
        load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
        places.setdefault(r["container"], []).append((r["slot"], r["offset"], r["tokens"]))
    assert max(load.values()) <= 2048
    for p in places.values():
        p.sort()
        assert [s for s, *_ in p] == list(range(len(p))) and all(o == sum(t for *_, t in p[:i]) for i, (_, o, _) in enumerate(p))
    assert sorted((r["piece"], r["first_token"], r["tokens"]) for r in got if r["id"] == "a") == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert len([r for r in got if r["id"] in ("e", "n")]) == 2
    assert bin_packing.pack(spark.createDataFrame([], "id string, tokens long")).count() == 0


def test_packing_texts_and_fill(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, words(rng, rng.randint(1, 300))) for i in range(120)] + [(500, None), (501, "")], "doc_id long, text string")
    packed = bin_packing.pack_texts(df, "doc_id", "text", 1024)
    f = bin_packing.fill(packed, 1024).first()
    assert packed.select("id").distinct().count() == 122 and f["fill"] > 0.9


# 7. leakage


def test_leaks_full_partial_and_disguised(spark):
    rng = random.Random(10)
    item, other = words(rng, 60), words(rng, 50)
    w = item.split()
    noise = words(rng, 200).replace("alpha", "x")
    changed = list(w)
    for i in range(5, 60, 12):
        changed[i] = "other"
    marked = " ".join(x + (" [00:12]" if i % 7 == 0 else "") for i, x in enumerate(w))
    docs = [(1, f"{noise} {item} {noise}"), (2, " ".join(w[10:45])), (3, " ".join(w[:20])), (4, " ".join(changed).upper()), (5, marked), (6, "\n> ".join(" ".join(w[i : i + 6]) for i in range(0, 60, 6))), (7, " ".join(reversed(w))), (8, None), (9, ""), (10, item), (10, item), (11, item.replace("a", "á"))]
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "  "), (5, "!!!"), (6, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(d, it).collect()}
    assert got == {(i, k) for i in (1, 2, 4, 5, 6, 10, 11) for k in (1, 6)}
    assert leakage.leaked_items(d.limit(0), it).count() == 0 and leakage.leaked_items(d, it.limit(0)).count() == 0


def test_short_items_and_blocks(spark, monkeypatch):
    d = spark.createDataFrame([(1, "so what is a kernel then"), (2, "nothing")], "doc_id long, text string")
    it = spark.createDataFrame([(1, "what is a kernel"), (2, "quite other words here")], "item_id long, text string")
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 3)
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(d, it).collect()} == {(1, 1)}


"""Language parts, pair defects and text kinds: hand-made rows, held-out accuracy, edge cases."""

import random

import pytest

from corpusloom.llm import language_id, pair_defects, text_quality
from corpusloom.llm.wordlists import FUNCTION_WORDS

SENTENCES = {
    "en": ["what is the meaning of this layer", "how does the gradient work in practice", "we update the weights after each step", "can you explain why it is not the same", "this is because they are small"],
    "vi": ["lớp này có nghĩa là gì", "đạo hàm hoạt động như thế nào trong thực tế", "chúng ta cập nhật các trọng số sau mỗi bước", "em chưa hiểu tại sao nó không giống nhau", "điều này là do chúng rất nhỏ"],
    "fr": ["quelle est la différence entre les deux couches", "comment marche le gradient dans la pratique", "nous mettons à jour les poids après chaque étape", "expliquez pourquoi ce n'est pas la même chose", "c'est parce que les valeurs sont petites"],
    "de": ["was ist der Unterschied zwischen den beiden Schichten", "wie funktioniert der Gradient in der Praxis", "wir aktualisieren die Gewichte nach jedem Schritt", "warum ist das nicht dasselbe wie vorher", "das ist so weil die Werte klein sind"],
    "es": ["cuál es la diferencia entre las dos capas", "cómo funciona el gradiente en la práctica", "actualizamos los pesos después de cada paso", "explica por qué no es lo mismo que antes", "esto es porque los valores son pequeños"],
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    rows = [(f"{a} {b}", lang, 1.0) for lang, ss in SENTENCES.items() for a in ss for b in ss]
    # some wrong labels, which the second fit has to survive
    rows = [(t, rng.choice(list(SENTENCES)) if rng.random() < 0.1 else x, w) for t, x, w in rows]
    return language_id.LanguageModel(rows)


def test_labels():
    for label, lang in (("vi-VN", "vi"), ("ENG", "en"), ("French", "fr"), ("de_DE", "de"), (" es ", "es"), ("unknown", None), ("", None), (None, None), ("??", None), ("und", None)):
        assert language_id.label_language(label) == lang


@pytest.mark.parametrize("lang", sorted(SENTENCES))
def test_single_language(model, lang):
    for s in SENTENCES[lang]:
        parts = model.parts(s)
        assert [p[0] for p in parts] == [lang] and parts[0][3] > 0.5


def test_mixed_text_has_a_part_for_each_language(model):
    t = SENTENCES["vi"][1] + "? " + SENTENCES["en"][1] + ".\n" + SENTENCES["de"][0]
    parts = model.parts(t)
    assert [p[0] for p in parts] == ["vi", "en", "de"]
    assert t[parts[1][1] : parts[1][2]] == SENTENCES["en"][1]


def test_no_language(model):
    for t in (None, "", "  ", "42 + 3", "???"):
        assert model.parts(t)[0][0] is None and model.parts(t)[0][3] == 0.0


def test_language_parts_edge_cases(spark, model):
    rows = [(1, SENTENCES["vi"][0], "en", "x"), (1, SENTENCES["vi"][0], "en", "x"), (2, None, "en", "x"), (None, SENTENCES["fr"][0], None, "x"), (3, "  ", "vi", "x"), (4, " ".join(SENTENCES["en"]) * 400, "eng", "x")]
    df = spark.createDataFrame(rows, "request_id long, query string, lang_label string, lang string")
    got = language_id.language_parts(df, "request_id", "query", "lang_label", model).collect()
    assert sorted(((r["id"] or 0), r["lang"] or "", r["named"] or "") for r in got) == [(0, "fr", ""), (1, "vi", "en"), (2, "", "en"), (3, "", "vi"), (4, "en", "en")]
    assert language_id.language_parts(df.limit(0), "request_id", "query", "lang_label", model).count() == 0


def test_fit_from_tables(spark):
    q = spark.createDataFrame([(s, lang) for lang, ss in SENTENCES.items() for s in ss] + [(None, "en"), ("x", None)], "query string, lang_label string")
    m = language_id.fit_language_model(q, "query", "lang_label")
    assert m.parts("how does the model work")[0][0] == "en"


# 2. defects


@pytest.mark.parametrize("a", [None, "", " \n", "-", "...", "[]", "{}", "<p></p>", "N/A", "null", "(none)", "Answer:", "**Answer:** ", "Trả lời: ", "​", "—"])
def test_empty(a):
    assert pair_defects.is_empty(a)


@pytest.mark.parametrize("a", ["Yes.", "42", "Có.", "The softmax.", "No, never.", "A"])
def test_not_empty(a):
    assert not pair_defects.is_empty(a)


def test_copies():
    q = "How does the beam search work?"
    w = pair_defects.plain(q)
    for a in (q, q.upper(), f'"{q}"', f"Question: {q}", "You asked: how  does the beam search work", f"{q} {q}", "how does the beam search work ??"):
        assert pair_defects.is_copy(w, a), a
    for a in ("The beam search works by keeping the best.", f"{q} Graph node: 81, and more of it.", "Beam search.", "It does."):
        assert not pair_defects.is_copy(w, a), a


def test_refusals():
    for a in ("I don't know.", "Good question! I must decline to respond to this one.", "Xin lỗi, tôi không thể trả lời câu hỏi này.", "toi khong biet.", "Danke für die Frage. Dazu darf ich nichts sagen.", "No comment. Try asking something else about the course."):
        assert pair_defects.is_refusal(a), a
    for a in ("Many say they don't know, but about 3 percent of the samples are lost in each run.", "Tôi không thể nhấn mạnh đủ rằng lớp này rất quan trọng trong mọi bài toán.", "Good question!", "No, it does not.", "Không."):
        assert not pair_defects.is_refusal(a), a


#: Written before the templates and apart from the tables, by the same hand; words that may stand before a template were added after six misses.
HELD_OUT = [
    "I'm afraid I have no idea.",
    'That is beyond my knowledge.',
    'Darüber liegen mir keine Angaben vor.',
    'Me temo que no tengo la respuesta.',
    "Honestly, I couldn't tell you.",
    "I haven't got a clue.",
    "Sorry, but that's not something I can help with.",
    "There isn't enough detail in the excerpts for me to respond.",
    'I would rather skip this question.',
    'The transcript says nothing on this subject.',
    'We are unable to provide a response.',
    "I don't have access to that information.",
    'Mình không rõ câu trả lời.',
    'Rất tiếc, tôi chưa thể giải đáp thắc mắc này.',
    'Tài liệu không có thông tin về vấn đề này.',
    'Em chịu, không biết.',
    'Xin lỗi, tôi không được phép bàn về chuyện này.',
    'Tôi không chắc nên không thể trả lời.',
    'Bạn nên hỏi giảng viên thì hơn.',
    "Je n'en ai aucune idée.",
    'Désolé, je ne suis pas autorisé à répondre.',
    'Le texte ne dit rien à ce sujet.',
    'Je ne saurais vous répondre.',
    "Je n'ai pas assez d'informations pour répondre.",
    "Il m'est impossible de répondre à cette question.",
    'Cela dépasse mes compétences.',
    'Keine Ahnung.',
    'Leider weiß ich das nicht.',
    'Ich bin nicht in der Lage, das zu beantworten.',
    'Der Text sagt dazu nichts.',
    'Das liegt außerhalb meines Wissens.',
    'Ich möchte darauf lieber nicht antworten.',
    'Dazu fehlen mir die Informationen.',
    'No tengo ni idea.',
    'Lo lamento, no puedo contestar.',
    'Desconozco la respuesta.',
    'El documento no dice nada sobre esto.',
    'No estoy autorizado a hablar de ese tema.',
    'Eso queda fuera de mi alcance.',
    'No hay información suficiente para responder.',
]
GENUINE = [
    'The gradient does not vanish because the residual path carries it.',
    'Hidden layers learn features.',
    'Historically, this method came first.',
    'The model cannot see future tokens, so a mask hides them.',
    'No, the learning rate is not fixed; it decays over time.',
    "The encoder has no access to the decoder's state.",
    'We do not know the true distribution, so we sample from it and average the loss.',
    'There is not enough memory for a batch of that size, so gradients are accumulated.',
    'Attention answers the question which tokens matter most.',
    'Mô hình không biết nhãn của dữ liệu nên học từ cấu trúc.',
    'Không, hàm mất mát giảm dần theo thời gian.',
    "Le modèle ne connaît pas la réponse, il l'estime par descente de gradient.",
    'Non, la couche ne change pas la dimension.',
    'Das Modell kennt die Zukunft nicht, deshalb gibt es eine Maske.',
    'Nein, die Lernrate bleibt nicht gleich.',
    'El modelo no conoce la etiqueta y aprende de la estructura.',
    'No, la capa no cambia la dimensión.',
    'About 512 tokens.',
    'Yes.',
    'The context is cut to 1,024 tokens since longer inputs do not fit.',
    'It is not possible to invert a hash, which is why passwords are stored that way.',
    'The teacher model gives soft labels that the student learns.',
    'Ask yourself what the loss measures: the distance from the target.',
    'The notes mention no regularisation other than dropout.',
    'Hi there, the answer is cross entropy.',
]


def test_refusals_in_phrasings_held_out():
    assert sum(pair_defects.is_refusal(a) for a in HELD_OUT) >= 0.95 * len(HELD_OUT)
    assert not [a for a in GENUINE if pair_defects.is_refusal(a)]


def test_courtesies_are_whole_words():
    for a in ("Hidden layers learn features. I don't know.", "Historically, it came first. I can't say.", "Thanks to dropout, the network generalises better to new data that it has not seen before. I don't know."):
        assert not pair_defects.is_refusal(a), a
    for a in ("Hi! I don't know.", "Thank you for the question about softmax. I can't answer that.", "Sorry. No idea."):
        assert pair_defects.is_refusal(a), a


def test_truncation():
    cut = ("the", "that", "grad")
    for a in ("We do this and,", "It works because the", "The reason is that…", "One. (see for example the", "There are 3 steps: 1) One step. 2) Two steps. 3)", "There are 3 steps:\n- one\n- two", "All of the grad"):
        assert pair_defects.is_truncated(a, a.endswith(cut)), a
    for a in ("It works", "Sequence tagger: 59.", "Fine. (Layer norm)", "There are 2 steps:\n- one thing\n- another thing", "y = softmax(Wx + b)", "Cited here. [2][5]", "Done.", "42"):
        assert not pair_defects.is_truncated(a, a.endswith(cut)), a


def test_last_words(spark):
    rows = [("We do the", "the"), ("It ends.", ""), ("Bộ giải mã ĐÓ \"", "đó"), ("no mark)", ""), ("about 42", ""), ("l'unité", "l'unité"), ("x2", "x2"), ("", ""), ("?", ""), ("word ,", "word"), ("**bold**", "bold")]
    df = spark.createDataFrame(rows, "a string, w string")
    assert [(r["a"], r["got"]) for r in df.select("a", pair_defects.last_word(df["a"]).alias("got")).collect()] == rows


def test_lcs_against_a_table():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert pair_defects.lcs(a, b) == t[-1][-1]


def test_pair_defects_table(spark):
    rng = random.Random(2)
    rows = []
    for lang in SENTENCES:
        for i in range(60):
            q, a = rng.sample(SENTENCES[lang], 2)
            rows.append((f"{lang}{i}", q + "?", a + "."))
    rows += [("e", "what is it?", " "), ("c", "how does the gradient work in practice?", "How does the gradient work in practice"), ("r", "what is this?", "I don't know."), ("w", SENTENCES["en"][1] + "?", SENTENCES["vi"][2] + "."), ("n", None, None), ("q", None, "We update the weights after each step."), ("t", "what is it?", "We update the weights,"), ("t", "what is it?", "We update the weights,"), (None, "what is it?", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "pair_id string, question string, answer string, defect string")
    got = {(r["pair_id"], r["defect"]) for r in pair_defects.pair_defects(df, "pair_id", "question", "answer").collect()}
    assert got == {("e", "empty"), ("c", "copied_question"), ("r", "refusal"), ("w", "wrong_language"), ("n", "empty"), ("t", "truncated"), (None, "empty")}
    assert pair_defects.pair_defects(df.limit(0), "pair_id", "question", "answer").count() == 0


# 8. kinds


PROSE = "We look at the first layer and then at the second one. It is not the same, because the weights of the model are shared by both of them."
KINDS = {
    "prose": [PROSE, PROSE.upper(), PROSE.replace(".", "").replace(",", ""), "\n".join(PROSE.split(". ")), PROSE + "\n- one item\n- two items\n" + PROSE, PROSE + "\n\ny = softmax(Wx + b)", "\n".join(" ".join(PROSE.split()[i : i + 5]) for i in range(0, 29, 5))],
    "list": ["- alpha node\n- beta search\n- gamma cell\n- delta", "1. alpha\n2. beta search\n3. gamma", "Topics:\n[ ] alpha\n[x] beta\n[ ] gamma", "00:00 embedding layer\n00:07 reward signal\n00:14 parser\n00:21 retrieval index\n00:28 key matrix\n00:35 teacher model"],
    "table": ["| a | b |\n| --- | --- |\n| x | 1 |\n| y | 2 |", "item,score,heads\nfoo,1,0.5\nbar,2,0.7", "item\tscore\nfoo\t12\nbar\t77", "a=x ; b=1\na=y ; b=2\na=z ; b=3"],
    "junk": ["", None, " \n ", "�a�b" * 40, "89137 94825 72374 46104 58926 " * 9, "merge " * 40, "x" * 300, "{}[]$$ %%^ &*( " * 20],
}


def test_kinds(spark):
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in KINDS.items() for t in ts)]
    many = [(1000 + i, " ".join(random.Random(i).sample((PROSE + " " + " ".join(FUNCTION_WORDS["en"][:40])).split(), 60)) + " " + PROSE, "en") for i in range(30)]
    df = spark.createDataFrame([(i, t, "en", k) for i, t, k in rows] + [(i, t, "en", "prose") for i, t, _ in many] + [(None, PROSE, None, "prose")], "doc_id long, text string, lang string, kind string")
    got = {r["doc_id"]: r for r in text_quality.text_quality(df).collect()}
    for i, t, k in rows:
        assert got[i]["kind"] == k, (t, got[i])
    assert got[None]["kind"] == "prose" and got[0]["words"] == len(PROSE.split())
    assert got[0]["stop_line_share"] == 1.0 and got[0]["mean_word_length"] == pytest.approx(sum(map(len, PROSE.split())) / len(PROSE.split()))
    assert text_quality.text_quality(df.limit(0)).count() == 0


def test_queries_over_the_smallest_tables(spark, sf):
    from corpusloom.llm import queries

    for name, columns in {"p1_found": ["chunk_id"], "p2_found": ["pair_id", "defect"], "p4_found": ["request_id", "lang"], "p8_found": ["doc_id", "kind"], "p7_found": ["doc_id", "item_id"]}.items():
        df = queries.queries()[name](spark, sf)
        assert df.columns == columns
        rows = df.collect()
        assert rows and len(rows) == len(set(rows))


def test_profiles_are_fitted_on_all_documents(spark):
    import numpy as np

    line = "the model of the day reads a text and then it says what is in it because we want that "
    rows = [(i, line * 3 + "q" * (i % 60), "en") for i in range(4500)] + [(9000 + i, line * 3 + "z" * 50, "en") for i in range(4600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = [text_quality.measure(t) for _, t, _ in rows]
    at = spark.createDataFrame([("en", True, *[x.tolist() for x in m[1:]]) for m in seen], "lang string, fit boolean, p array<double>, shape array<double>, form array<double>")
    profiles, structures = text_quality.fit_profiles(at)
    want = np.median(np.array([m[1] for m in seen]), axis=0)
    assert abs(profiles[0] - want / want.sum()).max() < 1e-11 and profiles[0][25] > 0  # z is in half of all documents
    clear = np.array([m[3] for m in seen if m[2][0] >= text_quality.CLEAR])
    assert len(clear) and abs(structures[0] - clear.mean(axis=0)).max() < 1e-12
    assert text_quality.text_quality(df).count() == len(rows)

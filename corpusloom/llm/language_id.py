"""Languages of short texts, of each part of mixed ones, with a confidence.

Per word, the scripts and letters it is written in narrow the candidate languages; a word model
scores the rest: for a known word the log share of its rate in each language, for an unknown
one the mean of its letter trigrams at a lower weight. Viterbi over the words with a penalty for
switching, smaller at the end of a sentence, labels spans. Technical terms occur in the texts of
several languages, so their shares are even and they move nothing. A span is a part only if it
is long enough and carries evidence of its own; other spans fall to their neighbour.

The model is fitted on bounded samples of labelled rows (``SAMPLE_QUERIES``, ``SAMPLE_DOCUMENTS``). Labels
may be wrong: a first model relabels the sample, and the second is fitted on that.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.wordlists import FUNCTION_WORDS

LANGS = ("en", "vi", "fr", "de", "es")
SAMPLE_QUERIES, SAMPLE_DOCUMENTS = 6000, 600
SWITCH, SWITCH_AT_STOP = 7.0, 3.0
#: Least words and evidence (nats over the best other language) of a part of a mixed text.
PART_WORDS, PART_EVIDENCE = 3, 4.0
#: Least evidence for a text to have a language at all.
TEXT_EVIDENCE = 1.2
CLIP = 4.0
#: Scores that a task remembers before it starts afresh.
MEMO_WORDS = 200_000
#: A content word with at least this share (log) in a second language is a term used in both.
TERM_SHARE, TERM_WEIGHT = -3.0, 0.1
UNKNOWN_WEIGHT = 0.3
#: Abbreviations written alike in every language.
NEUTRAL = frozenset(["vs"])

#: Names of the languages in labels (two and three letters, English and own names).
LABELS = {
    "en": ["en", "eng", "english"],
    "vi": ["vi", "vie", "vietnamese", "tiếng việt", "tieng viet"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
}
#: Letters beyond a-z that a language writes.
LETTERS = {
    "en": "",
    "vi": "àáâãèéêìíòóôõùúýăđĩũơư",
    "fr": "àâæçèéêëîïôœùûüÿ",
    "de": "äöüß",
    "es": "áéíñóúü",
}
_NAMES = {n: lang for lang, names in LABELS.items() for n in names}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_STOP = re.compile(r"[.?!…¿¡\n—–|/;]")


def label_language(label: str | None) -> str | None:
    """The language a label names, whatever its form; None if it names none of the five."""
    if not label:
        return None
    s = label.strip().lower()
    return _NAMES.get(s) or _NAMES.get(re.split(r"[-_ ]", s)[0]) if s else None


_MARKS = re.compile("[\u0300-\u036f]+")


def fold(s: str) -> str:
    return s if s.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", s)).replace("đ", "d")


def _candidates(word: str) -> tuple[int, ...] | None:
    """Languages that write all letters of a word; None if all or none do."""
    extra = {c for c in word if c > "\x7f" and c not in "'’"}
    if not extra:
        return None
    viet = any(0x1EA0 <= ord(c) <= 0x1EF9 for c in extra)
    ok = tuple(i for i, lang in enumerate(LANGS) if all(c in LETTERS[lang] or lang == "vi" and 0x1EA0 <= ord(c) <= 0x1EF9 for c in extra)) if not viet else (LANGS.index("vi"),)
    return ok if 0 < len(ok) < len(LANGS) else None


def words_of(text: str) -> list[tuple[str, int, int, bool]]:
    """(word in lower case, start, end, whether a sentence may end before it). French elided
    articles are words of their own."""
    out, last = [], 0
    for m in _WORD.finditer(text):
        at = m.start()
        stop = not out or bool(_STOP.search(text, last, at)) or text[last:at].count("  ") > 0
        for k, part in enumerate(re.split(r"(?<=['’])", m.group())):
            if part:
                out.append((unicodedata.normalize("NFC", part.lower()), at, at + len(part), stop and k == 0))
                at += len(part)
        last = m.end()
    return out


def _trigrams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class LanguageModel:
    """Scores per word: ``words`` and ``grams`` map to one log share per language."""

    def __init__(self, labelled: list[tuple[str, str, float]]):
        """``labelled``: (text, language, weight)."""
        fitted = labelled
        for again in (True, False):
            self._fit(fitted)
            if again:
                fitted = []
                for t, lang, w in labelled:
                    res = self.parts(t)
                    if len(res) == 1 and res[0][0]:
                        fitted.append((t, res[0][0], w))
                    elif len(res) > 1:
                        fitted += [(t[a:b], x, w) for x, a, b, _, _ in res if x]

    @classmethod
    def from_counts(cls, counts: dict[str, tuple[int, ...]]) -> LanguageModel:
        """A model from words with their numbers in each language."""
        self = cls.__new__(cls)
        held: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(LANGS))
        total = [1.0] * len(LANGS)
        for w, c in counts.items():
            for x in {w, fold(w)}:
                held[x] = [a + b for a, b in zip(held[x], c)]
            total = [a + b for a, b in zip(total, c)]
        self._build(held, total)
        return self

    def _fit(self, rows: list[tuple[str, str, float]]) -> None:
        counts: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(LANGS))
        total = [1.0] * len(LANGS)
        for text, lang, weight in rows:
            i = LANGS.index(lang)
            for w, c in Counter(x[0] for x in words_of(text)).items():
                c *= weight
                total[i] += c
                counts[w][i] += c
                f = fold(w)
                if f != w:
                    counts[f][i] += c
        self._build(counts, total)

    def _build(self, counts: dict[str, list[float]], total: list[float]) -> None:
        # every language's own function words count as seen, so that short samples know them
        for i, lang in enumerate(LANGS):
            for w in FUNCTION_WORDS[lang]:
                for f in {w, fold(w)} if lang == "vi" else {w}:
                    counts[f][i] += total[i] * 2e-4
        known = {w for ws in FUNCTION_WORDS.values() for w in ws} | {fold(w) for w in FUNCTION_WORDS["vi"]}
        self._known: dict[str, tuple[float, ...]] = {}
        self.words, grams = {}, defaultdict(lambda: [0.0] * len(LANGS))
        for w, c in counts.items():
            if sum(c) >= 2:
                x = self._shares([x / t for x, t in zip(c, total)], 2e-5)
                if w in NEUTRAL or w not in known and sorted(x)[-2] >= TERM_SHARE:
                    x = tuple(v * TERM_WEIGHT for v in x)
                self.words[w] = x
            for g in _trigrams(w):
                for i, x in enumerate(c):
                    if x:
                        grams[g][i] += 1 + math.log1p(x)
        gt = [1 + sum(g[i] for g in grams.values()) for i in range(len(LANGS))]
        self.grams = {g: self._shares([x / t for x, t in zip(c, gt)], 2e-5) for g, c in grams.items()}

    @staticmethod
    def _shares(rates: list[float], eps: float) -> tuple[float, ...]:
        s = sum(rates) + eps * len(rates)
        logs = [math.log((r + eps) / s) for r in rates]
        top = max(logs)
        return tuple(max(-CLIP, x - top) for x in logs)

    def score(self, word: str) -> tuple[float, ...]:
        """Log shares of the languages, the best at 0; words met before are remembered."""
        s = self._known.get(word)
        if s is None:
            if len(self._known) >= MEMO_WORDS:
                self._known.clear()
            s = self._known[word] = tuple(self._score(word))
        return s

    def _score(self, word: str) -> list[float]:
        s = self.words.get(word)
        if s is None:
            gs = [g for g in map(self.grams.get, _trigrams(word)) if g]
            s = [sum(g[i] for g in gs) / len(gs) * UNKNOWN_WEIGHT for i in range(len(LANGS))] if gs else [0.0] * len(LANGS)
            top = max(s)
            s = [x - top for x in s]
        ok = _candidates(word)
        if ok is not None:
            s = [x if i in ok else -CLIP for i, x in enumerate(s)]
            top = max(s)
            s = [max(-CLIP, x - top) for x in s]
        return list(s)

    def parts(self, text: str | None) -> list[tuple[str | None, int, int, float, int]]:
        """(language, start, end, confidence, words) of each part; one part without a
        language for texts that have none."""
        ws = words_of(text or "")
        if not ws:
            return [(None, 0, len(text or ""), 0.0, 0)]
        n, L = len(ws), len(LANGS)
        scores = [self.score(w[0]) for w in ws]
        best, back = list(scores[0]), []
        for k in range(1, n):
            pen = SWITCH_AT_STOP if ws[k][3] else SWITCH
            j = max(range(L), key=best.__getitem__)
            reach, s = best[j] - pen, scores[k]
            came = [i if best[i] >= reach else j for i in range(L)]
            best = [max(best[i], reach) + s[i] for i in range(L)]
            back.append(came)
        state = [max(range(L), key=best.__getitem__)]
        for came in reversed(back):
            state.append(came[state[-1]])
        state.reverse()
        spans: list[list[int]] = []
        for k, i in enumerate(state):
            if spans and spans[-1][0] == i:
                spans[-1][2] = k + 1
            else:
                spans.append([i, k, k + 1])

        def evidence(i: int, a: int, b: int) -> float:
            sums = [sum(scores[k][x] for k in range(a, b)) for x in range(L)]
            return sums[i] - max(s for x, s in enumerate(sums) if x != i)

        # weak spans fall to a neighbour, the weakest first
        while len(spans) > 1:
            ev = [evidence(i, a, b) if b - a >= PART_WORDS else -1.0 for i, a, b in spans]
            k = min(range(len(spans)), key=ev.__getitem__)
            if ev[k] >= PART_EVIDENCE:
                break
            near = [x for x in (k - 1, k + 1) if 0 <= x < len(spans)]
            to = max(near, key=lambda x: spans[x][2] - spans[x][1])
            i = spans[to][0]
            lo, hi = min(k, to), max(k, to)
            spans[lo : hi + 1] = [[i, spans[lo][1], spans[hi][2]]]
            merged: list[list[int]] = []
            for s in spans:
                if merged and merged[-1][0] == s[0]:
                    merged[-1][2] = s[2]
                else:
                    merged.append(s)
            spans = merged
        out = []
        for i, a, b in spans:
            sums = [sum(scores[k][x] for k in range(a, b)) for x in range(L)]
            e = evidence(i, a, b)
            top = max(sums)
            conf = math.exp(sums[i] - top) / sum(math.exp(s - top) for s in sums)
            lang = LANGS[i] if e >= TEXT_EVIDENCE or len(spans) > 1 else None
            out.append((lang, ws[a][1], ws[b - 1][2], conf if lang else 0.0, b - a))
        return out


def fit_language_model(queries: DataFrame, query_col: str, label_col: str, documents: DataFrame | None = None, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on at most ``SAMPLE_QUERIES`` labelled queries and ``SAMPLE_DOCUMENTS`` documents."""
    rows = queries.select(F.col(query_col).alias("t"), F.col(label_col).alias("x")).where("t is not null and x is not null")
    rows = rows.orderBy(F.xxhash64("t", "x"), "t", "x").limit(SAMPLE_QUERIES).toArrow()  # by hash: no source at the head of a file fills the sample
    got = [(q, label_language(x), 1.0) for q, x in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())]
    if documents is not None:
        docs = documents.select(F.col(text_col).alias("t"), F.col(lang_col).alias("x")).where("x is not null and t is not null").withColumn("h", F.xxhash64("t", "x"))
        docs = docs.orderBy("h").limit(SAMPLE_DOCUMENTS).select("t", "x").toArrow()
        got += [(t, label_language(x), 0.1) for t, x in zip(docs.column(0).to_pylist(), docs.column(1).to_pylist()) if t]
    return LanguageModel([(t, x, w) for t, x, w in got if x])


_PARTS = "id long, part int, parts int, lang string, confidence double, first_char int, last_char int, words int, named string"


def language_parts(df: DataFrame, id_col: str, text_col: str, label_col: str | None, model: LanguageModel) -> DataFrame:
    """``(id, part, parts, lang, confidence, first_char, last_char, words, named)``: the parts of every
    text in order, with the language ``named`` by the row's label (null if none or meaningless).

    A null, empty or blank text, and one of only terms, numbers or signs, is one part with a
    null language and confidence 0. Equal rows come out once; ids may be null. Very long texts
    are labelled whole. An empty table gives an empty table. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PARTS.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for b in batches:
            rec = []
            for i, t, label in zip(*(c.to_pylist() for c in b.columns)):
                ps = model.parts(t)
                named = label_language(label)
                rec += [(i, k, len(ps), lang, conf, s, e, n, named) for k, (lang, s, e, conf, n) in enumerate(ps)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rec) if rec else [()] * len(types), types)], names=names)

    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), label.alias("label")).distinct().mapInArrow(run, _PARTS)

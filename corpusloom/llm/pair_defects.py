"""Defects of prompt and response pairs: empty, copied_question, refusal, wrong_language, truncated.

Copies: the response's words, after labels, are aligned with the prompt's by containment of
three-word shingles and the longest common subsequence, repeated for repeated copies. Refusals: every
sentence of the response but courtesies aligns with a template of slots (:mod:`refusals`). Language: word scores of both
sides; the model is fitted without labels, from function words, on all texts. Truncation: open brackets and
enumerations, trailing commas and, for a response without an end mark, a last word that sentences hardly ever end
with, or that is no word but the beginning of one; how often each word occurs and ends a sentence
is counted over all texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.language_id import LANGS, LanguageModel, fold
from corpusloom.llm.refusals import is_refusal, plain
from corpusloom.llm.wordlists import FUNCTION_WORDS
from corpusloom.session import written

#: Words of the language model, the most frequent of the corpus.
MODEL_WORDS = 200_000
#: Parts that the rows of one last word are spread over.
SALTS = 16
#: A word ends sentences "hardly ever" at this rate or below, if seen at least this often.
FINAL_RATE, FINAL_SEEN = 0.004, 40
#: A last word seen inside texts at most this often, and this much less than a longer one, is cut.
CUT_SEEN, CUT_RATIO = 2, 10
COPY_SHARE = 0.85
LANGUAGE_EVIDENCE = 4.0

#: Labels before an answer or a question, and place-holders, folded.
LABELS = "answer|response|a|tra loi|dap an|cau tra loi|reponse|antwort|respuesta|question|q|you asked|your question|the question|cau hoi|ban hoi|frage|pregunta|vous avez demande"
PLACEHOLDERS = frozenset("n/a|na|n.a|null|none|nil|nan|undefined|tbd|todo|empty|blank|missing|placeholder|no data|khong co|aucun|aucune|keine|ninguno|ninguna|lorem ipsum".split("|"))
_LABEL = re.compile(rf"^[\s*_#>\"'“«\-]*(?:{LABELS})\s*[*_]*\s*[:：]\s*[*_]*\s*")
_TAG = re.compile(r"<[^<>]{0,80}>|&nbsp;?|```\w*")
_ENUM = re.compile(r"(?:^|[\s(])\(?(\d{1,2})[.)](?=\s|$)")
_BULLET = re.compile(r"^\s*[-*•–]\s+\S", re.M)
_ANNOUNCED = re.compile(r"\b([2-9]|1\d)\s+(?:\w+\s+)?(steps?|points?|reasons?|parts?|stages?|bước|buoc|điểm|lý do|phần|étapes?|points|raisons?|schritte?n?|punkte?|gründe|pasos?|puntos?|razones)\b\s*[:.]", re.I)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = row & at.get(w, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - bin(row).count("1")


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    t = fold(_TAG.sub(" ", answer).lower())
    for _ in range(2):
        t = _LABEL.sub("", t)
    t = t.strip(" \t\r\n\"'`*_#()[]{}<>|.…:;,!?-–—/\\​‌‍﻿ ")
    return t in PLACEHOLDERS or not any(c.isalnum() for c in t)


def is_copy(question: list[str], answer_text: str) -> bool:
    t = fold(answer_text.lower().replace("’", "'").replace("ß", "ss"))
    for _ in range(2):
        t = _LABEL.sub("", t)
    a, q = plain(t), question
    if not q or not a or len(a) < COPY_SHARE * len(q):
        return False
    times = max(1, round(len(a) / len(q)))
    if abs(len(a) - times * len(q)) > max(1, 0.1 * len(q) * times):
        return False
    rep = q * times
    if len(q) >= 3:
        mine = {tuple(rep[i : i + 3]) for i in range(len(rep) - 2)}
        theirs = [tuple(a[i : i + 3]) for i in range(len(a) - 2)]
        if sum(x in mine for x in theirs) < 0.5 * len(theirs):
            return False
    return lcs(rep, a) >= COPY_SHARE * max(len(rep), len(a))


def last_word(answer: Column) -> Column:
    """The last word in lower case, with accents, if no end mark follows it; else ''."""
    return F.lower(F.regexp_extract(answer, r"((?=[\p{L}\p{M}\p{N}'’]*[\p{L}\p{M}])[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*)[^\p{L}\p{N}.!?。)\]}]*$", 1))


def is_truncated(answer: str, hangs: bool) -> bool:
    """``hangs``: it ends with a word that sentences hardly ever end with, or with the beginning of one."""
    t = answer.rstrip()
    if t.endswith(("…", "...", "-", "–", "—", ",", ";", ":", "(", "[", "/")):
        return True
    if re.search(r"(?:(?:^|\n|[.!?;]\s)\s*\(?(?:\d{1,2}|[a-z])[.)]|:\s\(?(?:\d{1,2}|[a-z])\))$", t):
        return True
    if re.search(r"(?:\n|^)\s*[-*•–]$", t):
        return True
    bare = re.sub(r"(?:^|(?<=\s))\(?\d{1,2}\)|(?:^|\n)\s*\(?[a-z]\)", " ", t)
    if bare.count("(") > bare.count(")") or bare.count("[") > bare.count("]"):
        return True
    m = _ANNOUNCED.search(t)
    if m:
        items = max(len(_BULLET.findall(t)), len(set(_ENUM.findall(t[m.end() :]))))
        if 0 < items < int(m.group(1)):
            return True
    return hangs


def defect(question: str | None, answer: str | None, model: LanguageModel, hangs: bool, asked: tuple[str | None, float] | None = None) -> str | None:
    """The defect of one pair, or None. ``asked``: the prompt's language, where it is known."""
    if is_empty(answer):
        return "empty"
    q = plain(question or "")
    if is_copy(q, answer):
        return "copied_question"
    if is_refusal(answer, frozenset(q)):
        return "refusal"
    if question:
        asked, e1 = asked or whole_language(model, question)
        given, e2 = whole_language(model, answer)
        if asked and given and asked != given and e1 >= LANGUAGE_EVIDENCE / 2 and e2 >= LANGUAGE_EVIDENCE:
            return "wrong_language"
    return "truncated" if is_truncated(answer, hangs) else None


_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def _words(text: str) -> list[str]:
    """Words in lower case; French elided articles are words of their own."""
    text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text.lower())
    out = []
    for w in _TOKEN.findall(text):
        out += [p for p in re.split(r"(?<=['’])", w) if p] if "'" in w or "’" in w else [w]
    return out


def whole_language(model: LanguageModel, text: str) -> tuple[str | None, float]:
    """The language of a whole text and its evidence over the next best."""
    sums = [0.0] * len(LANGS)
    for w in _words(text):
        a, b, c, d, e = model.score(w)
        sums[0] += a
        sums[1] += b
        sums[2] += c
        sums[3] += d
        sums[4] += e
    order = sorted(sums)
    e = order[-1] - order[-2]
    return (LANGS[sums.index(order[-1])] if e > 0 else None), e


# function words without accents are told apart by those that only one language has
_FUNCTION = {lang: set(ws) | ({fold(w) for w in ws} if lang == "vi" else set()) for lang, ws in FUNCTION_WORDS.items()}
_ONLY = {w: i for i, lang in enumerate(LANGS) for w in _FUNCTION[lang] - set().union(*(o for x, o in _FUNCTION.items() if x != lang))}


def _first_guess(ws: list[str]) -> int | None:
    """The language whose own function words a text has, by number."""
    hits = [0] * len(LANGS)
    for w in ws:
        if w in _ONLY:
            hits[_ONLY[w]] += 1
    best = sorted(hits)
    return hits.index(best[-1]) if best[-1] >= 2 and best[-1] >= 2 * best[-2] else None


def fit_without_labels(texts: DataFrame) -> LanguageModel:
    """A language model from all of ``texts(t)``: each gets its language from function words, and words are counted by language,
    within batches first. The ``MODEL_WORDS`` most frequent words come to the driver; rarer ones are scored by their letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for t in b.column(0).to_pylist():
                ws = _words(t or "")
                i = _first_guess(ws)
                if i is not None:
                    counts.update((w, i) for w in ws)
            ws, ls = zip(*counts) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array(ls, pa.int32()), pa.array(counts.values(), pa.int64())], names=["w", "lang", "n"])

    each = texts.mapInArrow(run, "w string, lang int, n long").groupBy("w").agg(*[F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(LANGS))])
    total = sum((F.col(f"n{i}") for i in range(len(LANGS))), F.lit(0))
    rows = each.orderBy(F.desc(total), "w").limit(MODEL_WORDS).toArrow()
    return LanguageModel.from_counts(dict(zip(rows.column(0).to_pylist(), zip(*(rows.column(i + 1).to_pylist() for i in range(len(LANGS)))))))


def pair_defects(df: DataFrame, id_col: str, question_col: str, answer_col: str) -> DataFrame:
    """``(pair_id, defect)`` of the defective pairs of ``df``, one row per distinct pair.

    A null or blank response is empty. A null or blank prompt rules out only the comparisons
    with it. Repeated rows come out once; ids may be null. Very long texts are judged
    whole. An empty table gives an empty table. Other columns are ignored.
    """
    pairs = df.select(F.col(id_col).cast("string").alias("pair_id"), F.col(question_col).cast("string").alias("q"), F.col(answer_col).cast("string").alias("a")).distinct()
    pairs = written(pairs.withColumn("w", last_word(F.right(F.coalesce("a", F.lit("")), F.lit(60)))))
    model = fit_without_labels(pairs.select(F.explode(F.array("q", "a")).alias("t")))

    # how often words occur and end sentences; which last words of responses sentences hardly end with, or are cut
    token = F.explode(F.regexp_extract_all(F.lower(F.col("a")), F.lit(r"(?U)([\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*)[.!?]?(?=[\s\"',;:()\[\]])"), F.lit(0))).alias("w")
    texts = pairs.select(F.explode(F.array("q", "a")).alias("a")).where("a is not null")
    words = texts.select(F.concat("a", F.when(F.col("a").rlike(r"[.!?]\s*$"), " ").otherwise("")).alias("a")).select(token)
    ends = F.col("w").rlike(r"[.!?]$")
    counts = written(words.groupBy(F.regexp_replace("w", r"[.!?]$", "").alias("w")).agg(F.count("*").alias("n"), F.count_if(ends).alias("final")))
    rare = counts.where((F.col("n") >= FINAL_SEEN) & (F.col("final") <= FINAL_RATE * F.col("n"))).select("w")
    longer = counts.where(F.col("n") >= CUT_RATIO).select(F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("k"), "w", "n").where("k < length(w)").groupBy(F.substring("w", F.lit(1), F.col("k")).alias("w")).agg(F.max("n").alias("longer"))
    lasts = pairs.where("w <> ''").select("w").distinct()
    cut = lasts.join(longer, "w").join(counts, "w", "left").where(F.coalesce("n", F.lit(0)) <= CUT_SEEN).where(F.col("longer") >= CUT_RATIO * F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).select("w")
    hanging = rare.join(lasts, "w", "left_semi").unionByName(cut).distinct().withColumn("hangs", F.lit(True))
    # most responses have no such word, and some words end many: only the others meet the table, by salted words
    salt = F.pmod(F.xxhash64("pair_id", "a"), F.lit(SALTS)).cast("int")
    hanging = hanging.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    some = pairs.where("w <> ''").withColumn("salt", salt).join(hanging, ["w", "salt"], "left").select("pair_id", "q", "a", F.coalesce("hangs", F.lit(False)).alias("hangs"))
    rows = pairs.where("w = ''").select("pair_id", "q", "a", F.lit(False).alias("hangs")).unionByName(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[str, tuple[str | None, float]] = {}  # prompts recur within a batch
            found = []
            for i, q, a, h in zip(*(c.to_pylist() for c in b.columns)):
                if q and q not in known:
                    known[q] = whole_language(model, q)
                d = defect(q, a, model, h, known.get(q))
                if d:
                    found.append((i, d))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], names=["pair_id", "defect"])

    return rows.mapInArrow(run, "pair_id string, defect string").distinct()

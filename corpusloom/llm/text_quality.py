"""Per-document text statistics, and from them natural prose, list, table or junk.

Two comparisons by Jensen-Shannon divergence assign the kind. First, the distribution of
character classes and base letters is compared with the prose profile of each language, next to
the share of that language's function words: text unlike every language, or without
words that repeat sensibly, is junk unless its lines have structure. Second, a text's structure is a distribution over the shapes
of its lines (by words in prose, items and rows), over function words that join clauses, articles and other words, and over
character classes; it is assigned to the nearest of the structural profiles of prose, lists and tables. A list
or table must besides be one in nearly all lines, by definition.

Both kinds of profile are fitted on all documents with a language label: language
profiles are medians, so wrong labels and junk do not move them; structural profiles are means over
the documents whose lines are clearly of one shape. What a text is judged by is measured in one pass over the whole of
each text and written as a row of numbers; fitting and judging read these rows. Nothing is shuffled but sums and counts per task.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.flat_text import fold_table
from corpusloom.llm.wordlists import FUNCTION_WORDS
from corpusloom.session import written

#: Medians are found in rounds: each cuts the interval that holds one into so many parts, which leaves 2**-40 of a share.
BINS, ROUNDS = 1024, 4
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Character classes beside the 26 base letters.
CLASSES = ["digit", "space", "stop", "comma", "other_sign", "other_letter", "bad"]
_KINDS = ("prose", "list", "table")
#: A structure is three distributions: shapes of lines, function words (joining, articles, others) and character classes; their weights.
STRUCTURE_WEIGHTS = (0.6, 0.2, 0.2)
_SIZES = (3, 3, len(CLASSES) + 1)
#: Documents fit a structural profile from this share of one shape on; fewer than this many leave it at the shape alone.
CLEAR, LEAST_CLEAR = 0.9, 5
_OUT = "doc_id long, words int, mean_word_length double, symbol_share double, stop_line_share double, common_word_share double, divergence double, kind string"


def _fold(s: str) -> str:
    t = unicodedata.normalize("NFD", s.lower())
    return "".join(c for c in t if not 0x300 <= ord(c) < 0x370).replace("đ", "d")


_COMMON = {lang: frozenset(w for w in ws) | frozenset(_fold(w) for w in ws) for lang, ws in FUNCTION_WORDS.items()}
#: Function words that join clauses; noun phrases of lists hardly have them.
_ARTICLES = frozenset("the a an of le la les l un une des du de d der die das den dem des ein eine el los las unos una del this our notre unser unsere nuestro nuestra diese esta to do lại từ lai tu phải phai chỉ chi".split())


def _class_table() -> np.ndarray:
    """Code point -> index into letters + CLASSES."""
    other = len(LETTERS)
    t = np.full(0x110000, other + 4, np.uint8)
    fold = fold_table()
    for i in range(0x250):
        c = chr(i)
        if c.isalpha():
            t[i] = LETTERS.find(chr(fold[i]).lower()) if chr(fold[i]).lower() in LETTERS else other + 5
    for i in range(0x1E00, 0x1F00):
        t[i] = LETTERS.find(chr(fold[i]).lower()) if chr(fold[i]).lower() in LETTERS else other + 5
    t[0x300:0x370] = other + 6
    t[ord("đ")] = t[ord("Đ")] = LETTERS.index("d")
    for i in range(0x370, 0x110000):
        if not 0x1E00 <= i < 0x1F00 and chr(i).isalpha():
            t[i] = other + 5
    for c in "0123456789":
        t[ord(c)] = other
    for c in " \n\t\r\xa0":
        t[ord(c)] = other + 1
    for c in ".!?…":
        t[ord(c)] = other + 2
    for c in ",;:'\"()-’–¿¡":
        t[ord(c)] = other + 3
    t[0xFFFD] = other + 6
    t[0x80:0xA0] = other + 6
    t[0:9] = other + 6
    t[0xD800:0xF900] = other + 6
    return t


_TABLE: list[np.ndarray] = []


def char_profile(text: str) -> np.ndarray:
    """Distribution of a text over base letters and character classes."""
    if not _TABLE:
        _TABLE.append(_class_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    # letters of the Latin supplement next to control or sign characters mark broken encoding
    n = np.bincount(_TABLE[0][codes], minlength=len(LETTERS) + len(CLASSES)).astype(np.float64)
    return n / max(1, len(codes))


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of ``p`` from each row of ``q``."""
    tiny = 1e-300
    m = np.log2((p + q) / 2 + tiny)
    return (p * (np.log2(p + tiny) - m) + q * (np.log2(q + tiny) - m)).sum(axis=-1) / 2


_ITEM = re.compile(r"\s*(?:[-*•–—·▪◦‣+>]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)]|\(?[ivxIVX]{1,5}[.)]|\[[ xX✓]?\]|[☐☑✓✗]|\[?\d{1,2}:\d{2}(?::\d{2})?\]?|\w{2,10} \d{1,3}:)\s+(?=\S)")
_BARE = re.compile(r"[^\W_]+")
_TIME = re.compile(r"\s*\[?\d{1,2}:\d{2}")
_RULE = re.compile(r"[\s|+:=\-_–—*]*[|+\-=_]{2,}[\s|+:=\-_–—*]*$")
_NUMBER = re.compile(r"[-+]?[\d.,]*\d[\d.,]*%?$")
_SPLITS = (re.compile(r"\s*\|\s*"), re.compile(r"\t+"), re.compile(r"\s*;\s*"), re.compile(r"\s*,\s*"), re.compile(r" {2,}"))

_SIGNS = ("|", "\t", ";", ",", "  ")


def _cells(line: str) -> tuple[int, int, int]:
    """(separator, cells, numeric or key=value cells) of the best separator."""
    best = (-1, 1, 0)
    s = line.strip().strip("|")
    for i, sep in enumerate(_SPLITS):
        if _SIGNS[i] not in s:
            continue
        parts = [x for x in sep.split(s) if x.strip()]
        if len(parts) > best[1]:
            hard = sum(1 for x in parts if _NUMBER.match(x.strip()) or "=" in x)
            wordy = sum(len(x.split()) for x in parts) / len(parts)
            if i in (0, 1) or wordy <= 2.5:
                best = (i, len(parts), hard)
    return best


def line_shapes(lines: list[str], common: frozenset[str]) -> tuple[float, float, float]:
    """Shares of (prose, item, row) among the words of non-blank lines, by the lines' shape."""
    n = len(lines)
    cells = [_cells(x) for x in lines]
    usual = Counter((s, c) for s, c, _ in cells if c > 1)
    rows = [False] * n
    if usual:
        (sep, width), seen = usual.most_common(1)[0]
        if seen >= 2 or (n == 1 and width >= 4):
            for i, (s, c, hard) in enumerate(cells):
                same = s == sep and abs(c - width) <= (1 if sep in (0, 1) else 0)
                rows[i] = same and (sep in (0, 1) or hard >= 1 or i == 0) or bool(_RULE.match(lines[i]))
            if sep not in (0, 1) and sum(h for _, _, h in cells) < 0.3 * sum(rows) * width:
                rows = [False] * n
    item, prose, row = 0, 0, sum(max(1, len(x.split())) for x, r in zip(lines, rows) if r)
    for i, line in enumerate(lines):
        if rows[i]:
            continue
        if i == 0 and n > 2 and line.rstrip().endswith(":"):
            continue  # a heading of what follows
        m = _ITEM.match(line)
        rest = (line[m.end() :] if m else line).split()
        if len(rest) > 10:
            prose += len(rest)
            continue
        joins = sum(1 for w in rest if w.lower().strip(".,;:!?") in common and w.lower() not in _ARTICLES)
        short = len(rest) <= 8 and not line.rstrip().endswith((".", "!", "?"))
        if m and (len(rest) <= 10 and (joins <= 1 or not _TIME.match(line)) if not line.lstrip().startswith(">") else False):
            item += max(1, len(rest))
        elif short and joins == 0 and len(rest) >= 1 and len(lines) > 2:
            item += max(1, len(rest))
        else:
            prose += max(1, len(rest))
    total = max(1, prose + item + row)
    return prose / total, item / total, row / total


def structure(shape: tuple[float, float, float], joins: float, articles: float, p: np.ndarray) -> np.ndarray:
    """The structure of a text as one distribution."""
    k = len(LETTERS)
    parts = (np.array(shape), np.array([joins, articles, max(0.0, 1 - joins - articles)]), np.append(p[:k].sum(), p[k:]))
    return np.concatenate([w * x / max(x.sum(), 1e-9) for w, x in zip(STRUCTURE_WEIGHTS, parts)])


def shape_profiles() -> np.ndarray:
    """Structural profiles by shape alone, all else even."""
    even = np.concatenate([w * np.full(n, 1 / n) for w, n in zip(STRUCTURE_WEIGHTS[1:], _SIZES[1:])])
    return np.array([np.concatenate([STRUCTURE_WEIGHTS[0] * x, even]) for x in np.eye(3)])


def _seen(text: str) -> tuple[str, Counter, list[str], np.ndarray, tuple[float, float, float], np.ndarray, float, int]:
    """(language, words, bare words, characters, shapes, structure, share of function words, lines) of a text."""
    lines = [x for x in text.split("\n") if x.strip()]
    p = char_profile(text)
    bare = _BARE.findall(text.lower())
    count = Counter(bare)
    total = max(1, len(bare))
    common_share, lang = max((sum(c for w, c in count.items() if w in ws) / total, lang) for lang, ws in _COMMON.items())
    articles = sum(c for w, c in count.items() if w in _COMMON[lang] and w in _ARTICLES) / total
    shape = line_shapes(lines, _COMMON[lang]) if lines else (0.0, 0.0, 0.0)
    return lang, count, bare, p, shape, structure(shape, common_share - articles, articles, p), common_share, len(lines)


def measure(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(scalars, characters, shapes, structure)`` of one text: all that :func:`judge` needs."""
    text = text or ""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    _, count, bare, p, shape, form, common_share, _ = _seen(text)
    k = len(LETTERS)
    stops = sum(1 for x in lines if x.rstrip().rstrip("\"'”’)]»*_").endswith((".", "!", "?", "…", ":", ";"))) / max(1, len(lines))
    mean_len = sum(map(len, words)) / max(1, n)
    bad = float(p[k + 6]) + text.count("Ã") / max(1, len(text))
    top_share = max(count.values(), default=0) / max(1, len(bare))
    lone = n >= 12 and (len(count) <= 3 or top_share > 0.5)
    mean_run = float(np.mean([len(w) for w in bare])) if bare else 0.0
    return np.array([n, mean_len, stops, common_share, bad, lone, mean_run, len(text), len(lines)]), p, np.array(shape), form


def judge(scalars: np.ndarray, p: np.ndarray, shape: np.ndarray, form: np.ndarray, profiles: np.ndarray, structures: np.ndarray) -> tuple:
    """Statistics and kind of a measured text."""
    n, mean_len, stops, common_share, bad, lone, mean_run, size, lines = scalars.tolist()
    k = len(LETTERS)
    symbols = float(p[k + 4] + p[k + 6])
    letters = float(p[:k].sum() + p[k + 5])
    # the nearest language by characters, each divergence less the sampling noise of a short text
    noise = min(0.3, 8.0 / max(1, size))
    d = float(divergence(p, profiles).min()) if len(profiles) else 0.0
    # list items carry numbers and marks: only their letters are compared
    spelt = p[:k] / max(p[:k].sum(), 1e-9)
    by_letter = float(divergence(spelt, profiles[:, :k] / profiles[:, :k].sum(axis=1, keepdims=True)).min()) if len(profiles) else 0.0
    kind = "prose"
    nearest = _KINDS[int(divergence(form, structures).argmin())]
    mean_run = mean_run if letters else 0.0
    if not n or not letters + p[k] or bad > 0.03 or lone:
        kind = "junk"
    elif nearest == "table" and shape[2] >= 0.6:
        kind = "table"
    elif nearest == "list" and shape[1] >= 0.85 and lines >= 3 and letters > 0.4 and mean_run < 16 and by_letter - noise < 0.16:
        kind = "list"
    elif letters < 0.4 or mean_run > 16 or (common_share < 0.08 and d - noise > 0.05) or (common_share < 0.02 and n >= 8):
        kind = "junk"
    return int(n), mean_len, symbols, stops, common_share, d, kind


def assess(text: str | None, profiles: np.ndarray, structures: np.ndarray | None = None) -> tuple:
    """Statistics and kind of one text."""
    return judge(*measure(text), profiles, shape_profiles() if structures is None else structures)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(df: DataFrame, count: Callable[[pa.RecordBatch], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums of arrays by key over all batches; each task sends one row per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for key, x in count(b).items():
                total[key] = total[key] + x if key in total else x
        for key, x in total.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.string()), pa.array(at), pa.array(x[at].astype(np.float64))], names=["key", "at", "x"])

    got = df.mapInArrow(run, "key string, at long, x double").groupBy("key", "at").agg(F.sum("x").alias("x")).toArrow()
    out: dict[str, np.ndarray] = {}
    keys, at, x = np.array(got.column("key").to_pylist(), object), got.column("at").to_numpy(), got.column("x").to_numpy()
    for key in set(keys.tolist()):
        own = keys == key
        out[key] = np.zeros(at[own].max() + 1)
        out[key][at[own]] = x[own]
    return out


def fit_profiles(measured: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Character profiles of the five languages (medians), and structural profiles of prose, lists and tables (means over clear
    cases), over all rows of ``measured(lang, fit, p, shape, form)`` that are marked ``fit``."""
    rows = measured.where("fit").select("lang", "p", "shape", "form")
    size, width = len(LETTERS) + len(CLASSES), sum(_SIZES)

    def totals(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        shapes, forms = _matrix(b.column(2)), _matrix(b.column(3))
        out = {kind: np.append(forms[shapes[:, i] >= CLEAR].sum(axis=0), (shapes[:, i] >= CLEAR).sum()) for i, kind in enumerate(_KINDS)} if b.num_rows else {}
        langs = np.array(b.column(0).to_pylist(), object)
        return out | {f"n:{lang}": np.array([(langs == lang).sum()]) for lang in set(langs.tolist())}

    sums = _summed(rows, totals)
    number = {key[2:]: int(x[0]) for key, x in sorted(sums.items()) if key.startswith("n:") and x[0] >= 5}
    structures = shape_profiles()
    for i, kind in enumerate(_KINDS):
        x = sums.get(kind, np.zeros(0))
        if len(x) > width and x[width] >= LEAST_CLEAR:
            structures[i] = x[:width] / x[width]
    # the lower and the upper middle value of each column: where its interval begins, and how many values lie before that
    cells = {(lang, side): np.zeros(size, np.int64) for lang in number for side in (0, 1)}
    before = {key: np.zeros(size) for key in cells}
    for depth in range(1, ROUNDS + 1 if cells else 1):
        known, scale = dict(cells), BINS**depth

        def bins(b: pa.RecordBatch, known: dict = known, scale: int = scale) -> dict[str, np.ndarray]:
            langs, p = np.array(b.column(0).to_pylist(), object), np.minimum((_matrix(b.column(1)) * scale).astype(np.int64), scale - 1)
            out = {}
            for (lang, side), start in known.items():
                own = p[langs == lang]
                row, col = np.nonzero(own // BINS == start)
                out[f"{lang}:{side}"] = np.bincount(col * BINS + own[row, col] % BINS, minlength=size * BINS)
            return out

        counts = _summed(rows, bins)
        for (lang, side), start in cells.items():
            x = np.zeros(size * BINS)
            got = counts[f"{lang}:{side}"]
            x[: len(got)] = got
            run = np.cumsum(x.reshape(size, BINS), axis=1) + before[lang, side][:, None]
            rank = (number[lang] - 1 + side) // 2
            pick = (run <= rank).sum(axis=1)
            before[lang, side] = np.where(pick > 0, run[np.arange(size), np.maximum(pick - 1, 0)], before[lang, side])
            cells[lang, side] = start * BINS + pick
    medians = [(cells[lang, 0] + cells[lang, 1]) / (2 * BINS**ROUNDS) for lang in number]
    return np.array([m / m.sum() for m in medians]), structures


def text_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``(doc_id, words, mean_word_length, symbol_share, stop_line_share, common_word_share,
    divergence, kind)`` for every row.

    A null, empty or blank text has zero counts and is junk. Repeated rows come out as often as
    they are given; ids may be null. An empty table gives an empty table. Other columns are
    ignored.
    """
    label = F.lower(F.col(lang_col).cast("string")) if lang_col else F.lit(None).cast("string")
    fit = F.coalesce(label.isin(*FUNCTION_WORDS) & (F.length(F.col(text_col).cast("string")) >= 200), F.lit(False))
    given = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), label.alias("lang"), fit.alias("fit"))
    parts = ["scalars", "p", "shape", "form"]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([r[i].tolist() for r in rows], pa.list_(pa.float64())) for i in range(len(parts))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *cols], names=["doc_id", "lang", "fit", *parts])

    measured = given.mapInArrow(seen, "doc_id long, lang string, fit boolean, " + ", ".join(f"{c} array<double>" for c in parts))
    profiles, structures = np.empty((0, 0)), shape_profiles()
    if lang_col:
        measured = written(measured)
        profiles, structures = fit_profiles(measured)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            res = [judge(*x, profiles, structures) for x in zip(*(_matrix(c) for c in b.columns[1:]))] if b.num_rows else []
            cols = list(zip(*res)) if res else [()] * 7
            types = [pa.int32(), *[pa.float64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=[x.split()[0] for x in _OUT.split(", ")])

    return measured.select("doc_id", *parts).mapInArrow(run, _OUT)

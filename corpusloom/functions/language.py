"""Rule-based language detection of short queries as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import rules as R
from corpusloom.functions.text import let


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-zA-ZÀ-ỹ]+(?:'[a-zA-ZÀ-ỹ]+)?"), F.lit(0))


def has_diacritics(c: Column) -> Column:
    return F.lower(c).rlike(f"[{R.DIACRITICS}]")


def _hits(ts: Column, vocabulary: list[str]) -> Column:
    return F.size(F.array_intersect(ts, F.array(*[F.lit(w) for w in dict.fromkeys(vocabulary)])))


def english_score(ts: Column) -> Column:
    s = (2 * _hits(ts, R.ENGLISH_STRONG) + _hits(ts, R.ENGLISH_MEDIUM)) / F.size(ts)
    return F.when(F.size(ts) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), s))


def pattern_weights(c: Column) -> tuple[Column, Column]:
    """(sum of weights, number) of the matching Vietnamese patterns."""
    low = F.lower(c)
    hits = [(low.rlike("(?U)" + p), w) for p, w in R.VIETNAMESE_PATTERNS]
    total = sum((F.when(h, F.lit(w)).otherwise(0.0) for h, w in hits), F.lit(0.0))
    return total, sum((h.cast("int") for h, _ in hits), F.lit(0))


def vietnamese_score(c: Column, ts: Column) -> Column:
    total, n = pattern_weights(c)
    share = F.when(F.size(ts) == 0, F.lit(0.0)).otherwise(_hits(ts, R.VIETNAMESE_STRONG) / F.size(ts))
    return F.when(n > 0, F.least(F.lit(1.0), F.lit(0.8) * total / n + F.lit(0.2) * share)).otherwise(F.least(F.lit(1.0), share))


def bands(vi: Column, en: Column) -> tuple[Column, Column]:
    """(language, confidence) by the gap of the scores."""
    gap = F.abs(vi - en)
    lang = F.when(vi > en, "vi").when(en > vi, "en").otherwise("unknown")
    conf = F.when(vi == en, F.lit(0.3)).when(gap > 0.4, F.lit(0.95)).when(gap > 0.2, F.lit(0.7)).otherwise(F.lit(0.5))
    return lang, conf


def detect(c: Column, model: Column | None = None) -> Column:
    """``(language, confidence, method, is_uncertain, en_score, vi_score)``. ``model`` is the
    language a pluggable model gives; without one the fallback is English at 0.6."""
    text = F.trim(F.coalesce(c, F.lit("")))
    scores = let(tokens(text), lambda ts: F.struct(english_score(ts).alias("en"), vietnamese_score(text, ts).alias("vi"), pattern_weights(text)[1].alias("n"), has_diacritics(text).alias("mark"), text.alias("text")))
    return let(scores, lambda s: _decide(s, model))


def _decide(s: Column, model: Column | None) -> Column:
    en, vi, n, mark, text = s["en"], s["vi"], s["n"], s["mark"], s["text"]
    lang, conf = bands(vi, en)
    sure, fallback = conf >= 0.7, n == 0
    language = F.when(text == "", "en").when(mark, "vi").when(sure, lang).when(fallback, F.coalesce(model, F.lit("en")) if model is not None else F.lit("en")).otherwise(lang)
    confidence = F.when(text == "", F.lit(0.5)).when(mark, F.lit(0.98)).when(sure, conf).when(fallback, F.lit(0.6)).otherwise(conf)
    method = F.when(text == "", "empty").when(mark, "diacritic").when(sure, "heuristic").when(fallback, "fallback").otherwise("heuristic")
    return F.struct(language.alias("language"), confidence.alias("confidence"), method.alias("method"), (confidence < 0.5).alias("is_uncertain"), en.alias("en_score"), vi.alias("vi_score"))

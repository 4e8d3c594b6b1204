"""Text cleaning and segmentation as column expressions; nothing leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import rules as R


def _sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def let(value: Column, f) -> Column:
    """``f(value)`` with the value evaluated once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def capital(c: Column) -> Column:
    """The first character in upper case."""
    return let(c, lambda t: F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, 2, 1 << 30)))


def _any(words) -> str:
    return "|".join(words)


def normalize_space(c: Column) -> Column:
    """Runs of white space become one blank; null becomes ''."""
    return F.trim(_sub(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def clean_segment(c: Column, strict_boundaries: bool = False) -> Column:
    """Stage-2 cleaning of a caption segment. The trailing filler needs no word boundary on its
    left ("the transformer" loses its "er") unless ``strict_boundaries``."""
    t = _sub(F.coalesce(c, F.lit("")), r"[\r\n]", " ")
    t = _sub(t, r"\b\d{1,2}:\d{2}(?::\d{2})?\s*-->\s*\d{1,2}:\d{2}(?::\d{2})?\b", " ")
    t = _sub(t, r"(?<!\d)\d{1,2}:\d{2}(?::\d{2})?(?!\d)", " ")
    t = _sub(t, rf"(?i)\[(?:{_any(R.BRACKET_WORDS)}).*?\]", " ")
    t = _sub(t, r"<[^>]+>", " ")
    t = normalize_space(t)
    t = _sub(t, rf"(?iU)^(?:(?:{_any(R.LEADING_FILLERS)})\b[\s,.-]*)+")
    for group in (R.INLINE_FILLERS, R.INLINE_PHRASES):
        t = _sub(t, rf"(?i)(^|[\s,.;!?-])(?:{_any(group)})(?=$|[\s,.;!?-])", "$1")
    edge = r"(?<![\p{L}\p{N}_])" if strict_boundaries else ""
    t = _sub(t, rf"(?i)(?:[\s,.;!?-]*{edge}(?:{_any(R.INLINE_FILLERS + R.INLINE_PHRASES)}))+$")
    t = _sub(_sub(t, r"\s+([,.;!?])", "$1"), r"([,.;!?]){2,}", "$1")
    return F.btrim(t, F.lit(" -.,;:!?"))


def clean_chunk(c: Column, ascii_only: bool = True) -> Column:
    """Stage-3 cleaning: contractions, fillers, character filter, capital."""
    t = F.concat(F.lit(" "), F.coalesce(c, F.lit("")), F.lit(" "))
    for wrong, right in R.CONTRACTIONS.items():
        w, r = f" {wrong} ", f" {right} "
        for a, b in ((w, r), (w.upper(), r), (w.title(), r.title())):
            t = F.replace(t, F.lit(a), F.lit(b))
    for f in (*R.CHUNK_FILLER_PHRASES, *R.CHUNK_FILLER_WORDS):
        t = _sub(t, rf"(?iU)\b{f}\b", " ")
    t = _sub(t, r"[^a-zA-Z0-9\s.,!?']" if ascii_only else r"(?U)[^\p{L}\p{N}\s.,!?']")
    t = normalize_space(t)
    return capital(t)


def clean_context(c: Column) -> Column:
    """Stage-8 cleaning: fillers, repeated words, white space. The boundary before a filler is looked for after its letters, as
    asking for one at every character is slow."""
    t = F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))
    for f in R.CONTEXT_FILLERS:
        t = _sub(t, rf"(?iU){f}\b(?<=\b{f})")
    return normalize_space(_sub(t, r"(?U)\b(\w++)( \1\b)+", "$1"))


def clean_v1(c: Column) -> Column:
    """The oldest cleaner: markers, bracketed text, white space, edges."""
    t = _sub(c, r"\n", " ")
    for m in R.V1_MARKERS:
        t = F.replace(t, F.lit(m), F.lit(""))
    return F.btrim(_sub(_sub(t, r"\[.*?\]"), r"(?U)\s+", " "), F.lit(" -.,"))


def remove_fillers(c: Column) -> Column:
    """Words that are fillers once their end marks are gone are dropped."""
    bare = lambda w: F.rtrim(F.lower(w), F.lit(".,!?"))
    return F.array_join(F.filter(words(c), lambda w: ~bare(w).isin(*R.V1_FILLERS)), " ")


def clean_embedding(c: Column, rewrites: dict[str, str] | None = None) -> Column:
    """Cleaner of embedding text. ``rewrites`` maps patterns to replacements: corpus-specific
    phrase rules are data of the caller."""
    t = _sub(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")
    for f in R.EMBEDDING_FILLERS:
        t = _sub(t, rf"(?iU)\b{f}\b")
    t = _sub(t, r"(?U)\s+", " ")
    for a, b in (rewrites or {}).items():
        t = _sub(t, f"(?iU){a}", b)
    t = _sub(_sub(_sub(t, r"\s*,\s*", ", "), r"\s*\.\s*", ". "), r"\s*,\s*,\s*", ",")
    # a word is capital if none stands before it, or one with an end mark
    cap = let(words(t), lambda ws: F.zip_with(ws, F.concat(F.array(F.lit(".")), ws), lambda w, before: F.when(before.rlike(r"[.!?]$"), capital(w)).otherwise(w)))
    text = F.array_join(F.filter(cap, lambda w: w.isNotNull()), " ")
    return let(text, lambda x: F.when((x == "") | x.rlike(r"[.!?]$"), x).otherwise(F.concat(x, F.lit("."))))


def normalize_text(c: Column) -> Column:
    """Chunk-v2 normalisation: white space, punctuation, edges, capital."""
    t = _sub(_sub(F.coalesce(c, F.lit("")), r"[\n\r]", " "), r"(?U)\s+", " ")
    t = F.btrim(_sub(_sub(t, r"\s+([,.;!?])", "$1"), r"([,.;!?]){2,}", "$1"), F.lit(" -.,;:!?"))
    return capital(t)


def words(c: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit("")))).cast("bigint")


def token_estimate(c: Column, factor: float = 1.3, least: int = 0) -> Column:
    """Words times ``factor``, rounded half to even."""
    return F.greatest(F.lit(least).cast("bigint"), F.bround(word_count(c) * F.lit(factor), 0).cast("bigint"))


def split_sentences(c: Column) -> Column:
    """Split after an end mark; pieces of up to three characters are dropped."""
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 3)


def is_complete(c: Column) -> Column:
    return F.trim(c).rlike(r"[.!?]\s*$")


def halves(c: Column) -> Column:
    """(first, second): at the middle sentence, or the middle word of a single sentence."""
    s, w = F.filter(F.split(c, r"(?U)(?<=[.!?])\s+"), lambda x: x != ""), words(c)
    parts = F.when(F.size(s) >= 2, s).otherwise(w)
    mid = F.floor(F.size(parts) / 2).cast("int")
    join = lambda a: F.array_join(a, " ")
    return F.struct(join(F.slice(parts, 1, mid)).alias("first"), join(F.slice(parts, mid + 1, F.size(parts))).alias("second"))


def extract_topic(title: Column) -> Column:
    """What follows "I ", else a version mark; else the whole title."""
    after = F.trim(F.split_part(title, F.lit("I "), F.lit(2)))
    after = F.trim(_sub(_sub(after, r"(?U)^[\w\s]+,\s*"), r"(?U)\s+\w+ \d{4}$"))
    out = F.when(title.contains("I "), after)
    for v in ("V2", "V3", "V4", "V5"):
        out = out.when(title.contains(v), F.trim(F.split_part(title, F.lit(v), F.lit(2))))
    return out.otherwise(title)


def content_words(c: Column) -> Column:
    """Distinct lower-case words of over two characters that are no stop words."""
    t = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9']+"), F.lit(0))
    return F.array_distinct(F.filter(t, lambda w: (F.length(w) > 2) & ~w.isin(*R.STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays of distinct words; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def starts_with_any(c: Column, prefixes) -> Column:
    t = F.lower(F.trim(c))
    return reduce(lambda x, y: x | y, [F.startswith(t, F.lit(p)) for p in prefixes])


# keywords, topics and the embedding header


def contains_word(lowered: Column, word: str) -> Column:
    """Whole-word test, free of look-arounds so that other engines agree."""
    w = word.replace("-", r"\-")
    return lowered.contains(word) & lowered.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])")


def keywords(c: Column, most: int = R.MAX_KEYWORDS, least_length: int = 3) -> Column:
    """Keywords found, in list order, without those whose words an accepted one holds."""

    def of(low: Column) -> Column:
        rows = [F.struct(F.lit(k).alias("k"), F.array(*[F.lit(t) for t in k.replace("-", " ").split()]).alias("t"), contains_word(low, k).alias("hit")) for k in R.KEYWORDS if len(k) >= least_length]
        none = F.array().cast("array<struct<k:string,t:array<string>>>")
        held = lambda acc, x: F.exists(acc, lambda a: F.size(F.array_except(x["t"], a["t"])) == 0)
        step = lambda acc, x: F.when(x["hit"] & (F.size(acc) < most) & ~held(acc, x), F.array_append(acc, F.struct(x["k"].alias("k"), x["t"].alias("t")))).otherwise(acc)
        return F.aggregate(F.array(*rows), none, step, lambda acc: F.transform(acc, lambda a: a["k"]))

    return let(F.lower(F.coalesce(c, F.lit(""))), of)


def keyword_hints(found: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in R.KEYWORDS.items() for x in kv])
    return F.array_distinct(F.transform(found, lambda k: m[k]))


def topic(c: Column) -> Column:
    """The topic with most keywords present; the first of equals; a default for none."""

    def best(low: Column) -> Column:
        scores = [F.struct(sum(contains_word(low, k).cast("int") for k in ks).alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, ks) in enumerate(R.TOPICS.items())]
        return F.array_max(F.array(*scores))

    return let(let(F.lower(F.coalesce(c, F.lit(""))), best), lambda b: F.when(b["s"] > 0, b["name"]).otherwise(F.lit(R.DEFAULT_TOPIC)))


def embedding_text(course: Column, title: Column, text: Column, start: Column, end: Column, budget: int = R.EMBEDDING_TOKENS) -> Column:
    """Header lines and content; over the budget hints go first, then keywords from the end
    down to three. The first candidate within the budget wins, else the last."""
    body = F.trim(F.coalesce(text, F.lit("")))
    time = F.concat(F.lit("Time: "), clock(start, hours=True), F.lit(" - "), clock(end, hours=True))
    head = F.concat_ws("\n", F.concat(F.lit("Course: "), F.coalesce(course, F.lit("Unknown"))), F.concat(F.lit("Lecture: "), F.coalesce(title, F.lit("Unknown"))), time, F.concat(F.lit("Topic: "), topic(body)))

    def pick(x: Column) -> Column:
        found = x["found"]
        n = F.size(found)

        def build(ks: Column, hints: bool) -> Column:
            lines = [x["head"], F.when(F.size(ks) > 0, F.concat(F.lit("Keywords: "), F.array_join(ks, ", ")))]
            if hints:
                lines.append(F.when(n > 0, F.concat(F.lit("Keywords (Vietnamese): "), F.array_join(keyword_hints(found), ", "))))
            return F.concat_ws("\n", *lines, F.lit(""), F.lit("Content:"), x["body"])

        cut = [build(F.slice(found, F.lit(1), F.greatest(n - i, F.least(n, F.lit(R.MIN_KEYWORDS)))), False) for i in range(R.MAX_KEYWORDS - R.MIN_KEYWORDS + 1)]
        return let(F.array(build(found, True), *cut), lambda cs: F.coalesce(F.get(F.filter(cs, lambda t: token_estimate(t, 1.28) <= budget), F.lit(0)), F.element_at(cs, -1)))

    return let(F.struct(body.alias("body"), keywords(body).alias("found"), head.alias("head")), pick)


def context_header(course: Column, title: Column, source: Column, start: Column, end: Column) -> Column:
    """Four lines and a blank one before a text that is to be embedded."""
    or_unknown = lambda c: F.coalesce(c, F.lit("Unknown"))
    return F.concat(F.lit("Course: "), or_unknown(course), F.lit("\nVideo: "), or_unknown(title), F.lit("\nSource: "), or_unknown(source), F.lit("\nTime: "), clock(start, True), F.lit(" - "), clock(end, True), F.lit("\n\n"))


def embedding_ready(chunks, text: Column):
    """Sixteen columns with defaults; ``embedding_text`` is the header and ``text``, a cleaned form of the chunk's own."""
    words = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("chunk_id", "video_id", "title", "course", "playlist_id", "published_at", "source", "chunk_type", "chunk_text")]
    numbers = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("chunk_index", "start_time", "end_time", "duration", "word_count", "token_estimate")]
    head = context_header(F.col("course"), F.col("title"), F.col("source"), F.col("start_time"), F.col("end_time"))
    return chunks.select(*words, *numbers, F.concat(head, F.coalesce(text, F.lit(""))).alias("embedding_text"))


# times, ids, addresses, citations, JSON


def clock(seconds: Column, hours: bool | None = None) -> Column:
    """``hours`` None: always HH:MM:SS; True: hours only if any; False: minutes may pass 59."""
    s = F.greatest(F.lit(0), F.floor(F.coalesce(seconds, F.lit(0.0)))).cast("bigint")
    h, m, x = F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), (s % 60).cast("bigint")
    long, short = F.format_string("%02d:%02d:%02d", h, m, x), F.format_string("%02d:%02d", m, x)
    if hours is None:
        return long
    if hours:
        return F.when(h > 0, long).otherwise(short)
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("bigint"), x)


def video_url(video: Column, start: Column) -> Column:
    return F.format_string("https://youtu.be/%s?t=%d", video, F.coalesce(start, F.lit(0.0)).cast("bigint"))


def thumbnail_url(video: Column) -> Column:
    return F.format_string("https://img.youtube.com/vi/%s/mqdefault.jpg", video)


def chunk_id(video: Column, kind: str | Column, version: str, index: Column, start: Column | None = None, end: Column | None = None) -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    base = F.format_string("%s:%s:%s:%04d", video, k, F.lit(version), index)
    if start is None:
        return base
    ms = lambda c: F.format_string("%010d", F.round(c * 1000).cast("bigint"))
    return F.concat_ws(":", base, ms(start), ms(end))


def citations(c: Column) -> Column:
    """Distinct numbers in square brackets, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int")))


def citation_confidence(c: Column) -> Column:
    n = F.size(citations(c))
    return F.when(n >= 2, "high").when(n == 1, "medium").otherwise("low")


def strip_citations(c: Column) -> Column:
    return F.trim(_sub(c, r"\[\d+\]"))


def conversation_title(c: Column, most: int = 6) -> Column:
    ws = words(c)
    return F.when(F.size(ws) > most, F.concat(F.array_join(F.slice(ws, 1, most), " "), F.lit("..."))).otherwise(F.array_join(ws, " "))


def playlist_id(url: Column) -> Column:
    """The text after ``list=`` up to the next ``&``."""
    return F.when(url.contains("list="), F.split_part(F.split_part(url, F.lit("list="), F.lit(-1)), F.lit("&"), F.lit(1)))


def json_payload(c: Column) -> Column:
    """JSON text inside optional code fences."""
    return F.trim(_sub(_sub(F.trim(c), r"^```(?:json)?\s*"), r"\s*```$"))


def clamp_score(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def error_class(message: Column) -> Column:
    """Fetch errors by what their text says."""
    m = F.lower(message)
    return F.when(m.rlike("429|too many requests|blocked|ipblocked|requestblocked"), "blocked").when(m.contains("disabled"), "transcripts_disabled").when(m.rlike("no transcript|notranscript"), "no_transcript").otherwise("error")


def is_rate_limit(message: Column) -> Column:
    return F.lower(message).rlike("429|rate_limit|quota")


def distance_similarity(distance: Column, metric: str) -> Column:
    if metric == "inner_product":
        return distance
    return 1 - distance if metric == "cosine" else 1 / (1 + F.greatest(distance, F.lit(0.0)))

"""Text functions as Column expressions: tokenizer, stemmer, cue splitting, corrections, stated claims, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts written without spaces (Hiragana, Katakana, Han, Hangul), for character bigrams.
CJK_RUN = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]+"
WORD_RUN = r"[\p{L}\p{N}_]+"
#: White space of any script, spelt out so that every engine takes the same.
BLANK = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Openers that announce a change to something said before.
CORRECTION = r"(?i)^\s*(?:(?:actually|nope|wait|correction|instead|scratch that|change of plan|on second thought|forget (?:that|what i said))\b|no[,.!-]\s)"
#: Terms too common to say what a message is about.
STOP_TERMS = """
a an the to of in on for and or it is be as at by we i you that this now not no so just with from actually instead should
would will can do did does have has had but if then than all any one too also still again rather plain change changed
switch flip reverse use keep make put get go
""".split()
#: Fixed value: a numbered or bulleted line.
CUE_ITEM = r"^\s*(?:\d+[.)]|[-*•])\s*"
#: The argument names whose first non-blank value describes a tool call.
DIGEST_KEYS = ("description", "query", "prompt", "pattern", "command", "file_path", "path", "url")


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stem(term: Column) -> Column:
    """Folds -ing, -ed and -s of plain ASCII words that are long enough; other terms stay."""
    n = F.length(term)
    plain = term.rlike("^[a-z]+$")
    return (
        F.when(~plain, term)
        .when((n > 5) & term.endswith("ing"), F.left(term, n - 3))
        .when((n > 4) & term.endswith("ed"), F.left(term, n - 2))
        .when((n > 3) & term.endswith("s") & ~term.endswith("ss"), F.left(term, n - 1))
        .otherwise(term)
    )


def cjk_bigrams(text: Column | str) -> Column:
    """Overlapping bigrams of each run of two or more space-free-script characters."""
    runs = F.filter(F.regexp_extract_all(column(text), F.lit(CJK_RUN), F.lit(0)), lambda r: F.length(r) > 1)
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))))


def tokenize(text: Column | str) -> Column:
    """Lexical keys of a text, repeats kept: stemmed lower-case words, then CJK bigrams. Null gives null."""
    words = F.regexp_extract_all(F.lower(column(text)), F.lit(WORD_RUN), F.lit(0))
    return F.concat(F.transform(words, stem), cjk_bigrams(text))


def similarity(left: Column, right: Column, distinct: bool = False) -> Column:
    """Jaccard similarity of two term arrays as sets; 0 where either is empty. distinct: neither repeats a term."""
    a, b = (left, right) if distinct else (F.array_distinct(left), F.array_distinct(right))
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def split_cue(text: Column | str) -> Column:
    """Numbered or bulleted lines with at least three terms, without their markers; empty unless there are two or more."""
    lines = F.filter(F.split(column(text), r"\r?\n"), lambda x: x.rlike(CUE_ITEM))
    parts = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, CUE_ITEM, ""))), lambda x: F.size(tokenize(x)) >= 3)
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def is_correction(text: Column | str) -> Column:
    return column(text).rlike(CORRECTION)


def topic_terms(terms: Column | str) -> Column:
    """Distinct terms longer than one character that aren't stop terms."""
    stop = F.array(*[F.lit(w) for w in STOP_TERMS])
    return F.array_except(F.filter(column(terms), lambda t: F.length(t) > 1), stop)


def clip(text: Column | str, limit: int) -> Column:
    return F.left(column(text), F.lit(limit))


def short(text: Column | str, limit: int) -> Column:
    """White space flattened; cut to the limit with three dots."""
    flat = F.trim(F.regexp_replace(column(text), BLANK + "+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit - 3)), F.lit("..."))).otherwise(flat)


def tidy(value: Column) -> Column:
    """White space collapsed, leading and trailing punctuation of both scripts removed."""
    flat = F.regexp_replace(value, r"\s+", " ")
    return F.trim(F.regexp_replace(flat, r"^[\s,:：、]+|[\s.,!?;。！？；、]+$", ""))


#: Fixed values: (belief type, pattern) in order of precedence; the first group is what the statement is about.
STATED_CUES = (
    ("preference", r"(?i)\bi (?:prefer|like|usually use|normally use|tend to use)\s+(.{3,})"),
    ("preference", r"(?i)\bi(?:'d| would) rather\s+(.{3,})"),
    ("preference", r"(?i)\bmy preference is\s+(.{3,})"),
    ("preference", r"(?i)^please\s+(?:always\s+)?use\s+(.{3,})"),
    ("preference", r"我(?:喜欢|偏好|更喜欢|倾向于|更倾向于|习惯用|一般用|通常用)\s*(.{2,})"),
    ("preference", r"我的偏好是\s*(.{2,})"),
    ("constraint", r"(?i)^(?:please\s+)?(?:never|do not|don't|avoid)\s+(.{3,})"),
    ("constraint", r"(?i)^(?:please\s+)?always\s+(.{3,})"),
    ("constraint", r"(?i)\byou must(?: not)?\s+(.{3,})"),
    ("constraint", r"^(?:请)?(?:不要|别|禁止|不准|不能)\s*(.{2,})"),
    ("constraint", r"^(?:请)?(?:必须|一定要|务必)\s*(.{2,})"),
)
SENTENCE = r"[.!?;。！？；\n]+"


def stated_claims(text: Column | str, least: int = 3, most: int = 60) -> Column:
    """ARRAY<STRUCT<type, subject, sentence>>: at most one claim per sentence, by the first cue with a long enough subject."""

    def claim(sentence: Column) -> Column:
        options = []
        for kind, pattern in STATED_CUES:
            subject = F.left(tidy(F.regexp_extract(sentence, pattern, 1)), F.lit(most))
            ok = sentence.rlike(pattern) & (F.length(subject) >= least)
            options.append(F.when(ok, F.struct(F.lit(kind).alias("type"), F.lower(subject).alias("subject"), sentence.alias("sentence"))))
        return F.coalesce(*options)

    sentences = F.filter(F.transform(F.split(column(text), SENTENCE), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return F.filter(F.transform(sentences, claim), lambda c: c.isNotNull())


def tool_digest(arguments: Column | str, limit: int) -> Column:
    """First line of the first non-blank describing argument of a JSON object, clipped with an ellipsis; null if none."""
    a = column(arguments)
    values = [F.trim(F.get_json_object(a, f"$.{k}")) for k in DIGEST_KEYS]
    first = F.coalesce(*[F.when(v != "", v) for v in values])
    line = F.split_part(first, F.lit("\n"), F.lit(1))
    return F.when(F.length(line) > limit, F.concat(F.left(line, F.lit(limit)), F.lit("…"))).otherwise(line)


def visible_text(content: Column | str) -> Column:
    """Text of the text blocks of ARRAY<STRUCT<type, text, ...>>, one per line, trimmed."""
    texts = F.transform(F.filter(column(content), lambda b: b["type"] == "text"), lambda b: b["text"])
    return F.regexp_replace(F.array_join(texts, "\n"), r"^\s+|\s+$", "")


def scope_key(kind: Column, value: Column) -> Column:
    """'user', 'workspace:<path>' or 'session:<id>'."""
    return F.when(kind == "user", F.lit("user")).otherwise(F.concat(kind, F.lit(":"), value))


def scope_kind(key: Column | str) -> Column:
    return F.split_part(column(key), F.lit(":"), F.lit(1))


def fnv1a(term: Column | str) -> Column:
    """32-bit FNV-1a over the UTF-16 code units of a term, as BIGINT."""
    points = F.transform(F.filter(F.split(column(term), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    high = lambda p: F.shiftright(p - 0x10000, 10) + 0xD800
    low = lambda p: (p - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00
    units = F.flatten(F.transform(points, lambda p: F.when(p < 0x10000, F.array(p)).otherwise(F.array(high(p), low(p)))))
    return F.aggregate(units, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def iso_day(epoch_ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(column(epoch_ms)), "yyyy-MM-dd")

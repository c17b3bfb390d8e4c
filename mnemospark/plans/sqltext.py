"""SQL twins of the text functions, for DuckDB."""

from __future__ import annotations

from mnemospark.functions.text import CORRECTION, STATED_CUES, STOP_TERMS

CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]+"


def stem(w: str) -> str:
    return f"CASE WHEN NOT regexp_full_match({w}, '[a-z]+') THEN {w} WHEN length({w}) > 5 AND {w} LIKE '%ing' THEN left({w}, length({w}) - 3) WHEN length({w}) > 4 AND {w} LIKE '%ed' THEN left({w}, length({w}) - 2) WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END"


def bigrams(t: str) -> str:
    return f"flatten(list_transform(list_filter(regexp_extract_all({t}, '{CJK}'), lambda r: length(r) > 1), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, CAST(i AS INT), 2))))"


def tokenize(t: str) -> str:
    return f"list_concat(list_transform(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: {stem('w')}), {bigrams(t)})"


def correction(t: str) -> str:
    return f"regexp_matches({t}, '{CORRECTION}')"


def topic(terms: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_TERMS)
    return f"list_distinct(list_filter({terms}, lambda w: length(w) > 1 AND NOT list_contains([{stop}], w)))"


def jaccard(a: str, b: str) -> str:
    """Of two lists of distinct terms."""
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / CAST(len({a}) + len({b}) - len(list_intersect({a}, {b})) AS DOUBLE) END"


def _sql(s: str) -> str:
    return s.replace("'", "''")


def claims(source: str, text: str, rest: str, least: int = 3, most: int = 60) -> str:
    """SELECT rest, type, subject, sentence, no of all claims in ``source``."""
    tidy = lambda v: f"trim(regexp_replace(regexp_replace({v}, '\\s+', ' ', 'g'), '^[\\s,:：、]+|[\\s.,!?;。！？；、]+$', '', 'g'))"
    cases = []
    for kind, pattern in STATED_CUES:
        subject = f"left({tidy(f'''regexp_extract(sentence, '{_sql(pattern)}', 1)''')}, {most})"
        cases.append(f"WHEN regexp_matches(sentence, '{_sql(pattern)}') AND length({subject}) >= {least} THEN struct_pack(type := '{kind}', subject := lower({subject}))")
    return f"""SELECT {rest}, c.type AS type, c.subject AS subject, sentence, no FROM (
  SELECT {rest}, sentence, no, CASE {' '.join(cases)} END AS c FROM (
    SELECT {rest}, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS sentence, no FROM (
      SELECT {rest}, unnest(regexp_split_to_array({text}, '[.!?;。！？；\\n]+')) AS x, generate_subscripts(regexp_split_to_array({text}, '[.!?;。！？；\\n]+'), 1) AS no FROM {source})) WHERE sentence <> '') WHERE c IS NOT NULL"""


def first_arrivals(t: str) -> str:
    return f"(SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn_ FROM {t}) WHERE rn_ = 1)"


def current(t: str) -> str:
    return f"(SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, ord) AS rn_ FROM {t}) WHERE rn_ = 1 AND op = 'put')"


def key(c: str) -> str:
    return f"nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"

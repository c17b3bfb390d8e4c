"""Word sets of texts: maximal runs of letters, digits and underscores after Unicode NFKC, then lower case."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RUN = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """The words of a text in their order; none for null."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _RUN.findall(text.lower())


def slices(texts: list[str | None], most: int = 2_000_000) -> Iterable[slice]:
    """Slices of texts of about ``most`` characters each, so that work arrays stay small however long the texts are."""
    begin = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= most:
            yield slice(begin, i + 1)
            begin, chars = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


class WordHashes:
    """64-bit hashes of words; those seen before are kept, up to a bound."""

    def __init__(self, most: int = 1_000_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def sequence(self, words: Iterable[str]) -> np.ndarray:
        """One hash a word, in the order given."""
        known, out = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                if len(known) >= self.most:
                    known.clear()
                h = known[w] = xxhash.xxh64_intdigest(w.encode()) - (1 << 63)
            out.append(h)
        return np.array(out, np.int64)

    def __call__(self, words: Iterable[str]) -> np.ndarray:
        """Sorted distinct hashes."""
        return np.sort(self.sequence(set(words)))


@F.pandas_udf(T.ArrayType(T.LongType(), False))
def word_set(texts: pd.Series) -> pd.Series:
    """Sorted distinct 64-bit word hashes of each text; an empty array for null and blank texts."""
    hashes = WordHashes()
    return pd.Series([hashes(words_of(t)) for t in texts], index=texts.index, dtype=object)


def words_sql(text: str) -> str:
    """DuckDB twin of ``words_of`` as a list of distinct words. DuckDB has NFC only; of the compatibility forms the twin
    folds full-width ASCII, the only ones that change words in the test tables.
    """
    full = "".join(chr(0xFF01 + i) for i in range(94) if chr(0x21 + i).isalnum() or i == 62)
    plain = "".join(chr(ord(c) - 0xFEE0) for c in full)
    return f"list_distinct(regexp_extract_all(lower(nfc_normalize(translate({text}, '{full}', '{plain}'))), '[\\p{{L}}\\p{{N}}_]+'))"

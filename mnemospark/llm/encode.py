"""Encoding of a corpus with a public byte-level BPE tokenizer, by reuse of content-defined chunks.

A rolling hash over the characters cuts texts where their content says so, hence alike stretches of different texts
give the same chunks; a chunk seen before isn't encoded again. A cut may fall where the tokenizer would join both sides:
each join is repaired by encoding the stretch from the last safe position before the cut to the first one after it, and
the stretch grows over whole chunks until both of its ends are safe. At a safe position every token sequence has a
boundary, whatever stands around it, so the parts' ids put together are exactly the text's.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemospark.llm.words import slices

#: Folder of the vocabulary files; a parameter of every operator.
TOKENIZERS = os.environ.get("MNEMOSPARK_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the split pattern of the byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters under the rolling hash, and the mean distance of cuts (a power of two).
WINDOW, MEAN_CHUNK = 8, 64
#: Characters of chunks that a Python worker remembers at most.
CACHE_CHARS = 32_000_000

#: Odd multipliers of the rolling hash, one a place in the window.
_GEAR = [np.uint32(pow(0x9E3779B1, i + 1, 1 << 32)) for i in range(WINDOW)]


def load_encoding(name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """tiktoken Encoding of the vocabulary ``name``.tiktoken; it has no special tokens, so their strings are ordinary text."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct values of two mostly ordered arrays, in order."""
    both = np.sort(np.concatenate((a, b)), kind="stable")
    return both[np.concatenate((np.ones(min(1, len(both)), bool), both[1:] != both[:-1]))]


def content_cuts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of cuts in the concatenated code points of several texts (text starts included, in order).

    Where the hash of the WINDOW characters before a position is among the lowest MEAN_CHUNK-th; windows that reach over a text's
    start are no cuts, so a cut depends on the text alone.
    """
    n = len(points)
    if n <= WINDOW:
        return starts
    with np.errstate(over="ignore"):
        h = np.zeros(n - WINDOW + 1, np.uint32)
        for i in range(WINDOW):  # polynomial hash of all windows at once
            h += points[i : n - WINDOW + 1 + i] * _GEAR[i]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
    at = np.flatnonzero(h < np.uint32((1 << 32) // MEAN_CHUNK)) + WINDOW
    at = at[at < n]
    of = np.searchsorted(starts, at, side="right") - 1
    return _merged(starts, at[at - starts[of] >= WINDOW])


def safe_positions(points: np.ndarray) -> np.ndarray:
    """The positions before which the tokenizer has a boundary in any surroundings, in order.

    A blank after a character that isn't white space always starts a new piece: no alternative of the pattern goes on
    from such a character over a blank, and what stands before it is the same with or without the blank. So does CJK
    punctuation after a CJK letter.
    """
    blank = np.flatnonzero(points[1:] == 0x20) + 1
    before = points[blank - 1]
    solid = (before > 0x20) & (before < 0x7F) | (before > 0xA0) & (before < 0x1680) | (before >= 0x3041) & (before < 0xFB00)
    wide = np.flatnonzero(points[1:] >= 0x3001) + 1
    wide = wide[(points[wide - 1] >= 0x4E00) & (points[wide - 1] <= 0x9FA5)]
    stop = wide[np.isin(points[wide], [0x3002, 0xFF0C, 0xFF1F, 0xFF01, 0xFF1A, 0x3001])]
    return _merged(blank[solid], stop) if len(stop) else blank[solid]


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(pieces of all texts in order, number of pieces of each text): the reusable chunks and the repaired joins."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    full = starts[sizes > 0]
    if not len(full):
        return [], np.zeros(len(texts), np.int64)
    cuts = content_cuts(points, full)
    safe = _merged(safe_positions(points), np.append(full, len(points)))  # a text's own ends are safe
    ends = np.append(cuts[1:], len(points))
    first = safe[np.searchsorted(safe, cuts)]  # first safe position of the chunk, perhaps beyond it
    last = safe[np.searchsorted(safe, ends, side="right") - 1]  # last safe position at or before the chunk's end
    inside = first <= ends
    # edges of pieces: a chunk's first and last safe positions; chunks without any fall into the join around them
    edges = _merged(np.append(full, len(points)), np.concatenate((first[inside], last[inside])))
    counts = np.diff(np.searchsorted(edges, np.append(starts, len(points))))
    cut = edges.tolist()
    return [joined[a:b] for a, b in zip(cut, cut[1:])], counts


class ChunkEncoder:
    """Encodes texts; a piece that was seen before is encoded by itself once more and then reused while the cache holds it.

    Pieces seen for the first time are encoded together with such neighbours in their text: where nothing is shared, the
    chunks cost nothing. ``reused`` and ``encoded`` count characters.
    """

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> None:
        self.encode = load_encoding(name, folder).encode_ordinary
        self.known: dict[str, list[int]] = {}
        self.seen: set[int] = set()
        self.chars = self.reused = self.encoded = 0

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        parts, counts = pieces(texts)
        known, seen, encode = self.known, self.seen, self.encode
        if self.chars > CACHE_CHARS:
            known.clear()
            seen.clear()
            self.chars = 0
        twice = {p for p, n in Counter(parts).items() if n > 1 or hash(p) in seen}
        seen.update(map(hash, parts))
        out: list[int] = []
        upto, at = [0], 0
        for n in counts.tolist():
            run: list[str] = []
            for p in parts[at : at + n]:
                if p not in twice:
                    run.append(p)
                    continue
                if run:
                    out += encode("".join(run))
                    run = []
                ids = known.get(p)
                if ids is None:
                    ids = known[p] = encode(p)
                    self.chars += len(p)
                else:
                    self.reused += len(p)
                out += ids
            if run:
                out += encode("".join(run))
            at += n
            upto.append(len(out))
        self.encoded += sum(map(len, texts))
        return np.array(out, np.int32), np.diff(np.array(upto, np.int64))


def _batches(batches: Iterator[pa.RecordBatch], name: str, folder: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    encoder = ChunkEncoder(name, folder)
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        parts = [encoder(texts[s]) for s in slices(texts, 250_000)]
        yield batch, np.concatenate([np.array([], np.int32), *(ids for ids, _ in parts)]), np.concatenate([np.array([], np.int64), *(n for _, n in parts)])


def encode_texts(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, key: str = "doc_id") -> DataFrame:
    """key and text -> key, ids ARRAY<INT>: the ids of each text, without special tokens.

    Null and empty texts get an empty list. Strings that look like special tokens are ordinary text. Whole texts are
    encoded. Repeated rows come out as often as they go in; other columns are dropped. No shuffle.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch, ids, sizes in _batches(batches, name, folder):
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(key), lists], names=[key, "ids"])

    return documents.select(key, "text").mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns of ``documents`` but text, and n_tokens BIGINT: the number of ids of each text, 0 for null and empty ones."""
    rest = [f for f in documents.schema.fields if f.name not in ("text", "n_tokens")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "n_tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch, _, sizes in _batches(batches, name, folder):
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(sizes, pa.int64())], names=[*(f.name for f in rest), "n_tokens"])

    return documents.select(*(f.name for f in rest), "text").mapInArrow(run, schema)

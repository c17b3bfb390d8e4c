import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemospark.llm.encode import TOKENIZERS, ChunkEncoder, count_tokens, encode_texts, load_encoding, pieces

WHOLE, CHUNKS = load_encoding(), ChunkEncoder()


def split(texts):
    ids, sizes = CHUNKS(texts)
    out, at = [], 0
    for n in sizes:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" '\n\t\u3000\u00a0a1é.,!|<>中文。，？\U0001f600st re'll")), max_size=300), max_size=5))
def test_chunks_give_the_ids_of_the_whole_text(texts):
    assert split(texts) == [WHOLE.encode_ordinary(t) for t in texts]


def test_against_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["<|endoftext|> is ordinary", "", " " * 3000, "a" * 50_000, "word " * 20_000, "中" * 5000, "it's we'll\r\n\tdon't", "x\x1cy\x85z"]
    assert split(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_put_together_are_the_text_and_recur():
    random.seed(2)
    shared = " ".join("".join(random.choices("abcdefghij", k=random.randint(2, 9))) for _ in range(2000))
    texts = ["".join(random.sample("abcdefgh ", 9)) + shared for _ in range(30)]
    parts, counts = pieces(texts)
    assert "".join(parts) == "".join(texts) and counts.sum() == len(parts)
    assert len(set(parts)) < len(parts) / 4


def test_operators(rows):
    df = rows("doc_id bigint, text string, ids string, n_tokens string", (1, None, "x", "y"), (2, "", "x", "y"), (3, "hello world", "x", "y"), (3, "hello world", "x", "y"), (None, "a", "x", "y"))
    got = encode_texts(df)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got.collect()) == [(0, [64]), (1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in count_tokens(df).collect()) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert encode_texts(df.limit(0)).count() == 0

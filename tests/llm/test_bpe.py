import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tickertone.llm import bpe

FILE = public_tokenizers.path("word_bpe_49k.json")
EDGES = [
    None, "", " \t\n", "aaaa aaaaaaa a", "ΑΣ ΣΑΣ Σ σς", "İstanbul ﬁ ẞ", "don't I'll we'Re 'S", "<|endoftext|> x<|startoftext|>y",
    "<|ENDOFTEXT|>", "\0<|endoftext|>", "\0<|ENDOFTEXT|>", "x\0<|EndOfText|>\0<|endoftext|>", " \0<|STARTOFTEXT|><|startoftext|>", "a\x1cb\x85c d", "é é", "12½Ⅷ①", "日本語 😀👍🏽", "x" * 30_000, "word " * 5000,
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(FILE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_edges_agree_with_the_library(vocabulary, library):
    ids, decoded = bpe.encode_texts(EDGES, vocabulary)
    for text, mine, back in zip(EDGES, ids, decoded, strict=True):
        assert (mine.tolist(), back) == expected(library, text)
        assert bpe.decode(mine.tolist(), vocabulary) == back


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cn", "Co")), max_size=40), max_size=6))
def test_any_texts_agree_with_the_library(vocabulary, library, texts):
    ids, decoded = bpe.encode_texts(texts, vocabulary)
    assert [(i.tolist(), d) for i, d in zip(ids, decoded, strict=True)] == [expected(library, t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["\0", "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", " ", "a", "\0\0", "|>", "\n"]), max_size=8).map("".join))
def test_special_tokens_beside_zero_characters(vocabulary, library, text):
    ids, decoded = bpe.encode_texts([text], vocabulary)
    assert (ids[0].tolist(), decoded[0]) == expected(library, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcn!", min_size=1, max_size=12), min_size=1, max_size=30, unique=True))
def test_words_together_merge_as_words_alone(vocabulary, words):
    ids, offsets = bpe.encode_words(words, vocabulary)
    for at, word in enumerate(words):
        alone, _ = bpe.encode_words([word], vocabulary)
        assert ids[offsets[at] : offsets[at + 1]].tolist() == alone.tolist()


def test_rows_and_columns(docs, library):
    table = docs([*EDGES, "same", "same"])
    rows = bpe.encode(table, FILE).collect()
    assert set(rows[0].asDict()) == {"doc_id", "lang", "source", "n_chars", "id", "ids", "decoded"}
    for row, text in zip(sorted(rows, key=lambda r: r.doc_id), [*EDGES, "same", "same"], strict=True):
        assert (list(row.ids), row.decoded) == expected(library, text)
    for row in bpe.encode(table, FILE, digests=True).collect():
        ids, decoded = expected(library, [*EDGES, "same", "same"][row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode(docs([]), FILE).collect() == []

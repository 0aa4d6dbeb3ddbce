"""Ids put together from remembered words: those of the tokenizer itself, whatever the text, and few calls to it."""

import pyarrow as pa
import public_tokenizers as P
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quorumlab.llm import wordids

WORDS = P.path("word_bpe_49k.json")
OWN, MEMO = Tokenizer.from_file(WORDS), wordids.WordMemo(WORDS)
PIECES = [
    *"abzIÀÿŸßÜñ×÷ªµİΣςǅ09٣½Ⅷ!'’.,;:?$<|>_-\"\\/ \t\n\r\x00\x0b\x1c\x1f\x7f\x85\xa0́̈​ 　日😀", "'s", "'S", "'ll", "don't", "HELLO", "word.", "Straße", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "  ", "x" * 60,
]


def ids(memo, texts):
    return [x for run in memo.encode(pa.array(texts, pa.string()), 1) for x in run.to_pylist()]


def plain(texts):
    return [[*OWN.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)), min_size=1, max_size=6))
def test_ids_are_those_of_the_tokenizer(texts):
    assert ids(MEMO, texts) == plain(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_any_text(texts):
    assert ids(MEMO, texts) == plain(texts)


def test_runs_and_slices(monkeypatch):
    texts = pa.array(["dropped", "one two", None, "", "a\x1cb <|endoftext|>", "\x1f", "three " * 50, "four"] * 3)
    for most in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(wordids, "BYTES_AT_ONCE", most)
        found = [x for run in MEMO.encode(texts.slice(1), 1) for x in run.to_pylist()]
        assert found == plain(texts.slice(1).to_pylist())
    assert ids(MEMO, []) == []


def test_a_full_memo_and_a_tokenizer_of_another_set_up(monkeypatch, tmp_path):
    monkeypatch.setattr(wordids, "MEMO_CHUNKS", 4)
    own = wordids.WordMemo(WORDS)
    texts = [f"word{'abcdefgh'[i % 8]} Émile's {i}, 日本{i}" for i in range(50)]
    for at in range(0, 50, 5):
        assert ids(own, texts[at : at + 5]) == plain(texts[at : at + 5])
        assert len(own.words) <= 4 and len(own.chunks) <= 4
    other = Tokenizer.from_file(WORDS)
    other.normalizer = None
    other.save(str(tmp_path / "other.json"))
    found = wordids.WordMemo(str(tmp_path / "other.json"))
    assert found.of_words is None
    assert ids(found, texts) == [[*other.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_words_are_encoded_once_whatever_their_case_and_marks(monkeypatch):
    own, asked, single = wordids.WordMemo(WORDS), [], []
    of_words, of_chunks = own._encode_words, own._encode_chunks
    monkeypatch.setattr(own, "_encode_words", lambda words: asked.extend(words) or of_words(words))
    monkeypatch.setattr(own, "_encode_chunks", lambda chunks: single.extend(chunks) or of_chunks(chunks))
    texts = ["Haus haus, HAUS$$$ (haus) haus's", "Haus-haus haus*** haus, 12"]
    assert ids(own, texts) == plain(texts) and ids(own, texts) == plain(texts)
    assert sorted(asked) == sorted(["haus", ",", "$$$", "(", ")", "'s", "-", "***", "1", "2"]) and not single

"""Ids of whole texts by a tokenizer of words, in Arrow batches: distinct chunks and words are looked up once for each batch."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from quorumlab.llm.chunks import MEMO_CHARS, MEMO_CHUNKS
from quorumlab.llm.workers import kept_by_worker

#: Bytes of text encoded at once, beyond one text.
BYTES_AT_ONCE = 4 << 20
#: Of these characters, letters are composed whatever stands beside them, have one letter each in lower case, and WORDS tells them from digits and marks.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"
#: Cuts plain chunks in lower case as PATTERN does.
WORDS = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"
#: The set-up of tokenizers that PLAIN and WORDS stand for.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What splitting at white space takes for it and the tokenizer doesn't.
ODD_SPACE = "[\x1c-\x1f]"


def tokenizer_of_words(tokenizer: Tokenizer) -> Tokenizer | None:
    """The tokenizer's model over words between single spaces; None if WORDS doesn't stand for its set-up."""
    setup = json.loads(tokenizer.to_str())
    steps = (setup["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
    if steps[0] != split or [s["type"] for s in steps[1:]] != ["ByteLevel"] or (setup["normalizer"] or {}).get("normalizers") != NORMALIZERS:
        return None
    steps[0] |= {"pattern": {"String": " "}, "invert": False}
    return Tokenizer.from_str(json.dumps(setup | {"normalizer": None, "added_tokens": []}))


def id_lists(each: list[bytes]) -> pa.ListArray:
    """A list of ids for each run of little-endian unsigned 32-bit integers."""
    ends = np.cumsum([0, *map(len, each)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(each), "<i4")))


class WordMemo:
    """Ids of whole texts, put together from remembered ids of their words.

    Texts are split at white space, which the tokenizer drops. Chunks of plain characters are cut into words as the
    tokenizer would cut them; only words not seen yet reach its model, as one text whose ids the tokens that end
    words part again. Other chunks, and those that hold an added token's exact string, go to the tokenizer
    itself, as do whole texts with odd spaces.
    """

    def __init__(self, path: str) -> None:
        self.plain, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # doesn't look for added tokens, which few chunks have
        self.added = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.of_words = tokenizer_of_words(self.plain)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        self.words, self.chunks = {}, {}

    def _encode_words(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.of_words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends, raw = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist(), ids.tobytes()
        if len(ends) != len(words) or ends[-1] != len(raw):
            raise ValueError("the words' ids can't be told apart")
        return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        has_added = [any(a in c for a in self.added) for c in chunks]
        found = [self.plain.encode(c, add_special_tokens=False) if a else e for c, a, e in zip(chunks, has_added, found, strict=True)]
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _remembered(self, memo: dict[str, bytes], names: pa.Array, encode) -> list[bytes]:
        """The ids of each of names, which are distinct."""
        names = names.to_numpy(zero_copy_only=False).tolist()
        out = list(map(memo.get, names))
        missing = [i for i, ids in enumerate(out) if ids is None]
        if missing:
            for i, ids in zip(missing, encode([names[i] for i in missing]), strict=True):
                out[i] = ids
                if len(names[i]) <= MEMO_CHARS:
                    memo[names[i]] = ids
            if len(memo) > MEMO_CHUNKS:  # what came first is what is frequent
                kept = list(islice(memo.items(), MEMO_CHUNKS // 2))
                memo.clear()
                memo.update(kept)
        return out

    def _chunk_ids(self, chunks: pa.Array) -> pa.ListArray:
        """The ids of each of chunks, which are distinct."""
        if self.of_words:
            plain = pc.match_substring_regex(chunks, PLAIN)
            for a in self.added:
                plain = pc.and_not(plain, pc.match_substring(chunks, a))
        else:
            plain = pc.equal(chunks, "")
        cut = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(pc.if_else(plain, chunks, "")), WORDS, r"\1 "), " ")
        words = cut.values.dictionary_encode()  # each chunk's last one is empty
        self.words.setdefault("", b"")
        found = id_lists(self._remembered(self.words, words.dictionary, self._encode_words)).take(words.indices)
        ends = found.offsets.take(cut.offsets)
        own = pa.ListArray.from_arrays(ends, found.values)
        other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        if not len(other):
            return own
        of_other = id_lists(self._remembered(self.chunks, chunks.take(pa.array(other)), self._encode_chunks))
        at = np.arange(len(chunks))
        at[other] = len(chunks) + np.arange(len(other))
        return pa.concat_arrays([own, of_other]).take(pa.array(at))

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[pa.ListArray]:
        """The ids of each text and end_id (int32), for a run of texts after the other; null texts have no ids of their own."""
        texts = texts.cast(pa.string()).fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(sizes // BYTES_AT_ONCE)) + 1).tolist(), len(texts)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield self._encode_run(texts.slice(lo, hi - lo), end_id)

    def _encode_run(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        whole = texts.filter(odd)
        chunks = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        names = chunks.values.dictionary_encode()
        own = [self._chunk_ids(names.dictionary), id_lists([np.array([end_id], "<u4").tobytes()])]
        if len(whole):
            own.append(id_lists(self._encode_chunks(whole.to_pylist())))
        # Odd texts have one empty chunk; their ids stand before the end id.
        ends, count = chunks.offsets.to_numpy()[1:], len(names.dictionary)
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        more = np.concatenate([count + 1 + np.arange(len(where)), np.full(len(texts), count)])
        at = np.insert(names.indices.to_numpy(), np.concatenate([ends[where], ends]), more)
        found = pa.concat_arrays(own).take(pa.array(at))
        last = ends + np.arange(1, len(texts) + 1) + np.cumsum(odd.to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(found.offsets.take(pa.array(np.concatenate([[0], last]))), found.values)


@kept_by_worker
def memo(tokenizer_path: str) -> WordMemo:
    return WordMemo(tokenizer_path)

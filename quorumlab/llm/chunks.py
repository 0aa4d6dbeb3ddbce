"""Tokenizer set-up and a memo of encoded text chunks."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterable
from itertools import islice

import numpy as np
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core

#: Chunks that a memo holds before it drops the later half; bounds a worker's memory.
MEMO_CHUNKS = 500_000
#: Longer chunks are encoded each time.
MEMO_CHARS = 48


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file that is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    moved = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


def tokenizer_from_ranks(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """A byte-level BPE tokenizer with the merges that the ranks imply.

    A pair merges wherever its bytes joined are a token, at that token's rank; so every way to
    split a token into two tokens is a merge.
    """
    to_char = byte_characters()
    shown = lambda token: "".join(to_char[b] for b in token)
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                merges.append((shown(token[:i]), shown(token[i:])))
    tokenizer = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


class ChunkMemo:
    """Ids of whole texts, put together from remembered ids of their chunks.

    split gives chunks of a text that the tokenizer treats independently of each other, or
    None where a text has to be encoded as one. Only chunks not seen yet reach the tokenizer:
    those that `joinable` admits as one text with `between` between them, whose ids `ends` parts
    again (it gives the number of ids up to the end of each chunk), the others one by one.
    """

    def __init__(
        self,
        tokenizer: Tokenizer,
        split: Callable[[str], list[str] | None],
        joinable: Callable[[str], object],
        between: str,
        ends: Callable[[np.ndarray, list[str]], np.ndarray],
    ) -> None:
        self.tokenizer, self.split, self.memo = tokenizer, split, {}
        self.joinable, self.between, self.ends = joinable, between, ends

    def _encode(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_fresh(self, fresh: list[str]) -> dict[str, bytes]:
        together = [c for c in fresh if self.joinable(c)]
        single = [c for c in fresh if not self.joinable(c)]
        out = dict(zip(single, self._encode(single), strict=True)) if single else {}
        if together:
            raw = self._encode([self.between.join(together)])[0]
            ends = (4 * self.ends(np.frombuffer(raw, "<u4"), together)).tolist()
            if len(ends) != len(together) or ends[-1] != len(raw):
                raise ValueError("the chunks' ids can't be told apart")
            out.update((c, raw[i:j]) for c, i, j in zip(together, [0, *ends], ends, strict=False))
        return out

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null texts give none."""
        texts = [t or "" for t in texts]
        lists = [self.split(t) if t else [] for t in texts]
        memo = self.memo
        fresh = [c for c in set().union(*(x for x in lists if x)) if c not in memo]
        if fresh:
            memo.update(self._encode_fresh(fresh))
        get = memo.__getitem__
        out = [b"".join(map(get, chunks)) if chunks is not None else self._encode([text])[0] for text, chunks in zip(texts, lists, strict=True)]
        for c in fresh:
            if len(c) > MEMO_CHARS:
                del memo[c]
        if len(memo) > MEMO_CHUNKS:  # what came first is what is frequent
            self.memo = dict(islice(memo.items(), MEMO_CHUNKS // 2))
        return out


_DOUBLE_SPACE = re.compile(r" \s|\s ")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def split_before_spaces(text: str) -> list[str] | None:
    """Chunks that begin at a single space between other characters; a pattern that takes one
    space along with the word after it always starts a match there."""
    if _DOUBLE_SPACE.search(text) or _ODD_SPACE.search(text):
        return None
    first, *rest = text.split(" ")
    if not first or (rest and not rest[-1]):
        return None
    return [first, *[" " + r for r in rest]]

"""Greedy word-piece counts by a linear longest-match automaton that never builds the pieces."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quorumlab.llm.chunks import read_ranks
from quorumlab.llm.workers import kept_by_worker

#: Words remembered by a worker before it starts anew; longer words are counted each time.
MEMO_WORDS = 300_000
MEMO_LENGTH = 64


class PieceCounter:
    """Counts the pieces that greedy longest matching from the left would cut from a word.

    The vocabulary's trie is walked once over the word. The failure link of a node leads to the
    node of what remains of its string when the longest pieces are popped off the front, and
    `popped` says how many those are. Both are computed once, so a word takes a step for each
    byte and each link followed, and no piece is ever built. A word that can't be cut counts as
    one unknown piece.
    """

    def __init__(self, pieces: Iterable[bytes]) -> None:
        self.children: list[dict[int, int]] = [{}]
        tokens = set()
        for piece in pieces:
            node = 0
            for byte in piece:
                node = self.children[node].setdefault(byte, len(self.children))
                if node == len(self.children):
                    self.children.append({})
            tokens.add(node)
        self.link = [-1] * len(self.children)  # -1: no way to cut the string leaves a node
        self.popped = [0] * len(self.children)
        level = [0]
        while level:
            below = []
            for parent in level:
                for byte, node in self.children[parent].items():
                    below.append(node)
                    if node in tokens:
                        self.link[node], self.popped[node] = 0, 1
                    else:
                        self._link(parent, byte, node)
            level = below

    def _link(self, parent: int, byte: int, node: int) -> None:
        at, count = self.link[parent], self.popped[parent]
        while at >= 0 and byte not in self.children[at]:
            count += self.popped[at]
            at = self.link[at]
        if at >= 0:
            self.link[node], self.popped[node] = self.children[at][byte], count

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 of an empty one."""
        children, link, popped = self.children, self.link, self.popped
        node = total = 0
        for byte in word:
            following = children[node].get(byte)
            while following is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 1
                following = children[node].get(byte)
            node = following
        while node:
            total += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return total


class WordCounts:
    """Remembers the counts of words; a word is cut with the space before it."""

    def __init__(self, ranks_path: str) -> None:
        self.counter = PieceCounter(read_ranks(ranks_path))
        self.memo: dict[str, int] = {}

    def text(self, text: str | None) -> tuple[int, int, int]:
        """Words, pieces, and the most pieces of a word."""
        listed, memo = (text or "").split(), self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        try:
            sizes = [memo[w] for w in listed]
        except KeyError:
            fresh = {w: self.counter.count(b" " + w.encode("utf-8", "replace")) for w in set(listed) if w not in memo}
            memo.update((w, n) for w, n in fresh.items() if len(w) <= MEMO_LENGTH)
            sizes = [memo[w] if w in memo else fresh[w] for w in listed]
        return len(sizes), sum(sizes), max(sizes, default=0)


@kept_by_worker
def word_counts(ranks_path: str) -> WordCounts:
    """One for each worker process."""
    return WordCounts(ranks_path)


def count_tokens(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, most_tokens_in_word) of each whole text.

    A word is a run without white space; a space and its UTF-8 bytes are cut greedily into the
    longest byte pieces of the vocabulary, in which a piece with a leading space begins a word.
    Null and empty texts have no words; texts are read whole, however long. Rows repeat as they come; other columns are ignored; an empty table gives no rows.
    """

    @F.arrow_udf("n_words long, n_tokens long, most_tokens_in_word long")
    def count(batch: pa.Array) -> pa.Array:
        own, rows = word_counts(ranks_path), []
        for at in range(0, len(batch), 512):
            rows += map(own.text, batch.slice(at, 512).to_pylist())
        table = np.array(rows, np.int64).reshape(-1, 3)
        return pa.StructArray.from_arrays([pa.array(table[:, i].copy()) for i in range(3)], names=["n_words", "n_tokens", "most_tokens_in_word"])

    return docs.select("doc_id", count("text").alias("r")).select("doc_id", "r.*")

"""Byte-level BPE over Arrow batches: ids with byte and character offsets, and back."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quorumlab.llm.chunks import ChunkMemo, read_ranks, split_before_spaces, tokenizer_from_ranks
from quorumlab.llm.workers import kept_by_worker

#: Texts encoded at once.
TEXTS_AT_ONCE = 256


class ByteCodec:
    """Encodes text by a file of byte ranks and decodes ids again.

    The file's path and the splitting pattern are parameters. Ids are those that merging by
    lowest rank within each match of the pattern gives; no special tokens exist.
    """

    def __init__(self, ranks_path: str, pattern: str) -> None:
        ranks = read_ranks(ranks_path)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.sizes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.memo = ChunkMemo(tokenizer_from_ranks(ranks, pattern), split_before_spaces, lambda c: c[0] == " ", "", self._chunk_ends)

    def _chunk_ends(self, ids: np.ndarray, chunks: list[str]) -> np.ndarray:
        """Ids up to the end of each chunk, by the bytes that ids and chunks have."""
        return np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(c.encode()) for c in chunks])) + 1

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(ids, "<u4") for ids in self.memo.encode(texts)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes of a character that the ids cut off become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each id: its first byte in the text's UTF-8, and the first character and the one
        after the last that it has bytes of. Ids that share a split character name it both."""
        data = np.frombuffer(text.encode(), np.uint8)
        size = self.sizes[ids]
        end = np.cumsum(size)
        character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
        if not len(ids):
            return end, end, end
        return end - size, character[end - size], character[end - 1] + 1


class StreamDecoder:
    """Decodes ids piece by piece and holds back the bytes of an unfinished character."""

    def __init__(self, codec: ByteCodec) -> None:
        self.codec, self.rest = codec, b""

    def feed(self, ids: np.ndarray) -> str:
        data = self.rest + self.codec.decode_bytes(ids)
        cut = len(data)
        for back in range(1, min(4, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                needs = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
                cut -= back if needs > back else 0
                break
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


@kept_by_worker
def codec(ranks_path: str, pattern: str) -> ByteCodec:
    """One codec for each worker process."""
    return ByteCodec(ranks_path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, byte_starts, char_starts, char_ends) of each whole text.

    Null and empty texts give empty arrays; a text is encoded whole, however long; rows repeat as they come; other columns are ignored; an empty table gives no rows.
    """

    @F.arrow_udf("ids array<int>, byte_starts array<int>, char_starts array<int>, char_ends array<int>")
    def encode(batch: pa.Array) -> pa.Array:
        own, cols = codec(ranks_path, pattern), ([], [], [], [])
        for at in range(0, len(batch), TEXTS_AT_ONCE):
            texts = batch.slice(at, TEXTS_AT_ONCE).to_pylist()
            for text, ids in zip(texts, own.encode(texts), strict=True):
                for c, x in zip(cols, (ids, *own.offsets(text or "", ids)), strict=True):
                    c.append(x.astype(np.int32))
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(c, kind) for c in cols], names=["ids", "byte_starts", "char_starts", "char_ends"])

    return docs.select("doc_id", encode("text").alias("r")).select("doc_id", "r.*")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """encoded with its ids column turned back into text; null ids give a null text."""

    @F.arrow_udf("string")
    def decode(batch: pa.Array) -> pa.Array:
        own = codec(ranks_path, pattern)
        return pa.array([None if x is None else own.decode(np.array(x, np.int64)) for x in batch.to_pylist()], pa.string())

    return encoded.select("doc_id", decode(ids).alias("text"))


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded, then its ids decoded.

    The ids never leave the worker. Null and empty texts have no ids and digests of no bytes; very long texts are encoded whole; rows repeat as they come; an empty table gives no rows.
    """

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batch: pa.Array) -> pa.Array:
        own, counts, of_ids, of_text = codec(ranks_path, pattern), [], [], []
        for at in range(0, len(batch), TEXTS_AT_ONCE):
            for raw in own.memo.encode(batch.slice(at, TEXTS_AT_ONCE).to_pylist()):
                counts.append(len(raw) // 4)
                of_ids.append(hashlib.sha256(raw).hexdigest())
                of_text.append(hashlib.sha256(own.decode_bytes(np.frombuffer(raw, "<u4"))).hexdigest())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest("text").alias("r")).select("doc_id", "r.*")

"""Byte-level BPE encoding and decoding with a sentencepiece model made from a rank file.

No training: every entry of the vocabulary becomes a piece, spelled with one letter a byte and
scored by its negative rank, so the best-scored merge is the lowest-ranked one.  Normalisation
is the identity.  Pre-tokens are encoded separately, and decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import arrow_map, chunks
from .pretokens import PretokenEncoder, byte_letters, spelled

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary's byte strings in order of rank; ranks are 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must be 0 to n - 1")
    return [token for _, token in ranked]


def _varint(number: int) -> bytes:
    number &= (1 << 64) - 1
    out = bytearray()
    while number > 127:
        out.append(number & 127 | 128)
        number >>= 7
    out.append(number)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field in protobuf's wire format."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model with an id for each token and the unknown piece last.

    Field numbers are those of sentencepiece's public model schema: pieces (1: text, 2: score,
    3: type, of which 1 is normal and 2 unknown), trainer settings (3: model type, 2 is BPE;
    4: vocabulary size; 40 to 43: ids of unknown, begin, end and padding) and normalisation
    (1: name; 3: dummy prefix; 4: extra white space; 5: escaping).
    """
    letters = byte_letters()
    pieces = [
        _field(1, "".join(letters[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1)
        for rank, token in enumerate(tokens)
    ]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    size = len(tokens)
    trainer = _field(3, 2) + _field(4, size + 1) + _field(40, size) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, piece) for piece in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.tokens = read_ranks(path)
        self.model = SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.encoder = PretokenEncoder(self.encode_pretokens)
        sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.size, self.start = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def encode_pretokens(self, pretokens: list[str]) -> list[list[int]]:
        return self.model.encode([spelled(p) for p in pretokens], num_threads=1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        total = np.cumsum(size)
        if not len(ids):
            return b""
        return self.bytes[np.repeat(self.start[ids] - total + size, size) + np.arange(total[-1])].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The ids of each row's text, as (doc_id, ids array<int>); a null text has none."""
    path = vocabulary or vocabulary_path()

    def encoded(batches):
        for rows, texts in chunks(batches, "text"):
            ids, first = codec(path).encode(texts)
            arrays = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), arrays], ["doc_id", "ids"])

    return arrow_map(docs.select("doc_id", "text"), encoded, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The text for each row of ids (doc_id, ids array<int>), as (doc_id, text); bytes that are no
    UTF-8 become U+FFFD, and null ids an empty text."""
    path = vocabulary or vocabulary_path()

    def decoded(batches):
        for batch in batches:
            texts = [
                codec(path).decode(np.array(ids or [], np.int64)).decode("utf-8", "replace")
                for ids in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), decoded, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode and decode each row's whole text in one pass over ``docs`` (doc_id, text).

    Returns doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids) and
    decoded_sha256.  A null or empty text has no ids; a null doc_id stays null; repeated rows
    are repeated; other columns are left aside; an empty table gives no rows.
    """
    path = vocabulary or vocabulary_path()

    def digests(batches):
        own = codec(path)
        for rows, texts in chunks(batches, "text"):
            ids, first = own.encode(texts)
            raw, marks = ids.astype("<u4").tobytes(), first.tolist()
            data = own.decode(ids)
            cut = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(own.size[ids], out=cut[1:])
            cut = cut[first].tolist()
            pairs = list(zip(marks[:-1], marks[1:], strict=True))
            columns = [
                rows.column("doc_id"),
                pa.array([b - a for a, b in pairs], pa.int64()),
                pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in pairs], pa.string()),
                pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select("doc_id", "text"), digests, ENCODED)

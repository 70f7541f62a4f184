"""Corpus encoding with a public byte-level BPE vocabulary, run by sentencepiece.

The rank file is turned into a sentencepiece BPE model without training: every token becomes a piece whose
bytes are written as printable characters (one per byte), and its score is the negative rank, so that the
highest-scored merge is the one of lowest rank. Normalisation is the identity. Texts are cut into pre-tokens
by the vocabulary's pattern, distinct pre-tokens are encoded, and ids are shifted back by the one reserved
unknown piece. Decoding maps characters back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, table

#: The split pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens remembered by one Python worker before its memo is emptied (memory bound only; results don't depend on it).
MEMO_ENTRIES = 200_000


def byte_characters() -> list[str]:
    """A printable character for each byte: Latin-1 letters and marks stand for themselves, others for 256 onward."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(kept))}
    return [chr(moved.get(b, b)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in rank order from a rank file (`base64 rank` per line)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is unknown, piece r + 1 is the token of rank r with score -r."""
    chars = byte_characters()
    unknown = _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)
    pieces = [unknown] + [_field(1, "".join(chars[b] for b in t).encode()) + _field(2, float(-r)) + _field(3, 1) for r, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class PieceCodec:
    """Encoder and decoder over one serialised model; built once per Python worker."""

    def __init__(self, model: bytes, pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        chars = byte_characters()
        self.to_chars = {b: chars[b] for b in range(256)}
        self.to_byte = {c: b for b, c in enumerate(chars)}
        self.memo: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of `text`; null and empty give the empty list; lone surrogates count as U+FFFD."""
        if not text:
            return []
        tokens, memo = self.split(text), self.memo
        new = list({t for t in tokens if t not in memo})
        if new:
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
                new = list(set(tokens))
            mapped = [t.encode("utf-8", "replace").decode("latin-1").translate(self.to_chars) for t in new]
            for t, ids in zip(new, self.sp.encode(mapped, out_type=int, num_threads=1)):
                memo[t] = [i - 1 for i in ids]
        out: list[int] = []
        for t in tokens:
            out += memo[t]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of `ids`, by mapping pieces back to bytes."""
        pieces = "".join(self.sp.id_to_piece(i + 1) for i in ids)
        return bytes(self.to_byte[c] for c in pieces).decode("utf-8", "replace")


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`id_col` and `ids` of every row; one narrow stage, no shuffle unless the input has fewer splits than cores.

    Null and empty texts give the empty list, a null id stays null, repeated rows stay repeated, other columns
    are not read. Long texts are encoded whole. An empty table gives an empty result. The vocabulary is read on the
    driver (under 1 MB) and travels with the task.
    """
    model = docs.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model.value)
        for batch in batches:
            offsets, flat = [0], []
            for text in batch.column(1).to_pylist():
                flat += codec.encode(text)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_key", "ids"])

    src = spread(docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("body")))
    kind = src.schema["doc_key"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_key {kind}, ids array<int>").withColumnRenamed("doc_key", id_col)


def p6_ids(spark, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document by the 50k byte-level BPE."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Documents, tokens and characters per source, for budgeting a training mix."""
    docs = table(spark, sf_dir, "documents")
    enc = encode_corpus(docs.select(F.struct("source", F.length("text").alias("chars")).alias("k"), "text"), "k", "text")
    return enc.groupBy(F.col("k.source").alias("source")).agg(
        F.count("*").alias("n_docs"), F.sum(F.size("ids")).cast("bigint").alias("n_tokens"), F.coalesce(F.sum("k.chars"), F.lit(0)).cast("bigint").alias("n_chars"))

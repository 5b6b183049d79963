"""Byte-level BPE encoding and decoding with a sentencepiece model made from a rank file.

Method: the rank file is the whole vocabulary. Each of its byte strings becomes a sentencepiece piece
by writing every byte as one printable character; the piece's score is its negative rank, so that
sentencepiece merges the pair of lowest rank first, as byte-level BPE does. The model is serialised here,
field by field, with the identity normaliser. Texts are cut into pre-tokens by the tokenizer's pattern;
each is encoded on its own, and ids are decoded through the inverse of the byte mapping.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfacts.llm.common import read_table

# Bounds of a Python worker's memory, not of what is encoded: pre-tokens kept with their ids from one text to
# the next, the longest that is kept, and characters of texts that are encoded together.
CACHE_ENTRIES = 200_000
CACHE_CHARS = 40
CHUNK_CHARS = 300_000

SCHEMA = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a tiktoken rank file, by rank; ranks are 0, 1, 2, ... without gaps."""
    with open(path, "rb") as file:
        entries = [line.split() for line in file if line.strip()]
    vocabulary = [base64.b64decode(piece) for piece, rank in sorted(entries, key=lambda e: int(e[1]))]
    if [int(rank) for rank in sorted((e[1] for e in entries), key=int)] != list(range(len(entries))):
        raise ValueError(f"ranks of {path} are not 0..{len(entries) - 1}")
    return vocabulary


# The first of 256 characters that stand for bytes (the normaliser is the identity, so any would do).
FIRST_CHARACTER = 0x100


def to_characters(data: bytes) -> str:
    return "".join(chr(FIRST_CHARACTER + b) for b in data)


def _varint(value: int) -> bytes:
    out = bytearray()
    value &= (1 << 64) - 1
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes(out) + bytes([value])


def _field(number: int, value) -> bytes:
    """One protobuf field: int as varint, float as 32 bits, bytes and str by length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(int(value))
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(vocabulary: list[bytes]) -> bytes:
    """A serialised sentencepiece ModelProto; a piece's id is its rank, <unk> comes last."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, to_characters(piece)) + _field(2, float(-rank)) + _field(3, normal))
        for rank, piece in enumerate(vocabulary)
    ]
    pieces.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = (
        _field(3, bpe) + _field(4, len(pieces))
        + _field(40, len(vocabulary)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    )
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


def _parting_characters() -> frozenset[str]:
    """Where the standard library's character classes and those of the pattern part: numbers that are not decimal
    digits, and separators that only the standard library counts as white space."""
    import sys
    import unicodedata

    return frozenset(
        c for c in map(chr, range(sys.maxunicode + 1))
        if (c.isalnum() and unicodedata.category(c)[0] != "L" and not c.isdecimal()) or "\x1c" <= c <= "\x1f"
    )


def pre_tokenizer(pattern: str):
    """A function from a text to its pre-tokens.

    The `regex` module runs any pattern. For the one the query uses, texts without the characters above are cut by
    an equal pattern of the standard library, which is about three times as fast.
    """
    import regex

    general = regex.compile(pattern).findall
    if pattern != KNOWN_PATTERN:
        return general
    fast = re.compile(KNOWN_AS_STANDARD).findall
    parting = _parting_characters()
    low = bytes(ord(c) for c in parting if ord(c) < 256)

    def split(text: str) -> list[str]:
        try:
            data = text.encode("latin-1")
            plain = len(data.translate(None, low)) == len(data)
        except UnicodeEncodeError:
            plain = parting.isdisjoint(text)
        return fast(text) if plain else general(text)

    return split


# Fixed: the pattern of the query's vocabulary, and the same in the standard library's classes.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KNOWN_AS_STANDARD = r""" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""


class Encoder:
    """Encodes texts; made once in each Python worker."""

    def __init__(self, model: bytes, vocabulary: list[bytes], pattern: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = pre_tokenizer(pattern)
        self.cache: dict[str, str] = {}
        self.runs: dict[str, bytes] = {}
        self.table = {str(i): piece for i, piece in enumerate(vocabulary)}
        self.characters = to_characters(bytes(range(256)))

    def encode(self, texts: list[str]) -> list[list[str]]:
        """The runs of ids of each text: one of each pre-token, decimal, joined by one space. Unseen pre-tokens of
        all texts are encoded in one call."""
        split = [self.split(text) for text in texts]
        known = self.cache
        if len(known) > CACHE_ENTRIES:
            known.clear()
        new = list({token for tokens in split for token in tokens if token not in known})
        mapped = [codecs.charmap_decode(token.encode(), "strict", self.characters)[0] for token in new]
        ids = [" ".join(map(str, row)) for row in self.model.encode(mapped, num_threads=1)] if new else []
        known.update(zip(new, ids))
        out = [[known[token] for token in tokens] for tokens in split]
        for token in new:
            if len(token) > CACHE_CHARS:
                del known[token]
        return out

    def decode(self, runs: list[str]) -> bytes:
        """The bytes of runs of ids, by the inverse of the vocabulary; runs met before are looked up."""
        if len(self.runs) > CACHE_ENTRIES:
            self.runs.clear()
        known = self.runs
        for run in set(runs).difference(known):
            known[run] = b"".join(map(self.table.__getitem__, run.split(" ")))
        return b"".join([known[run] for run in runs])


def _together(column: pa.Array, limit: int = CHUNK_CHARS):
    """(start, texts): neighbouring texts of about `limit` characters; a longer text on its own."""
    group, size, start = [], 0, 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        if group and size + len(text) > limit:
            yield start, group
            group, size, start = [], 0, i
        group.append(text)
        size += len(text)
    if group:
        yield start, group


def encode_documents(
    docs: DataFrame, rank_path: str, pattern: str, text: str = "text", key: str = "doc_id",
    with_ids: bool = True,
) -> DataFrame:
    """One row per row of `docs`: its key as doc_id, n_tokens, ids, ids_sha256, decoded_sha256.

    `ids` is the token ids, null unless `with_ids`. A null text is an empty text, which has no tokens (the
    hash of the empty string); a null key stays null; repeated rows are encoded each on its own; other columns
    are not looked at. Texts of any length are encoded whole. Nothing is shuffled; the rank file is read by
    the driver and sent with the tasks (one vocabulary, whatever the data).
    """
    spark = docs.sparkSession
    vocabulary = read_ranks(rank_path)
    shared = spark.sparkContext.broadcast((sentencepiece_model(vocabulary), vocabulary, pattern))

    def run(batches):
        encoder = Encoder(*shared.value)
        for batch in batches:
            # A batch goes out in pieces, so that only a piece's ids are held.
            for start, texts in _together(batch.column(1)):
                counts, ids_out, id_hashes, text_hashes = [], [], [], []
                for runs in encoder.encode(texts):
                    ids = " ".join(runs)
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    ids_out.append(np.array(ids.split(), np.int32) if with_ids else None)
                    id_hashes.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_hashes.append(hashlib.sha256(encoder.decode(runs)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)).cast(pa.int64()), pa.array(counts, pa.int64()),
                        pa.array(ids_out, pa.list_(pa.int32())),
                        pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )

    picked = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def tokenizer_files() -> tuple[str, str]:
    """Path of the rank file and the pattern used by the query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return encode_documents(docs, *tokenizer_files(), with_ids=False).drop("ids")

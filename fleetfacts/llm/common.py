"""Reading given tables, folders on shared storage, and words of texts as numpy arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfacts.plans.staging import cut_lineage, staging_folder

__all__ = [
    "read_table", "cut_lineage", "staging_folder", "long_texts", "text_arrays", "chunks",
    "mix", "words_of", "WORD_BYTES", "NON_SPACE_BYTES",
]

# Byte classes, as tables over byte values. Bytes of a character beyond ASCII are all word bytes, so
# classes that hold every such character can be read off UTF-8 without decoding it.
# `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing: digits, letters, everything beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
# `[^\x20\x09-\x0D]`
NON_SPACE_BYTES = np.ones(256, bool)
NON_SPACE_BYTES[9:14] = NON_SPACE_BYTES[32] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Texts are worked through in chunks of about this many bytes (a longer text is a chunk of its own), so
# that the arrays over bytes stay small whatever a batch holds.
CHUNK_BYTES = 1_000_000
# Two words of 2,048 letters can be made whose polynomials modulo 2**64 are equal for every odd base; shorter ones differ.
LONG_WORD_BYTES = 256


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a given table; other columns, whatever their names, are not read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*[F.col(f"`{c}`") for c in columns])


def long_texts(array: pa.Array) -> pa.Array:
    """Strings as large binary, null as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.cast(pa.large_string()).fill_null("").cast(pa.large_binary())


def text_arrays(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the offsets (one more than there are texts), null as empty."""
    array = long_texts(array)
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first, last = int(ends[0]), int(ends[-1])
    return body[first:last], ends - first


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES, most: int = 100_000):
    """Ranges of at most `most` texts with about `limit` bytes, in order."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n, start + most)
        yield start, end
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def words_of(body: np.ndarray, offsets: np.ndarray, members: np.ndarray):
    """Words of some texts, A-Z lower-cased: (text index, start, end, 64-bit hash) of each, in order.

    A word is a longest run of bytes in `members`, within one text. Its hash is a polynomial in its
    bytes, taken from prefix sums, then mixed with its length. Long words, of which different ones can be
    made to meet in any such polynomial, are hashed one by one.
    """
    lower = _LOWER[body]
    # One byte outside every class between texts.
    n_texts = len(offsets) - 1
    inside = np.zeros(len(lower) + n_texts + 1, bool)
    spread = np.arange(len(lower)) + np.repeat(np.arange(n_texts), np.diff(offsets)) + 1
    inside[spread] = members[lower]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    # Positions with one gap byte after each text: text t begins at offsets[t] + t.
    text = np.searchsorted(offsets[:-1] + np.arange(n_texts), starts, side="right") - 1
    starts, ends = starts - text, ends - text
    sums = np.zeros(len(lower) + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(lower)), out=sums[1:])
    back = _powers(_INVERSE, len(lower) + 1)
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > LONG_WORD_BYTES).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(lower[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return text, starts, ends, hashes


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` consecutive words, by its first word."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * np.uint64(0x100000001B3) + hashes[k : k + n]
        out ^= out >> np.uint64(29)
    return mix(out)

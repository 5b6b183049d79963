"""Five-word shingles of texts: hashed sets in numpy, exact sets for confirmation."""

from __future__ import annotations

import numpy as np

from fleetfacts.llm.common import NON_SPACE_BYTES, mix, window_hashes, words_of

SIZE = 5
# A pair is linked when 100 * |intersection| >= 75 * |union|.
SIMILARITY_PERCENT = 75

_LOWER_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(body: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit hash) of each distinct shingle of each text, sorted by both.

    A text of fewer words than `size` has one shingle, all its words; one without words has none.
    """
    text, _, _, hashes = words_of(body, offsets, NON_SPACE_BYTES)
    n_words = np.bincount(text, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(n_words)[:-1]]).astype(np.int64)
    windows = window_hashes(hashes, size)
    whole = text[: len(windows)] == text[size - 1 :] if len(windows) else np.zeros(0, bool)
    owners, values = [text[: len(windows)][whole]], [windows[whole]]
    for length in range(1, size):
        short = np.flatnonzero(n_words == length)
        if len(short):
            owners.append(short)
            values.append(window_hashes(hashes, length)[first[short]])
    owner, value = np.concatenate(owners), np.concatenate(values)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if len(owner):
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])
        owner, value = owner[new], value[new]
    return owner.astype(np.int64), value


def set_keys(owner: np.ndarray, value: np.ndarray, n_texts: int) -> np.ndarray:
    """128 bits of each text's set, alike for equal sets: two sums of mixed hashes."""
    keys = np.zeros((n_texts, 2), np.uint64)
    for column, salt in enumerate((0x51ED270B27B4F3CF, 0xC2B2AE3D27D4EB4F)):
        np.add.at(keys[:, column], owner, mix(value ^ np.uint64(salt)))
    return keys


def exact_shingles(text: str | None, size: int = SIZE) -> set[tuple[bytes, ...]]:
    """The set itself: words lower-cased in A-Z, cut at `[\\x20\\x09-\\x0D]+`."""
    words = (text or "").encode().translate(_LOWER_TABLE).split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


def linked(a: set, b: set, percent: int = SIMILARITY_PERCENT) -> bool:
    common = len(a & b)
    return bool(common) and 100 * common >= percent * (len(a) + len(b) - common)

"""Vectorised tokenising of many UTF-8 texts at once.

A batch of texts is one byte array. A byte table says what each byte becomes (0: a separator). A word's hash is the
polynomial sum of random 64-bit values of its bytes, taken from one running sum over the batch, so that hashing needs
no Python object for each word. Sums wrap at 2**64; the base is odd, so powers of it have inverses.
"""

from __future__ import annotations

from functools import cache

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
PIECE = 1 << 20


def _spaces() -> np.ndarray:
    kept = np.arange(256, dtype=np.uint8)
    kept[[0x20, *range(0x09, 0x0E)]] = 0
    return kept


def cased_words() -> np.ndarray:
    """Words are runs of other bytes than space and 0x09 to 0x0D, as they are."""
    return _spaces()


def line_bytes() -> np.ndarray:
    """Runs between line feeds."""
    kept = np.arange(256, dtype=np.uint8)
    kept[10] = 0
    return kept


def lower_ascii(kept: np.ndarray) -> np.ndarray:
    out = kept.copy()
    out[65:91] = np.where(kept[65:91] > 0, np.arange(97, 123), 0)
    return out


def whitespace_words() -> np.ndarray:
    """Words are runs of other bytes than space and 0x09 to 0x0D; A-Z become a-z. A zero byte is kept as a word byte."""
    return lower_ascii(_spaces())


def alphanumeric_words() -> np.ndarray:
    """Words are runs of digits, ASCII letters and bytes from 0x80 on; A-Z become a-z."""
    kept = np.zeros(256, dtype=np.uint8)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        kept[low : high + 1] = np.arange(low, high + 1)
    return lower_ascii(kept)


def separators(kept: np.ndarray) -> np.ndarray:
    """Which bytes separate words; a zero byte itself does only where the table makes no exception."""
    out = kept == 0
    if not out[1]:
        out[0] = False
    return out


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, _MASK, 256, dtype=np.uint64, endpoint=True) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def encode(texts) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [b"" if t is None or t != t else t.encode("utf-8", "surrogatepass") for t in texts]


def word_hashes(docs: list[bytes], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all documents in order, and the number of words of each document."""
    counts = np.zeros(len(docs), dtype=np.int64)
    parts: list[np.ndarray] = []
    at = 0
    while at < len(docs):
        end, total = at, 0
        while end < len(docs) and (end == at or total + len(docs[end]) + 1 <= PIECE):
            total += len(docs[end]) + 1
            end += 1
        hashes, per_doc = _piece(docs[at:end], kept)
        parts.append(hashes)
        counts[at:end] = per_doc
        at = end
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), counts


def _piece(docs: list[bytes], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" ".join(docs) + b" ", dtype=np.uint8)
    starts, _, hashes = runs(raw, kept)
    offsets = np.cumsum([0] + [len(d) + 1 for d in docs])
    return hashes, np.diff(np.searchsorted(starts, offsets))


def runs(raw: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in a byte array that ends with a separator."""
    word = ~separators(kept)[raw]
    edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _powers(1 << max(20, int(len(raw)).bit_length()))
    values = np.where(word, _byte_values()[kept][raw], np.uint64(0))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * power[: len(raw)], dtype=np.uint64)])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverse[starts])


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs."""
    if not len(values):
        return values, np.zeros(0, dtype=np.int64)
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts of equal values of several results of ``counted``."""
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    values, weights = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if not len(values):
        return values, weights
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(weights, first)

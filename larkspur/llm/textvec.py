"""Vectorised word scanning over many texts at once."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_BACK = np.uint64(_inverse(int(_STEP)))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(factors)
    return have[:n]


def joined(texts: list[bytes | None]) -> tuple[bytes, np.ndarray]:
    """All texts behind each other, one \\n after each; offsets[i]:offsets[i + 1] - 1 is text i."""
    parts = [t or b"" for t in texts]
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return b"\n".join(parts) + b"\n", offsets


def word_spans(data: bytes, is_word: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes whose is_word entry is 1; data ends with a byte outside words."""
    flags = np.frombuffer(data.translate(is_word), dtype=np.int8)
    edge = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    if len(flags) and flags[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of random byte values for each span."""
    values = _BYTE[np.frombuffer(data, dtype=np.uint8)]
    values *= powers(_STEP, len(data))
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values, out=total[1:])
    out = total[ends] - total[starts]
    out *= powers(_BACK, len(data) + 1)[starts]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def table(pattern_bytes) -> bytes:
    """A translate() table with 1 for the given byte values."""
    out = bytearray(256)
    for b in pattern_bytes:
        out[b] = 1
    return bytes(out)


#: ASCII letters and every byte of a non-ASCII character.
LETTERS = table([*range(65, 91), *range(97, 123), *range(128, 256)])
#: The same and digits, for lower-cased text.
ALNUM = table([*range(48, 58), *range(97, 123), *range(128, 256)])

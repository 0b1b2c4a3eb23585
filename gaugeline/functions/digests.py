"""Numbers from md5, many at once: what a hashed draw costs decides how many replicates are possible."""

from __future__ import annotations

import hashlib
import math

import numpy as np

TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().tolist()
ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
BLOCK = 55  # bytes of a text that is one block of md5
AT_ONCE = 32768  # texts whose numbers stay in a core's cache


def _words(texts: list[bytes], at: int = 0) -> np.ndarray:
    """Texts from byte ``at`` of their block, as its sixteen numbers."""
    out = np.zeros((len(texts), 64), np.uint8)
    for row, text in zip(out, texts, strict=True):
        row[at : at + len(text)] = np.frombuffer(text, np.uint8)
    return out.view("<u4").astype(np.uint32)


def _one_block(left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """As :func:`first_words`, for the numbers of heads and tails whose texts all have one length."""
    shape = (len(left), len(right))
    word = [(left[:, j, None] | right[None, :, j]) if left[:, j].any() or right[:, j].any() else None for j in range(16)]
    a, b, c, d = (np.full(shape, s, np.uint32) for s in START)
    f = np.empty(shape, np.uint32)
    for r in range(61):  # the last three do not change the first word
        if r < 16:
            j = r
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif r < 32:
            j = (5 * r + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif r < 48:
            j = (3 * r + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            j = 7 * r % 16
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        a += np.uint32((ADDED[r] + (8 * length if j == 14 else 0)) % 2**32)
        a += f
        if word[j] is not None:
            a += word[j]
        np.left_shift(a, np.uint32(TURNS[r]), out=f)
        a >>= np.uint32(32 - TURNS[r])
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    b += np.uint32(START[0])
    return b.byteswap()


def first_words(heads: list[str], tails: list[str]) -> np.ndarray:
    """(len(heads), len(tails)) numbers: the first eight hex digits of md5(head + tail)."""
    left, right = [h.encode() for h in heads], [t.encode() for t in tails]
    out = np.empty((len(left), len(right)), np.uint32)
    by = lambda texts: {n: [i for i, t in enumerate(texts) if len(t) == n] for n in {len(t) for t in texts}}
    for n, rows in by(left).items():
        for m, columns in by(right).items():
            some, others = [left[i] for i in rows], [right[i] for i in columns]
            if n + m > BLOCK:
                out[np.ix_(rows, columns)] = [[int.from_bytes(hashlib.md5(h + t).digest()[:4], "big") for t in others] for h in some]
                continue
            first, last, step = _words(some), _words([t + b"\x80" for t in others], n), max(AT_ONCE // len(others), 1)
            for lo in range(0, len(some), step):
                out[np.ix_(rows[lo : lo + step], columns)] = _one_block(first[lo : lo + step], last, n + m)
    return out

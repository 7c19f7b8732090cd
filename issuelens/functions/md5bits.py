"""The first bit of many MD5 digests at once.

``md5(head + str(v) + ':' + token)`` of every token and every ``v`` is one small
message each. Those of up to 55 bytes are one block of 16 words, and 61 of the
64 steps settle the first word of the digest: numpy does a step for thousands
of messages in the time that ten digests take one by one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from issuelens.operators.mmr import gathered

try:
    from _md5 import md5  # twice as fast on a word as OpenSSL's
except ImportError:
    from hashlib import md5

#: Messages at a time: their words and the state stay in a core's cache.
CHUNK = 32_768
#: Bytes of the longest message of one block.
ONE_BLOCK = 55

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADD = [np.uint32(math.floor(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
_LEFT = [np.uint32(x) for x in [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4]
_RIGHT = [np.uint32(32 - x) for x in _LEFT]
_WORD = [i for i in range(16)] + [(5 * i + 1) % 16 for i in range(16, 32)] + [(3 * i + 5) % 16 for i in range(32, 48)] + [7 * i % 16 for i in range(48, 64)]


def first_bit_clear(words: np.ndarray, filled: Sequence[int]) -> np.ndarray:
    """Whether the digest of each block begins with a 0 bit; ``words`` is ``(16, n)``, word j is 0 from place ``filled[j]`` on."""
    n, u = words.shape[1], np.uint32
    a, b, c, d = (np.full(n, x, u) for x in _START)
    f, t = np.empty(n, u), np.empty(n, u)
    for i in range(61):
        if i < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, _ADD[i], out=f)
        there = filled[_WORD[i]]
        if there:
            np.add(f[:there], words[_WORD[i], :there], out=f[:there])
        np.left_shift(f, _LEFT[i], out=t)
        np.right_shift(f, _RIGHT[i], out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    # the digest's first word is the last step's, in little-endian order
    return (b + u(_START[0])) & u(0x80) == 0


def first_bits_clear(heads: Sequence[bytes], sizes: Sequence[int], tokens: Sequence[bytes], n: int) -> np.ndarray:
    """``(n, len(tokens))``: whether ``md5(head + str(v) + ':' + token)`` begins with a 0 bit, for ``v`` from 1; row 0 is true.

    ``heads[i]`` goes before the next ``sizes[i]`` tokens.
    """
    out = np.ones((n, len(tokens)), bool)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(tokens), np.uint8)
    head_size = np.fromiter(map(len, heads), np.int64, len(heads))
    head_start = np.cumsum(head_size) - head_size
    head_flat = np.frombuffer(b"".join(heads), np.uint8)
    of = np.repeat(np.arange(len(heads)), sizes)
    order = np.argsort(-(size + head_size[of]), kind="stable")  # long messages first: the words of the others end early
    low = 1
    while low < n and len(tokens):
        digits, high = len(str(low)), min(10 * low, n)
        total = (size + head_size[of] + digits + 1)[order]
        whole = int(np.searchsorted(-total, -ONE_BLOCK))
        for row in order[:whole].tolist():  # more than one block
            for v in range(low, high):
                out[v, row] = md5(heads[of[row]] + f"{v}:".encode() + tokens[row]).digest()[0] < 128
        for at in range(whole, len(order), CHUNK):
            rows = order[at:at + CHUNK]
            m, length, lead = len(rows), size[rows], head_size[of[rows]]
            words = np.zeros((16, m), "<u4")
            text = words.view(np.uint8).reshape(-1)

            def place(row: np.ndarray, byte: np.ndarray, m: int = m) -> np.ndarray:
                return ((byte >> 2) * m + row) * 4 + (byte & 3)

            row = np.arange(m)
            each = np.repeat(row, lead)
            text[place(each, gathered(np.zeros(m, np.int64), lead))] = head_flat[gathered(head_start[of[rows]], lead)]
            text[place(row, lead + digits)] = ord(":")
            each = np.repeat(row, length)
            text[place(each, gathered(lead + digits + 1, length))] = flat[gathered(start[rows], length)]
            text[place(row, lead + digits + 1 + length)] = 0x80
            words[14] = (lead + digits + 1 + length) * 8
            last = (lead + digits + 1 + length) >> 2  # the word of the closing bit
            filled = [int(np.searchsorted(-last, -j, "right")) for j in range(14)] + [m, 0]
            number = [place(row, lead + i) for i in range(digits)]
            for v in range(low, high):
                for i, digit in enumerate(str(v).encode()):
                    text[number[i]] = digit
                out[v, rows] = first_bit_clear(words, filled)
        low = high if high < n else n
    return out

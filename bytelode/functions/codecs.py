"""Codecs that Python's library lacks: AES in CBC mode, LZW, and blocks of LZ4 and LZO1X."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def _times(a: int, b: int) -> int:
    """Product in GF(2^8) modulo x^8 + x^4 + x^3 + x + 1."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """S-box, its inverse, and products with the factors of the inverse column mix."""
    box = np.zeros(256, np.uint8)
    inverse = [0] * 256
    for a in range(1, 256):
        if not inverse[a]:
            b = next(b for b in range(1, 256) if _times(a, b) == 1)
            inverse[a], inverse[b] = b, a
    for a in range(256):
        x, out = inverse[a], 0x63
        for i in range(5):
            out ^= (x << i | x >> (8 - i)) & 0xFF
        box[a] = out
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256)
    return box, back, {f: np.array([_times(a, f) for a in range(256)], np.uint8) for f in (9, 11, 13, 14)}


def round_keys(key: bytes) -> np.ndarray:
    box, _, _ = tables()
    n, factor = len(key) // 4, 1
    words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
    while len(words) < 4 * (n + 7):
        w = list(words[-1])
        if len(words) % n == 0:
            w = [int(box[x]) for x in w[1:] + w[:1]]
            w[0] ^= factor
            factor = _times(factor, 2)
        elif n > 6 and len(words) % n == 4:
            w = [int(box[x]) for x in w]
        words.append([a ^ b for a, b in zip(words[-n], w)])
    return np.array(words, np.uint8).reshape(-1, 16)


#: Where each byte of a column-wise state comes from when the rows are shifted back.
SHIFT = np.array([(4 * (c - r) + r) % 16 for c in range(4) for r in range(4)])


def aes_cbc_decrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    """All blocks at once; the padding stays."""
    if len(data) % 16:
        raise ValueError("not whole blocks")
    _, back, times = tables()
    keys = round_keys(key)
    cipher = np.frombuffer(data, np.uint8).reshape(-1, 16)
    state = cipher ^ keys[-1]
    for k in keys[-2::-1]:
        state = back[state[:, SHIFT]] ^ k
        if k is not keys[0] and not np.shares_memory(k, keys[0]):
            s = state.reshape(-1, 4, 4)
            state = np.stack([times[14][s[:, :, i]] ^ times[11][s[:, :, (i + 1) % 4]] ^ times[13][s[:, :, (i + 2) % 4]] ^ times[9][s[:, :, (i + 3) % 4]] for i in range(4)], 2).reshape(-1, 16)
    return (state ^ np.concatenate([np.frombuffer(iv, np.uint8).reshape(1, 16), cipher[:-1]])).tobytes()


def aes_cbc_encrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    """Block by block: for small data, as samples have."""
    box, _, _ = tables()
    keys, last, out = round_keys(key), iv, []
    for at in range(0, len(data), 16):
        state = [a ^ b ^ int(k) for a, b, k in zip(data[at : at + 16], last, keys[0])]
        for n, k in enumerate(keys[1:], 1):
            # The row shift, then the column mix but in the last round.
            state = [int(box[state[(4 * (c + r) + r) % 16]]) for c in range(4) for r in range(4)]
            if n < len(keys) - 1:
                state = [_times(state[4 * c + r], 2) ^ _times(state[4 * c + (r + 1) % 4], 3) ^ state[4 * c + (r + 2) % 4] ^ state[4 * c + (r + 3) % 4] for c in range(4) for r in range(4)]
            state = [s ^ int(x) for s, x in zip(state, k)]
        last = bytes(state)
        out.append(last)
    return b"".join(out)


def lzw(data: bytes, widest: int, blocks: bool) -> bytes:
    """Codes of 9 bits on, of which eight of a width are a group; 256 clears the table if there are blocks."""
    bits, at, end, out = 9, 0, len(data) * 8, []
    first = [bytes([i]) for i in range(256)] + [b""] * blocks
    table, before, group = list(first), b"", 0

    def aligned() -> int:
        return group + -(-(at - group) // (8 * bits)) * 8 * bits

    while at + bits <= end:
        word = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << bits) - 1)
        at += bits
        if blocks and word == 256:
            at = aligned()
            table, before, bits, group = list(first), b"", 9, at
            continue
        if word < len(table):
            now = table[word]
        elif word == len(table) and before:
            now = before + before[:1]
        else:
            raise ValueError("a code that is not in the table")
        out.append(now)
        if before and len(table) < 1 << widest:
            table.append(before + now[:1])
        before = now
        if len(table) >= 1 << bits and bits < widest:
            at = aligned()
            bits, group = bits + 1, at
    return b"".join(out)


def lzo1x(data: bytes, most: int) -> bytes:
    """A block of LZO1X: literal runs, and matches whose first byte tells distance and length; a match carries up to three literals."""
    out, at = bytearray(), 0

    def long(base: int) -> int:
        nonlocal at
        n = base
        while not data[at]:
            n, at = n + 255, at + 1
        n, at = n + data[at], at + 1
        return n

    def literals(n: int) -> None:
        nonlocal at
        out.extend(data[at : at + n])
        at += n
        if len(out) > most:
            raise ValueError("the block is too large")

    state = 0
    if data[0] > 17:
        n = data[0] - 17
        at = 1
        literals(n)
        state = min(n, 4)
    while True:
        word = data[at]
        at += 1
        if word < 16 and state == 0:
            literals(word + 3 if word else long(15 + 3))
            state = 4
            continue
        if word < 16:
            back = (word >> 2) + (data[at] << 2) + (1 if state < 4 else 2049)
            n, carried, at = 2 if state < 4 else 3, word & 3, at + 1
        elif word < 32:
            n = (word & 7) + 2 if word & 7 else long(7 + 2)
            low = int.from_bytes(data[at : at + 2], "little")
            back, carried, at = 16384 + ((word & 8) << 11) + (low >> 2), low & 3, at + 2
            if back == 16384:
                return bytes(out)
        elif word < 64:
            n = (word & 31) + 2 if word & 31 else long(31 + 2)
            low = int.from_bytes(data[at : at + 2], "little")
            back, carried, at = (low >> 2) + 1, low & 3, at + 2
        else:
            n, carried = (word >> 5) - 1 + 2, word & 3
            back, at = (data[at] << 3) + (word >> 2 & 7) + 1, at + 1
        if back > len(out) or len(out) + n > most:
            raise ValueError("a match points before the start, or the block is too large")
        start = len(out) - back
        out += out[start : start + n] if back >= n else (out[start:] * (n // back + 1))[:n]
        literals(carried)
        state = carried


def lz4_block(data: bytes, most: int, before: bytes = b"") -> bytes:
    """A raw block of LZ4, of at most so many bytes when decoded; matches may reach into what came before."""
    out, at = bytearray(before[-65536:]), 0
    known = len(out)
    most += known

    def length(start: int) -> int:
        nonlocal at
        n = start
        if start == 15:
            while True:
                n += (byte := data[at])
                at += 1
                if byte != 255:
                    break
        return n

    while at < len(data):
        token = data[at]
        at += 1
        n = length(token >> 4)
        out += data[at : at + n]
        at += n
        if at >= len(data):
            break
        back = data[at] | data[at + 1] << 8
        at += 2
        n = length(token & 15) + 4
        if not 0 < back <= len(out) or len(out) + n > most:
            raise ValueError("a match points before the start, or the block is too large")
        start = len(out) - back
        if back >= n:
            out += out[start : start + n]
        else:
            out += (out[start:] * (n // back + 1))[:n]
    return bytes(out[known:])

"""Draws of the bootstrap as whole arrays: the hashes that Spark has as expressions, for all rows of a group at once.

A draw is (seed, group, replicate, row), a thousand for each row, so none of them becomes a row of a table."""

from __future__ import annotations

import hashlib
import math

import numpy as np

SHIFTS = (7, 12, 17, 22, 5, 9, 14, 20, 4, 11, 16, 23, 6, 10, 15, 21)
SINES = tuple(int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64))
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
CHUNK, WORD = 32_768, 0xFFFFFFFF
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
LONG, CELLS = 0xFFFFFFFFFFFFFFFF, 1 << 15


def _rotated(x, s: int):
    if isinstance(x, int):
        return (x << s | x >> (32 - s)) & WORD
    high = x << s
    x >>= 32 - s
    high |= x
    return high


def _first_word(words: list):
    """The first word of the MD5 digest of one block; `words` are 16 numbers or arrays of them."""
    a, b, c, d = START
    for i in range(61):  # what follows changes the other words
        if i < 16:
            f, g = (c ^ d) & b ^ d, i
        elif i < 32:
            f, g = (b ^ c) & d ^ c, (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = (d ^ WORD | b) ^ c, 7 * i % 16
        word = words[g]
        if all(isinstance(x, int) for x in (f, a, word)):
            f = (f + a + SINES[i] + word) & WORD
        else:
            known = sum(x for x in (SINES[i], f, a, word) if isinstance(x, int)) & WORD
            arrays = [x for x in (f, a, word) if not isinstance(x, int)]
            f = arrays[0] + known if len(arrays) == 1 or arrays[0] is not f else arrays[0]
            if f is arrays[0]:
                f += known
            for x in arrays[1:]:
                f += x
        f = _rotated(f, SHIFTS[i // 16 * 4 + i % 4])
        if isinstance(f, int) and isinstance(b, int):
            f = (f + b) & WORD
        elif isinstance(f, int):
            f = b + f
        else:
            f += b
        a, d, c, b = d, c, b, f
    return (START[0] + b if not isinstance(b, int) else (START[0] + b) & WORD)


def _spans(low: int, high: int, longest: int):
    """(low, high, digits): ranges of numbers of the same count of digits."""
    while low < high:
        digits = len(str(low))
        end = min(high, 10**digits, low + longest)
        yield low, end, digits
        low = end


def _digits(low: int, high: int, digits: int, offset: int) -> list:
    """The digits of the numbers as little-endian words, the first at a byte of the first word."""
    number = np.arange(low, high, dtype=np.uint64)
    found = np.zeros((high - low, (offset + digits + 3) // 4 * 4), np.uint8)
    for k in range(digits):
        found[:, offset + k] = 48 + number // np.uint64(10 ** (digits - 1 - k)) % np.uint64(10)
    return list(np.ascontiguousarray(found.view("<u4").T))


def md5_draws(head: str, resamples: range, n: int):
    """(replicates, low, high, hashes): the first 32 bits of md5(head:r:i) as a big-endian number, for all places i
    from 0 to n - 1 and all replicates r of a range; CHUNK draws at once."""
    start = f"{head}:".encode()
    for low, high, digits in _spans(0, n, CHUNK):
        known = {}
        for first, last, width in _spans(resamples.start, resamples.stop, max(1, CHUNK // (high - low))):
            size, split = len(start) + width + 1 + digits, len(start) + width + 1
            if size > 55:  # more than one block
                each = (hashlib.md5(start + f"{r}:{i}".encode()).digest()[:4] for r in range(first, last) for i in range(low, high))
                found = np.frombuffer(b"".join(each), ">u4").astype(np.uint32)
            else:
                block = bytearray(start + bytes(width) + b":" + bytes(digits) + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little")
                words = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
                for k, x in enumerate(_digits(first, last, width, len(start) % 4), len(start) // 4):
                    words[k] = words[k] + x[:, None]
                if split not in known:
                    known[split] = _digits(low, high, digits, split % 4)
                for k, x in enumerate(known[split], split // 4):
                    words[k] = words[k] + x[None, :]
                shape = (last - first, high - low)
                found = _first_word([x if isinstance(x, int) else np.ascontiguousarray(np.broadcast_to(x, shape)).ravel() for x in words]).byteswap()
            yield range(first, last), low, high, found.reshape(last - first, high - low)


def resampled(head: str, values: np.ndarray, weights: np.ndarray, resamples: range) -> list[float | None]:
    """Per replicate r the weighted mean of n draws of n: draw i takes row md5(head:r:i) % n. None where no weight is."""
    n, product = len(values), values * weights
    top, below = np.zeros(len(resamples)), np.zeros(len(resamples))
    for replicates, _, _, h in md5_draws(head, resamples, n):
        h %= np.uint32(n)
        at = slice(replicates.start - resamples.start, replicates.stop - resamples.start)
        top[at] += product.take(h).sum(1)
        below[at] += weights.take(h).sum(1)
    return [float(a / b) if b != 0 else None for a, b in zip(top, below)]


def _mixed(h: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The end of xxhash64, in place."""
    np.right_shift(h, 33, out=other)
    h ^= other
    h *= P2
    np.right_shift(h, 29, out=other)
    h ^= other
    h *= P3
    np.right_shift(h, 32, out=other)
    h ^= other
    return h


def xx_int(value: np.ndarray, seed: int) -> np.ndarray:
    """xxhash64 of 32-bit numbers, one seed."""
    h = np.uint64((seed + P5 + 4) & LONG) ^ (value.astype(np.uint64) & np.uint64(WORD)) * np.uint64(P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * np.uint64(P2) + np.uint64(P3)
    return _mixed(h, np.empty_like(h))


def _poisson() -> tuple[np.ndarray, np.ndarray]:
    """(least 40-bit numbers from which a row enters once, twice and so on; the times by their upper bits, 255 where the lower decide)."""
    term, total, edges = 2.718281828459045**-1, 0.0, []
    for k in range(1, 12):
        total += term
        edges.append(math.ceil(total * (1 << 40)))
        term /= k
    cell = (1 << 40) // CELLS
    low = np.arange(CELLS, dtype=np.int64) * cell
    first, last = (np.searchsorted(edges, x, "right") for x in (low, low + cell - 1))
    return np.array(edges, np.int64), np.where(first == last, first, 255).astype(np.uint8)


EDGES, TIMES = _poisson()


def poisson_times(seeds: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each row enters each replicate (replicates, rows): Poisson(1) by xxhash64 of the row's key under the replicate's seed."""
    key = keys.astype(np.uint64) * np.uint64(P2)
    key = ((key << np.uint64(31)) | (key >> np.uint64(33))) * np.uint64(P1)
    h = (seeds + np.uint64(P5 + 8))[:, None] ^ key[None, :]
    other = h >> 37
    h <<= 27
    h |= other
    h *= P1
    h += P4
    _mixed(h, other)
    h &= (1 << 40) - 1
    np.right_shift(h, 25, out=other)
    times = TIMES.take(other.view(np.int64))
    unsure = np.flatnonzero(times.ravel() == 255)
    if len(unsure):
        times.ravel()[unsure] = np.searchsorted(EDGES, h.ravel()[unsure].astype(np.int64), "right")
    return times


def poisson_sums(seed: int, values: np.ndarray, weights: np.ndarray, keys: np.ndarray, resamples: int) -> np.ndarray:
    """(replicates, 2): sums of value times weight and of weight over the rows as often as they enter; `seed` is the group's."""
    seeds = xx_int(np.arange(resamples), int(seed) & LONG)
    both, sums = np.stack([values * weights, weights], 1), np.zeros((resamples, 2))
    step = max(1, 65_536 // max(resamples, 1))
    for at in range(0, len(keys), step):
        sums += np.einsum("rk,ki->ri", poisson_times(seeds, keys[at : at + step]).astype(np.float64), both[at : at + step])  # no threads of its own
    return sums

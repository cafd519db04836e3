"""Counting quotient filters over packed word-id n-grams, without loss.

An n-gram of ids of ``width`` bits is one number of ``m * width`` bits, held in
limbs of 64 bits.  An invertible permutation spreads it evenly.  Its leading
bits are the quotient, all others the remainder, so a filter says exactly which
n-grams it holds: how many each quotient has, their remainders in order, and
their counts.  Sorted filters of the same part of the quotients merge by
adding counts.
"""

from __future__ import annotations

import struct

import numpy as np

_ALL = 0xFFFFFFFFFFFFFFFF
_ODD = 0x9E3779B97F4A7C15
_FACTOR = np.uint64(_ODD)
_HEAD = struct.Struct("<qbbq")

Limbs = list  # of uint64 arrays, the lowest 64 bits first


def limb_bits(bits: int) -> list[int]:
    """Bits of each limb of a number of so many bits."""
    return [min(64, bits - k) for k in range(0, bits, 64)]


def packed(ids: list[np.ndarray], width: int) -> Limbs:
    """The ids of n-grams, first id in the highest bits."""
    bits = limb_bits(len(ids) * width)
    out = [np.zeros(len(ids[0]), np.uint64) for _ in bits]
    for place, word in enumerate(reversed(ids)):
        k, shift = divmod(place * width, 64)
        out[k] |= word << np.uint64(shift)
        if shift + width > 64:
            out[k + 1] |= word >> np.uint64(64 - shift)
    return out


def unpacked(limbs: Limbs, m: int, width: int) -> list[np.ndarray]:
    """The ids of packed n-grams."""
    mask, out = np.uint64((1 << width) - 1), []
    for place in range(m):
        k, shift = divmod(place * width, 64)
        word = limbs[k] >> np.uint64(shift)
        if shift + width > 64:
            word |= limbs[k + 1] << np.uint64(64 - shift)
        out.append(word & mask)
    return out[::-1]


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _spread(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * _FACTOR
    x = (x ^ (x >> np.uint64(29))) * _FACTOR
    return x ^ (x >> np.uint64(32))


def _others(limbs: Limbs) -> np.ndarray:
    h = np.zeros(len(limbs[0]), np.uint64)
    for k, x in enumerate(limbs[1:]):
        h = _spread(h ^ x, k + 7)
    return h


def permuted(limbs: Limbs, bits: list[int]) -> Limbs:
    """An invertible mixing of the whole number; the lowest limb comes out evenly spread."""
    low, mask, half = limbs[0], _mask(bits[0]), np.uint64((bits[0] + 1) // 2)
    for _ in range(3):
        low = (low * _FACTOR) & mask
        low = low ^ (low >> half)
    rest = [x ^ (_spread(low, k) & _mask(b)) for k, (x, b) in enumerate(zip(limbs[1:], bits[1:]))]
    if rest:
        low = low ^ (_others([low, *rest]) & mask)
    return [low, *rest]


def restored(limbs: Limbs, bits: list[int]) -> Limbs:
    """What ``permuted`` was given."""
    low, mask, half = limbs[0], _mask(bits[0]), np.uint64((bits[0] + 1) // 2)
    if len(limbs) > 1:
        low = low ^ (_others(limbs) & mask)
    rest = [x ^ (_spread(low, k) & _mask(b)) for k, (x, b) in enumerate(zip(limbs[1:], bits[1:]))]
    inverse = np.uint64(pow(_ODD, -1, 1 << 64))
    for _ in range(3):
        low = low ^ (low >> half)
        low = (low * inverse) & mask
    return [low, *rest]


def summed(limbs: Limbs, counts: np.ndarray) -> tuple[Limbs, np.ndarray]:
    """Sorted different numbers and the sums of their counts."""
    if not len(counts):
        return limbs, counts
    order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(tuple(limbs[::1][1:]) + (limbs[0],))
    limbs, counts = [x[order] for x in limbs], counts[order]
    new = np.ones(len(counts), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in limbs], axis=0)
    start = np.flatnonzero(new)
    return [x[start] for x in limbs], np.add.reduceat(counts, start)


def _as_bytes(x: np.ndarray, bits: int) -> bytes:
    """The low bytes of each number that ``bits`` need."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :-(-bits // 8)].tobytes()


def _from_bytes(data: memoryview, n: int, bits: int) -> tuple[np.ndarray, int]:
    wide = -(-bits // 8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :wide] = np.frombuffer(data, np.uint8, n * wide).reshape(n, wide)
    return out.view("<u8").reshape(n).astype(np.uint64), n * wide


def encoded(limbs: Limbs, counts: np.ndarray, bits: list[int], skip: int) -> bytes:
    """A filter of sorted permuted numbers that agree in their first ``skip`` bits (of the lowest limb)."""
    n, left = len(counts), bits[0] - skip
    q = min(max(n, 1).bit_length(), left, 30)
    low = limbs[0] & _mask(left) if left < 64 else limbs[0]
    sizes = np.bincount((low >> np.uint64(left - q)).astype(np.int64) if left - q < 64 else np.zeros(n, np.int64), minlength=1 << q)
    wide = 1 if sizes.max(initial=0) < 256 else 4
    large = np.flatnonzero(counts > 254)
    short = np.minimum(counts, 255).astype(np.uint8)
    return b"".join([
        _HEAD.pack(n, q, wide, len(large)), sizes.astype(f"<u{wide}").tobytes(), _as_bytes(low & _mask(left - q), left - q),
        *[_as_bytes(x, b) for x, b in zip(limbs[1:], bits[1:])], short.tobytes(), counts[large].astype("<i8").tobytes()])


def decoded(data: bytes, bits: list[int], skip: int, head: int) -> tuple[Limbs, np.ndarray]:
    """The numbers and counts of a filter whose numbers begin with the ``skip`` bits ``head``."""
    view, left = memoryview(data), bits[0] - skip
    n, q, wide, large = _HEAD.unpack_from(view)
    at = _HEAD.size
    sizes = np.frombuffer(view[at:], f"<u{wide}", 1 << q)
    at += wide << q
    low, used = _from_bytes(view[at:], n, left - q)
    at += used
    quotient = np.repeat(np.arange(1 << q, dtype=np.uint64), sizes)
    low = low | (quotient << np.uint64(left - q) if left - q < 64 else np.uint64(0))
    if skip:
        low = low | (np.uint64(head) << np.uint64(left) if left < 64 else np.uint64(0))
    rest = []
    for b in bits[1:]:
        x, used = _from_bytes(view[at:], n, b)
        rest.append(x)
        at += used
    counts = np.frombuffer(view[at:], np.uint8, n).astype(np.int64)
    at += n
    counts[counts == 255] = np.frombuffer(view[at:], "<i8", large)
    return [low, *rest], counts

"""FLAC decoding (S11) in Python, for corpora that are stored so; a native decoder can be injected instead.

Frames are decoded sample by sample, some 2 microseconds each. The stream's own checksum of its
samples is verified where it has one.
"""

from __future__ import annotations

import hashlib
from operator import mul

import numpy as np

#: Coefficients of the fixed predictors, by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


class Bits:
    """Bits of a byte string, most significant first."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data + bytes(16), np.uint8)
        self.size = 8 * len(data)
        ones = np.flatnonzero(np.unpackbits(raw))
        # the place of the next one from each place on
        place = np.searchsorted(ones, np.arange(8 * len(raw)))
        self.next_one = np.append(ones, 8 * len(raw))[place].tolist()
        wide = np.zeros(len(raw) - 8, np.uint64)
        for k in range(8):
            wide |= raw[k : k + len(wide)].astype(np.uint64) << np.uint64(56 - 8 * k)
        #: 64 bits from each byte on.
        self.wide = wide.tolist()
        self.at = 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > self.size:
            raise ValueError("FLAC data end too early")
        out = (self.wide[self.at >> 3] >> (64 - (self.at & 7) - n)) & ((1 << n) - 1)
        self.at += n
        return out

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        one = self.next_one[self.at]
        if one >= self.size:
            raise ValueError("FLAC data end too early")
        out, self.at = one - self.at, one + 1
        return out

    def rice(self, k: int, n: int) -> list[int]:
        """n folded numbers of a unary part and k bits each."""
        out, at, ones, wide, mask = [], self.at, self.next_one, self.wide, (1 << k) - 1
        if at >= self.size and n:
            raise ValueError("FLAC data end too early")
        for _ in range(n):
            one = ones[at]
            if one >= self.size:
                raise ValueError("FLAC data end too early")
            x = one - at
            at = one + 1
            if k:
                x = x << k | (wide[at >> 3] >> (64 - (at & 7) - k)) & mask
                at += k
            out.append(x >> 1 if not x & 1 else ~(x >> 1))
        self.at = at
        return out


def residual(bits: Bits, block: int, order: int) -> list[int]:
    wide = bits.take(2)
    if wide > 1:
        raise ValueError("FLAC residual of an unknown coding")
    depth, partitions = 4 + wide, 1 << bits.take(4)
    out: list[int] = []
    for part in range(partitions):
        n = block // partitions - (order if part == 0 else 0)
        k = bits.take(depth)
        if k == (1 << depth) - 1:
            size = bits.take(5)
            out += [bits.signed(size) for _ in range(n)]
        else:
            out += bits.rice(k, n)
    return out


def predicted(start: list[int], rest: list[int], weights: tuple[int, ...], shift: int) -> list[int]:
    """Samples from the first ones and what the prediction from the ones before each leaves."""
    order, back = len(weights), weights[::-1]
    out = list(start)
    for x in rest:
        out.append(x + (sum(map(mul, back, out[len(out) - order :])) >> shift) if order else x)
    return out


def subframe(bits: Bits, block: int, size: int) -> list[int]:
    if bits.take(1):
        raise ValueError("not a FLAC subframe")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    size -= wasted
    if kind == 0:
        out = [bits.signed(size)] * block
    elif kind == 1:
        out = [bits.signed(size) for _ in range(block)]
    elif 8 <= kind <= 12:
        start = [bits.signed(size) for _ in range(kind - 8)]
        out = predicted(start, residual(bits, block, kind - 8), FIXED[kind - 8], 0)
    elif kind >= 32:
        order = kind - 31
        start = [bits.signed(size) for _ in range(order)]
        precision, shift = bits.take(4) + 1, bits.signed(5)
        weights = tuple(bits.signed(precision) for _ in range(order))
        out = predicted(start, residual(bits, block, order), weights, shift)
    else:
        raise ValueError("FLAC subframe of an unknown kind")
    return [x << wasted for x in out] if wasted else out


def frame(bits: Bits, size: int) -> list[list[int]]:
    """The channels of a frame; ``size``: bits a sample where the frame names none."""
    if bits.take(15) != 0b111111111111100:
        raise ValueError("not a FLAC frame")
    bits.take(1)
    block_code, rate_code, channels, size_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    lead = bits.take(8)  # the frame's number: as many bytes more as there are ones in front, less one
    for _ in range(max(0, 8 - (lead ^ 0xFF).bit_length() - 1)):
        bits.take(8)
    if block_code == 0:
        raise ValueError("FLAC frame without a size")
    block = 192 if block_code == 1 else 576 << (block_code - 2) if block_code < 6 else bits.take(8) + 1 if block_code == 6 else bits.take(16) + 1 if block_code == 7 else 256 << (block_code - 8)
    bits.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    bits.take(8)
    size = SIZES.get(size_code, size)
    if channels < 8:
        out = [subframe(bits, block, size) for _ in range(channels + 1)]
    else:
        a, b = subframe(bits, block, size + (channels == 9)), subframe(bits, block, size + (channels != 9))
        if channels == 8:
            out = [a, [x - y for x, y in zip(a, b, strict=True)]]
        elif channels == 9:
            out = [[x + y for x, y in zip(a, b, strict=True)], b]
        else:
            whole = [(x << 1) | (y & 1) for x, y in zip(a, b, strict=True)]
            out = [[(x + y) >> 1 for x, y in zip(whole, b, strict=True)], [(x - y) >> 1 for x, y in zip(whole, b, strict=True)]]
    bits.at = (bits.at + 7) // 8 * 8
    bits.take(16)
    return out


def decode_flac(data: bytes) -> tuple[np.ndarray, int]:
    """Samples in -1 to 1 and the rate; channels are averaged."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info = 4, False, b""
    while not last:
        last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4])
        if kind == 0:
            info = data[at + 4 : at + 4 + n]
        at += 4 + n
    fields = int.from_bytes(info[10:18])
    rate, channels, size, total = fields >> 44, (fields >> 41 & 7) + 1, (fields >> 36 & 31) + 1, fields & (1 << 36) - 1
    bits = Bits(data[at:])
    parts: list[list[list[int]]] = []
    n = 0
    while bits.at + 32 <= bits.size and (not total or n < total):
        parts.append(frame(bits, size))
        n += len(parts[-1][0])
    found = np.concatenate([np.array(p, np.int64).T for p in parts]) if parts else np.zeros((0, channels), np.int64)
    width = (size + 7) // 8
    plain = np.ascontiguousarray(found, "<i8").view(np.uint8).reshape(*found.shape, 8)[:, :, :width].tobytes()
    if info[18:34].strip(b"\0") and hashlib.md5(plain).digest() != info[18:34]:
        raise ValueError("FLAC samples do not have the stream's checksum")
    return (found.mean(axis=1) / (1 << (size - 1))).astype(np.float32), rate

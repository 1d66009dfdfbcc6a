"""The FLAC decoder against streams that a plain encoder of the format writes here."""

import hashlib
import random

import numpy as np
import pytest

from framewright.sources import audio
from framewright.sources.flac import FIXED, decode_flac


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, x, n):
        self.bits += [x >> i & 1 for i in range(n - 1, -1, -1)]

    def unary(self, n):
        self.bits += [0] * n + [1]

    def bytes(self):
        return np.packbits(self.bits).tobytes()


def residual(w, rest, block, order, k, partitions=0, escape=()):
    w.put(int(k > 14), 2)
    w.put(partitions, 4)
    at = 0
    for part in range(1 << partitions):
        n = (block >> partitions) - (order if not part else 0)
        own, at = rest[at : at + n], at + n
        depth = 5 if k > 14 else 4
        if part in escape:
            size = max((x if x >= 0 else ~x).bit_length() for x in own) + 1 if any(own) else 0
            w.put((1 << depth) - 1, depth)
            w.put(size, 5)
            for x in own:
                w.put(x & (1 << size) - 1, size)
            continue
        w.put(k, depth)
        for x in own:
            u = 2 * x if x >= 0 else -2 * x - 1
            w.unary(u >> k)
            w.put(u & (1 << k) - 1, k)


def subframe(w, x, size, kind, k=4, **options):
    wasted = 0
    if kind == "wasted":
        wasted = 2
        x, kind = [v >> 2 for v in x], "verbatim"
    size -= wasted
    name, _, order = kind.partition(" ")
    order = int(order or 0)
    w.put({"constant": 0, "verbatim": 1, "fixed": 8 + order, "linear": 31 + order}[name], 7)
    w.put(int(wasted > 0), 1)
    if wasted:
        w.unary(wasted - 1)
    mask = (1 << size) - 1
    if name == "constant":
        w.put(x[0] & mask, size)
    elif name == "verbatim":
        for v in x:
            w.put(v & mask, size)
    else:
        weights, shift = (FIXED[order], 0) if name == "fixed" else ([int(40 / (j + 1)) * (-1) ** j for j in range(order)], 6)
        for v in x[:order]:
            w.put(v & mask, size)
        if name == "linear":
            w.put(7, 4)
            w.put(shift, 5)
            for c in weights:
                w.put(c & 0xFF, 8)
        rest = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(weights)) >> shift) for i in range(order, len(x))]
        residual(w, rest, len(x), order, k, **options)


def stream(channels, size, frames, rate=16000, checksum=True):
    """``frames``: (start, end, channel assignment, [(kind, options)] by channel)."""
    n, count = len(channels[0]), len(channels)
    plain = b"".join(int(c[i]).to_bytes((size + 7) // 8, "little", signed=True) for i in range(n) for c in channels)
    info = (16).to_bytes(2) + (4096).to_bytes(2) + bytes(6) + (rate << 44 | (count - 1) << 41 | (size - 1) << 36 | n).to_bytes(8)
    info += hashlib.md5(plain).digest() if checksum else bytes(16)
    out = b"fLaC" + bytes([0]) + len(info).to_bytes(3) + info + bytes([0x84]) + (5).to_bytes(3) + b"hello"
    for number, (a, b, how, kinds) in enumerate(frames):
        w = Writer()
        w.put(0b111111111111100, 15)
        w.put(0, 1)
        w.put(7, 4)
        w.put(0, 4)
        w.put(how, 4)
        w.put({8: 1, 16: 4, 24: 6}[size] if number % 2 else 0, 3)
        w.put(0, 1)
        if number < 128:
            w.put(number, 8)
        w.put(b - a - 1, 16)
        w.put(0, 8)
        left, right = (channels[0][a:b], channels[-1][a:b])
        side = [x - y for x, y in zip(left, right)]
        sent = {8: [left, side], 9: [side, right], 10: [[(x + y) >> 1 for x, y in zip(left, right)], side]}.get(how, [c[a:b] for c in channels])
        for c, (x, (kind, options)) in enumerate(zip(sent, kinds)):
            subframe(w, x, size + (how in (8, 10) and c == 1) + (how == 9 and c == 0), kind, **options)
        out += w.bytes() + bytes(2)
    return out


def tone(n, loud, seed):
    rng = random.Random(seed)
    return [int(loud * np.sin(i / 9) + rng.uniform(-loud / 50, loud / 50)) for i in range(n)]


KINDS = [("verbatim", {}), ("wasted", {}), *((f"fixed {o}", {"k": k, "partitions": p}) for o, k, p in ((0, 9, 0), (1, 8, 2), (2, 7, 3), (3, 20, 1), (4, 9, 0))), ("linear 1", {"k": 9}), ("linear 8", {"k": 10, "partitions": 2, "escape": (1,)}), ("linear 32", {"k": 11, "partitions": 1, "escape": (0, 1)})]


@pytest.mark.parametrize("kind", KINDS, ids=[k for k, _ in KINDS])
@pytest.mark.parametrize("size", [16, 24])
def test_subframes(kind, size):
    x = [v & ~3 for v in tone(640, 1 << (size - 3), 1)]
    samples, rate = decode_flac(stream([x], size, [(0, 320, 0, [kind]), (320, 640, 0, [kind])]))
    assert rate == 16000
    np.testing.assert_allclose(samples, np.array(x) / (1 << (size - 1)), atol=1e-7)


@pytest.mark.parametrize("how", [1, 8, 9, 10])
def test_channels(how):
    a, b = tone(512, 9000, 2), tone(512, 8000, 3)
    kinds = [("fixed 2", {"k": 8}), ("linear 4", {"k": 8})]
    samples, _ = decode_flac(stream([a, b], 16, [(0, 256, how, kinds), (256, 512, how, kinds[::-1])]))
    np.testing.assert_allclose(samples, (np.array(a) + np.array(b)) / 2 / 32768, atol=1e-7)


def test_constant_and_wrong_streams():
    data = stream([[-5] * 100], 8, [(0, 100, 0, [("constant", {})])])
    np.testing.assert_allclose(decode_flac(data)[0], -5 / 128)
    bad = bytearray(data)
    bad[-3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        decode_flac(bytes(bad))
    with pytest.raises(ValueError):
        decode_flac(data[:-6])
    with pytest.raises(ValueError):
        decode_flac(b"RIFF")


def test_read_audio_takes_both(spark, tmp_path):
    x = tone(800, 9000, 4)
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "a.flac").write_bytes(stream([x], 16, [(0, 800, 0, [("fixed 1", {"k": 9})])], checksum=False))
    (tmp_path / "p1" / "b.wav").write_bytes(audio.encode_wav(np.array(x) / 32768, 16000))
    one, two = (audio.read_audio(spark, str(tmp_path), s).first() for s in (".flac", ".wav"))
    assert (one["speaker"], one["utt"], one["sr"]) == ("p1", "a", 16000)
    np.testing.assert_allclose(one["samples"], two["samples"], atol=1e-4)

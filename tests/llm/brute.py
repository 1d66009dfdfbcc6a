"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def covered(n, starts, width):
    gone = bytearray(n)
    for s in starts:
        gone[s : s + width] = b"\1" * width
    return gone


def runs(gone):
    return len(re.findall(b"\1+", bytes(gone)))


def byte_repeats(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    places = defaultdict(int)
    for _, t in texts:
        for p in range(len(t) - length + 1):
            places[t[p : p + length]] += 1
    out = []
    for i, t in texts:
        gone = covered(len(t), [p for p in range(len(t) - length + 1) if places[t[p : p + length]] > 1], length)
        out.append((i, len(t), sum(gone), runs(gone), sha(bytes(c for c, g in zip(t, gone) if not g))))
    return out


def word_repeats(rows, width):
    found = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    rank = lambda i: (i is None, i or 0)
    for i, w in found:
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            least[key] = min(least.get(key, (True, 1)), rank(i))
    out = []
    for i, w in found:
        gone = covered(len(w), [p for p in range(len(w) - width + 1) if least[tuple(w[p : p + width])] < rank(i)], width)
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def fingerprint(text, width=4):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(lower)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius=4):
    prints = [(i, fingerprint(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, f"{f:016x}", least.get(root(k))) for k, (i, f) in enumerate(prints)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    out = []
    text = text or ""
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    repeated = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))

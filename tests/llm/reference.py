"""Brute-force versions of the training-data operators, row by row in plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def suffix_dedup(rows, length=200):
    seen = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, sha(kept)))
    return sorted(out, key=str)


def near_duplicates(rows, k, percent):
    sets = []
    for d, t in rows:
        w = words(t)
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    u, v = sorted((find(a), find(b)))
                    parent[v] = u
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    n, rep = len(w), len(covered)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 10 or 100 * rep > 20 * n)


def conversations(rows):
    """conv_id -> n_turns, turns_sha256, loss_chars, loss_sha256."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()), len(loss), sha(loss.encode()))
    return out


def line_dedup(rows, width=3):
    seen, out = {}, []
    blank = " \t\n\x0b\x0c\r"
    for d, t in sorted(rows):
        lines = (t or "").split("\n")
        solid = [i for i, x in enumerate(lines) if x.strip(blank)]
        gone = set()
        for k in range(len(solid) - width + 1):
            key = tuple(lines[i].strip(blank) for i in solid[k : k + width])
            if key in seen and seen[key] != (d, k):
                gone.update(solid[k : k + width])
            seen.setdefault(key, (d, k))
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((d, len(lines), len(gone), sha(text.encode())))
    return out


def katz(rows, k=5):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    uni, bi = Counter(), Counter()
    texts = [(d, words(t) + ["</s>"]) for d, t in rows]
    for d, w in texts:
        if not held[d]:
            uni.update(w)
            bi.update(zip(["<s>"] + w[:-1], w))
    total, vocabulary = sum(uni.values()), len(uni)

    def factors(c):
        n = [sum(1 for v in c.values() if v == r) for r in range(1, k + 2)]
        if all(n):
            top = (k + 1) * n[k] / n[0]
            if top < 1:
                d = [((r + 1) * n[r] / n[r - 1] / r - top) / (1 - top) for r in range(1, k + 1)]
                if all(0 < x < 1 for x in d):
                    return [1.0] + d
        a = min(n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5, 0.9)
        return [1.0] + [(r - a) / r for r in range(1, k + 1)]

    d1, d2 = factors(uni), factors(bi)
    disc = lambda d, c: c if c > k else d[c] * c
    seen = sum(disc(d1, c) for c in uni.values()) / total
    unknown = max(1 - seen, 1 / (total + 1))
    p1 = {w: (1 - unknown) / seen * disc(d1, c) / total for w, c in uni.items()}
    after = defaultdict(dict)
    for (h, w), c in bi.items():
        after[h][w] = c
    tables = {}
    for h, ws in after.items():
        n = sum(ws.values())
        mass = sum(disc(d2, c) for c in ws.values())
        below = n + 1 if n - mass < 1e-9 * n else n
        alpha = (1 - mass / below) / (1 - sum(p1[w] for w in ws))
        tables[h] = (below, alpha, ws)

    def p(h, w):
        lower = p1.get(w, unknown)
        if h not in tables:
            return lower
        below, alpha, ws = tables[h]
        return disc(d2, ws[w]) / below if w in ws else alpha * lower

    out = {}
    for d, w in texts:
        base = sum(math.log10((uni[x] + 1) / (total + vocabulary + 1)) for x in w)
        out[d] = (held[d], len(w), sum(x in uni for x in w), total, base, sum(math.log10(p(a, b)) for a, b in zip(["<s>"] + w[:-1], w)))
    sums = [sum(p(h, w) for w in uni) + p(h, None) for h in list(tables)[:40]]
    return out, sums

"""Plain versions of the operators, to test against."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash


def union(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def components(ids, pairs):
    """The least id of each row's component; null ids count only if there is no other."""
    root = union(len(ids), pairs)
    least = {}
    for r, i in zip(root, ids):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(r) for r in root]


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def simhash(rows):
    fps = [fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    comp = components([i for i, _ in rows], pairs)
    return [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comp)]


def removed(rows, width=50):
    big = 2**63 - 1
    data = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            first[s] = min(first.get(s, big), i)
    out = []
    for (i, _), (k, b) in zip(rows, data):
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < k:
                gone[p : p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def cosine_links(rows, threshold=0.95):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, float)
        return x / np.linalg.norm(x)

    vs = [unit(v) for _, v in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if vs[i] is not None and vs[j] is not None and len(vs[i]) == len(vs[j]) and vs[i] @ vs[j] >= threshold]
    n = [sum(k in p for p in pairs) for k in range(len(rows))]
    comp = components([i for i, _ in rows], pairs)
    return [(i, n[k], comp[k], i == comp[k]) for k, (i, _) in enumerate(rows)]


def rule_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip("0")) <= 3 and int("0" + p.lstrip("0")) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return [(a, b, k) for a, k, b in sorted(out)]


def repeated_windows(rows, width=20):
    """(id, words, removed words, digest, kept text, removed runs) of each row."""
    key = lambda i, p: (i is None, i or 0, p)
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for p in range(len(w) - width + 1):
            s = tuple(w[p : p + width])
            first[s] = min(first.get(s, key(i, p)), key(i, p))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < key(i, p):
                gone[p : p + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        spans = [(p, next((q for q in range(p, len(w)) if not gone[q]), len(w)) - p) for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1])]
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept, spans))
    return out


def hard_negatives(rows, positives=5, negatives=10):
    """Rows (anchor, positive, rank, negative, positive score, negative score) of ``(id, vector, label)``."""
    some = [
        (i, [int(np.floor(256 * float(x))) for x in v], lab if i is None or i % 7 else (lab + 1) % 10)
        for i, v, lab in rows
        if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    some = [r for r in some if sum(x * x for x in r[1]) <= 2**50]
    out = []
    for a, (i, v, lab) in enumerate(some):
        if i is None or i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0, b, other) for b, (j, w, other) in enumerate(some) if b != a and len(w) == len(v)]
        scored.sort(key=lambda s: s[:3])
        ids = {b: some[b][0] for b in range(len(some))}
        for p in [s for s in scored if s[4] == lab][:positives]:
            ps = -p[0]
            fit = [s for s in scored if s[4] != lab and 30 * ps <= -100 * s[0] <= 90 * ps][:negatives]
            out += [(i, ids[p[3]], k, ids[s[3]], ps, -s[0]) for k, s in enumerate(fit, 1)]
    return out


def spelling_variants(rows):
    """(word, form, root, n, near, form's n) of ``(id, text)``."""
    counts = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return variants_of({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})


def variants_of(n):
    def one_apart(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_apart(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in best.items() if n[x] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n]

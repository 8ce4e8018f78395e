"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


class Forest:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def jaccard(rows):
    """(doc_id, n_shingles, component_id) of (doc_id, text)."""
    sets, f = [(i, shingle_set(t)) for i, t in rows], Forest()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                f.join(i, j)
    return sorted((i, len(s), f.find(i)) for i, s in sets)


def contained(docs, items, threshold=0.75):
    out = []
    for i, t in docs:
        u = shingle_set(t)
        for j, q in items:
            s = shingle_set(q)
            if s and len(s & u) >= threshold * len(s):
                out.append((i, j, len(s), len(s & u)))
    return sorted(out, key=str)


def substrings(rows, width):
    raws, seen = [(i, (t or "").encode()) for i, t in rows], {}
    for _, r in raws:
        for k in range(len(r) - width + 1):
            seen[r[k : k + width]] = seen.get(r[k : k + width], 0) + 1
    out = []
    for i, r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for k in range(len(r) - width + 1):
            if seen[r[k : k + width]] > 1:
                gone[k : k + width] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def vectors(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) of (vec_id, embedding)."""
    fine = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    f, n = Forest(), [0] * len(rows)
    for k, (i, a) in enumerate(rows):
        for m, (j, b) in enumerate(rows[:k]):
            if fine(a) and fine(b) and len(a) == len(b):
                x, y = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                    n[k] += 1
                    n[m] += 1
                    f.join(i, j)
    return sorted((i, c, f.find(i), f.find(i) == i) for (i, _), c in zip(rows, n, strict=True))


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


KINDS = ("email", "ip", "card", "phone")


def personal(text):
    """(start, rank, end) of the spans that meet the fixed rules."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def rebuild(rows):
    """Turns of each rebuilt conversation of (conv_id, turn, role, text)."""
    import zlib

    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + t[h:]
    return out


def trie(convs):
    """Rows of op11 for {conv: turns}."""
    nodes = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) if below else 1
        saved[p] = ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0) + sum(saved[q] for q in below)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def phrases(rows, longest=3, least=10, share=50, top=2000):
    """Rows of op12 for (lang, text)."""
    words, counts = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] = words.get(lang, 0) + len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    out = {}
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < least:
            continue
        inside = any(len(q) > len(p) and f >= least and 100 * f >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (other, q), f in counts.items() if other == lang)
        if not inside:
            score, _, left, right = min((1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, words[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def passages(rows, width=50):
    """Rows of op13 for (doc_id, text)."""
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)

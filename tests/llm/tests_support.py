"""Plain versions of what the operators compute, shared by the tests."""

import itertools
from collections import Counter

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_passages(docs, items, r=0.8):
    import regex
    cut = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}\p{M}]+", (t or "").lower()) if w]
    out = {}
    for d, text in docs:
        w = cut(text)
        for i, passage in items:
            p = cut(passage)
            k = min(5, len(p))
            if not p or len(w) < k:
                continue
            want = Counter(tuple(p[j : j + k]) for j in range(len(p) - k + 1))
            if want.keys().isdisjoint(tuple(w[j : j + k]) for j in range(len(w) - k + 1)):
                continue
            for s in range(max(1, len(w) - len(p) + 1)):
                win = w[s : s + len(p)]
                has = Counter(tuple(win[j : j + k]) for j in range(len(win) - k + 1))
                sim = sum((has & want).values()) / sum((has | want).values())
                if sim >= r and sim > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (sim, s)
    return out


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, distance=2):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= distance:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in parent}

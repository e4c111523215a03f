"""Plain versions of the operators, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = WORD.findall(lower(text))
    if not w:
        return frozenset()
    if len(w) < k:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(docs, k, num, den):
    """{doc_id: (n, component)} over (doc_id, text) rows, by all pairs that share a shingle."""
    sets = {d: shingles(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_token = {}
    for d, s in sets.items():
        for t in s:
            by_token.setdefault(t, []).append(d)
    seen = set()
    for group in by_token.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeats(docs, width=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} over (doc_id, text) rows."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - width + 1):
            s = raw[j : j + width]
            if s in seen:
                gone[j : j + width] = b"\1" * width
            else:
                seen.add(s)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out

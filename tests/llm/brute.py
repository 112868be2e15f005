"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib


def ordered(docs):
    """(doc_id, text) rows by doc_id, null first, then text."""
    return sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def gone(docs, units_of, length):
    """Units of each ordered document, and which of them an earlier window covers."""
    seen, out = set(), []
    for doc_id, text in ordered(docs):
        units = units_of(text)
        flags = [False] * len(units)
        for k in range(len(units) - length + 1):
            w = tuple(units[k : k + length]) if isinstance(units, list) else units[k : k + length]
            if w in seen:
                flags[k : k + length] = [True] * length
            seen.add(w)
        out.append((doc_id, units, flags))
    return out


def bytes_digest(docs, length=100):
    rows = []
    for doc_id, raw, flags in gone(docs, str.encode, length):
        spans = sum(f and not (k and flags[k - 1]) for k, f in enumerate(flags))
        kept = bytes(b for b, f in zip(raw, flags) if not f)
        rows.append((doc_id, len(raw), sum(flags), spans, hashlib.sha256(kept).hexdigest()))
    return rows


def words_digest(docs, length=20):
    rows = []
    for doc_id, words, flags in gone(docs, lambda t: t.encode().split(), length):
        kept = b" ".join(w for w, f in zip(words, flags) if not f)
        rows.append((doc_id, len(words), sum(flags), hashlib.sha256(kept).hexdigest()))
    return rows


def fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs, distance=3):
    """(doc_id, fingerprint, component) by comparing all pairs."""
    rows = ordered(docs)
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(d, f"{prints[k]:016x}", rows[find(k)][0]) for k, (d, _) in enumerate(rows)]


def jaccard(a, b):
    """Generalised Jaccard of word counts."""
    from collections import Counter

    a, b = Counter(a.split()), Counter(b.split())
    both = a.keys() | b.keys()
    return sum(min(a[x], b[x]) for x in both) / max(1, sum(max(a[x], b[x]) for x in both))

"""The operators' results in plain Python, for small inputs."""

from __future__ import annotations

import hashlib
import re
import struct

import xxhash


def signed(x: int) -> int:
    return struct.unpack("<q", struct.pack("<Q", x))[0]


def text_hash(text: str | None) -> int:
    return signed(xxhash.xxh64_intdigest((text or "").encode(), 42))


def in_order(docs):
    """Different ``(doc_id, text)`` in the order of documents: null ids first."""
    different = {(d, t or "") for d, t in docs}
    return sorted(different, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1])))


def without_repeats(docs, size, words):
    """``(doc_id, text)`` to units, removed places and what is kept."""
    seen, out = set(), {}
    for doc_id, text in in_order(docs):
        cut = text.encode().split() if words else text.encode()
        gone = set()
        for i in range(len(cut) - size + 1):
            window = tuple(cut[i:i + size])
            if window in seen:
                gone.update(range(i, i + size))
            seen.add(window)
        kept = [cut[i:i + 1] if not words else cut[i] for i in range(len(cut)) if i not in gone]
        out[doc_id, text] = (len(cut), sorted(gone), (b" " if words else b"").join(kept))
    return out


def spans(places):
    return sum(1 for i, p in enumerate(places) if i == 0 or places[i - 1] != p - 1)


def fingerprint(text: str | None) -> int:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Node to the smallest node reachable."""
    above = {n: n for n in nodes}

    def top(n):
        while above[n] != n:
            n = above[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                p, q = top(a), top(b)
                above[max(p, q)] = min(p, q)
    return {n: top(n) for n in nodes}


def benchmark_words(text: str | None) -> list[str]:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text) if w]


def contamination(docs, items, size=13):
    """``(n_words, n_hit, ids)`` for each document."""
    windows = []
    for item_id, text in items:
        w = benchmark_words(text)
        if w:
            windows += [(item_id, w[i:i + size]) for i in range(max(1, len(w) - size + 1))]
    out = []
    for _, text in docs:
        w, hit, ids = benchmark_words(text), set(), set()
        for item_id, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i:i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    ids.add(item_id)
        out.append((len(w), len(hit), sorted(str(i) for i in ids if i is not None)))
    return out


def without_chunks(docs, rolling=2, divisor=3, fewest=2):
    """``(doc_id, text)`` to lines, removed lines and what is kept."""
    seen, out = set(), {}
    for doc_id, text in in_order(docs):
        lines = text.split("\n")
        h = [int(hashlib.md5(s.encode()).hexdigest()[:8], 16) for s in lines]
        chunks, start = [], 0
        for i in range(len(lines)):
            x = h[i]
            for back in range(1, rolling):
                x = (x * 31 + (h[i - back] if i >= back else 0)) % 2147483647
            if x % divisor == 0 or i == len(lines) - 1:
                chunks.append((start, i + 1))
                start = i + 1
        gone = set()
        for a, b in chunks:
            body = "\n".join(lines[a:b])
            if b - a >= fewest:
                if body in seen:
                    gone.update(range(a, b))
                seen.add(body)
        out[doc_id, text] = (len(lines), len(gone), "\n".join(s for i, s in enumerate(lines) if i not in gone))
    return out

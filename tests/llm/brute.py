"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def components(docs, width=4, percent=85):
    """doc_id -> (set size, smallest id reachable)."""
    sets = {}
    for i, text in docs:
        w = words(lower(text))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def _covered(docs, window):
    """For each (id, symbols), in order, which symbols repeated windows cover."""
    seen, out = {}, []
    for i, symbols in sorted(docs, key=lambda x: x[0]):
        gone = [False] * len(symbols)
        for s in range(len(symbols) - window + 1):
            key = symbols[s : s + window]
            if seen.setdefault(key, (i, s)) != (i, s):
                gone[s : s + window] = [True] * window
        out.append((i, symbols, gone))
    return out


def substrings(docs, window=20):
    rows = {}
    for i, w, gone in _covered([(i, tuple(words(t))) for i, t in docs], window):
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        rows[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return rows


def suffixes(docs, window=100):
    rows = {}
    for i, raw, gone in _covered([(i, (t or "").encode()) for i, t in docs], window):
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        rows[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return rows


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def best_stretch(item, text):
    """Fewest word edits between the item and any stretch of the text."""
    return min((edits(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, min(len(text), i + 2 * len(item)) + 1)), default=len(item))


def top(vectors, k=20):
    out = {}
    for q, a in vectors:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vectors if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out



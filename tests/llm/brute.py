"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import re

import numpy as np

_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_TO_LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def roots(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def near_duplicates(docs):
    """``{doc_id: (n_shingles, component)}``."""
    sets = {i: shingles(t) for i, t in docs}
    inside = {}
    for i, s in sets.items():
        for g in s:
            inside.setdefault(g, []).append(i)
    pairs = {}
    for own in inside.values():
        for x in range(len(own)):
            for y in range(x):
                k = (own[y], own[x])
                pairs[k] = pairs.get(k, 0) + 1
    links = [(a, b) for (a, b), n in pairs.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    root = roots(sets, links)
    return {i: (len(s), root[i]) for i, s in sets.items()}


def base_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def repeats(docs, width=100):
    """``{doc_id: (n_bytes, n_removed, n_spans, sha256)}``."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            if w in seen:
                gone[p : p + width] = True
            seen.add(w)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def near_vectors(rows, least=0.98):
    """``{vec_id: (n_links, component)}`` of ``(id, vector, label)``."""
    good = [(i, np.array(v, float), y) for i, v, y in rows if v is not None and y is not None and all(c is not None for c in v)]
    good = [(i, v / np.abs(v).max(), y) for i, v, y in good if np.isfinite(v).all() and v.any()]
    links = []
    for a in range(len(good)):
        for b in range(a):
            (i, v, y), (j, w, z) = good[a], good[b]
            if y == z and len(v) == len(w) and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= least:
                links.append((j, i))
    root = roots([r[0] for r in rows], links)
    n = dict.fromkeys(root, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], root[i]) for i in root}

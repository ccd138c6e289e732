"""Personal data by rules and weak supervision.

Four kinds are found by rule: e-mail and IP addresses, payment cards and phone numbers. For what the
rules leave, candidate strings get votes of labelers (shape patterns, a gazetteer of cue words, the
context before and after); expectation maximisation over all candidates' vote patterns estimates
how reliable each labeler is, and a logistic span classifier is trained on the resulting soft
labels. It adds spans of two kinds, ``secret`` and ``account``; spans found by rule always stay.

Defined results: a null or empty text has no spans; repeated rows give repeated results; other
columns are ignored; without candidates nothing is trained or added; an empty table gives no rows. A very long text is scanned
whole, in time that grows with its length alone. The classifier is fitted on at most ``FIT_CANDIDATES`` candidates.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import id_text, stage

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("secret", "account")

#: Candidates the span classifier is fitted on, those of the least hash; EM uses the counts of all.
FIT_CANDIDATES = 20_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"[A-Za-z0-9_+/=-]+")

# Cue words that announce a secret or an account.
_CUES = {
    "secret": ("token", "password", "passwd", "secret", "apikey", "api_key", "key", "auth", "bearer", "credential"),
    "account": ("account", "iban", "card", "konto", "compte", "cuenta", "ssn", "passport", "phone", "tel", "mobile"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i & 1:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The local part is the longest run before an ``@`` that an earlier match has left free."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        stop = at + 1
        if m:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                free = stop = m.end()
        at = text.find("@", stop)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the four base kinds in code points, end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if not _DIGITS.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found["phone"].append(m.span())
    return found


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Strings with digits that no base span touches: mixed ones of 12 characters or more, and numbers of 9 to 19 digits."""
    taken = sorted(s for spans in base.values() for s in spans)
    out, done, k, reach = [], 0, 0, -1
    for m in _DIGITS.finditer(text):
        start, stop = m.span()
        if start < done:
            continue
        while k < len(taken) and taken[k][0] < stop:
            reach = max(reach, taken[k][1])
            k += 1
        while start > done and text[start - 1] in "_+/=-" or start > done and text[start - 1].isascii() and text[start - 1].isalnum():
            start -= 1
        stop = _TOKEN.match(text, start).end()
        if start < reach or k < len(taken) and taken[k][0] < stop:
            done = m.end()
            continue
        token = text[start:stop].strip("=+/-_")
        start = text.index(token, start)
        if len(token) >= 12 and any(c.isalpha() for c in token):
            out.append(("secret", start, start + len(token)))
            done = start + len(token)
            continue
        run = _CARD.match(text, m.start())
        if run and 9 <= sum("0" <= c <= "9" for c in run[0]) <= 19 and not (k < len(taken) and taken[k][0] < run.end()):
            out.append(("account", *run.span()))
            done = run.end()
        else:
            done = m.end()
    return out


_HEX = re.compile(r"[0-9a-f]{16,}")
_URL = re.compile(r"(?:https?:|www\.|/)\S*$")

#: Labelers, in the order of their votes in a pattern.
LABELERS = ("shape", "mixing", "cue", "assigned", "address", "isolated")


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """1: personal, -1: not, 0: no vote."""
    token, before, after = text[start:end], text[max(0, start - 24) : start].lower(), text[end : end + 1]
    digits = sum(c.isdigit() for c in token)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    if kind == "secret":
        shape = 1 if _HEX.fullmatch(token.lower()) else 0
        mixing = 1 if switches >= 5 else -1 if switches <= 2 else 0
    else:
        groups = {len(g) for g in re.split("[ -]", token)}
        shape = 1 if len(groups) == 1 and digits >= 12 else 0
        mixing = -1 if len(set(token)) <= 3 else 0
    cue = 1 if any(c in before for c in _CUES[kind]) else 0
    assigned = 1 if before.rstrip(" \"'")[-1:] in ("=", ":") and before else -1
    address = -1 if _URL.search(before) else 0
    isolated = 1 if (not before or before[-1] in " \"'=:\n(") and (not after or after in " \"'.,;\n)") else -1
    return shape, mixing, cue, assigned, address, isolated


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """What the span classifier sees: shape and surroundings, without the votes."""
    token, before, after = text[start:end], text[max(0, start - 16) : start], text[end : end + 1]
    n = max(1, len(token))
    counts = np.unique(np.frombuffer(token.encode() or b"\0", np.uint8), return_counts=True)[1]
    p = counts / counts.sum()
    word = re.sub("[^a-z]", "", before.lower())[-8:]
    slot = [0.0] * 16
    slot[sum(map(ord, word)) % 16] = 1.0
    return [
        1.0, float(kind == "account"), math.log(n), sum(c.isdigit() for c in token) / n, sum(c.isupper() for c in token) / n, sum(c in "abcdef" for c in token) / n, float(-(p * np.log(p)).sum()),
        float("=" in before[-3:]), float(":" in before[-3:]), float(before[-1:] in ("'", '"')), float(after in ("'", '"')), float(before[-1:] in (" ", "\n", "")), float("/" in before), float(any(c in before.lower() for c in _CUES[kind])), *slot,
    ]


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, found array<struct<kind:int,s:int,e:int,pattern:int,x:array<float>>>"
_FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("pattern", pa.int32()), ("x", pa.list_(pa.float32()))]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[] for _ in BASE_KINDS]
        base, found = [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            for c, k in zip(counts, BASE_KINDS, strict=True):
                c.append(len(spans[k]))
            base.append(",".join(f"{k}:{s}:{e}" for k in BASE_KINDS for s, e in spans[k]))
            more = []
            for kind, s, e in candidates(text, spans):
                pattern = 0
                for v in votes(kind, text, s, e):
                    pattern = pattern * 3 + v + 1
                more.append({"kind": MORE_KINDS.index(kind), "s": s, "e": e, "pattern": pattern, "x": features(kind, text, s, e)})
            found.append(more)
        yield pa.record_batch(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(found, _FOUND)],
            names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base", "found"],
        )


def unpack(pattern: int) -> list[int]:
    out = []
    for _ in LABELERS:
        out.append(pattern % 3 - 1)
        pattern //= 3
    return out[::-1]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM for two classes. ``patterns``: votes by row. Returns each pattern's chance to be personal, and P(vote | class)."""
    post = 1 / (1 + np.exp(-1.5 * patterns.sum(axis=1)))
    table = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        for c, w in enumerate((counts * (1 - post), counts * post)):
            for v in range(3):
                table[c, :, v] = ((patterns == v - 1) * w[:, None]).sum(axis=0) + 0.5
            table[c] /= table[c].sum(axis=1, keepdims=True)
        prior = np.clip((counts * post).sum() / counts.sum(), 0.02, 0.98)
        logs = np.log(table[:, np.arange(patterns.shape[1]), patterns + 1]).sum(axis=2)
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - prior) / prior), -50, 50)))
    return post, table


def fit_spans(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.5, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression on soft labels; returns mean, scale and weights."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[0], scale[0] = 0, 1
    z = (x - mean) / scale
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= rate * (z.T @ (p - y) / len(y) + l2 * w)
    return mean, scale, w


def _finish(batches: Iterator[pa.RecordBatch], model: tuple[np.ndarray, np.ndarray, np.ndarray] | None, cut: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for base, found in zip(batch.column("base").to_pylist(), batch.column("found").to_pylist(), strict=True):
            kept = []
            if found and model:
                mean, scale, w = model
                score = ((np.array([f["x"] for f in found], float) - mean) / scale) @ w
                kept = sorted((f["kind"], f["s"], f["e"]) for f, s in zip(found, score, strict=True) if s >= math.log(cut / (1 - cut)))
            spans.append(",".join([*([base] if base else []), *(f"{MORE_KINDS[k]}:{s}:{e}" for k, s, e in kept)]))
        yield pa.record_batch(
            [*(batch.column(c) for c in ("doc_id", *(f"n_{k}" for k in BASE_KINDS), "base")), pa.array(spans, pa.string())],
            names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base", "spans"]
        )


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_candidates: int = FIT_CANDIDATES, cut: float = 0.5
) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base, spans``; span lists are ``kind:start:end`` joined by commas."""
    scanned = stage(id_text(docs, id_col, text_col).mapInArrow(_scan, _SCHEMA), "pii")
    one = scanned.select("doc_id", F.explode("found").alias("c"))
    counted = one.groupBy("c.kind", "c.pattern").count().collect()  # at most one row for each kind and pattern of votes
    model = None
    if counted:
        post = {}
        for kind in range(len(MORE_KINDS)):
            rows = [r for r in counted if r.kind == kind]
            if rows:
                got, _ = estimate(np.array([unpack(r.pattern) for r in rows]), np.array([float(r["count"]) for r in rows]))
                post |= {(kind, r.pattern): p for r, p in zip(rows, got, strict=True)}
        sample = one.orderBy(F.xxhash64("doc_id", "c.s", "c.kind"), "doc_id", "c.s").limit(fit_candidates).select("c.kind", "c.pattern", "c.x").collect()
        model = fit_spans(np.array([r.x for r in sample], float), np.array([post[r.kind, r.pattern] for r in sample]))
    out = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
    return scanned.mapInArrow(lambda it: _finish(it, model, cut), out)

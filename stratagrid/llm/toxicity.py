"""Toxicity by a convolutional text classifier in numpy.

A word's embedding is the sum of three rows of one hashed table: those of the word and of its first four and
five bytes, so inflected forms share what they have in common. Filters of widths 1, 2 and 3 run
over the words, each filter's greatest answer is kept, and a linear layer scores them. The table's first
column starts at how much more often a slot occurs in toxic documents of the training
sample; everything is then trained together by Adagrad.

Scores are calibrated by language: the language is guessed from the function words of the text itself, and
on held-back training documents each language gets the threshold of best F1, to which the calibrated
score ``cut`` corresponds.

Defined results: a null or empty text is scored as one of padding alone; a very long text is read whole, one text
at a time; repeated rows give repeated results; without any label to learn from every score is 0; an empty table gives no rows;
other columns are ignored. The model is fitted on at most ``FIT_DOCUMENTS`` documents and ``FIT_BYTES`` bytes of table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from stratagrid.llm.common import ALNUM, Words, chunks, id_text
from stratagrid.llm.quality import bounded_rows, labelled_sample

#: Labelled documents the model is fitted on, those of the least hash.
FIT_DOCUMENTS = 8_000

#: Bytes of their words' table rows that are brought together for the fit.
FIT_BYTES = 64 << 20
SLOTS = 1 << 16
#: Rows of words that go through the network at a time.
ROWS = 1 << 19
WIDTHS = (1, 2, 3)
_PAD = 3

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is was for with that this on are by be at or it from an as",
    "de": "der die das und den von zu mit ist im für auf nicht ein eine sich des dem sie es",
    "fr": "le la les des et du une dans pour que qui sur par au pas est plus ne ce il elle",
    "es": "el los las del y por con para una su al como más lo se no un está pero ha",
}


def _word_hashes(words: str) -> np.ndarray:
    return Words([words.encode()], ALNUM).hash


_KNOWN = np.concatenate([_word_hashes(w) for w in FUNCTION_WORDS.values()])
_KNOWN_OF = np.repeat(np.arange(len(FUNCTION_WORDS)), [len(w.split()) for w in FUNCTION_WORDS.values()])
_ORDER = np.argsort(_KNOWN, kind="stable")
_KNOWN, _KNOWN_OF = _KNOWN[_ORDER], _KNOWN_OF[_ORDER]


def guess_language(words: Words) -> np.ndarray:
    """Index into ``FUNCTION_WORDS`` of each text, or its length where no function word stands."""
    i = np.minimum(np.searchsorted(_KNOWN, words.hash), len(_KNOWN) - 1)
    hit = _KNOWN[i] == words.hash
    n = len(words.count)
    votes = np.bincount(words.doc[hit] * len(FUNCTION_WORDS) + _KNOWN_OF[i[hit]], minlength=n * len(FUNCTION_WORDS)).reshape(n, -1)
    return np.where(votes.any(axis=1), votes.argmax(axis=1), len(FUNCTION_WORDS))


def slots(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words, three each, with padding rows (0) after each text; and each text's first row."""
    first = words.first[:-1] + _PAD * np.arange(len(words.count))
    ids = np.zeros((len(words.hash) + _PAD * len(words.count), 3), np.int32)
    at = np.arange(len(words.hash)) + _PAD * words.doc
    for j, h in enumerate((words.hash, words.prefix(4) + np.uint64(1), words.prefix(5) + np.uint64(2))):
        ids[at, j] = (h % np.uint64(SLOTS - 1)).astype(np.int32) + 1
    return ids, first


@dataclass
class ConvModel:
    p: dict[str, np.ndarray]
    shift: np.ndarray
    cut: float

    def raw(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Logits. Texts of many rows are pooled part by part: a part is the windows that begin in it."""
        if len(ids) <= ROWS:
            return _forward(self.p, ids, first)["logit"]
        out = np.empty(len(first), self.p["c"].dtype)
        for k, (a, b) in enumerate(zip(first, [*first[1:], len(ids)], strict=True)):
            best = None
            for low in range(a, b - 2, ROWS):
                part = _forward(self.p, ids[low : min(low + ROWS, b - 2) + 2], np.zeros(1, np.int64))["pre"]
                best = part if best is None else np.maximum(best, part)
            out[k] = (np.maximum(best, 0) @ self.p["o"] + self.p["c"])[0]
        return out

    def __call__(self, words: Words) -> np.ndarray:
        logit = self.raw(*slots(words)) - self.shift[guess_language(words)] + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _forward(p: dict[str, np.ndarray], ids: np.ndarray, first: np.ndarray) -> dict:
    e = p["emb"][ids[:, 0]] + p["emb"][ids[:, 1]] + p["emb"][ids[:, 2]]
    n, d = e.shape
    out, last = {"e": e}, np.concatenate([first[1:], [n]])
    pooled = []
    for w in WIDTHS:
        c = e @ p[f"w{w}"][:d]
        for j in range(1, w):
            c[: n - j] += e[j:] @ p[f"w{w}"][j * d : (j + 1) * d]
        c[last - 1] = c[last - 2] = -np.inf  # these windows would reach the next text
        out[f"c{w}"] = c
        pooled.append(np.maximum.reduceat(c, first, axis=0) + p[f"b{w}"])
    out["pre"] = np.concatenate(pooled, axis=1)
    out["pool"] = np.maximum(out["pre"], 0)
    out["logit"] = out["pool"] @ p["o"] + p["c"]
    return out


def _presence(ids: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many standard errors more often each slot occurs in positive texts."""
    hit, seen = np.zeros(SLOTS), np.zeros(SLOTS)
    for a, b, label in zip(first, [*first[1:], len(ids)], y, strict=True):
        own = np.unique(ids[a:b])
        seen[own] += 1
        hit[own] += label
    rate = y.mean()
    z = (hit - seen * rate) / np.sqrt(seen * rate * (1 - rate) + 1)
    z[0] = 0
    return z


def gradients(p: dict[str, np.ndarray], ids: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Of the mean log loss of texts: by parameter, and for the table of embeddings by the rows that have one."""
    dim, filters = p["emb"].shape[1], len(p["o"]) // len(WIDTHS)
    f = _forward(p, ids, first)
    dl = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y).astype(p["emb"].dtype) / len(y)
    dpool = dl[:, None] * p["o"] * (f["pre"] > 0)
    out, rows_seen, grads = {"o": f["pool"].T @ dl, "c": dl.sum(keepdims=True)}, [], []
    for k, w in enumerate(WIDTHS):
        d, c = dpool[:, k * filters : (k + 1) * filters], f[f"c{w}"]
        top = np.stack([c[a:b].argmax(axis=0) + a for a, b in zip(first, [*first[1:], len(ids)], strict=True)])
        gw = np.zeros_like(p[f"w{w}"])
        for j in range(w):
            gw[j * dim : (j + 1) * dim] = np.einsum("bfd,bf->df", f["e"][top + j], d)
            rows_seen.append((top + j).ravel())
            grads.append((d[:, :, None] * p[f"w{w}"][j * dim : (j + 1) * dim].T[None]).reshape(-1, dim))
        out |= {f"w{w}": gw, f"b{w}": d.sum(axis=0)}
    rows, at = np.unique(ids[np.concatenate(rows_seen)].ravel(), return_inverse=True)
    total = np.zeros((len(rows), dim), p["emb"].dtype)
    np.add.at(total, at, np.repeat(np.concatenate(grads), 3, axis=0))
    total[rows == 0] = 0
    return out, rows, total


def fit(
    ids: np.ndarray, first: np.ndarray, y: np.ndarray, dim: int = 8, filters: int = 8, epochs: int = 5, batch: int = 32, rate: float = 0.05,
    seed: int = 5
) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"emb": rng.normal(0, 0.05, (SLOTS, dim)), "o": rng.normal(0, 0.1, len(WIDTHS) * filters), "c": np.array([-2.0])}
    p["emb"][:, 0] = np.clip(_presence(ids, first, y) / 10, -1, 2)
    p["emb"][0] = 0
    for w in WIDTHS:
        p[f"w{w}"], p[f"b{w}"] = rng.normal(0, 0.2, (w * dim, filters)), np.zeros(filters)
        p[f"w{w}"][0, : filters // 2] += 1
        p[f"b{w}"][: filters // 2] -= 0.5
    p["o"].reshape(len(WIDTHS), filters)[:, : filters // 2] += 0.3
    p = {k: v.astype(np.float32) for k, v in p.items()}
    g2 = {k: np.full_like(v, 1e-3) for k, v in p.items()}
    ends = np.concatenate([first[1:], [len(ids)]])

    def descend(name: str, g: np.ndarray, rows=slice(None)) -> None:
        g2[name][rows] += g * g
        p[name][rows] -= rate * g / np.sqrt(g2[name][rows])

    for _ in range(epochs):
        order = rng.permutation(len(first))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            sizes = ends[pick] - first[pick]
            begin = np.cumsum(sizes) - sizes
            own = ids[np.repeat(first[pick] - begin, sizes) + np.arange(sizes.sum())]
            g, rows, ge = gradients(p, own, begin, y[pick])
            descend("emb", ge, rows)
            for name, value in g.items():
                descend(name, value)
    return p


def best_threshold(logit: np.ndarray, y: np.ndarray, fallback: float) -> float:
    """The logit between two examples at which F1 is greatest."""
    if not len(y) or not y.any() or y.all():
        return fallback
    order = np.argsort(-logit, kind="stable")
    s, hit = logit[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    best = int(f1.argmax())
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float(s[best] - 1)


def train_on(bags: list[np.ndarray], lang: np.ndarray, y: np.ndarray, cut: float) -> ConvModel:
    """Fit on the table rows of texts; each fifth text is held back for the thresholds.

    A language's threshold is drawn to that of all held-back texts, as if it had 20 toxic texts more. Where no toxic text
    is held back the model's own even odds stand for the threshold.
    """
    back = np.arange(len(y)) % 5 == 4

    def part(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [b for b, m in zip(bags, mask, strict=True) if m]
        sizes = np.array([len(b) for b in own])
        return np.concatenate(own), np.cumsum(sizes) - sizes

    model = ConvModel(fit(*part(~back), y[~back].astype(np.float32)), np.zeros(len(FUNCTION_WORDS) + 1), cut)
    if not y[back].any():
        return model
    truth, lang, logit = y[back], lang[back], model.raw(*part(back))
    overall = best_threshold(logit, truth, 0.0)
    for k in range(len(FUNCTION_WORDS) + 1):
        own = lang == k
        n = int(truth[own].sum())
        model.shift[k] = (n * best_threshold(logit[own], truth[own], overall) + 20 * overall) / (n + 20)
    return model


def _sample_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        words = Words(texts, ALNUM)
        ids, first = slots(words)
        raw = [ids[a:b].astype("<u2").tobytes() for a, b in zip(first, [*first[1:], len(ids)], strict=True)]
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("y"), pa.array(guess_language(words).astype(np.int32)), pa.array(raw, pa.binary())],
            names=["doc_id", "y", "lang", "ids"]
        )


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    limit: int = FIT_DOCUMENTS, cut: float = 0.3
) -> ConvModel | None:
    """Fit on at most ``limit`` documents for which ``usable`` (over ``labels``) holds."""
    sample = labelled_sample(id_text(docs, id_col, text_col), labels, label, usable, limit)
    rows = bounded_rows(sample.mapInArrow(_sample_slots, "doc_id long, y int, lang int, ids binary"), "ids", FIT_BYTES)
    if not rows:
        return None
    return train_on(
        [np.frombuffer(r.ids, "<u2").reshape(-1, 3) for r in rows], np.array([r.lang for r in rows]), np.array([r.y for r in rows], float), cut
    )


def _score(batches: Iterator[pa.RecordBatch], model: ConvModel | None) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        y = model(Words(texts, ALNUM)).astype(np.float64) if model else np.zeros(len(texts))
        yield pa.record_batch([batch.column("doc_id"), pa.array(y)], names=["doc_id", "score"])


def score(docs: DataFrame, model: ConvModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row. The model (a few MB of fixed size) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return id_text(docs, id_col, text_col).mapInArrow(lambda it: _score(it, shared.value), "doc_id long, score double")

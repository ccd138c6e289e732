"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded by a small network over
counts of byte classes and of their neighbours, and over word statistics; gated attention
(a tanh gate times a sigmoid gate) weighs the passages, and the weighted sum is
scored. Encoder, gates and scorer are trained together in numpy from document labels alone.

Defined results: a null or empty text is one passage without bytes and gets the model's score for it; a very long
text has as many passages as it takes, one text at a time; documents without labels are scored like all others, repeated rows alike;
without any label to learn from every score is 0.5; an empty table gives no rows; other columns are ignored. The model is
fitted on at most ``FIT_DOCUMENTS`` documents and ``FIT_BYTES`` bytes of features; all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratagrid.llm.common import BLOCK_BYTES, SPACED, Words, chunks, discard, id_text, stage

PASSAGE = 512

#: Labelled documents the model is fitted on, those of the least hash.
FIT_DOCUMENTS = 6_000

#: Bytes of their features that are brought together for the fit.
FIT_BYTES = 64 << 20

_CLASSES = 16


def _byte_classes() -> np.ndarray:
    t = np.full(256, 12, np.uint8)
    t[:32] = 15
    t[128:192], t[192:] = 14, 13
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1] = 3, 4, 5
    for group, c in ((" ", 0), ("\n\r\t", 1), ("aeiou", 2), (".", 6), (",", 7), ("!?", 8), ("#", 9), ("$%&*", 10), ("|", 11)):
        t[[ord(x) for x in group]] = c
    return t


_TABLE = _byte_classes()
N_FEATURES = _CLASSES * _CLASSES + 8


def passage_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features by passage, and the number of passages of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(1, -(-lengths // PASSAGE))
    first = np.cumsum(counts) - counts
    total = int(counts.sum())
    buf = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(lengths) - lengths
    x = np.zeros((total, N_FEATURES), np.float32)
    for low in range(0, len(buf) - 1, BLOCK_BYTES):
        at = np.arange(low, min(low + BLOCK_BYTES + 1, len(buf)))
        doc = np.searchsorted(begin, at, "right") - 1
        piece = first[doc] + (at - begin[doc]) // PASSAGE
        same = piece[1:] == piece[:-1]
        c, base = _TABLE[buf[low : low + len(at)]].astype(np.int64), piece[0]
        pairs = (piece[:-1][same] - base) * _CLASSES**2 + c[:-1][same] * _CLASSES + c[1:][same]
        seen = piece[-1] - base + 1
        x[base : base + seen, : _CLASSES**2] += np.bincount(pairs, minlength=seen * _CLASSES**2).reshape(seen, -1)
    np.sqrt(x[:, : _CLASSES**2] / PASSAGE, out=x[:, : _CLASSES**2])
    words = Words(texts, SPACED)
    if len(words.hash):
        at = first[words.doc] + (words.start - words.text_start[words.doc]) // PASSAGE
        size = (words.end - words.start).astype(np.float64)
        n = np.maximum(1, np.bincount(at, minlength=total))
        order = np.lexsort((words.hash, at))
        a, h = at[order], words.hash[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (h[1:] != h[:-1])])
        again = np.zeros(len(at))
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (at[1:] == at[:-1])
        own = np.lexsort((words.hash, words.doc))
        d, g = words.doc[own], words.hash[own]
        fresh = np.concatenate([[True], (d[1:] != d[:-1]) | (g[1:] != g[:-1])])
        varied = np.bincount(d[fresh], minlength=len(texts)) / np.maximum(1, words.count)
        k = _CLASSES * _CLASSES
        x[:, k] = np.bincount(at, size, total) / n / 10
        x[:, k + 1] = np.sqrt(np.maximum(0, np.bincount(at, size * size, total) / n - (np.bincount(at, size, total) / n) ** 2)) / 10
        x[:, k + 2] = np.bincount(a[new], minlength=total) / n
        x[:, k + 3] = np.bincount(at, again, total) / n
        x[:, k + 4] = np.repeat(varied, counts)
        x[:, k + 5] = np.repeat(np.log1p(words.count) / 10, counts)
        x[:, k + 6] = n / 100
    x[:, -1] = np.repeat(lengths == 0, counts)
    return x, counts


@dataclass
class AttentionModel:
    """Parameters by name; ``mean`` and ``scale`` standardise the features."""

    p: dict[str, np.ndarray]

    def __call__(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _forward(self.p, (x - self.p["mean"]) / self.p["scale"], counts)["y"]

    def attention(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _forward(self.p, (x - self.p["mean"]) / self.p["scale"], counts)["a"]


def _forward(p: dict[str, np.ndarray], z: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    at = np.cumsum(counts) - counts
    h = np.tanh(z @ p["w"] + p["b"])
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = (t * s) @ p["q"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
    a = e / np.repeat(np.add.reduceat(e, at), counts)
    bag = np.add.reduceat(a[:, None] * h, at)
    y = 1 / (1 + np.exp(-np.clip(bag @ p["o"] + p["c"], -30, 30)))
    return {"h": h, "t": t, "s": s, "a": a, "bag": bag, "y": y}


def gradients(p: dict[str, np.ndarray], z: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss of documents, by parameter."""
    at = np.cumsum(counts) - counts
    f = _forward(p, z, counts)
    dy = (f["y"] - y) / len(y)
    dbag = np.repeat(dy[:, None] * p["o"], counts, axis=0)
    da = (dbag * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at), counts))
    dts = de[:, None] * p["q"]
    dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
    dh = (f["a"][:, None] * dbag + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
    return {
        "w": z.T @ dh, "b": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "q": (f["t"] * f["s"]).T @ de, "o": f["bag"].T @ dy,
        "c": dy.sum(keepdims=True)
    }


def fit(
    x: np.ndarray, counts: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 25, rate: float = 3e-3, batch: int = 64, l2: float = 1e-4,
    seed: int = 3
) -> AttentionModel:
    """Adam on the log loss of documents."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean).astype(np.float32, copy=False)
    z /= scale
    n = x.shape[1]
    p = {
        "w": rng.normal(0, n**-0.5, (n, hidden)), "b": np.zeros(hidden), "v": rng.normal(0, 0.2, (hidden, hidden)),
        "u": rng.normal(0, 0.2, (hidden, hidden)), "q": rng.normal(0, 0.2, hidden), "o": rng.normal(0, 0.2, hidden), "c": np.zeros(1)
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, r, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    ends = np.cumsum(counts)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            pick = order[i : i + batch]
            k = counts[pick]
            rows = np.repeat(ends[pick] - k - (np.cumsum(k) - k), k) + np.arange(k.sum())
            xb = z[rows]
            g = gradients(p, xb, k, y[pick])
            step += 1
            for name in p:
                d = g[name] + l2 * p[name]
                m[name] = 0.9 * m[name] + 0.1 * d
                r[name] = 0.999 * r[name] + 0.001 * d * d
                p[name] = (p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(r[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return AttentionModel(p | {"mean": mean.astype(np.float32), "scale": scale.astype(np.float32)})


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``limit`` labelled documents: a bounded table, so its ids may be broadcast.

    Of rows that share an id one counts, the one with the least hash of its text; of several labels of an id the greatest.
    """
    picked = labels.filter(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")
    return docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(one).select("doc_id", F.col("one.text").alias("text"), "y")


def bounded_rows(features: DataFrame, column: str, most: int) -> list:
    """Rows of a sample, in the order of the hashes of their ids, as far as ``column`` stays within ``most`` bytes in all."""
    held = stage(features, "sample")
    sizes = sorted(held.select(F.xxhash64("doc_id").alias("o"), "doc_id", F.length(column).alias("n")).collect())
    total = np.cumsum([r.n for r in sizes]) if sizes else np.zeros(0)
    kept = held
    if len(sizes) and total[-1] > most:
        last, o = sizes[max(0, int(np.searchsorted(total, most, "right")) - 1)], F.xxhash64("doc_id")
        kept = held.filter((o < last.o) | ((o == last.o) & (F.col("doc_id") <= last.doc_id)))
    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    discard(held)
    return rows


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        x, counts = passage_features(texts)
        stops = np.cumsum(counts)
        raw = [x[b - k : b].astype(np.float16).tobytes() for k, b in zip(counts, stops, strict=True)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(raw, pa.binary())], names=["doc_id", "y", "x"])


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    limit: int = FIT_DOCUMENTS
) -> AttentionModel | None:
    """Fit on at most ``limit`` documents for which ``usable`` (over ``labels``) holds."""
    sample = labelled_sample(id_text(docs, id_col, text_col), labels, label, usable, limit)
    rows = bounded_rows(sample.mapInArrow(_sample_features, "doc_id long, y int, x binary"), "x", FIT_BYTES)
    if not rows:
        return None
    bags = [np.frombuffer(r.x, np.float16).reshape(-1, N_FEATURES) for r in rows]
    x, counts, y = np.concatenate(bags, dtype=np.float32), np.array([len(b) for b in bags]), np.array([r.y for r in rows], np.float32)
    del rows, bags
    return fit(x, counts, y)


def _score(batches: Iterator[pa.RecordBatch], model: AttentionModel | None) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        y = model(*passage_features(texts)).astype(np.float64) if model else np.full(len(texts), 0.5)
        keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.record_batch([*(batch.column(i) for i in keep), pa.array(y)], names=[*(batch.schema.names[i] for i in keep), "score"])


def score(docs: DataFrame, model: AttentionModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row."""
    return id_text(docs, id_col, text_col).mapInArrow(lambda it: _score(it, model), "doc_id long, score double")


def _filter(batches: Iterator[pa.RecordBatch], model: AttentionModel | None, text_col: str, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.record_batch([batch.column(text_col).cast(pa.string()).fill_null("")], names=["text"])
        kept = np.concatenate([
            model(*passage_features(t)) if model else np.full(len(t), 0.5) for _, t in chunks(iter([texts]))
        ] or [np.zeros(0)]) >= least
        yield batch.filter(pa.array(kept, pa.bool_()))


def keep_good(docs: DataFrame, model: AttentionModel | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, whole and unshuffled."""
    return docs.mapInArrow(lambda it: _filter(it, model, text_col, least), T.StructType(docs.schema.fields))

"""Shared pieces: batching of texts and word hashing.

Hashes here are 64-bit. Every place that joins on them accepts the chance of
a false match of about n * m / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.staging import discard, shared_dir, stage  # noqa: F401

#: Texts are handled in groups of about this many bytes, which bounds a worker's memory.
CHUNK_BYTES = 1 << 19

#: What tasks of one kind leave for the next in a reused Python worker; tasks of another kind give it back.
WORKER_CACHE: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; a null text becomes empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the incoming batches with their ``text`` column as bytes, each of about ``limit`` bytes."""
    WORKER_CACHE.clear()
    for batch in batches:
        text = batch.column("text").cast(pa.binary())
        total = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(total, (total[start - 1] if start else 0) + limit)) + 1
            yield batch.slice(start, stop - start), text.slice(start, stop - start).to_pylist()
            start = min(stop, batch.num_rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix construction)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream64(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words parted by white space: ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of lower-cased words of letters and digits: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BYTE = stream64(256, 7)
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_MULT = stream64(64, 11) | np.uint64(1)

#: Bytes that are hashed, or otherwise held as wide numbers, at a time.
BLOCK_BYTES = 1 << 20


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse; tables for unusually long words are not kept."""
    if len(_powers[0]) >= n:
        return _powers
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    if n <= 4 * BLOCK_BYTES:
        _powers[:] = out
    return out


class Words:
    """Words of several texts laid end to end.

    ``hash``: one 64-bit hash per word; ``doc``: index of its text; ``first``: index of each
    text's first word (one entry more than texts); ``start``/``end``: byte offsets in ``buf``. Besides the words' own
    numbers a text takes a few bytes of memory for each of its bytes, however long it is.
    """

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        buf = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        inside = is_word[buf]
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edges = np.concatenate([[0], turns]) if inside[0] else turns
        self.buf, self.start, self.end = buf, edges[0::2], edges[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        self.text_start = bounds[:-1]
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.hash = self._span(self.end)

    def _span(self, stop: np.ndarray) -> np.ndarray:
        """Hash of each word up to ``stop``, by differences of running sums over a block of words."""
        out, i, n = np.empty(len(stop), np.uint64), 0, len(stop)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.start, self.start[i] + BLOCK_BYTES)))
            low = self.start[i]
            own = self.buf[low : self.end[j - 1]]
            up, down = _power_tables(len(own))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[own] * up[: len(own)])])
            a, b = self.start[i:j] - low, stop[i:j] - low
            out[i:j] = mix64((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
            i = j
        return out

    def prefix(self, n: int) -> np.ndarray:
        """Hash of each word's first ``n`` bytes."""
        return self._span(np.minimum(self.start + n, self.end))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words that begin at each word; only where ``whole(k)`` holds is it meaningful."""
        n = len(self.hash)
        out = np.zeros(n, np.uint64)
        for j in range(min(k, n)):
            out[: n - j] += self.hash[j:] * _MULT[j]
        return mix64(out + np.uint64(k))

    def whole(self, k: int) -> np.ndarray:
        """Whether the ``k`` words from each word on lie in one text."""
        n = len(self.doc)
        ok = np.zeros(n, bool)
        if n >= k:
            ok[: n - k + 1] = self.doc[: n - k + 1] == self.doc[k - 1 :]
        return ok

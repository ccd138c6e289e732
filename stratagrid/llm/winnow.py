"""Benchmark decontamination by winnowing.

A text is a sequence of lower-cased words. Of every ``w = window - k + 1`` consecutive
``k``-word grams the ones with the least hash are kept as fingerprints, so any span of
``window`` words that a document shares with an item keeps the same fingerprint on both
sides: no shared span of that length is missed. Documents whose fingerprints pass a filter
of fixed size are extended to the whole windows around the hit, and these windows are
joined with the items' windows by equality.

Defined results: a null or wordless text has no words and no hits; an item of fewer words
than ``window`` is one window; every row has its own result, also rows that share an id or have none;
items that share an id count once; without items nothing is hit; an empty table gives no rows; other columns are ignored.
Very long texts are read whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.llm.common import ALNUM, Words, chunks, id_text, stage

#: Least and most bits of the filter that is broadcast; between them it grows with the items' texts.
FILTER_BITS = (1 << 20, 1 << 28)

_CANDIDATES = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("len", pa.int32())])))]
)


def fingerprints(words: Words, k: int, window: int) -> np.ndarray:
    """Indices of the words at which a kept ``k``-gram begins. All ties for the least are kept."""
    w = window - k + 1
    n = len(words.hash)
    grams = np.where(words.whole(k), words.grams(k), np.uint64(0xFFFFFFFFFFFFFFFF))
    least = grams.copy()
    for j in range(1, min(w, n)):
        np.minimum(least[: n - j], grams[j:], out=least[: n - j])
    reach = least.copy()
    for j in range(1, min(w, n)):
        np.maximum(reach[j:], least[: n - j], out=reach[j:])
    return np.flatnonzero((reach == grams) & words.whole(k))


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _add(filter_: np.ndarray, h: np.ndarray) -> None:
    for s in _slots(h, len(filter_) * 8):
        np.bitwise_or.at(filter_, s >> 3, (1 << (s & 7)).astype(np.uint8))


def _passes(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for s in _slots(h, len(filter_) * 8):
        out &= (filter_[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
    return out


def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        words = Words(texts, ALNUM)
        at = np.flatnonzero(words.whole(window))
        h, doc, size = words.grams(window)[at], words.doc[at], np.full(len(at), window)
        for m in range(1, window):
            short = words.first[:-1][words.count == m]
            h = np.concatenate([h, words.grams(m)[short]])
            doc, size = np.concatenate([doc, words.doc[short]]), np.concatenate([size, np.full(len(short), m)])
        ids = batch.column("doc_id").take(pa.array(doc))
        yield pa.record_batch([ids, pa.array(h.view(np.int64)), pa.array(size.astype(np.int32))], names=["item_id", "h", "len"])


def _item_filters(batches: Iterator[pa.RecordBatch], k: int, window: int, bits: int) -> Iterator[pa.RecordBatch]:
    """One filter of fixed size for each task, with a bit mask of the lengths of short items."""
    filter_, lengths = np.zeros(bits // 8, np.uint8), 0
    for _, texts in chunks(batches):
        words = Words(texts, ALNUM)
        _add(filter_, words.grams(k)[fingerprints(words, k, window)])
        for m in range(1, window):
            short = words.first[:-1][words.count == m]
            if len(short):
                lengths |= 1 << m
                _add(filter_, words.grams(m)[short])
    if filter_.any():
        yield pa.record_batch([pa.array([filter_.tobytes()]), pa.array([lengths], pa.int32())], names=["f", "lengths"])


def _document_windows(batches: Iterator[pa.RecordBatch], filter_: np.ndarray, lengths: int, k: int, window: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        words = Words(texts, ALNUM)
        n = len(words.hash)
        near = np.zeros(n + 1, np.int64)
        found = fingerprints(words, k, window)
        found = found[_passes(filter_, words.grams(k)[found])]
        np.add.at(near, np.maximum(found - (window - k), 0), 1)
        np.add.at(near, found + 1, -1)
        at = np.flatnonzero((np.cumsum(near[:n]) > 0) & words.whole(window))
        h, size = words.grams(window)[at], np.full(len(at), window, np.int32)
        for m in range(1, window):
            if lengths >> m & 1:
                ok = np.flatnonzero(words.whole(m))
                g = words.grams(m)[ok]
                hit = _passes(filter_, g)
                at, h, size = np.concatenate([at, ok[hit]]), np.concatenate([h, g[hit]]), np.concatenate([size, np.full(hit.sum(), m, np.int32)])
        doc = words.doc[at]
        order = np.argsort(doc, kind="stable")
        at, h, size, doc = at[order], h[order], size[order], doc[order]
        rel = (at - words.first[doc]).astype(np.int32)
        offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
        hits = pa.StructArray.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(rel), pa.array(size)], fields=list(_CANDIDATES.field("hits").type.value_type)
        )
        yield pa.record_batch([batch.column("doc_id"), pa.array(words.count), pa.ListArray.from_arrays(pa.array(offsets), hits)], schema=_CANDIDATES)


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", window: int = 10, k: int = 5, filter_bits: tuple[int, int] = FILTER_BITS
) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` (sorted array of ids as strings) for every row of ``docs``.

    What is broadcast is one filter of about four bits for each byte of the items, but never more than the larger of
    ``filter_bits``; a fuller filter lets more windows into the join and changes no result.
    """
    spark: SparkSession = docs.sparkSession
    tests = id_text(items, item_col, text_col)
    wanted = 1 << (4 * (tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0)).bit_length()
    bits = min(max(wanted, filter_bits[0]), filter_bits[1])
    windows = tests.mapInArrow(lambda it: _item_windows(it, window), "item_id long, h long, len int")
    filter_, lengths = np.zeros(bits // 8, np.uint8), 0
    parts = tests.coalesce(16).mapInArrow(lambda it: _item_filters(it, k, window, bits), "f binary, lengths int")
    for row in parts.toLocalIterator():
        filter_ |= np.frombuffer(row.f, np.uint8)
        lengths |= row.lengths
    shared = spark.sparkContext.broadcast(filter_)
    own = id_text(docs, id_col, text_col)
    read = stage(
        own.mapInArrow(
            lambda it: _document_windows(it, shared.value, lengths, k, window),
            "doc_id long, n_words long, hits array<struct<h:long,at:int,len:int>>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "winnow",
    )
    rows = read.select("row", "doc_id", "n_words")
    hits = read.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("x")).select("row", "x.h", "x.len", "x.at").distinct()
    known = windows.distinct()
    met = hits.join(known.select("h", "len").distinct(), ["h", "len"], "left_semi")
    covered = met.groupBy("row").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("len") - 1))))).cast("long").alias("n_hit")
    )
    named = (
        hits.select("row", "h", "len").distinct().join(known, ["h", "len"]).groupBy("row")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    found = covered.join(named, "row")
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )

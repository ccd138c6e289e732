"""Exact long repeats across documents with a run-length Burrows-Wheeler index.

A byte is removed when a string of ``width`` bytes that covers it also starts earlier in the corpus.

Parse. A window is a string of ``width`` bytes; its trigger is the ``GRAM``-gram in it with the least hash, the
leftmost of equals. Neighbouring windows with the same trigger form a phrase. Equal windows have the
same trigger, so they lie in phrases with one trigger. As in prefix-free parsing the index is built of a dictionary
of different phrases: equal phrases are settled by their hash, all but the first are removed whole, and
in a task equal phrases are reduced to their first before anything is shuffled. Only triggers with several
different phrases can hold more repeats.

Index. The different phrases of such triggers are laid end to end in corpus order, shard by shard, and
suffix-sorted; of the Burrows-Wheeler transform only runs are kept, with a text position and a length of agreement sampled at
run ends. Every phrase then streams backwards through the runs by LF steps, which yields its matching
statistics against the row above: from step to step one character more within a run, the sample at a run's end. Rows
whose match is at least ``width`` long, with the row above the first of them, are the places of one window, and all
but the earliest are marked.

A trigger with more than ``HOT`` different phrases would not fit a shard: its windows are spread by
their own hashes and joined with their first place, combined before the shuffle. This is the exact way for what
the bound on a shard keeps out; README says which share of bytes goes it.

Defined results: texts are UTF-8 bytes, null is empty; matches stay within a document; shorter texts
lose nothing. Rows are documents in the order of ``doc_id`` (null first), then text, so of repeated rows
all but the first are removed, if they are long enough. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import CHUNK_BYTES, id_text, mix64, stage, stream64
from stratagrid.llm.common import _power_tables as powers
from stratagrid.operators.ordering import running

WIDTH = 100
GRAM = 40

#: Different phrases of one trigger above which it is spread by windows.
HOT = 4_000

#: Bytes of phrases that one index holds.
SHARD_BYTES = 1 << 20

#: Phrases that a task gathers before it hands them on.
FLUSH = 1 << 20

_BITS = np.uint64(21)
_BYTE = stream64(256, 77)


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Keys, offsets and bytes of texts or, of long ones, of pieces that overlap by ``width - 1``; about ``CHUNK_BYTES`` at a time."""
    keys, offsets, texts, size = [], [], [], 0
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            for at in range(0, max(1, len(text) - width + 1), CHUNK_BYTES - width):
                part = text[at : at + CHUNK_BYTES - 1]
                if len(part) < width:
                    continue
                keys.append(key)
                offsets.append(at)
                texts.append(part)
                size += len(part)
                if size >= CHUNK_BYTES:
                    yield np.array(keys, np.int64), np.array(offsets, np.int64), texts
                    keys, offsets, texts, size = [], [], [], 0
    if texts:
        yield np.array(keys, np.int64), np.array(offsets, np.int64), texts


def _prefix_hash(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(buf) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[: len(buf)])]), down


def parse(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Phrases of texts: ``text`` index, first window ``start`` in its text, number ``n`` of windows, ``trigger`` and ``phrase`` hashes."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    total, down = _prefix_hash(buf)
    n = len(buf)
    g = mix64((total[gram:] - total[: n + 1 - gram]) * down[: n + 1 - gram])
    least = (g >> _BITS << _BITS) | np.arange(len(g), dtype=np.uint64)
    reach, w = 1, width - gram + 1
    while reach < w:
        step = min(reach, w - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + width <= (begin + sizes)[text])
    trigger = (least[at] & np.uint64((1 << int(_BITS)) - 1)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(at)]]))
    start = at[first]
    phrase = mix64((total[start + count + width - 1] - total[start]) * down[start] + count.astype(np.uint64))
    return {"text": text[start], "start": start - begin[text[start]], "n": count, "trigger": g[trigger[first]], "phrase": phrase}


_PHRASE = np.dtype([("trigger", "<u8"), ("phrase", "<u8"), ("key", "<i8"), ("start", "<i8"), ("n", "<i4")])
_MARK = np.dtype([("key", "<i8"), ("start", "<i8"), ("n", "<i4")])


def _first_of_each(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rows, and which of them are the first of their phrase."""
    rows = rows[np.lexsort((rows["start"], rows["key"], rows["phrase"], rows["trigger"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["trigger"][1:] != rows["trigger"][:-1]) | (rows["phrase"][1:] != rows["phrase"][:-1])
    return rows, new


def _scan(batches: Iterator[pa.RecordBatch], width: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Phrases by bucket of their trigger, as packed arrays; repeats found in the task as marks, by bucket of their document."""
    held: list[np.ndarray] = []
    size = 0

    def close() -> pa.RecordBatch:
        rows, new = _first_of_each(np.concatenate(held))
        out = []
        for kind, part, bucket in (
            (0, rows[new], rows["trigger"][new] % np.uint64(buckets)),
            (1, _marks(rows[~new]), mix64(rows["key"][~new].astype(np.uint64)) % np.uint64(buckets))
        ):
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(buckets)))
            out += [(int(bucket[order[a]]), kind, part[order[a:b]].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
        b, k, raw = zip(*out, strict=True)
        return pa.record_batch([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(raw, pa.binary())], names=["bucket", "kind", "rows"])

    for keys, offsets, texts in _pieces(batches, width):
        p = parse(texts, width, gram)
        rows = np.empty(len(p["n"]), _PHRASE)
        rows["trigger"], rows["phrase"], rows["n"] = p["trigger"], p["phrase"], p["n"]
        rows["key"], rows["start"] = keys[p["text"]], p["start"] + offsets[p["text"]]
        held.append(rows)
        size += len(rows)
        if size >= FLUSH:
            yield close()
            held, size = [], 0
    if size:
        yield close()


def _marks(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), _MARK)
    for c in _MARK.names:
        out[c] = rows[c]
    return out


_FOUND = "key long, start long, n int, trigger long, hot boolean"


def _found(marks: np.ndarray, trigger: np.ndarray | None = None, hot: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(marks)
    return pa.record_batch(
        [
            pa.array(marks["key"]), pa.array(marks["start"]), pa.array(marks["n"]),
            pa.array(trigger.view(np.int64)) if trigger is not None else pa.nulls(n, pa.int64()), pa.array(hot) if hot is not None else pa.nulls(n, pa.bool_()),
        ],
        names=["key", "start", "n", "trigger", "hot"],
    )


def _settle(batches: Iterator[pa.RecordBatch], hot: int, most: int = FLUSH) -> Iterator[pa.RecordBatch]:
    """Marks (no trigger) of repeated phrases, and the phrases (with trigger) that an index must compare. Rows come sorted by bucket.

    Beyond ``most`` rows of a bucket the repeated ones among them are settled and triggers already known to have more than
    ``hot`` phrases are handed on as they come, so what is held is never more than a few phrases of many triggers.
    """
    held: list[np.ndarray] = []
    size, limit, last = 0, most, None
    burst = np.empty(0, np.uint64)

    def firsts_of() -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        rows, new = _first_of_each(np.concatenate(held))
        firsts = rows[new]
        _, inv, count = np.unique(firsts["trigger"], return_inverse=True, return_counts=True)
        return _found(_marks(rows[~new])), firsts, count[inv]

    def close() -> Iterator[pa.RecordBatch]:
        marks, firsts, count = firsts_of()
        yield marks
        several = count > 1
        yield _found(_marks(firsts[several]), firsts["trigger"][several].copy(), count[several] > hot)

    def as_hot(rows: np.ndarray) -> pa.RecordBatch:
        return _found(_marks(rows), rows["trigger"].copy(), np.ones(len(rows), bool))

    for batch in batches:
        for bucket, kind, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "rows")), strict=True):
            if kind:
                yield _found(np.frombuffer(raw, _MARK))
                continue
            if bucket != last:
                if held:
                    yield from close()
                held, size, limit, last, burst = [], 0, most, bucket, burst[:0]
            rows = np.frombuffer(raw, _PHRASE)
            if len(burst):
                known = np.isin(rows["trigger"], burst)
                yield as_hot(rows[known])
                rows = rows[~known]
            held.append(rows)
            size += len(rows)
            if size > limit:
                marks, firsts, count = firsts_of()
                yield marks
                yield as_hot(firsts[count > hot])
                burst = np.union1d(burst, firsts["trigger"][count > hot])
                held = [firsts[count <= hot]]
                size, limit = len(held[0]), max(most, 2 * len(held[0]))
    if held:
        yield from close()


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the asked phrases of each document."""
    for batch in batches:
        for key, text, asked in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "asked")), strict=True):
            raw = text.encode()
            rows = [(key, a["start"], a["n"], a["trigger"], a["hot"], raw[a["start"] : a["start"] + a["n"] + width - 1]) for a in asked]
            yield pa.record_batch(
                [
                    pa.array(c, t) for c,
                    t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)
                ],
                names=["key", "start", "n", "trigger", "hot", "bytes"],
            )


class RunLengthIndex:
    """Run-length Burrows-Wheeler index of strings laid end to end, each closed by an end mark of its own.

    ``run_start``, ``run_char``: runs; ``before``: equal characters in earlier runs; ``less``: smaller characters;
    ``heads``, ``ranks``: bit vector of run heads with its rank directory. Sampled at run ends: ``head_above``, the text position
    of the suffix just above the one that a run's first row leads to (it is led to by the last row of the run of this
    character before), and ``head_length``, how far the two agree.
    """

    def __init__(self, strings: list[bytes]):
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.begin = np.cumsum(self.sizes + 1) - self.sizes - 1
        n = int((self.sizes + 1).sum())
        sym = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.begin + self.sizes] = False
        sym[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        end = np.repeat(self.begin + self.sizes, self.sizes + 1)
        sa, ranks = self._sort(sym, end)
        opens = np.zeros(n, bool)
        opens[self.begin] = True
        bwt = np.where(opens[sa], 0, sym[sa - 1])
        new = np.ones(n, bool)
        new[1:] = bwt[1:] != bwt[:-1]
        self.run_start = np.flatnonzero(new)
        self.heads = np.packbits(np.concatenate([new, np.zeros(-n % 64, bool)]), bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.heads).astype(np.int64)
        self.ranks = np.cumsum(ones) - ones
        self.run_char = bwt[self.run_start]
        length = np.diff(np.concatenate([self.run_start, [n]]))
        order = np.argsort(self.run_char, kind="stable")
        cum = np.cumsum(length[order]) - length[order]
        first = np.searchsorted(self.run_char[order], np.arange(258))
        self.less = np.concatenate([cum, [n]])[np.minimum(first, len(cum))]
        self.before = np.empty(len(order), np.int64)
        self.before[order] = cum - self.less[self.run_char[order]]
        to = self.less[self.run_char] + self.before
        below, above = sa[to], sa[np.maximum(to - 1, 0)]
        self.head_above = np.where(to > 0, above, -1)
        self.head_length = np.where(to > 0, self._agreeing(sym, end, ranks, below, above), 0)

    def _run(self, row: np.ndarray) -> np.ndarray:
        """Runs of rows, by rank in the bit vector of run heads."""
        word = row >> 6
        upto = self.heads[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (row & 63)).astype(np.uint64))
        return self.ranks[word] + np.bitwise_count(upto) - 1

    def _sort(self, sym: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Suffix array by prefix doubling, with suffixes ending at their own end mark and ties by position; and the ranks by each length."""
        n = len(sym)
        at = np.arange(n)
        used = np.zeros(257, np.int64)
        used[sym] = 1
        used[0] = 1
        dense = (np.cumsum(used) - 1)[sym]
        letters = int(used.sum())
        h = max(1, int(62 / np.log2(max(2, letters))))
        key = np.zeros(n, np.int64)
        for j in range(h):
            key = key * letters + np.where(at + j <= end, dense[np.minimum(at + j, n - 1)], 0)
        rank = self._ranks(key)
        ranks = {h: rank.astype(np.int32)}
        longest = int(self.sizes.max()) + 1
        while 2 * h < longest:
            rank = self._ranks(self._pair(rank, at, end, h))
            h *= 2
            ranks[h] = rank.astype(np.int32)
        return np.argsort(self._pair(rank, at, end, h), kind="stable"), ranks

    @staticmethod
    def _agreeing(sym: np.ndarray, end: np.ndarray, ranks: dict[int, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many characters the suffixes at ``i`` and ``j`` share, end marks not counted."""
        last, most = len(sym) - 1, np.minimum(end[i] - i, end[j] - j)
        length = np.zeros(len(i), np.int64)
        for h in sorted(ranks, reverse=True):
            rank = ranks[h]
            length += np.where(rank[np.minimum(i + length, last)] == rank[np.minimum(j + length, last)], h, 0)
            length = np.minimum(length, most)
        open_ = length < most
        for _ in range(min(ranks) - 1):
            open_ &= sym[np.minimum(i + length, last)] == sym[np.minimum(j + length, last)]
            length += open_
            open_ &= length < most
        return length

    @staticmethod
    def _pair(rank: np.ndarray, at: np.ndarray, end: np.ndarray, h: int) -> np.ndarray:
        n = len(rank)
        return rank * (n + 1) + np.where(at + h <= end, rank[np.minimum(at + h, n - 1)] + 1, 0)

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.diff(sorted_, prepend=sorted_[:1]) != 0)
        return rank

    def matching_statistics(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Stream all strings backwards side by side: ``string, offset, row, length, place``.

        ``length`` characters from there on agree with the text at ``place``, that of the row above. Within a run both follow from
        the step before (one character more, one place earlier); at a run's first row they are the samples.
        """
        live = np.arange(len(self.sizes))
        row, at = live.copy(), self.sizes.copy()  # the end marks are the first rows, in order
        length, place = np.zeros(len(live), np.int64), np.concatenate([[-1], (self.begin + self.sizes)[:-1]])
        while len(live):
            run = self._run(row)
            c = self.run_char[run]
            go = c != 0
            live, at, row, length, place, run, c = (x[go] for x in (live, at - 1, row, length, place, run, c))
            head = row == self.run_start[run]
            length = np.where(head, self.head_length[run], length + 1)
            place = np.where(head, self.head_above[run], place - 1)
            row = self.less[c] + self.before[run] + row - self.run_start[run]
            yield live, at, row, length, place

    def repeated(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of strings and offsets at which ``width`` bytes begin that stand earlier too.

        Rows that agree with the row above for ``width`` characters follow each other; with the row above the first of them
        they are all places of one string of that length, and all but the least are repeats.
        """
        rows, at, above = [], [], []
        for string, offset, row, length, place in self.matching_statistics():
            far = np.flatnonzero(length >= width)
            rows.append(row[far])
            at.append((self.begin[string] + offset)[far])
            above.append(place[far])
        rows, at, above = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, at, above))
        if not len(rows):
            return rows, rows
        order = np.argsort(rows)
        rows, at, above = rows[order], at[order], above[order]
        new = np.diff(rows, prepend=-2) != 1
        first = np.flatnonzero(new)
        top = above[first]
        least = np.minimum(np.minimum.reduceat(at, first), top)
        again = np.concatenate([at[at > least[np.cumsum(new) - 1]], top[top > least]])
        string = np.searchsorted(self.begin, again, "right") - 1
        return string, again - self.begin[string]


def _index(batches: Iterator[pa.RecordBatch], width: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Marks of repeated windows. Rows come sorted by trigger; triggers are put together up to ``shard_bytes``."""
    held: list[tuple] = []
    size = 0
    last = None

    def close() -> pa.RecordBatch:
        rows = sorted(held)
        i, o = RunLengthIndex([r[2] for r in rows]).repeated(width)
        if not len(i):
            return _found(np.empty(0, _MARK))
        order = np.lexsort((o, i))
        i, o = i[order], o[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (o[1:] != o[:-1] + 1)
        first = np.flatnonzero(new)
        out = np.empty(len(first), _MARK)
        out["key"] = np.array([r[0] for r in rows], np.int64)[i[first]]
        out["start"] = np.array([r[1] for r in rows], np.int64)[i[first]] + o[first]
        out["n"] = np.diff(np.concatenate([first, [len(i)]]))
        return _found(out)

    for batch in batches:
        for trigger, *row in zip(*(batch.column(c).to_pylist() for c in ("trigger", "key", "start", "bytes")), strict=True):
            if size >= shard_bytes and trigger != last:
                yield close()
                held, size = [], 0
            last = trigger
            held.append(tuple(row))
            size += len(row[2])
    if held:
        yield close()


def _window_hashes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, start, n, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "start", "n", "bytes")), strict=True):
            total, down = _prefix_hash(np.frombuffer(raw, np.uint8))
            h = mix64((total[width : width + n] - total[:n]) * down[:n])
            second = [int.from_bytes(hashlib.blake2b(raw[i : i + width], digest_size=8).digest(), "little", signed=True) for i in range(n)]
            yield pa.record_batch(
                [pa.array(np.full(n, key)), pa.array(start + np.arange(n)), pa.array(h.view(np.int64)), pa.array(second, pa.int64())],
                names=["key", "start", "h1", "h2"]
            )


def _remove(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, marks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "marks")), strict=True):
            raw = text.encode()
            gone = np.zeros(len(raw), bool)
            if marks:
                edge = np.zeros(len(raw) + 1, np.int64)
                at, n = np.array([m["start"] for m in marks]), np.array([m["n"] for m in marks])
                np.add.at(edge, at, 1)
                np.add.at(edge, at + n + width - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
            out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        )


def _keyed(docs: DataFrame) -> DataFrame:
    """``key, doc_id, text`` with a unique key in corpus order: the id itself, or where ids repeat or are null a number in sorted order."""
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.select(F.col("doc_id").alias("key"), "doc_id", "text")
    return running(docs, [F.col("doc_id"), F.col("text")], {"key": F.lit(1)}).select(F.col("key").cast("long").alias("key"), "doc_id", "text")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT,
    shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row; ``kept`` are the bytes left."""
    spark = docs.sparkSession
    own = _keyed(id_text(docs, id_col, text_col))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    phrases = own.select("key", "text").mapInArrow(lambda it: _scan(it, width, gram, 8 * parts), "bucket int, kind int, rows binary")
    settled = stage(phrases.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _settle(it, hot), _FOUND), "phrases")
    asked = settled.filter("trigger is not null").groupBy("key").agg(F.collect_list(F.struct("start", "n", "trigger", "hot")).alias("asked"))
    cut = stage(
        own.select("key", "text").join(asked, "key").mapInArrow(
            lambda it: _cut(it, width), "key long, start long, n int, trigger long, hot boolean, bytes binary"
        ),
        "asked"
    )
    mark = F.struct("start", "n").alias("mark")
    marks = settled.filter("trigger is null").select("key", mark)
    shards = cut.filter("not hot").select("trigger", "key", "start", "bytes").repartition(parts, "trigger").sortWithinPartitions("trigger")
    marks = marks.unionByName(shards.mapInArrow(lambda it: _index(it, width, shard_bytes), _FOUND).select("key", mark))
    if cut.filter("hot").limit(1).count():
        windows = stage(
            cut.filter("hot").select("key", "start", "n", "bytes").mapInArrow(
                lambda it: _window_hashes(it, width), "key long, start long, h1 long, h2 long"
            ),
            "windows"
        )
        first = windows.groupBy("h1", "h2").agg(F.min(F.struct("key", "start")).alias("f"))
        later = windows.join(first, ["h1", "h2"]).filter(F.struct("key", "start") > F.col("f"))
        marks = marks.unionByName(later.select("key", F.struct("start", F.lit(1).alias("n")).alias("mark")))
    by_doc = marks.groupBy("key").agg(F.collect_list("mark").alias("marks"))
    return own.join(by_doc, "key", "left").select("doc_id", "text", "marks").mapInArrow(
        lambda it: _remove(it, width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )

"""Token ids in wavelet-matrix files.

A shard holds a run of documents in ascending ``doc_id`` order. Its file is one binary
value: a header, the documents' ids and lengths, and one bit-plane for each bit of
an id, most significant first, each with its number of zeros. Planes are stable partitions of
each other, so ``WaveletMatrix`` reads a token, counts an id or finds its n-th place from the
planes alone; they are compressed block by block, with a directory of the ones before each
block, so that a lookup unpacks a few blocks. Files are written as rows of a Spark table in the shared folder: the
commit protocol keeps the output of exactly one attempt of each task, and any store that Spark
reaches will do.

Defined results: a null text is empty and gives only the end id; a null ``doc_id`` is written as -1; rows with equal ``doc_id`` follow each
other by hash of text; an empty table gives no shards.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import WORKER_CACHE, id_text, stage

MAGIC = b"WVM2"
_HEAD = struct.Struct("<4sBQQ")

#: Bits of a plane that are compressed together, with one entry in the rank directory.
BLOCK = 1 << 16

#: A shard is closed when it holds this many ids.
SHARD_IDS = 1 << 19

#: Words whose ids a task remembers before it starts anew.
CACHE_WORDS = 1_500_000


def encode_planes(ids: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """``(zeros, packed bits)`` from the most to the least significant bit."""
    out, cur = [], ids
    for level in range(bits - 1, -1, -1):
        bit = cur & cur.dtype.type(1 << level) != 0
        out.append((int(len(cur) - np.count_nonzero(bit)), np.packbits(bit)))
        cur = np.concatenate([np.compress(~bit, cur), np.compress(bit, cur)])  # quicker than indexing by a mask
    return out


def pack_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """One file: header, zeros of each plane, ones before each block of each plane, frame sizes; then the frames.

    Frames (zstandard) are document ids, lengths, and the planes cut to blocks of ``BLOCK`` bits.
    """
    squeeze = zstandard.ZstdCompressor(level=1).compress
    frames = [squeeze(doc_ids.astype("<i8").tobytes()), squeeze(lengths.astype("<i8").tobytes())]
    zeros, ranks, width = [], [], BLOCK // 8
    for z, plane in encode_planes(ids, bits):
        zeros.append(z)
        blocks = [plane[i : i + width] for i in range(0, len(plane), width)]
        ones = np.array([int(np.bitwise_count(b).sum(dtype=np.int64)) for b in blocks], np.int64)
        ranks.append(np.cumsum(ones) - ones)
        frames += [squeeze(b.tobytes()) for b in blocks]
    head = _HEAD.pack(MAGIC, bits, len(doc_ids), len(ids)) + np.array(zeros, "<u8").tobytes()
    directory = np.concatenate(ranks).astype("<u8").tobytes() if len(ids) else b""
    return head + directory + np.array([len(f) for f in frames], "<u8").tobytes() + b"".join(frames)


class WaveletMatrix:
    """Reads one shard file. A token, a count or a place takes one or two blocks of each plane from it, not the whole planes."""

    def __init__(self, blob: bytes):
        magic, self.bits, docs, self.size = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = _HEAD.size
        self.zeros = np.frombuffer(blob, "<u8", self.bits, at).astype(np.int64)
        at += 8 * self.bits
        self._blocks = -(-self.size // BLOCK)
        self._ranks = np.frombuffer(blob, "<u8", self.bits * self._blocks, at).astype(np.int64).reshape(self.bits, self._blocks)
        at += 8 * self._ranks.size
        sizes = np.frombuffer(blob, "<u8", 2 + self._ranks.size, at).astype(np.int64)
        self._at = at + 8 * len(sizes) + np.concatenate([[0], np.cumsum(sizes)])
        self._blob, self._held = blob, {}
        self.doc_ids, self.lengths = (np.frombuffer(self._frame(i, max(8 * docs, 8)), "<i8") for i in (0, 1))

    def _frame(self, i: int, most: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._blob[self._at[i] : self._at[i + 1]], max_output_size=most)

    def _block(self, level: int, block: int) -> np.ndarray:
        """Packed bits of a block; the last few stay at hand."""
        key = (level, block)
        if key not in self._held:
            if len(self._held) >= 4 * self.bits:
                self._held.clear()
            self._held[key] = np.frombuffer(self._frame(2 + level * self._blocks + block, BLOCK // 8), np.uint8)
        return self._held[key]

    def _bit(self, level: int, i: int) -> int:
        return int(self._block(level, i // BLOCK)[i % BLOCK >> 3]) >> (7 - (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position ``i`` of a plane, by the directory and the block's own bits."""
        block, rest = divmod(i, BLOCK)
        if block == self._blocks:
            return self.size - int(self.zeros[level])
        packed = self._block(level, block)
        ones = int(self._ranks[level, block]) + int(np.bitwise_count(packed[: rest >> 3]).sum(dtype=np.int64))
        return ones + (int(packed[rest >> 3] >> (8 - (rest & 7))).bit_count() if rest & 7 else 0)

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = int(self.zeros[level]) + ones if bit else i - ones
        return value

    def _range(self, value: int, stop: int) -> tuple[int, int]:
        lo, hi = 0, stop
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if value >> (self.bits - 1 - level) & 1:
                lo, hi = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, value: int, stop: int) -> int:
        """Times that ``value`` stands before position ``stop``."""
        lo, hi = self._range(value, stop)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.size)

    def select(self, value: int, n: int) -> int:
        """Position of the ``n``-th (from 0) ``value``."""
        lo, hi = self._range(value, self.size)
        if not 0 <= n < hi - lo:
            raise IndexError(n)
        i = lo + n
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def _select(self, level: int, bit: int, n: int) -> int:
        """Position of a plane's ``n``-th one or zero: its block by the directory, then within the block."""
        before = self._ranks[level] if bit else np.arange(self._blocks) * BLOCK - self._ranks[level]
        block = int(np.searchsorted(before, n, "right")) - 1
        bits = np.unpackbits(self._block(level, block))
        return block * BLOCK + int(np.flatnonzero(bits == bit)[n - int(before[block])])

    def tokens(self) -> np.ndarray:
        """All ids in order: ``access`` of every place at once, by undoing the partitions from the last plane to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        cur = np.zeros(self.size, kind)
        for level in range(self.bits - 1, -1, -1):
            packed = b"".join(self._frame(2 + level * self._blocks + b, BLOCK // 8) for b in range(self._blocks))
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.size).view(bool)
            z, out = int(self.zeros[level]), np.empty(self.size, kind)
            out[np.flatnonzero(~bit)], out[np.flatnonzero(bit)] = cur[:z], cur[z:] | kind(1 << (self.bits - 1 - level))
            cur = out
        return cur


#: Marks that a letter parts from its word at the end of a piece; an apostrophe may belong to the word.
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")

#: A capital before a character from U+0300 on, where all combining marks are.
_OPEN = re.compile(rb"[A-Z][\xcc-\xff]")


class WordEncoder:
    """Ids of a text, as packed integers of ``kind``, by its pieces between ASCII white space.

    The vocabulary composes characters, then lower-cases them, drops white space, and parts letters from marks, so a
    text's ids are those of its pieces joined, and of a piece those of its word and of the marks after it. ASCII letters are
    lower-cased beforehand, but not where one could compose with what follows it (``_OPEN``), since some capitals have
    no composed form that their small letters have. Each distinct
    one goes to the tokenizer once while it is remembered; new ones are encoded many at a time, parted by
    a mark that none of them has. Texts that could hold a special token are encoded as they are.
    """

    def __init__(self, path: str, kind: str = "<u4", part: str = "~"):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.kind, self.part = Tokenizer.from_file(path), np.dtype(kind), part
        self.known: dict[bytes, bytes] = {}
        # the same model for words of letters alone, which the normaliser and the pattern leave as they are
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        ])
        ids = self._encode([part])[0]
        self.part_id = ids[0] if len(ids) == 1 else None

    def _encode(self, texts: list[str], letters: bool = False) -> list[list[int]]:
        return [e.ids for e in (self.letters if letters else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: set[bytes]) -> None:
        """Remember new pieces, by way of their words and marks."""
        cut = {}
        for p in fresh:
            word = p.rstrip(_MARKS)
            if len(word) < len(p) and word and 97 <= word[-1] <= 122:
                cut[p] = (word, p[len(word) :])
        self._look_up({x for p in cut.values() for x in p} | (fresh - cut.keys()))
        known = self.known
        for p, (word, marks) in cut.items():
            known[p] = known[word] + known[marks]

    def _kind(self, piece: bytes) -> int:
        """0: lower-case letters in composed form; 1: may be encoded among others; 2: goes alone."""
        if self.part_id is None:
            return 2
        if piece.isascii():
            return 0 if piece.isalpha() else 2 if self.part.encode() in piece else 1
        text = piece.decode("utf-8")
        if text.isalpha():
            return 0 if text == text.lower() and unicodedata.is_normalized("NFC", text) else 1
        return 2 if self.part in text else 1

    def _look_up(self, pieces: set[bytes]) -> None:
        groups: tuple[list[bytes], ...] = ([], [], [])
        for p in pieces:
            if p not in self.known:
                groups[self._kind(p)].append(p)
        between = f" {self.part} ".encode()
        for letters, new in ((True, groups[0]), (False, groups[1])):
            for i in range(0, len(new), 2048):
                some = new[i : i + 2048]
                blocks = [between.join(some[k : k + 64]).decode("utf-8") for k in range(0, len(some), 64)]
                ids = np.array(list(chain.from_iterable(x + [self.part_id] for x in self._encode(blocks, letters))), self.kind)
                raw, width, at = ids.tobytes(), self.kind.itemsize, 0
                for piece, stop in zip(some, np.flatnonzero(ids == self.part_id).tolist(), strict=True):
                    self.known[piece] = raw[at * width : stop * width]
                    at = stop + 1
        for piece in groups[2]:
            self.known[piece] = np.array(self._encode([piece.decode("utf-8")])[0], self.kind).tobytes()

    @staticmethod
    def _pieces(text: bytes) -> list[bytes]:
        """Between white space, lower-cased as far as that changes no id; none of a text that goes to the tokenizer whole."""
        if b"<|" in text:
            return []
        if text.isascii() or not _OPEN.search(text):
            return text.lower().split()
        return [p.lower() if p.isascii() else p for p in text.split()]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        pieces = [self._pieces(t) for t in texts]
        flat = list(chain.from_iterable(pieces))
        ids = list(map(self.known.get, flat))
        missing, i = [], -1
        for _ in range(ids.count(None)):
            i = ids.index(None, i + 1)
            missing.append(i)
        if missing:
            self._learn({flat[i] for i in missing})
            for i in missing:
                ids[i] = self.known[flat[i]]
        out, at = [], 0
        for p in pieces:
            out.append(b"".join(ids[at : at + len(p)]))
            at += len(p)
        for i, t in enumerate(texts):
            if b"<|" in t:
                out[i] = np.array(self._encode([t.decode("utf-8")])[0], self.kind).tobytes()
        return out


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int, bits: int) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kind = np.dtype("<u2" if bits <= 16 else "<u4")
    encode = WORKER_CACHE.get((path, kind.str)) or WORKER_CACHE.setdefault((path, kind.str), WordEncoder(path, kind.str))
    end, width = np.array([end_id], kind).tobytes(), kind.itemsize
    part, seq, held, before = TaskContext.get().partitionId(), 0, 0, 0
    docs: list[int | None] = []
    parts: list[bytes] = []

    def close() -> pa.RecordBatch:
        lengths = np.array([len(p) // width for p in parts], np.int64)
        ids = np.frombuffer(b"".join(parts), kind)
        blob = pack_shard(np.array([-1 if d is None else d for d in docs], np.int64), lengths, ids, bits)
        return pa.record_batch(
            [
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([blob], pa.binary())
            ],
            names=["part", "seq", "before", "n", "shard"],
        )

    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
        for i in range(0, len(texts), 256):
            for d, x in zip(ids[i : i + 256], encode(texts[i : i + 256]), strict=True):
                docs.append(d)
                parts.append(x + end)
                held += len(x) // width + 1
                if held >= SHARD_IDS:
                    yield close()
                    docs, parts, held, seq, before = [], [], 0, seq + 1, before + held
    if docs:
        yield close()


def _read(batches: Iterator[pa.RecordBatch], base: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, before, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "shard")), strict=True):
            m = WaveletMatrix(blob)
            raw = memoryview(m.tokens().astype("<u4").tobytes())
            stops = np.cumsum(m.lengths)
            starts = stops - m.lengths
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            yield pa.record_batch(
                [
                    pa.array(m.doc_ids), pa.array(starts + base[part] + before), pa.array(m.lengths), pa.array(crc, pa.int64())
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )


def write_shards(
    docs: DataFrame, tokenizer: str, end_id: int = 1, bits: int = 16, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None
) -> DataFrame:
    """Encode every text and store the shards; returns the stored table ``part, seq, before, n, shard``."""
    own = id_text(docs, id_col, text_col)
    by = ("doc_id", F.xxhash64("text"))  # rows that share an id, or have none, are dealt out too
    ranged = own.repartitionByRange(partitions, *by) if partitions else own.repartitionByRange(*by)
    shards = ranged.sortWithinPartitions(*by, "text").mapInArrow(
        lambda it: _write(it, tokenizer, end_id, bits), "part int, seq int, before long, n long, shard binary"
    )
    return stage(shards, "wavelet")


def read_shards(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from stored shards.

    The driver holds one number for each partition that wrote shards.
    """
    base, total = {}, 0
    for row in shards.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        base[row.part], total = total, total + row.n
    return shards.select("part", "before", "shard").mapInArrow(lambda it: _read(it, base), "doc_id long, start long, n_tokens long, ids_crc32 long")

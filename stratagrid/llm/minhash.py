"""MinHash near-duplicates by a signature-coordinate inverted join.

Texts with the same shingle set form a class; a class has a signature of ``K`` coordinates, each the
least value of the set under its own permutation. Classes are posted under every (coordinate, value)
pair that more than one class has. Two classes of similarity ``s`` agree on about ``s * K`` coordinates; pairs
that agree on fewer than ``T`` are not looked at. With ``K = 32, T = 12`` a pair of similarity 0.75 is missed with
a chance of about 1e-6.

Prefix: of each class only its ``K - T + 1`` rarest pairs are posted, since two classes that agree on
``T`` coordinates meet in one of these. Collisions are then counted over ``TAIL`` further coordinates too,
and a pair with fewer than ``T_ALL`` in all is dropped (another chance of 1e-6 at 0.75). Each list is first
joined around one leader; classes that collide enough are a family. Skip: lists whose members are already
one family are left out; the others are joined in tiles of bounded size.

Families are confirmed on the full shingle sets in the same way: first every member with the leader of its
family, then, where that leaves a family in several components, tile by tile the pairs between these.
Tiles give spanning forests, so no list or family is gathered whole and no group is written out as pairs.

Defined results: words are parted by ASCII white space and A-Z lower-cased; a text of fewer than ``shingle``
words is one shingle; a null text or one without words has no shingles and no links; repeated rows are
of one class. Rows are what is linked: rows that share an id may be of different groups, each with its own least id. A
row without an id is linked like any other and always kept; a group without ids has none. An empty table gives no rows. Very long texts
are read whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import SPACED, Words, chunks, discard, id_text, mix64, stage, stream64
from stratagrid.llm.components import components, forest

K = 32
T = 12
SHINGLE = 5

#: Coordinates that are not posted, of which only a byte is kept: they sharpen the count of collisions.
TAIL = 96

#: Collisions of ``K + TAIL`` coordinates below which a pair is dropped.
T_ALL = 72

#: Members on each side of a tile: where collisions are counted, and where full sets are compared.
TILE = 1024
FULL_TILE = 256

#: Members of a family that meet one copy of their leader's text.
LED = 1024

#: Links up to which components are settled by one task, which took 115 MB for that many; more take rounds, of two plans each.
AT_ONCE = 1 << 20


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, laid end to end; and the size of each text's set."""
    words = Words(texts, SPACED)
    whole = words.whole(shingle)
    parts, docs = [words.grams(shingle)[whole]], [words.doc[whole]]
    for m in range(1, shingle):
        short = np.flatnonzero(words.count == m)
        parts.append(words.grams(m)[words.first[:-1][short]] if len(short) else np.zeros(0, np.uint64))
        docs.append(short)
    h, doc = np.concatenate(parts), np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    h, doc = h[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(texts))


def signatures(h: np.ndarray, sizes: np.ndarray, k: int = K) -> np.ndarray:
    """One row of ``k`` 32-bit coordinates for each set that is not empty."""
    at = (np.cumsum(sizes) - sizes)[sizes > 0]
    x = (h >> np.uint64(32)).astype(np.uint32)
    mult, add = (stream64(k, 101) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (stream64(k, 202) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at), k), np.uint32)
    for i in range(k):
        y = x * mult[i] + add[i]
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x85EBCA6B)
        out[:, i] = np.minimum.reduceat(y, at) if len(at) else 0
    return out


def _agreeing(head: np.ndarray, tail: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Collisions of the pairs ``i[n], j[n]`` over all coordinates."""
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 1 << 15):
        a, b = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
        out[s : s + len(a)] = (head[a] == head[b]).sum(axis=1) + (tail[a] == tail[b]).sum(axis=1)
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: type) -> np.ndarray:
    """A list or binary column of fixed width as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)
    return column.flatten().to_numpy().reshape(-1, width)


def _sign(batches: Iterator[pa.RecordBatch], shingle: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        h, sizes = shingle_sets(texts, shingle)
        full = sizes > 0
        at = (np.cumsum(sizes) - sizes)[full]
        sig, keys = np.zeros((len(texts), k + TAIL), np.uint32), np.zeros((2, len(texts)), np.uint64)
        if full.any():
            sig[full] = signatures(h, sizes, k + TAIL)
            keys[0][full], keys[1][full] = np.add.reduceat(mix64(h + np.uint64(1)), at), np.add.reduceat(mix64(h ^ np.uint64(0x5BD1E995C0FFEE11)), at)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(sig[:, :k]).ravel().view(np.int32)), k).cast(pa.list_(pa.int32()))
        yield pa.record_batch(
            [
                batch.column("doc_id"), batch.column("th"), pa.array(sizes.astype(np.int64)), pa.array(keys[0].view(np.int64)),
                pa.array(keys[1].view(np.int64)), flat, pa.array([t.tobytes() for t in sig[:, k:].astype(np.uint8)], pa.binary())
            ],
            names=["doc_id", "th", "n_shingles", "k1", "k2", "sig", "tail"],
        )


def _confirm(batches: Iterator[pa.RecordBatch], shingle: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs ``a, b, text_a, text_b``, those with the same ``a`` mostly together, that link."""
    last, left = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        ta, tb = batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary())
        good = []
        for i in range(len(a)):
            if a[i] != last:
                last, left = a[i], shingle_sets([ta[i].as_py()], shingle)[0]
            right = shingle_sets([tb[i].as_py()], shingle)[0]
            both = len(np.intersect1d(left, right, assume_unique=True))
            if den * both >= num * (len(left) + len(right) - both) and both:
                good.append(i)
        yield pa.record_batch(
            [batch.column("a").take(pa.array(good, pa.int64())), batch.column("b").take(pa.array(good, pa.int64()))], names=["a", "b"]
        )


def _common(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every set of ``x`` with every set of ``y``."""
    owner = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in x + y])
    values, ids, counts = np.unique(np.concatenate(x + y), return_inverse=True, return_counts=True)
    rank = np.cumsum(counts > 1) - 1
    owner, ids = owner[counts[ids] > 1], rank[ids[counts[ids] > 1]]
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    out = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
        s, e = np.searchsorted(ids, [lo, lo + width])
        has = np.zeros((len(x) + len(y), width), np.float32)
        has[owner[s:e], ids[s:e] - lo] = 1
        out += has[: len(x)] @ has[len(x) :].T
    return out


def _tiles(batches: Iterator[pa.RecordBatch], num: int, den: int, shingle: int, confirm: bool) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of each tile's links. Rows come sorted by ``(key, tile)``; ``side`` is 0 for rows, 1 for columns, 2 for both.

    Links are pairs of different ``comp`` that collide enough and, with ``confirm``, are similar on their full sets.
    """
    held: list[pa.RecordBatch] = []

    def close() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        rep, comp, n, side = (t.column(c).to_numpy() for c in ("rep", "comp", "n", "side"))
        sig, tail = _matrix(t.column("sig"), K, np.int32), _matrix(t.column("tail"), TAIL, np.uint8)
        x, y = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        agree = np.zeros((len(x), len(y)), np.uint8)
        for c in range(K):
            agree += sig[x, c][:, None] == sig[y, c][None]
        ok = (agree >= T) & (comp[x][:, None] != comp[y][None]) & (den * np.minimum(n[x][:, None], n[y][None]) >= num * np.maximum(n[x][:, None], n[y][None]))
        i, j = np.nonzero(ok)
        likely = _agreeing(sig, tail, x[i], y[j]) >= T_ALL
        i, j = i[likely], j[likely]
        if confirm and len(i):
            rows, cols = np.unique(i), np.unique(j)
            texts = t.column("text").cast(pa.binary()).take(pa.array(np.concatenate([x[rows], y[cols]]))).to_pylist()
            h, sizes = shingle_sets(texts, shingle)
            sets = np.split(h, np.cumsum(sizes)[:-1])
            both = _common(sets[: len(rows)], sets[len(rows) :])[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)
            good = den * both >= num * (n[x[i]] + n[y[j]] - both)
            i, j = i[good], j[good]
        tree = np.array(forest(x[i], y[j], len(rep)), np.int64).reshape(-1, 2) if len(i) else np.zeros((0, 2), np.int64)
        return pa.record_batch([pa.array(rep[tree[:, 0]]), pa.array(rep[tree[:, 1]])], names=["a", "b"])

    last = None
    for batch in batches:
        key, tile = batch.column("key").to_numpy(), batch.column("tile").to_numpy()
        bounds = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1).tolist(), len(key)]
        for s, e in zip(bounds, bounds[1:]):
            if s == e:
                continue
            if held and last != (key[s], tile[s]):
                yield close()
                held = []
            last = (key[s], tile[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield close()


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        head = np.concatenate([_matrix(batch.column(c), K, np.int32) for c in ("sa", "sb")])
        tail = np.concatenate([_matrix(batch.column(c), TAIL, np.uint8) for c in ("ta", "tb")])
        ok = pa.array(_agreeing(head, tail, np.arange(n), np.arange(n) + n) >= T_ALL)
        yield pa.record_batch([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])


def _deal(groups: DataFrame, tile: int) -> DataFrame:
    """``key, rep, comp`` to ``key, tile, rep, comp, side``: the groups of several components, cut to tiles."""
    open_ = groups.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")
    ).filter("lo < hi").select("key", F.ceil(F.col("n") / tile).alias("blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o")
    dealt = groups.join(open_, "key").select("key", "rep", "comp", "blocks", block.alias("me"), other)
    low, high = F.least("me", "o"), F.greatest("me", "o")
    side = F.when(F.col("me") == F.col("o"), 2).when(F.col("me") < F.col("o"), 0).otherwise(1)
    return dealt.select("key", (low * F.col("blocks") + high).alias("tile"), "rep", "comp", side.cast("int").alias("side"))


def _families(edges: DataFrame, name: str) -> DataFrame:
    """``rep, comp`` of the classes that an edge touches."""
    return stage(components(edges, at_once=AT_ONCE).select(F.col("id").alias("rep"), F.col("component").alias("comp")), name)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, num: int = 75, den: int = 100, tile: int = TILE, full_tile: int = FULL_TILE
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row: linked where ``den * both >= num * either``."""
    k, least = K, T
    base = id_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    kinds = "doc_id long, th long, n_shingles long, k1 long, k2 long, sig array<int>, tail binary"
    signed = stage(base.mapInArrow(lambda it: _sign(it, shingle, k), kinds), "signed")
    # a class is a node of its own, whichever ids its rows have; one of these and the hash of the text lead to a text
    one = F.min(F.struct("doc_id", "th")).alias("one")
    classes = signed.filter("n_shingles > 0").groupBy("k1", "k2").agg(
        one, F.min("doc_id").alias("low"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("tail").alias("tail")
    )
    reps = stage(classes.select(F.xxhash64("k1", "k2").alias("rep"), "k1", "k2", "low", "one", "n_shingles", "sig", "tail"), "reps")
    # posting lists, each class under its rarest pairs
    posted = reps.select("rep", F.posexplode("sig").alias("i", "v")).select(
        "rep", (F.col("i").cast("long") * (1 << 32) + F.col("v").cast("long") + (1 << 31)).alias("key")
    )
    shared = posted.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    own = posted.join(shared, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("pairs")).filter(F.size("pairs") >= least)
    prefix = F.slice("pairs", 1, F.greatest(F.lit(k - least + 1) - (F.lit(k) - F.size("pairs")), F.lit(0)))
    posts = stage(own.select("rep", F.explode(prefix).alias("p")).select("rep", F.col("p.key").alias("key")), "posts")
    sizes = reps.select("rep", F.col("n_shingles").alias("n"), "sig", "tail")

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    def tiles(dealt: DataFrame, confirm: bool) -> DataFrame:
        return dealt.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(
            lambda it: _tiles(it, num, den, shingle, confirm), "a long, b long"
        )

    leader = posts.groupBy("key").agg(F.min("rep").alias("a"))
    pairs = posts.join(leader, "key").filter("a < rep").select("a", F.col("rep").alias("b")).distinct()
    side = lambda x: reps.select(
        F.col("rep").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sig").alias(f"s{x}"), F.col("tail").alias(f"t{x}")
    )
    fit = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    likely = stage(fit.mapInArrow(_likely, "a long, b long"), "likely")
    guess = _families(likely, "family")
    more = stage(tiles(_deal(labelled(posts, guess), tile).join(sizes, "rep"), False), "likely")
    family = _families(likely.unionByName(more), "family")
    discard(posts, likely, more, guess)

    # one text of every class that is in a family
    repeated = bool(signed.groupBy("doc_id", "th").count().filter("count > 1").limit(1).count())
    wanted = family.join(reps, "rep").select("rep", F.col("one.doc_id").alias("of"), F.col("one.th").alias("of_th"))
    each = base.dropDuplicates(["doc_id", "th"]) if repeated else base
    texts = stage(each.join(wanted, (F.col("th") == F.col("of_th")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("rep", "text"), "texts")
    edges = stage(_with_leader(family, texts).mapInArrow(lambda it: _confirm(it, shingle, num, den), "a long, b long"), "links")
    groups = labelled(family.select(F.col("comp").alias("key"), "rep"), _families(edges, "labels"))
    rest = stage(tiles(_deal(groups, full_tile).join(sizes, "rep").join(texts, "rep"), True), "links")
    labels = _families(edges.unionByName(rest), "labels")
    discard(texts, family, edges, rest)
    lowest = reps.join(labels, "rep").groupBy("comp").agg(F.min("low").alias("lowest"))
    of_class = reps.select("rep", "k1", "k2", "low").join(labels.join(lowest, "comp"), "rep", "left").select("k1", "k2", F.coalesce("lowest", "low").alias("comp"))
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    comp = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def _with_leader(family: DataFrame, texts: DataFrame, most: int = LED) -> DataFrame:
    """``a, b, text_a, text_b``: members ``b`` beside the leader ``a`` of their family, at most about ``most`` members to a key."""
    led = family.filter("rep <> comp").select(F.col("comp").alias("a"), F.col("rep").alias("b"))
    blocks = led.groupBy("a").agg(F.ceil(F.count("*") / most).alias("blocks"))
    dealt = led.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    leaders = blocks.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").select(
        "a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    )
    return dealt.join(
        texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b"
    ).join(leaders, ["a", "block"]).select("a", "b", "text_a", "text_b")

"""Embedding near-duplicates by an exact metric range join.

Unit vectors with cosine ``c`` are ``sqrt(2 - 2c)`` apart, so links are pairs within a radius ``r``. A label's vectors are
parted by pivots drawn from that label: every vector has its home at the nearest one. By the triangle inequality all
partners of a vector with home ``p`` are among those whose distance to ``p`` exceeds the distance to their own home by no more
than ``2r``, and no further from the plane between both pivots than ``r``: such a vector is copied to the cell of
``p``, though only if ``p`` comes before its own home, since the pair needs to meet once. Cells join independently. A cell whose home vectors
or members are many is cut into tiles of ``TILE`` by ``TILE``; a tile counts links and keeps a spanning forest
of them, so neither pairs nor cells are ever gathered whole.

Equal vectors of a label are joined as one with a weight. Defined results: null vectors or labels, zero
vectors, and vectors with null or non-finite components have no links; only vectors of equal length
link; an empty table gives no rows; other columns are ignored. ``id_col`` is taken as unique: repeated ids are merged to one row. Vectors
are scaled by powers of two before they are multiplied, so their magnitude doesn't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import discard, stage
from stratagrid.llm.components import components, forest

#: Most pivots of a label, a sample by hash, and of all labels: what is broadcast is bounded by their product with the dimension.
PIVOTS = 4096
ALL_PIVOTS = 1 << 15
#: Vectors that a cell should hold; a label gets as many pivots as that takes, up to ``PIVOTS``. Labels of fewer vectors are one cell.
TILE = 1024
_EPS = 1e-6


def _vectors(column: pa.ListArray) -> list[np.ndarray] | np.ndarray:
    """Rows as doubles: a matrix where all lengths agree."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(n) and (n == n[0]).all():
        return flat.reshape(len(n), -1)
    return np.split(flat, np.cumsum(n)[:-1])


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two, exactly, so that squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1])


def _unit(v: np.ndarray, width: int) -> np.ndarray:
    """Unit vectors, cut or padded to ``width``: dropping coordinates never makes a distance longer."""
    v = _scaled(v)
    v = v / np.sqrt((v * v).sum(axis=-1, keepdims=True))
    out = np.zeros((len(v), width))
    out[:, : min(width, v.shape[1])] = v[:, :width]
    return out


def _cells(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each row, and which cells before it the row is copied to."""
    apart = np.sqrt(np.maximum(0, (pivots * pivots).sum(axis=1)[:, None] - 2 * pivots @ pivots.T + (pivots * pivots).sum(axis=1)[None]))
    d2 = np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1)[None])
    home = d2.argmin(axis=1)
    at_home = d2[np.arange(len(d2)), home][:, None]
    near = (np.sqrt(d2) <= np.sqrt(at_home) + 2 * radius + _EPS) & (d2 - at_home <= 2 * radius * apart[home] + _EPS)
    return home, near & (np.arange(len(pivots))[None] < home[:, None])


def _assign(batches: Iterator[pa.RecordBatch], pivots: dict[object, np.ndarray], radius: float) -> Iterator[pa.RecordBatch]:
    """Cells of each vector, home first; labels without pivots are one cell."""
    for batch in batches:
        vectors = _vectors(batch.column("v"))
        by_label: dict[object, list[int]] = {}
        for i, label in enumerate(batch.column("label").to_pylist()):
            by_label.setdefault((label, len(vectors[i])) if label in pivots else None, []).append(i)
        rows, cells = [], []
        for key, own in by_label.items():
            if key is None:
                rows.append(np.array(own))
                cells.append(np.zeros(len(own), np.int64))
                continue
            at = pivots[key[0]]
            for some in (own[i : i + 256] for i in range(0, len(own), 256)):
                home, copies = _cells(_unit(np.array([vectors[i] for i in some]), at.shape[1]), at, radius)
                i, q = np.nonzero(copies)
                rows += [np.array(some), np.array(some)[i]]
                cells += [home, q]
        rows, cells = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cells))
        order = np.argsort(rows, kind="stable")
        offsets = np.searchsorted(rows[order], np.arange(batch.num_rows + 1)).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells[order].astype(np.int32)))
        yield pa.record_batch([*(batch.column(c) for c in batch.schema.names), listed], names=[*batch.schema.names, "cells"])


def _tiles(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of a tile's home vectors (``side`` 0) with its members: homes again (1) or copies (2). Rows come sorted by tile.

    A pair of homes meets twice and counts for the one that asks; a home and a copy meet once and count for both.
    """
    held: list[pa.RecordBatch] = []

    def close() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        x, ids, weight, side = _scaled(np.array(_vectors(t.column("v")))), t.column("id").to_numpy(), t.column("weight").to_numpy(), t.column("side").to_numpy()
        norm = np.sqrt((x * x).sum(axis=1))
        q, m = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
        link = ((x[q] @ x[m].T) / (norm[q][:, None] * norm[m][None]) >= least) & (ids[q][:, None] != ids[m][None])
        i, j = np.nonzero(link)
        links = np.zeros(len(x), np.int64)
        np.add.at(links, q[i], weight[m[j]])
        copied = side[m[j]] == 2
        np.add.at(links, m[j[copied]], weight[q[i[copied]]])
        names, inv = np.unique(np.concatenate([ids[q[i]], ids[m[j]]]), return_inverse=True)
        tree = np.array(forest(inv[: len(i)], inv[len(i) :], len(names)), np.int64).reshape(-1, 2)
        some = links > 0
        return pa.record_batch(
            [
                pa.array(np.concatenate([ids[some], names[tree[:, 0]]])), pa.array([None] * int(some.sum()) + names[tree[:, 1]].tolist(), pa.int64()),
                pa.array(np.concatenate([links[some], np.zeros(len(tree), np.int64)]))
            ],
            names=["id", "other", "links"],
        )

    last = None
    for batch in batches:
        tiles = np.array(batch.column("tile").to_pylist(), object)
        bounds = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), len(tiles)]
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            if held and tiles[a] != last:
                yield close()
                held = []
            last = tiles[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield close()


def _pivots(classes: DataFrame, most: int, all_most: int, tile: int) -> dict[object, np.ndarray]:
    """Pivots of the labels that need several: vectors of the least hashes among a sample of about four times as many."""
    counts = classes.groupBy("label").count().filter(F.col("count") > tile).orderBy(F.desc("count"), "label").limit(all_most // 2).collect()
    wanted = {r.label: min(most, math.ceil(r["count"] / tile)) for r in counts}
    shrink = min(1.0, all_most / max(1, sum(wanted.values())))
    rows = [(
        r.label, int(wanted[r.label] * shrink), 4.0 * wanted[r.label] * shrink / r["count"]
    ) for r in counts if int(wanted[r.label] * shrink) > 1]
    if not rows:
        return {}
    kind = dict(classes.dtypes)["label"]
    rates = classes.sparkSession.createDataFrame(rows, f"label {kind}, wanted int, rate double")
    draw = F.xxhash64("v").bitwiseAND((1 << 52) - 1) / float(1 << 52)
    sample: dict[object, list] = {}
    for r in classes.join(F.broadcast(rates), "label").select("label", "v", "wanted", draw.alias("draw")).filter(F.col("draw") < F.col("rate")).collect():
        sample.setdefault(r.label, []).append((r.draw, r.wanted, r.v))
    out = {}
    for label, found in sample.items():
        own = [np.asarray(v, float) for _, _, v in sorted(found, key=lambda x: x[0])[: found[0][1]]]
        width = max(map(len, own))
        out[label] = np.concatenate([_unit(v[None], width) for v in own])
    return out


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, pivots: int = PIVOTS, tile: int = TILE, all_pivots: int = ALL_PIVOTS
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    radius = math.sqrt(2 - 2 * least)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sound = rows.filter(F.col("v").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda c: c != 0))
    classes = stage(sound.groupBy("label", "v").agg(F.min("id").alias("id"), F.count_distinct("id").alias("weight")), "vectors")
    at = _pivots(classes, pivots, all_pivots, tile)
    shared = classes.sparkSession.sparkContext.broadcast(at)
    kinds = dict(classes.dtypes)
    placed = classes.mapInArrow(
        lambda it: _assign(it, shared.value, radius), f"label {kinds['label']}, v {kinds['v']}, id long, weight long, cells array<int>"
    )
    members = stage(placed.select("id", "weight", "v", "label", F.size("v").alias("dim"), "cells"), "cells")
    each = F.posexplode("cells").alias("k", "cell")
    sizes = members.select("label", "dim", each).groupBy("label", "dim", "cell").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("k") == 0, 1).otherwise(0)).alias("homes")
    )
    cut = members.select("id", "weight", "v", "label", "dim", each).join(sizes.filter("homes > 0 and n > 1"), ["label", "dim", "cell"])
    rows_of, cols_of = F.ceil(F.col("homes") / tile), F.ceil(F.col("n") / tile)
    own_row, own_col = F.pmod(F.xxhash64("id", F.lit(1)), rows_of), F.pmod(F.xxhash64("id", F.lit(2)), cols_of)
    kind = "array<struct<r:bigint,c:bigint,side:int>>"
    asks = F.when(
        F.col("k") == 0,
        F.transform(F.sequence(F.lit(0).cast("long"), cols_of - 1), lambda c: F.struct(own_row.alias("r"), c.alias("c"), F.lit(0).alias("side")))
    )
    side = F.when(F.col("k") == 0, 1).otherwise(2)
    answers = F.transform(F.sequence(F.lit(0).cast("long"), rows_of - 1), lambda r: F.struct(r.alias("r"), own_col.alias("c"), side.alias("side")))
    spread = cut.select("label", "dim", "cell", "id", "v", "weight", F.explode(F.concat(F.coalesce(asks, F.array().cast(kind)), answers)).alias("t"))
    keyed = spread.select(F.concat_ws("|", "dim", "cell", "t.r", "t.c", "label").alias("tile"), "id", "t.side", "v", "weight")
    met = stage(
        keyed.repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda it: _tiles(it, least), "id long, other long, links long"), "tiles",
        members
    )
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    of = components(met.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    found = links.join(of, "id", "full")
    by_class = classes.join(found, "id", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")
    )
    done = sound.join(by_class, ["label", "v"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    return rows.select("id").distinct().join(done, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component_id"), (F.coalesce("component", "id") == F.col("id")).alias("kept")
    )

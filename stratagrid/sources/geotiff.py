"""GeoTIFF rasters: one file for each tile, all bands of one type as planes, deflated strips.

Files are written and read by numpy and the standard library alone. What is read: strips or tiles, plain or deflated, planar or
interleaved, integers and floats of 8 to 64 bits, little or big endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.model import GridSpec
from stratagrid.sources.storage import WholeFile

# Tags, and field types by code with their sizes.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _STRIP_AT, _SAMPLES, _ROWS, _STRIP_SIZE, _PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
_TILE_WIDTH, _TILE_HEIGHT, _TILE_AT, _TILE_SIZE, _EXTRA, _KIND, _PIXEL, _TIE, _GEO_KEYS, _METADATA, _NO_DATA = 322, 323, 324, 325, 338, 339, 33550, 33922, 34735, 42112, 42113
_FIELDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
_KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass
class Raster:
    """Bands by name over one grid: origin of the north-west corner, cell size, system and the value that stands for missing data."""

    bands: dict[str, np.ndarray]
    x0: float
    y0: float
    cell: float
    epsg: int = 0
    no_data: float | None = None
    more: dict[int, tuple] = field(default_factory=dict)


def default_no_data(kind: np.dtype) -> float | int:
    """NaN for floats, the most negative of signed integers, the most positive of unsigned ones."""
    kind = np.dtype(kind)
    if kind.kind == "f":
        return float("nan")
    return int(np.iinfo(kind).min if kind.kind == "i" else np.iinfo(kind).max)


def encode(raster: Raster) -> bytes:
    """A little endian file with one deflated strip for each band."""
    planes = list(raster.bands.values())
    kind, (high, wide) = planes[0].dtype.newbyteorder("<"), planes[0].shape
    strips = [zlib.compress(p.astype(kind).tobytes(), 6) for p in planes]
    names = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{escape(n)}</Item>' for i, n in enumerate(raster.bands))
    n = len(planes)
    tags: list[tuple[int, int, list | bytes]] = [
        (_WIDTH, 4, [wide]), (_HEIGHT, 4, [high]), (_BITS, 3, [kind.itemsize * 8] * n), (_COMPRESSION, 3, [8]), (_PHOTOMETRIC, 3, [1]), (_STRIP_AT, 4, [0] * n), (_SAMPLES, 3, [n]), (_ROWS, 4, [high]),
        (_STRIP_SIZE, 4, [len(s) for s in strips]), (_PLANAR, 3, [2]), *([(_EXTRA, 3, [0] * (n - 1))] if n > 1 else []), (_KIND, 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * n),
        (_PIXEL, 12, [raster.cell, raster.cell, 0.0]), (_TIE, 12, [0.0, 0.0, 0.0, raster.x0, raster.y0, 0.0]), (
            _GEO_KEYS, 3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, raster.epsg]
        ),
        (
            _METADATA, 2, f"<GDALMetadata>{names}</GDALMetadata>".encode() + b"\0"
        ), *([(_NO_DATA, 2, repr(raster.no_data).encode() + b"\0")] if raster.no_data is not None else []),
    ]
    behind = 8 + 2 + 12 * len(tags) + 4
    extra, entries = b"", b""
    packed = {t: v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{_FIELDS[k][0]}", *v) for t, k, v in tags}
    at = behind + sum(len(v) + len(v) % 2 for v in packed.values() if len(v) > 4)
    offsets = np.cumsum([0, *map(len, strips)])[:-1] + at
    packed[_STRIP_AT] = struct.pack(f"<{n}I", *offsets.tolist())
    for t, k, v in tags:
        raw = packed[t]
        value = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", behind + len(extra))
        if len(raw) > 4:
            extra += raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HHI", t, k, len(raw) // _FIELDS[k][1]) + value
    return b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra + b"".join(strips)


def _tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", raw, 4)[0]
    out = {}
    for i in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        if kind not in _FIELDS:
            continue
        code, size = _FIELDS[kind]
        place = at + 2 + 12 * i + 8 if count * size <= 4 else struct.unpack_from(order + "I", raw, at + 2 + 12 * i + 8)[0]
        out[tag] = (raw[place : place + count],) if kind == 2 else struct.unpack_from(order + code * count, raw, place)
    return order, out


def decode(raw: bytes) -> Raster:
    order, tags = _tags(raw)
    wide, high, n = tags[_WIDTH][0], tags[_HEIGHT][0], tags.get(_SAMPLES, (1,))[0]
    if len({*tags[_BITS]}) > 1 or len({*tags.get(_KIND, (1,))}) > 1:
        raise ValueError("bands of several types in one file can't be read")
    compression = tags.get(_COMPRESSION, (1,))[0]
    if compression not in (1, 8, 32946):
        raise ValueError(f"compression {compression} can't be read")
    kind = np.dtype(f"{order}{_KINDS[tags.get(_KIND, (1,))[0]]}{tags[_BITS][0] // 8}")
    planar = tags.get(_PLANAR, (1,))[0] == 2
    deep = 1 if planar else n
    if _TILE_AT in tags:
        part_wide, part_high, places, sizes = tags[_TILE_WIDTH][0], tags[_TILE_HEIGHT][0], tags[_TILE_AT], tags[_TILE_SIZE]
    else:
        part_wide, part_high, places, sizes = wide, tags.get(_ROWS, (high,))[0], tags[_STRIP_AT], tags[_STRIP_SIZE]
    part_high = min(part_high, high) if _TILE_AT not in tags else part_high
    across, down = -(-wide // part_wide), -(-high // part_high)
    out = np.zeros((n, high, wide), kind.newbyteorder("="))
    for i, (at, size) in enumerate(zip(places, sizes, strict=True)):
        piece = raw[at : at + size]
        piece = np.frombuffer(zlib.decompress(piece) if compression != 1 else piece, kind).reshape(-1, part_wide, deep)
        band, rest = divmod(i, across * down)
        y, x = rest // across * part_high, rest % across * part_wide
        own = piece[: high - y, : wide - x]
        out[band if planar else slice(None), y : y + own.shape[0], x : x + own.shape[1]] = own[:, :, 0] if planar else np.moveaxis(own, 2, 0)
    names = {int(i.get("sample", 0)): i.text for i in ElementTree.fromstring(tags[_METADATA][0].rstrip(b"\0"))} if _METADATA in tags else {}
    keys = tags.get(_GEO_KEYS, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys), 4) if keys[i] in (3072, 2048)), 0)
    tie = tags.get(_TIE, (0.0,) * 6)
    no_data = float(tags[_NO_DATA][0].rstrip(b"\0")) if _NO_DATA in tags else None
    return Raster({names.get(i, f"band{i + 1}"): out[i] for i in range(n)}, tie[3], tie[4], tags.get(_PIXEL, (1.0,))[0], epsg, no_data)


def write_tiles(cells: DataFrame, folder: str, grid: GridSpec, bands: list[str], tile_cells: int, kind: str = "float64", epsg: int = 0) -> DataFrame:
    """Write cells ``cx, cy`` and ``bands`` as files ``r<row>c<column>.tif`` of ``tile_cells`` squared; ``tile, path`` of what is written when that is computed.

    Missing cells and nulls get the type's value for missing data. A tile is the unit that a task holds.
    """
    missing = default_no_data(kind)

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = int(key[0]), int(key[1])
        shape = (min(tile_cells, grid.size_y - row * tile_cells), min(tile_cells, grid.size_x - col * tile_cells))
        y, x = pdf.cy.to_numpy(np.int64) - row * tile_cells, pdf.cx.to_numpy(np.int64) - col * tile_cells
        planes = {}
        for b in bands:
            planes[b] = np.full(shape, missing, kind)
            there = pdf[b].notna().to_numpy()
            planes[b][y[there], x[there]] = pdf[b].to_numpy()[there].astype(kind)
        cell = grid.cell * grid.scale
        raster = Raster(planes, grid.x0 * grid.scale + col * tile_cells * cell, grid.y0 * grid.scale - row * tile_cells * cell, cell, epsg, missing)
        path = f"{folder.rstrip('/')}/r{row}c{col}.tif"
        with WholeFile(path) as file:
            file.write(encode(raster))
        return pd.DataFrame({"tile": [f"r{row}c{col}"], "path": [path]})

    key = [F.floor(F.col(c) / tile_cells).cast("int").alias(f"tile_{c[1]}") for c in ("cy", "cx")]
    return cells.select(*key, "cx", "cy", *bands).groupBy("tile_y", "tile_x").applyInPandas(write, "tile string, path string")


def read_tiles(spark: SparkSession, path: str, bands: list[str], grid: GridSpec) -> DataFrame:
    """``tile, cx, cy`` and the named bands as doubles of the files below a folder or glob; missing data is null, cells without any are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                r = decode(raw)
                cell = grid.cell * grid.scale
                col, row = round((r.x0 - grid.x0 * grid.scale) / cell), round((grid.y0 * grid.scale - r.y0) / cell)
                values = np.stack([r.bands[b].astype(float) for b in bands])
                gone = np.isnan(values) if r.no_data is None else np.isnan(values) | (values == r.no_data)
                y, x = np.nonzero(~gone.all(axis=0))
                tile = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                cols = [pa.array(values[i, y, x], mask=gone[i, y, x]) for i in range(len(bands))]
                yield pa.record_batch(
                    [pa.array([tile] * len(y)), pa.array((x + col).astype(np.int32)), pa.array((y + row).astype(np.int32)), *cols],
                    names=["tile", "cx", "cy", *bands]
                )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][iI][fF]").load(path).select("path", "content")
    return files.mapInArrow(read, "tile string, cx int, cy int, " + ", ".join(f"{b} double" for b in bands))

"""LAS point files: headers, variable length records, points; and a writer.

Headers are read as byte ranges: the header block, the records before the points and the extended ones behind them. Points are read
by splits of ``SPLIT_POINTS`` records, each a byte range of its own, so a file of any size is spread over tasks and a
task holds one batch of records. Files are found by Spark's own listing. Compressed files give their header only.
"""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.model import POINTS
from stratagrid.sources.storage import RangeReader, WholeFile

# Least record length of each point format, and where time, colour and near infrared stand.
RECORD_LENGTH = (20, 28, 26, 34, 57, 63, 30, 36, 38, 59, 67)
_COLOUR_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
_TIME_AT = {1: 20, 3: 20, 4: 20, 5: 20, **{k: 22 for k in range(6, 11)}}
_NIR_AT = {8: 36, 10: 36}

#: Length of a header of version 1.4, the longest.
HEADER = 375
#: Records of a batch and of a split.
BATCH = 200_000
SPLIT_POINTS = 1 << 21

HEADER_SCHEMA = (
    "path string, file_source int, global_encoding int, version string, system string, software string, created date, header_size int, points_at long, vlr_count long, "
    "format int, compressed boolean, record_length int, points long, by_return array<long>, x_scale double, y_scale double, z_scale double, x_offset double, y_offset double, z_offset double, "
    "x_max double, x_min double, y_max double, y_min double, z_max double, z_min double, evlr_at long, evlr_count long, vlrs array<struct<user_id:string,record_id:int,description:string,payload:binary>>, wkt string"
)


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("latin-1").strip()


def _records(raw: bytes, at: int, count: int, extended: bool) -> Iterator[dict]:
    """Records one after another; a count or length beyond the bytes ends the list."""
    head = 60 if extended else 54
    for _ in range(count):
        if at + head > len(raw):
            return
        user, record = raw[at + 2 : at + 18], struct.unpack_from("<H", raw, at + 18)[0]
        size = struct.unpack_from("<Q" if extended else "<H", raw, at + 20)[0]
        if at + head + size > len(raw):
            return
        text = raw[at + head - 32 : at + head]
        yield {"user_id": _text(user), "record_id": record, "description": _text(text), "payload": raw[at + head : at + head + size]}
        at += head + size


def created_on(year: int, day: int) -> datetime.date | None:
    """Date of a year and a day of the year; a day off the year is held to it, without a year there is none."""
    if not 1 <= year <= 9999 or not day:
        return None
    days = (datetime.date(year, 12, 31) - datetime.date(year, 1, 1)).days + 1
    return datetime.date(year, 1, 1) + datetime.timedelta(days=min(day, days) - 1)


def parse_header(raw: bytes) -> dict:
    """The header block of versions 1.0 to 1.4."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    source, encoding = struct.unpack_from("<HH", raw, 4)
    major, minor = raw[24], raw[25]
    day, year, header_size, points_at, vlrs, form, length, points = struct.unpack_from("<HHHIIBHI", raw, 90)
    by_return = list(struct.unpack_from("<5I", raw, 111))
    numbers = struct.unpack_from("<12d", raw, 131)
    evlr_at = evlr_count = 0
    if (major, minor) >= (1, 4):
        evlr_at, evlr_count, points = struct.unpack_from("<QIQ", raw, 235)
        by_return = list(struct.unpack_from("<15Q", raw, 255))
    names = ("x_scale", "y_scale", "z_scale", "x_offset", "y_offset", "z_offset", "x_max", "x_min", "y_max", "y_min", "z_max", "z_min")
    return dict(zip(names, numbers, strict=True)) | {
        "file_source": source, "global_encoding": encoding, "version": f"{major}.{minor}", "system": _text(raw[26:58]), "software": _text(raw[58:90]), "created": created_on(year, day), "header_size": header_size,
        "points_at": points_at, "vlr_count": vlrs, "format": form & 63, "compressed": bool(form & 128), "record_length": length, "points": points, "by_return": by_return, "evlr_at": evlr_at, "evlr_count": evlr_count,
    }


def read_header(file: RangeReader | bytes) -> dict:
    """Header of a file with its variable length records; the points between them are not read."""
    read, size = (file.read, file.size) if isinstance(file, RangeReader) else (lambda at, n: file[at : at + n], len(file))
    out = parse_header(read(0, HEADER))
    before = read(0, out["points_at"] if out["vlr_count"] else 0)
    behind = read(out["evlr_at"], size - out["evlr_at"]) if out["evlr_count"] else b""
    records = [*_records(before, out["header_size"], out["vlr_count"], False), *_records(behind, 0, out["evlr_count"], True)]
    wkt = next((_text(r["payload"]) for r in records if r["user_id"] == "LASF_Projection" and r["record_id"] == 2112), None)
    return out | {"vlrs": records, "wkt": wkt}


def decode_points(raw: bytes, form: int, length: int) -> dict[str, np.ndarray | None]:
    """Columns of ``POINTS`` but for ``tile`` and ``seq``, of whole records."""
    if form >= len(RECORD_LENGTH) or length < RECORD_LENGTH[form]:
        raise ValueError(f"point format {form} with records of {length} bytes can't be read")
    rec = np.frombuffer(raw, np.uint8).reshape(-1, length)

    def field(at: int, kind: str) -> np.ndarray:
        kind = np.dtype(kind)
        return np.ascontiguousarray(rec[:, at : at + kind.itemsize]).view(kind)[:, 0]

    out = {"x_raw": field(0, "<i4"), "y_raw": field(4, "<i4"), "z_raw": field(8, "<i4"), "intensity": field(12, "<u2")}
    flags = rec[:, 14]
    if form < 6:
        cls = rec[:, 15]
        out |= {"return_number": flags & 7, "number_of_returns": flags >> 3 & 7, "scan_direction": flags & 64 != 0, "edge": flags & 128 != 0}
        out |= {
            "classification": cls & 31, "synthetic": cls & 32 != 0, "key_point": cls & 64 != 0, "withheld": cls & 128 != 0, "overlap": cls & 31 == 12
        }
        out |= {"scan_angle_raw": np.rint(np.ascontiguousarray(rec[:, 16]).view(np.int8) / 0.006), "source_id": field(18, "<u2")}
    else:
        more = rec[:, 15]
        out |= {"return_number": flags & 15, "number_of_returns": flags >> 4, "scan_direction": more & 64 != 0, "edge": more & 128 != 0}
        out |= {
            "classification": rec[:, 16], "synthetic": more & 1 != 0, "key_point": more & 2 != 0, "withheld": more & 4 != 0, "overlap": more & 8 != 0
        }
        out |= {"scan_angle_raw": field(18, "<i2"), "source_id": field(20, "<u2")}
    out["gps_time"] = field(_TIME_AT[form], "<f8") if form in _TIME_AT else None
    for i, c in enumerate(("red", "green", "blue")):
        out[c] = field(_COLOUR_AT[form] + 2 * i, "<u2") if form in _COLOUR_AT else None
    out["nir"] = field(_NIR_AT[form], "<u2") if form in _NIR_AT else None
    return out


def list_clouds(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the point files below a folder or glob, whatever the case of their extension."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[lL][aA][sSzZ]").load(path)
    return found.select("path", "length")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file."""
    names = [c.split(" ")[0] for c in HEADER_SCHEMA.split(", ")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf.path:
                with RangeReader(p) as file:
                    rows.append({"path": p} | read_header(file))
            yield pd.DataFrame(rows, columns=names)

    return list_clouds(spark, path).select("path").mapInPandas(decode, HEADER_SCHEMA)


def cloud_info(headers: DataFrame) -> DataFrame:
    """The figures of a header that a list of files shows."""
    name = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    return headers.select(
        name.alias("tile"), "version", "format", "record_length", "points", F.size("vlrs").alias("records"), "created", "x_scale", "y_scale", "z_scale", "x_offset", "y_offset", "z_offset",
        "x_min", "x_max", "y_min", "y_max", "z_min", "z_max", "wkt",
    )


def _kinds() -> list[tuple[str, pa.DataType]]:
    arrow = {"integer": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
    return [(f.name, arrow[f.dataType.typeName()]) for f in POINTS.fields[2:]]


def read_points(spark: SparkSession, path: str, split_points: int = SPLIT_POINTS) -> DataFrame:
    """All points of uncompressed files, raw coordinates. ``seq`` is a point's place in its file."""
    heads = read_headers(spark, path).select("path", "format", "compressed", "record_length", "points_at", "points")
    n = heads.agg(F.sum(F.ceil(F.col("points") / split_points))).first()[0] or 0
    splits = heads.filter("points > 0").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("points") - 1, F.lit(split_points).cast("long"))).alias("first")
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["compressed"]:
                    raise ValueError(f"{row['path']} is compressed")
                length, tile = row["record_length"], row["path"].rsplit("/", 1)[-1].rsplit(".", 1)[0]
                stop = min(row["first"] + split_points, row["points"])
                with RangeReader(row["path"]) as file:
                    for start in range(row["first"], stop, BATCH):
                        raw = file.read(row["points_at"] + start * length, min(BATCH, stop - start) * length)
                        if len(raw) < min(BATCH, stop - start) * length:
                            raise ValueError(f"{row['path']} ends before its last point")
                        cols = decode_points(raw, row["format"], length)
                        count = len(raw) // length
                        arrays = [pa.array(cols[c]).cast(t, safe=False) if cols[c] is not None else pa.nulls(count, t) for c, t in _kinds()]
                        yield pa.record_batch([pa.array([tile] * count), pa.array(np.arange(start, start + count)), *arrays], names=POINTS.names)

    return splits.repartition(max(1, min(n, 1 << 16))).mapInArrow(decode, POINTS)


def encode_points(points: pd.DataFrame, form: int) -> bytes:
    """Records of a point format from rows of ``POINTS``; missing columns and nulls are 0. Formats below 6 hold 7 returns and 32 classes."""
    n = len(points)
    rec = np.zeros((n, RECORD_LENGTH[form]), np.uint8)

    def col(c: str, kind: type = np.int64) -> np.ndarray:
        return points[c].fillna(0).to_numpy(kind) if c in points else np.zeros(n, kind)

    def put(at: int, values: np.ndarray, kind: str) -> None:
        raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(n, -1)
        rec[:, at : at + raw.shape[1]] = raw

    for k, c in enumerate(("x_raw", "y_raw", "z_raw")):
        put(4 * k, col(c), "<i4")
    put(12, col("intensity"), "<u2")
    most = 7 if form < 6 else 15
    rn, of = np.minimum(col("return_number"), most), np.minimum(col("number_of_returns"), most)
    marks = col("synthetic") | col("key_point") << 1 | col("withheld") << 2
    way = col("scan_direction") << 6 | col("edge") << 7
    if form < 6:
        put(14, rn | of << 3 | way, "u1")
        put(15, col("classification") & 31 | marks << 5, "u1")
        put(16, np.clip(np.rint(col("scan_angle_raw") * 0.006), -128, 127), "i1")
        put(18, col("source_id"), "<u2")
    else:
        put(14, rn | of << 4, "u1")
        put(15, marks | col("overlap") << 3 | way, "u1")
        put(16, col("classification"), "u1")
        put(18, col("scan_angle_raw"), "<i2")
        put(20, col("source_id"), "<u2")
    if form in _TIME_AT:
        put(_TIME_AT[form], col("gps_time", float), "<f8")
    if form in _COLOUR_AT:
        for i, c in enumerate(("red", "green", "blue")):
            put(_COLOUR_AT[form] + 2 * i, col(c), "<u2")
    if form in _NIR_AT:
        put(_NIR_AT[form], col("nir"), "<u2")
    return rec.tobytes()


def encode_record(user_id: str, record_id: int, payload: bytes, description: str = "", extended: bool = False) -> bytes:
    return struct.pack("<H16sH" + ("Q" if extended else "H") + "32s", 0, user_id.encode(), record_id, len(payload), description.encode()) + payload


def encode_header(
    count: int, by_return: list[int], bounds: list[tuple[float, float]], form: int, scale: tuple[float, ...], offset: tuple[float, ...], records: bytes, n_records: int, n_extended: int, day: tuple[int, int], system: str = "", software: str = ""
) -> bytes:
    """A header of version 1.4 for points that follow ``records``; ``bounds`` are (least, greatest) by axis."""
    at, old = HEADER + len(records), count if form < 6 and count < 1 << 32 else 0
    few = [n if old else 0 for n in by_return[:5]]
    head = b"LASF" + struct.pack(
        "<HH16sBB32s32sHHHIIBHI5I", 0, 16 if form > 5 else 0, b"", 1, 4, system.encode(), software.encode(), *day, HEADER, at, n_records, form,
        RECORD_LENGTH[form], old, *few
    )
    head += struct.pack("<12d", *scale, *offset, *(v for low, high in bounds for v in (high, low)))
    behind = at + count * RECORD_LENGTH[form] if n_extended else 0
    return head + struct.pack("<QQIQ15Q", 0, behind, n_extended, count, *by_return)


def patch_header(head: bytes, created: datetime.date | None = None, offsets: tuple[float, float, float] | None = None) -> bytes:
    """A header block with another date of creation or other offsets; its bounds move with the offsets."""
    out = bytearray(head)
    if created is not None:
        struct.pack_into("<HH", out, 90, created.timetuple().tm_yday, created.year)
    if offsets is not None:
        before = struct.unpack_from("<3d", out, 155)
        struct.pack_into("<3d", out, 155, *offsets)
        bounds = struct.unpack_from("<6d", out, 179)
        struct.pack_into("<6d", out, 179, *(v + offsets[i // 2] - before[i // 2] for i, v in enumerate(bounds)))
    return bytes(out)


def encode_file(
    points: pd.DataFrame, scale: float = 0.001, offset: tuple[float, float, float] = (0.0, 0.0, 0.0), wkt: str = "", day: tuple[int, int] = (1, 2024),
    form: int = 6
) -> bytes:
    """A whole file from rows of ``POINTS``."""
    n = len(points)
    records = encode_record("LASF_Projection", 2112, wkt.encode() + b"\0", "WKT") if wkt else b""
    rn = points["return_number"].fillna(0).to_numpy(np.int64) if "return_number" in points else np.zeros(n, np.int64)
    axes = [points[c].to_numpy(np.int64) for c in ("x_raw", "y_raw", "z_raw")]
    bounds = [(a.min() * scale + o, a.max() * scale + o) if n else (0.0, 0.0) for a, o in zip(axes, offset, strict=True)]
    head = encode_header(n, np.bincount(rn, minlength=16)[1:16].tolist(), bounds, form, (scale,) * 3, offset, records, int(bool(wkt)), 0, day)
    return head + records + encode_points(points, form)


def write_points(
    points: DataFrame, folder: str, form: int = 6, scale: tuple[float, float, float] = (0.001,) * 3, offset: tuple[float, float, float] = (0.0, 0.0, 0.0), wkt: str = "", day: tuple[int, int] = (1, 2024),
    records: list[tuple[str, int, bytes]] = (), extended: list[tuple[str, int, bytes]] = (),
) -> DataFrame:
    """Write one file ``<tile>.las`` for each tile, in any point format; ``tile, path, points`` of what is written when that is computed.

    Counts and bounds come first, as a row of their own before a tile's points, which are then streamed in the order of ``seq``: a
    task holds a batch of points, whatever the size of the tile. A file appears when it is whole.
    """
    have = [c for c in POINTS.names if c in points.columns]
    returns = F.array(*(F.count_if(F.col("return_number") == k) for k in range(1, 16)))
    span = F.array(*(f(c).cast("long") for c in ("x_raw", "y_raw", "z_raw") for f in (F.min, F.max)))
    heads = points.groupBy("tile").agg(F.struct(F.count("*").alias("n"), returns.alias("returns"), span.alias("span")).alias("head"))
    kind = dict(heads.dtypes)["head"]
    order = F.col("seq") if "seq" in have else F.lit(0).cast("long")
    rows = points.select(*have, F.lit(None).cast(kind).alias("head"), order.alias("_order"), F.lit(1).alias("_kind"))
    firsts = heads.select(
        *(F.col("tile") if c == "tile" else F.lit(None).cast(dict(points.dtypes)[c]).alias(c) for c in have), "head",
        F.lit(0).cast("long").alias("_order"), F.lit(0).alias("_kind")
    )
    before = [("LASF_Projection", 2112, wkt.encode() + b"\0"), *records] if wkt else list(records)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, out = None, []
        front, back = b"".join(encode_record(*r) for r in before), b"".join(encode_record(*r, extended=True) for r in extended)

        def close() -> None:
            file.write(back)
            file.__exit__(None)

        try:
            for batch in batches:
                kinds = batch.column("_kind").to_numpy()
                cuts = np.flatnonzero(kinds == 0).tolist()
                for a, b in zip([0, *cuts], [*cuts, len(kinds)], strict=True):
                    if a < b and kinds[a] == 0:
                        if file:
                            close()
                        head, tile = batch.column("head")[a].as_py(), batch.column("tile")[a].as_py()
                        path = f"{folder.rstrip('/')}/{tile}.las"
                        file = WholeFile(path)
                        bounds = [(head["span"][2 * k] * scale[k] + offset[k], head["span"][2 * k + 1] * scale[k] + offset[k]) for k in range(3)]
                        file.write(encode_header(
                            head["n"], head["returns"], bounds, form, scale, offset, front, len(before), len(extended), day
                        ) + front)
                        out.append((tile, path, head["n"]))
                        a += 1
                    if a < b:
                        file.write(encode_points(batch.slice(a, b - a).drop_columns(["head"]).to_pandas(), form))
            if file:
                close()
        except BaseException as error:
            if file:
                file.__exit__(type(error))
            raise
        yield pa.record_batch(
            [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["tile", "path", "points"]
        )

    dealt = rows.unionByName(firsts).repartition("tile").sortWithinPartitions("tile", "_kind", "_order")
    return dealt.mapInArrow(write, "tile string, path string, points long")


def set_header(headers: DataFrame, created=None, offsets: tuple[float, float, float] | None = None) -> DataFrame:
    """Headers with another date of creation or other offsets."""
    new = {}
    if created is not None:
        new["created"] = F.lit(created).cast("date")
    if offsets is not None:
        new |= {f"{a}_offset": F.lit(o) for a, o in zip("xyz", offsets, strict=True)}
        new |= {
            f"{a}_{m}": F.col(f"{a}_{m}") + (F.lit(o) - F.col(f"{a}_offset")) for a, o in zip("xyz", offsets, strict=True) for m in ("min", "max")
        }
    return headers.withColumns(new) if new else headers


def rewrite_headers(
    spark: SparkSession, path: str, folder: str, created: datetime.date | None = None, offsets: tuple[float, float, float] | None = None
) -> DataFrame:
    """Copies of files in ``folder`` with the header changed; ``path`` of each, written when that is computed."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for name in batch.column("path").to_pylist():
                done.append(f"{folder.rstrip('/')}/{name.rsplit('/', 1)[-1]}")
                with RangeReader(name) as file, WholeFile(done[-1]) as out:
                    out.write(patch_header(file.read(0, HEADER), created, offsets))
                    for at in range(HEADER, file.size, 1 << 24):
                        out.write(file.read(at, 1 << 24))
            yield pa.record_batch([pa.array(done, pa.string())], names=["path"])

    return list_clouds(spark, path).select("path").mapInArrow(copy, "path string")

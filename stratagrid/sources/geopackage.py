"""GeoPackage point layers: one file for each tile, written and read with the standard library's SQLite."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stratagrid.sources.storage import WholeFile

# Marks and tables that the format asks for.
_APPLICATION, _VERSION = 0x47504B47, 10300
_TABLES = (
    "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER NOT NULL PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)",
    "CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)",
    "CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name))",
)
_TYPES = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "string": "TEXT"}


def _point(x: float, y: float, srs: int) -> bytes:
    return b"GP\0\x01" + struct.pack("<i", srs) + struct.pack("<BIdd", 1, 1, x, y)


def _place(geometry: bytes) -> tuple[float, float]:
    envelope = (0, 32, 48, 48, 64)[geometry[3] >> 1 & 7]
    at = 8 + envelope
    return struct.unpack_from("<dd" if geometry[at] else ">dd", geometry, at + 5)


def encode_layer(rows: pd.DataFrame, layer: str, kinds: dict[str, str], epsg: int, stamp: str = "2024-01-01T00:00:00Z") -> bytes:
    """A file with one layer of points at ``x, y``; the other columns of ``kinds`` are its fields."""
    fields = [c for c in kinds if c not in ("x", "y")]
    db = sqlite3.connect(":memory:")
    db.execute(f"PRAGMA application_id = {_APPLICATION}")
    db.execute(f"PRAGMA user_version = {_VERSION}")
    for sql in _TABLES:
        db.execute(sql)
    systems = [("undefined cartesian", -1, "NONE", -1, "undefined", ""), ("undefined geographic", 0, "NONE", 0, "undefined", "")]
    if epsg > 0:
        systems.append((f"EPSG:{epsg}", epsg, "EPSG", epsg, f"EPSG:{epsg}", ""))
    db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, ?)", systems)
    box = [float(f(rows[c])) if len(rows) else None for f, c in ((min, "x"), (min, "y"), (max, "x"), (max, "y"))]
    db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', ?, ?, ?, ?, ?, ?)", (layer, layer, stamp, *box, epsg))
    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POINT', ?, 0, 0)", (layer, epsg))
    db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, geom POINT, ' + ", ".join(f'"{c}" {_TYPES[kinds[c]]}' for c in fields) + ")")
    own = rows.astype(object).where(rows.notna(), None)
    marks = ", ".join("?" * (1 + len(fields)))
    quoted = ", ".join(f'"{c}"' for c in fields)
    db.executemany(
        f'INSERT INTO "{layer}" (geom, {quoted}) VALUES ({marks})',
        [(_point(x, y, epsg), *rest) for x, y, *rest in own[["x", "y", *fields]].itertuples(index=False)]
    )
    db.commit()
    return db.serialize()


def write_layers(points: DataFrame, folder: str, layer: str, epsg: int = 0) -> DataFrame:
    """Write points ``tile, x, y`` and more as a file ``<tile>.gpkg`` for each tile; ``tile, path, features`` of what is written when that is computed."""
    kinds = {c: t for c, t in points.dtypes if c != "tile"}

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder.rstrip('/')}/{key[0]}.gpkg"
        with WholeFile(path) as file:
            file.write(encode_layer(pdf.drop(columns="tile"), layer, kinds, epsg))
        return pd.DataFrame({"tile": [key[0]], "path": [path], "features": [len(pdf)]})

    return points.groupBy("tile").applyInPandas(write, "tile string, path string, features long")


def read_layers(spark: SparkSession, path: str, layer: str, schema: T.StructType) -> DataFrame:
    """``tile, x, y`` and the fields of ``schema`` from the layer of that name in the files below a folder or glob."""
    fields = [f.name for f in schema.fields]
    full = T.StructType([
        T.StructField("tile", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), *schema.fields
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(raw)
                quoted = ", ".join(f'"{c}"' for c in fields)
                rows = db.execute(f'SELECT geom, {quoted} FROM "{layer}" ORDER BY fid').fetchall()
                tile = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield pd.DataFrame([(tile, *_place(g), *rest) for g, *rest in rows], columns=["tile", "x", "y", *fields])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gpkg").load(path).select("path", "content")
    return files.mapInPandas(read, full)


def layer_counts(spark: SparkSession, path: str) -> DataFrame:
    """``file, layer, features`` of all layers in the files below a folder or glob."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(raw)
                for (layer,) in db.execute("SELECT table_name FROM gpkg_contents ORDER BY 1").fetchall():
                    rows.append((name.rsplit("/", 1)[-1], layer, db.execute(f'SELECT count(*) FROM "{layer}"').fetchone()[0]))
            yield pd.DataFrame(rows, columns=["file", "layer", "features"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gpkg").load(path).select("path", "content")
    return files.mapInPandas(read, "file string, layer string, features long")

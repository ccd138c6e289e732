"""XML documents: virtual rasters and disk benchmarks; and raster tables."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vrt(text: str) -> dict:
    """A virtual raster document: size, system, transform and bands with their sources."""
    root = ET.fromstring(text)
    bands = []
    for b in root.findall("VRTRasterBand"):
        sources = []
        for s in [x for x in b if x.tag.endswith("Source")]:
            rect = {f"dst_{k}": float(v) for k, v in s.find("DstRect").attrib.items()} if s.find("DstRect") is not None else {}
            sources.append({"kind": s.tag, "file": s.findtext("SourceFilename"), "band": int(s.findtext("SourceBand", "1"))} | rect)
        bands.append({
            "name": b.findtext("Description"), "type": b.get("dataType"), "no_data": b.findtext("NoDataValue"), "colour": b.findtext("ColorInterp"),
            "block": (b.get("blockXSize"), b.get("blockYSize")), "sources": sources
        })
    transform = [float(x) for x in root.findtext("GeoTransform", "0,1,0,0,0,-1").split(",")]
    return {
        "size_x": int(root.get("rasterXSize")), "size_y": int(root.get("rasterYSize")), "srs": root.findtext("SRS"), "transform": transform,
        "bands": bands
    }


def write_vrt(doc: dict) -> str:
    root = ET.Element("VRTDataset", rasterXSize=str(doc["size_x"]), rasterYSize=str(doc["size_y"]))
    if doc.get("srs"):
        ET.SubElement(root, "SRS").text = doc["srs"]
    ET.SubElement(root, "GeoTransform").text = ", ".join(repr(float(x)) for x in doc["transform"])
    for i, b in enumerate(doc["bands"], 1):
        size = {k: v for k, v in zip(("blockXSize", "blockYSize"), b.get("block") or (None, None), strict=True) if v}
        band = ET.SubElement(root, "VRTRasterBand", dataType=b["type"], band=str(i), **size)
        for tag, key in (("Description", "name"), ("NoDataValue", "no_data"), ("ColorInterp", "colour")):
            if b.get(key) is not None:
                ET.SubElement(band, tag).text = str(b[key])
        for s in b["sources"]:
            src = ET.SubElement(band, s.get("kind", "ComplexSource"))
            ET.SubElement(src, "SourceFilename", relativeToVRT="1").text = s["file"]
            ET.SubElement(src, "SourceBand").text = str(s["band"])
            if rect := {k[4:]: repr(v) for k, v in s.items() if k.startswith("dst_")}:
                ET.SubElement(src, "DstRect", **rect)
    return ET.tostring(root, encoding="unicode")


def keep_bands(doc: dict, names: list[str]) -> dict:
    return doc | {"bands": [b for b in doc["bands"] if b["name"] in names]}


def drop_block_size(doc: dict) -> dict:
    return doc | {"bands": [b | {"block": None} for b in doc["bands"]]}


def read_disk_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each run, thread and target: bytes, operations and rates; MB are of 1024² bytes, latencies in microseconds."""
    target = "struct<Path:string,BytesCount:bigint,IOCount:bigint,ReadBytes:bigint,ReadCount:bigint,WriteBytes:bigint,WriteCount:bigint,AverageReadLatencyMilliseconds:double,ReadLatencyStdev:double>"
    schema = f"TimeSpan struct<TestTimeSeconds:double,ThreadCount:int,Thread:array<struct<Id:int,Target:array<{target}>>>>, System struct<ComputerName:string,RunTime:string>"
    runs = spark.read.format("xml").option("rowTag", "Results").schema(schema).load(path)
    threads = runs.select(
        F.col("System.ComputerName").alias("computer"), F.col("System.RunTime").alias("run_time"), F.col("TimeSpan.TestTimeSeconds").alias("seconds"),
        F.explode("TimeSpan.Thread").alias("t")
    )
    targets = threads.select("computer", "run_time", "seconds", F.col("t.Id").alias("thread"), F.explode("t.Target").alias("x"))
    rate = lambda c: F.try_divide(c, F.col("seconds") * (1024.0 * 1024.0))
    return targets.select(
        "computer", "run_time", "seconds", "thread", F.col("x.Path").alias("target"), F.col("x.BytesCount").alias("bytes"), F.col("x.IOCount").alias("operations"),
        rate(F.col("x.BytesCount")).alias("mb_per_s"), rate(F.col("x.ReadBytes")).alias("read_mb_per_s"), rate(F.col("x.WriteBytes")).alias("write_mb_per_s"),
        (F.col("x.AverageReadLatencyMilliseconds") * 1000).alias("read_latency_us"), (F.col("x.ReadLatencyStdev") * 1000).alias("read_latency_sd_us"),
    )


def write_raster(raster: DataFrame, path: str, groups: dict[str, list[str]] | None = None) -> None:
    """One table for each group of bands, partitioned by tile; missing cells stay null."""
    for name, bands in (groups or {"raster": [c for c in raster.columns if c not in ("cx", "cy", "tile")]}).items():
        raster.select("tile", "cx", "cy", *bands).write.mode("overwrite").partitionBy("tile").parquet(f"{path}/{name}")


def read_raster(spark: SparkSession, path: str, group: str = "raster", no_data: float | None = None) -> DataFrame:
    """A written group of bands; NaN and a sentinel become null."""
    df = spark.read.parquet(f"{path}/{group}")
    for c, t in df.dtypes:
        if t in ("double", "float"):
            missing = F.isnan(c) | ((F.col(c) == no_data) if no_data is not None else F.lit(False))
            df = df.withColumn(c, F.when(~missing, F.col(c)))
    return df

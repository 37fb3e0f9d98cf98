"""Readers of the pipeline's inputs. Missing values, in any of their spellings, become null here."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poseframe.functions.text import frame_number, number

STEP_COLUMNS = "frame bigint, time double, utc_time string, left_total_pressure double, right_total_pressure double, max_pressure_foot string"
POSE = "people array<struct<pose_keypoints_2d:array<double>>>"
CAMERAS = "frames array<struct<file_path:string,transform_matrix:array<array<double>>,fl_x:double,fl_y:double,cx:double,cy:double>>"
POSITIONS = "frame_name string, world_position struct<x:double,y:double,z:double>"
#: PLY's number types, and what NumPy calls them.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema; read as text and cast, so that nan and empty fields are null."""
    kinds = [p.strip().rsplit(" ", 1) for p in schema.split(",")]
    raw = spark.read.csv(path, header=True)
    cols = []
    for name, kind in kinds:
        if name not in raw.columns:
            cols.append(F.lit(None).cast(kind).alias(name))
        elif kind in ("double", "float"):
            cols.append(number(F.col(name)).cast(kind).alias(name))
        elif kind == "string":
            cols.append(F.when(F.lower(name) != "nan", F.col(name)).alias(name))
        else:
            cols.append(F.col(name).try_cast(kind).alias(name))
    return raw.select(*cols)


def joints_long(df: DataFrame, key: list[str]) -> DataFrame:
    """Columns {joint}_x, {joint}_y, {joint}_z as rows (key, joint, x, y, z); joints that lack an axis are left out."""
    names = sorted({c[:-2] for c in df.columns if c[-2:] in ("_x", "_y", "_z")})
    whole = [j for j in names if all(f"{j}_{a}" in df.columns for a in "xyz")]
    rows = F.array(*[F.struct(F.lit(j).alias("joint"), *[F.col(f"{j}_{a}").alias(a) for a in "xyz"]) for j in whole])
    return df.select(*key, F.inline(rows))


def channel_position(channels: Column, base: Column | int) -> list[Column]:
    """x, y and z in metres of a node whose channels start at `base` (counted from 0): centimetres in the three after it."""
    return [F.get(channels, base + F.lit(k)).cast("double") / 100 for k in (1, 2, 3)]


def joints_wide(df: DataFrame, key: list[str], joints: list[str]) -> DataFrame:
    """The inverse of joints_long for named joints."""
    at = lambda j, a: F.max(F.when(F.col("joint") == j, F.col(a))).alias(f"{j}_{a}")
    return df.groupBy(*key).agg(*[at(j, a) for j in joints for a in "xyz"])


def parse_subtitles(df: DataFrame, text: str = "value") -> DataFrame:
    """Subtitle blocks of whole files as rows (pos, frame, local_time, latitude, longitude)."""
    block = r"(?s)FrameCnt: ?(\d+).*?(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3})(?:.*?\[latitude: ?(-?[\d.]+)\] ?\[longitude: ?(-?[\d.]+)\])?"
    every = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(FrameCnt: ?\d+.*?(?=FrameCnt:|\z))"), 1), lambda b: F.regexp_extract(b, block, 0))
    rows = df.select(F.posexplode(every).alias("pos", "b"))
    pick = lambda i: F.regexp_extract("b", block, i)
    return rows.where("b != ''").select("pos", pick(1).cast("bigint").alias("frame"), pick(2).try_cast("timestamp_ntz").alias("local_time"), pick(3).try_cast("double").alias("latitude"), pick(4).try_cast("double").alias("longitude"))


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    return parse_subtitles(spark.read.text(path, wholetext=True))


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document for each frame: frame, and the first person's keypoints (x, y, confidence in turn)."""
    raw = spark.read.schema(POSE).json(path, multiLine=True).select("*", F.col("_metadata.file_name").alias("file"))
    return raw.select(frame_number(F.col("file")).alias("frame"), F.get("people", F.lit(0))["pose_keypoints_2d"].alias("keypoints")).where("frame is not null")


def keypoint(index: int, least: float, strict: bool = True) -> list[Column]:
    """x and y of a keypoint whose confidence is above (or at) `least`, else null."""
    at = lambda k: F.get("keypoints", F.lit(3 * index + k))
    sure = at(2) > least if strict else at(2) >= least
    return [F.when(sure, at(0)), F.when(sure, at(1))]


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """frame, position, rotation (row-major 9) and intrinsics; names without a frame number are skipped."""
    raw = spark.read.schema(CAMERAS).json(path, multiLine=True).select(F.explode("frames").alias("f"))
    m = F.col("f.transform_matrix")
    cell = lambda i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
    out = raw.select(
        frame_number(F.col("f.file_path"), r"(\d+)\.[A-Za-z]+$").alias("frame"),
        *[cell(i, 3).alias(n) for i, n in enumerate(("px", "py", "pz"))],
        F.array(*[cell(i, j) for i in range(3) for j in range(3)]).alias("r"),
        "f.fl_x", "f.fl_y", "f.cx", "f.cy",
    )
    return out.where("frame is not null")


def _header(data: bytes) -> tuple[bytes, str, list[tuple[str, int, list[tuple[str, ...]]]]]:
    head, _, body = data.partition(b"end_header")
    body = body[2:] if body[:2] == b"\r\n" else body[1:]
    form, parts = "", []
    for line in head.decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            parts.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            parts[-1][2].append(tuple(w[1:]))
    return body, form, parts


def parse_ply(data: bytes) -> dict[str, pd.DataFrame]:
    """The vertex and face tables of a PLY file, text or binary, whatever number types its header names.

    A face with other than three corners is left out.
    """
    body, form, parts = _header(data)
    order = ">" if "big" in form else "<"
    out: dict[str, pd.DataFrame] = {}
    words, at = (body.split(), 0) if form == "ascii" else ([], 0)
    for name, n, props in parts:
        lists = any(p[0] == "list" for p in props)
        if not lists:
            names = [p[-1] for p in props]
            if form == "ascii":
                grid = np.array(words[at : at + n * len(names)], float).reshape(n, -1)
                at += n * len(names)
                out[name] = pd.DataFrame(grid, columns=names)
            else:
                kind = np.dtype([(p[-1], order + PLY_TYPES[p[0]]) for p in props])
                out[name] = pd.DataFrame({c: np.frombuffer(body, kind, n, at)[c].astype(float) for c in names})
                at += n * kind.itemsize
            continue
        rows = []
        for _ in range(n):
            for p in props:
                if p[0] != "list":
                    at += 1 if form == "ascii" else np.dtype(PLY_TYPES[p[0]]).itemsize
                    continue
                if form == "ascii":
                    k = int(words[at])
                    corners = [int(x) for x in words[at + 1 : at + 1 + k]]
                    at += 1 + k
                else:
                    count, item = np.dtype(order + PLY_TYPES[p[1]]), np.dtype(order + PLY_TYPES[p[2]])
                    k = int(np.frombuffer(body, count, 1, at)[0])
                    corners = np.frombuffer(body, item, k, at + count.itemsize).tolist()
                    at += count.itemsize + k * item.itemsize
                if p[-1].startswith("vert") and k == 3:
                    rows.append(corners)
        out[name] = pd.DataFrame(rows, columns=["i0", "i1", "i2"])
    return out


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices (file, vid, x, y, z) and faces (file, fid, i0, i1, i2); one file is one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def reader(element: str, columns: list[str], key: str):
        def run(batches):
            for pdf in batches:
                for p, c in zip(pdf["path"], pdf["content"], strict=True):
                    t = parse_ply(bytes(c)).get(element)
                    if t is not None:
                        t = t[columns].copy()
                        t.insert(0, key, np.arange(len(t)))
                        t.insert(0, "file", p)
                        yield t

        return run

    vertices = files.mapInPandas(reader("vertex", ["x", "y", "z"], "vid"), "file string, vid bigint, x double, y double, z double")
    return vertices, files.mapInPandas(reader("face", ["i0", "i1", "i2"], "fid"), "file string, fid bigint, i0 int, i1 int, i2 int")


def listed_frames(spark: SparkSession, path: str) -> DataFrame:
    """The image files of a folder in order of their names: place from 0, file name."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.regexp_extract("path", r"^(.*)/", 1).alias("folder"))
    return files.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy("file")) - 1)


def media_kind(name: Column) -> Column:
    """image, animation or video by a file's extension."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff"), "image").when(ext == "gif", "animation").when(ext.isin("mp4", "mov", "avi", "mkv", "webm", "m4v"), "video")

"""Writers and small readers, and streams against the batch operators."""

import pytest
from pyspark.sql import functions as F

from poseframe.functions import vectors as V
from poseframe.functions.text import with_optional
from poseframe.operators import series
from poseframe.sources import readers, writers
from poseframe.streaming import stateful


def test_csv_and_parquet_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, True, 1.23456, None), (2, False, None, "x")], "k int, ok boolean, v double, s string")
    writers.write_csv(df, f"{tmp_path}/csv", decimals=2)
    back = {r["k"]: r for r in readers.read_table(spark, f"{tmp_path}/csv", "k int, ok int, v double, s string").collect()}
    assert (back[1]["ok"], back[1]["v"], back[1]["s"]) == (1, 1.23, None) and (back[2]["ok"], back[2]["v"], back[2]["s"]) == (0, None, "x")
    writers.write_parquet(df, f"{tmp_path}/pq", by=["k"])
    assert spark.read.parquet(f"{tmp_path}/pq").where("k = 2").first()["s"] == "x"
    with pytest.raises(Exception, match="already exists"):
        writers.write_parquet(df, f"{tmp_path}/pq")


def test_joints_there_and_back_and_optional_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "k int, a_x double, a_y double, a_z double, b_x double, b_y double, b_z double")
    assert readers.joints_wide(readers.joints_long(df, ["k"]), ["k"], ["a", "b"]).first() == df.first()
    more = with_optional(df, {"a_x": "double", "gaze_valid": "tinyint"})
    assert dict(more.dtypes)["gaze_valid"] == "tinyint" and more.first()["a_x"] == 1.0


def test_listed_frames_and_kinds(spark, tmp_path):
    for n in ("b.png", "a.jpg", "c.gif"):
        (tmp_path / n).write_bytes(b"x")
    got = [(r["place"], r["file"]) for r in readers.listed_frames(spark, str(tmp_path)).orderBy("place").collect()]
    assert got == [(0, "a.jpg"), (1, "b.png"), (2, "c.gif")]
    kinds = spark.createDataFrame([("a.JPG",), ("b.gif",), ("c.mp4",), ("d",)], "n string").select(readers.media_kind(F.col("n")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["image", "animation", "video", None]


def test_an_inverse_transform_undoes_it(spark):
    m = [[0.0, -2.0, 0.0, 1.0], [2.0, 0.0, 0.0, 2.0], [0.0, 0.0, 2.0, 3.0], [0.0, 0.0, 0.0, 1.0]]
    there = V.rigid(V.literal_rows(m), tuple(F.lit(m[i][3]) for i in range(3)), (F.lit(5.0), F.lit(6.0), F.lit(7.0)))
    back = V.rigid(*V.inverse_transform(m), there)
    got = spark.range(1).select(*[c.alias(n) for n, c in zip("xyz", back, strict=True)]).first()
    assert tuple(round(x, 9) for x in got) == (5.0, 6.0, 7.0)


def stream_of(spark, df, path, parts=2):
    """df's rows in file order as a stream, one file for a batch."""
    rows = df.collect()
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def ended(out, mode, spark, name):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    rows = [(s, f, f % 5 == 0) for f in range(20) for s in (1, 2)]
    df = spark.createDataFrame(rows, "stream long, frame long, flag boolean")
    got = ended(stateful.rolling_any_stream(stream_of(spark, df, tmp_path / "a"), 3), "append", spark, "rolled")
    want = series.rolling_any(df, ["stream"], "frame", "flag", 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("stream", "frame", "flag").collect()))

    walk = spark.createDataFrame([(1, f, "L" if f // 4 % 2 == 0 else "R", 0.1 * f) for f in range(20)], "stream long, frame long, foot string, heel double")
    got = ended(stateful.slip_stream(stream_of(spark, walk, tmp_path / "b")), "append", spark, "held").orderBy("frame").collect()
    fixed = series.slip_corrected(walk.withColumn("x", F.col("heel")), ["stream"], "frame", "foot", {"L": ["heel"], "R": ["heel"]}, [["x"]]).orderBy("frame").collect()
    last = max(r["island"] for r in fixed)
    assert all(abs(g["heel"] - w["x"]) < 1e-9 for g, w in zip(got, fixed, strict=True) if w["island"] < last)

    weights = spark.createDataFrame([(p % 3, float(p)) for p in range(12)], "point int, weight double")
    got = ended(stateful.density_stream(stream_of(spark, weights, tmp_path / "c")), "complete", spark, "dense")
    assert {r["point"]: r["weight"] for r in got.collect()} == {0: 18.0, 1: 22.0, 2: 26.0}


def shuffled(rows, seed):
    import random

    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[1] + rng.uniform(0, 6))


def test_late_frames_in_several_triggers_equal_the_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    from poseframe.streaming import ordered

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.STORE)
    try:
        at = lambda f: datetime(2024, 1, 1) + timedelta(seconds=f)
        rows = [(s, f, at(f), None if f % 11 == 0 else f % 5 == 0) for f in range(40) for s in (1, 2)]
        end = [(s, 9999, at(9999), False) for s in (1, 2)]  # moves the watermark past the last frame
        df = spark.createDataFrame([*shuffled(rows, 1), *end], "stream long, frame long, ts timestamp, flag boolean")
        got = ended(ordered.rolling_any_ordered(stream_of(spark, df, tmp_path / "a", 5), 3), "append", spark, "ordered_flags")
        plain = df.where("frame < 9999").withColumn("flag", F.coalesce("flag", F.lit(False)))
        want = series.rolling_any(plain, ["stream"], "frame", "flag", 3).select("stream", "frame", "flag")
        assert [tuple(r) for r in got.orderBy("stream", "frame").collect()] == [tuple(r) for r in want.orderBy("stream", "frame").collect()]

        walk = [(1, f, at(f), "L" if f // 4 % 2 == 0 else "R", 0.1 * f) for f in range(30)]
        df = spark.createDataFrame([*shuffled(walk, 2), (1, 9999, at(9999), "L", 0.0), (1, 40, None, "L", 0.0)], "stream long, frame long, ts timestamp, foot string, heel double")
        got = ended(ordered.slip_ordered(stream_of(spark, df, tmp_path / "b", 6)), "append", spark, "ordered_slip").orderBy("frame").collect()
        whole = df.where("frame < 9999 and ts is not null").withColumn("x", F.col("heel"))
        fixed = series.slip_corrected(whole, ["stream"], "frame", "foot", {"L": ["heel"], "R": ["heel"]}, [["x"]]).orderBy("frame").collect()
        last = max(r["island"] for r in fixed)
        assert len(got) == 30 and all(abs(g["heel"] - w["x"]) < 1e-9 for g, w in zip(got, fixed, strict=True) if w["island"] < last)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_batch_that_comes_again_leaves_the_same_table(spark, tmp_path):
    from poseframe.streaming import sinks

    df = spark.createDataFrame([(f, f % 3) for f in range(12)], "frame long, obj long")
    double = lambda b: b.withColumn("obj", F.col("obj") * 2)
    out = f"{tmp_path}/out"
    stream = stream_of(spark, df, tmp_path / "in", 3)
    sinks.frames_to(stream, out, f"{tmp_path}/check", double).trigger(availableNow=True).start().awaitTermination(120)
    read = lambda: sorted(map(tuple, sinks.written(spark, out, "frame long, obj long").collect()))
    first = read()
    assert [(f, o) for f, o, _ in first] == [(f, f % 3 * 2) for f in range(12)]
    again = sinks.batch_writer(out, double)
    batch = first[0][2]
    again(spark.createDataFrame([(f, o // 2) for f, o, b in first if b == batch], df.schema), batch)
    again(spark.createDataFrame([(f, o // 2) for f, o, b in first if b == batch], df.schema), batch)
    assert read() == first
    sinks.frames_to(stream, out, f"{tmp_path}/check", double).trigger(availableNow=True).start().awaitTermination(120)
    assert read() == first


@pytest.mark.parametrize("order", ["<", ">"])
def test_byte_ranges_of_a_mesh_are_the_whole_mesh(spark, tmp_path, order):
    import struct

    from poseframe.sources.ply_source import PlySource

    spark.dataSource.register(PlySource)
    form = "binary_little_endian" if order == "<" else "binary_big_endian"
    v = [(float(i), i * 0.5, -float(i), i % 256) for i in range(1000)]
    f = [(i, (i + 1) % 1000, (i + 7) % 1000) for i in range(1500)]
    head = f"ply\nformat {form} 1.0\nelement vertex {len(v)}\nproperty float x\nproperty double y\nproperty float z\nproperty uchar red\nelement face {len(f)}\nproperty list uchar int vertex_indices\nend_header\n"
    body = b"".join(struct.pack(order + "fdfB", *x) for x in v) + b"".join(struct.pack(order + "B3i", 3, *x) for x in f)
    (tmp_path / "a.ply").write_bytes(head.encode() + body)
    quad = head.replace(f"element face {len(f)}", "element face 2")
    (tmp_path / "b.ply").write_bytes(quad.encode() + b"".join(struct.pack(order + "fdfB", *x) for x in v) + struct.pack(order + "B4i", 4, 0, 1, 2, 3) + struct.pack(order + "B3i", 3, 5, 6, 7))
    (tmp_path / "c.txt").write_text("no mesh")
    read = lambda element, path: spark.read.format("ply").option("element", element).option("bytes", "4000").load(str(path))
    a = tmp_path / "a.ply"
    assert read("vertex", a).rdd.getNumPartitions() > 3 and read("face", a).rdd.getNumPartitions() > 3
    for element, twin in zip(("vertex", "face"), readers.read_ply(spark, f"{tmp_path}/*.ply"), strict=True):
        plain = lambda df: sorted((r[0].split("/")[-1], *r[1:]) for r in df.collect())
        assert plain(read(element, tmp_path)) == plain(twin)


def test_aligned_frames_with_and_without_camera_and_gaze(spark, tmp_path):
    from poseframe.sources import tables

    camera = ",".join(tables.CAMERA)
    (tmp_path / "a.csv").write_text(f"time,max_pressure_foot,Head_aligned_x,Head_aligned_y,Head_aligned_z,Toe_aligned_x,{camera},gaze_x,gaze_y,gaze_z,gaze_valid\n0.5,LeftFoot,1,2,nan,9,{','.join(map(str, range(12)))},1,,NaN,1\n1.5,RightFoot,1,2,3,9,{','.join(['nan'] * 12)},nan,nan,nan,0\n")
    (tmp_path / "b.csv").write_text("time,Head_aligned_x,Head_aligned_y,Head_aligned_z,cam_pos_x\n0.5,1,2,3,4\n")
    rows = tables.read_aligned_frames(spark, str(tmp_path / "a.csv")).orderBy("time").collect()
    assert (rows[0]["Head_aligned_x"], rows[0]["Head_aligned_z"], rows[0]["cam_rot_r22"], rows[0]["gaze_y"], rows[0]["gaze_valid"], rows[1]["gaze_valid"], rows[1]["cam_pos_x"]) == (1.0, None, 11.0, None, True, False, None)
    assert "Toe_aligned_x" not in rows[0].asDict()
    bare = tables.read_aligned_frames(spark, str(tmp_path / "b.csv")).first()
    assert (bare["Head_aligned_z"], bare["cam_pos_x"], bare["gaze_valid"], bare["max_pressure_foot"]) == (3.0, None, None, None)


def test_transforms_are_read_and_checked(spark, tmp_path):
    from poseframe.sources import tables

    rows = [(0, [0.0, 0.0, 0.0, 2.0], [1.0, 2.0, 3.0], None), (1, [0.0, 0.0, 0.0], [1.0, 2.0, 3.0], 2.0), (2, [0.0] * 4, [1.0, 2.0, 3.0], 2.0), (3, [0.0, 0.0, 1.0, None], [1.0, 2.0, 3.0], 2.0), (4, [0.0, 0.6, 0.0, 0.8], [1.0, 2.0], 2.0)]
    spark.createDataFrame(rows, "step_idx int, q array<double>, t array<double>, scale double").write.parquet(f"{tmp_path}/t")
    got = {r["step_idx"]: (r["q"], r["t"], r["scale"]) for r in tables.read_step_transforms(spark, f"{tmp_path}/t").collect()}
    assert got[0] == ([0.0, 0.0, 0.0, 1.0], [1.0, 2.0, 3.0], 1.0) and all(got[k][:2] == (None, None) for k in (1, 2, 3, 4))
    one = lambda m: spark.createDataFrame([(m,)], "T_total array<double>")
    m = [2.0, 0, 0, 1, 0, 2, 0, 2, 0, 0, 2, 3, 0, 0, 0, 1]
    there, back, condition = tables.alignment(one([float(x) for x in m]))
    assert abs(there @ back - [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]).max() < 1e-12 and 1 < condition < 100
    for bad, why in (([0.0] * 15 + [1.0], "undone"), ([1.0] * 15, "16 known"), ([1.0] * 16, "last row")):
        with pytest.raises(ValueError, match=why):
            tables.alignment(one(bad))
    with pytest.raises(ValueError, match="several"):
        tables.alignment(one([float(x) for x in m]).union(one([float(x) for x in m])))

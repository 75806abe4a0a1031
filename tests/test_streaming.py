"""Streams end with what the batch form gives."""

import time

import pytest
from pyspark.sql import functions as F

from orbitframe.operators.series import episodes
from orbitframe.plans.certified import block_aabb, block_verdicts
from orbitframe.registry import files
from orbitframe.streaming import blocks


def run(df, name, mode, tmp_path):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_block_bounds(spark, tmp_path):
    rows = [(1, f, g, g, float(f + g), float(f * 2), 0.5, 20.0, 20.0, 20.0) for f in range(40) for g in (0, 1)]
    df = spark.createDataFrame(rows, "traj_id int, frame long, group_id int, atom_id int, x double, y double, z double, lx double, ly double, lz double")
    for k in range(4):
        df.filter((F.col("frame") >= k * 10) & (F.col("frame") < k * 10 + 10)).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    found = run(blocks.stream_block_bounds(stream), "bounds", "complete", tmp_path)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, block_aabb(df).select(*found.columns).collect()))


def test_block_verdicts(spark, tmp_path):
    rows = [(1, f, g, g, float(f % 7 + g), float(f * 0.2), 0.5, 20.0, 20.0, 20.0) for f in range(60) for g in (0, 1)]
    df = spark.createDataFrame(rows, "traj_id int, frame long, group_id int, atom_id int, x double, y double, z double, lx double, ly double, lz double")
    for k in range(6):  # files don't end with blocks
        df.filter((F.col("frame") >= k * 11) & (F.col("frame") < k * 11 + 11)).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = blocks.run_available(blocks.stream_block_verdicts(stream, 4.0), "update")
    names = ["frame_start", "frame_end", "lower", "upper", "verdict"]
    last = found.groupBy("traj_id", "block_id").agg(F.max_by(F.struct(*names), "batch").alias("r")).select("traj_id", "block_id", "r.*")
    assert found.select("batch").distinct().count() > 1
    assert sorted(map(tuple, last.collect()), key=str) == sorted(map(tuple, block_verdicts(df, 4.0).collect()), key=str)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_episodes_wait_for_late_rows(spark, tmp_path, kind):
    """Rows come out of order within the watermark's delay; those behind it are dropped; keys of any type."""
    flags = {"1": "TTFTTTFFTTTTT", "2": "FFTFTTTTTTTTF", "3": "TTTTTTTTTTTTT"}
    rows = [(k, i, c == "T", i * 60) for k, s in flags.items() for i, c in enumerate(s)]
    df = spark.createDataFrame([(k, i, f, t + 1_700_000_000) for k, i, f, t in rows], "traj_id string, frame long, flag boolean, t long")
    df = df.select(F.col("traj_id").cast(kind).alias("traj_id"), "frame", "flag", F.timestamp_seconds("t").alias("ts"))
    late = F.col("frame").isin(3, 4)
    behind = spark.createDataFrame([("1", 0, False, 1_600_000_000)], "traj_id string, frame long, flag boolean, t long").select(F.col("traj_id").cast(kind).alias("traj_id"), "frame", "flag", F.timestamp_seconds("t").alias("ts"))
    end = df.select("traj_id").distinct()
    far = [end.select("traj_id", F.lit(100 + k).cast("long").alias("frame"), F.lit(False).alias("flag"), F.timestamp_seconds(F.lit(1_800_000_000 + k * 10_000_000)).alias("ts")) for k in range(2)]
    parts = [df.filter("frame < 6").filter(~late), df.filter(late), df.filter("frame >= 6"), behind, far[0], far[1]]
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "ep"))
        time.sleep(0.05)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ep"))
    found = {tuple(r) for r in blocks.run_available(blocks.stream_episodes(stream), "append").select("traj_id", "k_s", "k_e").collect()}
    assert found == {tuple(r) for r in episodes(df, "flag").collect()}


def test_occupancy(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "a", m % 3 == 0) for m in range(0, 60, 5)] + [("2024-01-01 05:00:00", "a", True)]
    df = spark.createDataFrame(rows, "t string, key string, flag boolean").select(F.to_timestamp("t").alias("ts"), "key", "flag")
    df.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    found = run(blocks.stream_occupancy(stream), "occupancy", "append", tmp_path).collect()
    assert [(r.n, round(r.share, 6)) for r in found] == [(12, round(4 / 12, 6))]


@pytest.mark.parametrize("kind", ["windows", "sessions"])
def test_windows_and_sessions_over_several_batches(spark, tmp_path, kind):
    """Late rows within the delay count, those behind the watermark don't; both forms end with what the batch form gives."""
    minutes = {"a": [0, 3, 4, 9, 21, 22, 40, 58], "b": [1, 2, 30, 31, 33]}
    rows = sorted((m, k, m % 2 == 0) for k, own in minutes.items() for m in own)
    late = (3, "a", False)
    rows.remove(late)
    closers = [(10_000, "", False), (20_000, "", False)]
    parts = [rows[:4], [late], rows[4:], closers[:1], [(5, "a", True)], closers[1:]]
    schema = "m int, key string, flag boolean"
    stamped = lambda x: spark.createDataFrame(x, schema).select(F.timestamp_seconds(F.lit(1_700_000_040) + F.col("m") * 60).alias("ts"), "key", "flag")
    for part in parts:
        stamped(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    whole = stamped(rows + [late])
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    if kind == "sessions":
        found, plain = blocks.run_available(blocks.stream_sessions(stream, "6 minutes"), "append"), blocks.stream_sessions(whole, "6 minutes")
    else:
        found, plain = blocks.run_available(blocks.stream_occupancy(stream, "10 minutes", slide="5 minutes"), "append"), blocks.stream_occupancy(whole, "10 minutes", slide="5 minutes")
    got = found.filter("key <> ''")
    assert sorted(map(tuple, got.drop("batch").collect())) == sorted(map(tuple, plain.collect()))
    assert got.count() > 4 and spark.read.parquet(str(tmp_path / "in")).count() > whole.count()


def test_files_of_a_stream_do_not_grow(spark, monkeypatch):
    """More rows make more files, of which a batch takes more."""
    monkeypatch.setattr(files, "ROWS", 100)
    rows = spark.range(1000).withColumnRenamed("id", "frame")
    stream = files._stream(spark, rows, ["frame"], 4)
    written = spark.read.parquet(stream._jdf.queryExecution().analyzed().collectLeaves().head().dataSource().options().apply("path"))
    sizes = [r["count"] for r in written.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 10 and max(sizes) < 200
    found = blocks.run_available(stream, "append")
    assert found.select("frame").distinct().count() == found.count() == 1000 and found.select("batch").distinct().count() == 4

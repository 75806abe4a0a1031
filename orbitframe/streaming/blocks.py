"""Streaming forms: block verdicts per micro-batch, contact shares per window, episodes that close when contact ends."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orbitframe.operators.graphs import shared_path
from orbitframe.plans.certified import BLOCK, block_aabb, block_bounds, with_verdict


def stream_block_bounds(coords: DataFrame, size: int = BLOCK) -> DataFrame:
    """Running bounds of a stream of coordinate rows, per group."""
    return block_aabb(coords, size)


def stream_block_verdicts(coords: DataFrame, tau: float, op: str = "<", size: int = BLOCK) -> DataFrame:
    """Running bounds and verdicts of a stream of coordinate rows: both groups are bounded in one aggregation, so a verdict follows without
    a join of streams. A block without one of the groups so far has none."""
    return with_verdict(block_bounds(coords, size), tau, op)


def stream_occupancy(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Share of TRUE flags per window and key of a stream (ts, key, flag); windows begin every `slide`, or follow each other."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "key")
    return rows.agg(F.avg(F.col("flag").cast("double")).alias("share"), F.count(F.lit(1)).alias("n"))


def stream_sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Share of TRUE flags per session and key of a stream (ts, key, flag). A session ends once nothing came for the gap, and is sent when
    the watermark has passed its end; its state is gone then."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), "key")
    return rows.agg(F.avg(F.col("flag").cast("double")).alias("share"), F.count(F.lit(1)).alias("n"))


def stream_episodes(frames: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Episodes [k_s, k_e) of a stream (traj_id, frame, flag, ts) of which rows may be late and out of order.

    Frames wait until the watermark has passed them, then count in order; rows behind the watermark are dropped. An episode is sent
    once a FALSE frame, a gap or the watermark closes it, and a trajectory of which nothing waits and no run is open leaves no state."""
    kind = frames.schema["traj_id"].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, after, waiting = state.get if state.exists else (-1, -1, [])
        waiting = [tuple(w) for w in waiting]
        for pdf in batches:
            waiting += zip(pdf["ms"].tolist(), pdf["frame"].tolist(), pdf["flag"].tolist(), strict=True)
        mark = state.getCurrentWatermarkMs()
        ready, waiting = sorted((w for w in waiting if w[0] <= mark), key=lambda w: w[1]), [w for w in waiting if w[0] > mark]
        closed: list[tuple[Any, int, int]] = []
        for _, frame, flag in ready:
            if start >= 0 and (not flag or frame != after):
                closed.append((key[0], start, after))
                start = -1
            if flag and start < 0:
                start = int(frame)
            after = int(frame) + 1
        if start >= 0 and not waiting and state.hasTimedOut:
            closed.append((key[0], start, after))
            start = -1
        if start < 0 and not waiting:
            if state.exists:
                state.remove()
        else:
            state.update((start, after, waiting))
            state.setTimeoutTimestamp(max(mark + 1, min((w[0] for w in waiting), default=mark + 1)))
        yield pd.DataFrame(closed, columns=["traj_id", "k_s", "k_e"])

    rows = frames.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("traj_id").applyInPandasWithState(step, f"traj_id {kind}, k_s long, k_e long", "start long, after long, waiting array<struct<ms:bigint,frame:bigint,flag:boolean>>", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there, and reads its rows from a table in the shared folder. In update mode the rows carry the batch
    that wrote them, so that the last one of a key is its result."""
    spark = stream.sparkSession
    out = shared_path(spark)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.withColumn("batch", F.lit(0).cast("long")).schema
    return spark.read.schema(schema).parquet(f"{out}/rows")

"""Scans along a key without a task that holds the key: runs, unions, neighbours and running values over ranges of positions.

Positions (frames, starts of spans) are cut into ranges of RANGE. What lies inside a range is one task's work; every range folds to one
row (its first and last value, its total, its open runs), these rows are scanned along the key, and what they say is handed back to the
range's rows. A key of n positions so puts n / RANGE rows into one task, and never its rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a range.
RANGE = 1 << 13
KEYS = ["traj_id"]


def ranged(rows: DataFrame, at: str = "frame") -> DataFrame:
    return rows.withColumn("range_", F.floor(F.col(at) / RANGE).cast("long"))


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)


def runs(series: DataFrame, good: Column, keys: list[str] = KEYS) -> DataFrame:
    """(keys, k_s, k_e) of the maximal half-open runs of consecutive frames where `good` holds. Runs are found within ranges; the open
    ones, which touch a range's edge, two for each range at most, meet in a second step."""
    rows = ranged(series.filter(good).select(*keys, "frame"))
    inner = Window.partitionBy(*keys, "range_").orderBy("frame")
    parts = rows.withColumn("run", F.col("frame") - F.row_number().over(inner)).groupBy(*keys, "range_", "run").agg(F.min("frame").alias("k_s"), (F.max("frame") + 1).alias("k_e"))
    open_ = (F.col("k_s") == F.col("range_") * RANGE) | (F.col("k_e") == (F.col("range_") + 1) * RANGE)
    # Closed runs stay among those of their range, where none adjoins another; the open ones of a key form one more cell.
    parts = parts.withColumn("cell", F.when(open_, -1).otherwise(F.col("range_")))
    along = Window.partitionBy(*keys, "cell").orderBy("k_s")
    fresh = (F.coalesce(F.lag("k_e").over(along) != F.col("k_s"), F.lit(True))).cast("int")
    parts = parts.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along))
    return parts.groupBy(*keys, "cell", "run").agg(F.min("k_s").alias("k_s"), F.max("k_e").alias("k_e")).drop("cell", "run")


def joined(spans: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, k_s, k_e) of spans that share no position, adjoining ones made one: within ranges first, then along the key those that can meet
    one of another range: the first of a range, where a span of an earlier one may end, and the one that reaches its end."""

    def step(rows: DataFrame, cell: str) -> DataFrame:
        along = Window.partitionBy(*keys, cell).orderBy("k_s")
        fresh = F.coalesce(F.lag("k_e").over(along) != F.col("k_s"), F.lit(True)).cast("int")
        rows = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along))
        return rows.groupBy(*keys, cell, "run").agg(F.min("k_s").alias("k_s"), F.max("k_e").alias("k_e")).drop("run")

    local = step(ranged(spans.select(*keys, "k_s", "k_e"), "k_s"), "range_")
    open_ = (F.col("k_s") == F.min("k_s").over(Window.partitionBy(*keys, "range_"))) | (F.col("k_e") >= (F.col("range_") + 1) * RANGE)
    return step(local.select(*keys, "k_s", "k_e", F.when(open_, -1).otherwise(F.col("range_")).alias("cell")), "cell").drop("cell")


def _united(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Unions of overlapping and adjoining spans among those of equal keys."""
    w = Window.partitionBy(*keys).orderBy("k_s", "k_e")
    reach = F.max("k_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("fresh", F.coalesce((F.col("k_s") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("fresh").over(w))
    return rows.groupBy(*keys, "run").agg(F.min("k_s").alias("k_s"), F.max("k_e").alias("k_e")).drop("run")


def unions(spans: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, k_s, k_e) of the unions of overlapping and adjoining spans. After the unions within ranges, a union that ends before
    the reach of earlier ranges is gone, and of each range two at most can meet others: the one at that reach and the last one."""
    local = _united(ranged(spans.select(*keys, "k_s", "k_e"), "k_s"), [*keys, "range_"])
    reach = local.groupBy(*keys, "range_").agg(F.max("k_e").alias("end")).withColumn("reach", F.max("end").over(_before(keys)))
    rows = local.join(reach.drop("end"), [*keys, "range_"]).filter("reach IS NULL OR k_e > reach")
    open_ = (F.col("k_e") >= (F.col("range_") + 1) * RANGE) | F.coalesce(F.col("k_s") <= F.col("reach"), F.lit(False))
    return _united(rows.withColumn("cell", F.when(open_, -1).otherwise(F.col("range_"))), [*keys, "cell"]).drop("cell")


def neighbours(rows: DataFrame, names: list[str], step: int, keys: list[str] = KEYS, at: str = "frame", prefix: str = "near_") -> DataFrame:
    """rows with the values that `names` have in the row before (step -1) or after (1) along the key; null where there is none.
    `at` must tell the rows of a key apart."""
    rows, values = ranged(rows, at), F.struct(*names)
    along = Window.partitionBy(*keys, "range_").orderBy(at)
    edge = (F.max_by if step < 0 else F.min_by)(values, at)
    across = Window.partitionBy(*keys).orderBy("range_")
    edges = rows.groupBy(*keys, "range_").agg(edge.alias("edge")).select(*keys, "range_", F.lag("edge", -step).over(across).alias("edge_"))
    rows = rows.join(edges, [*keys, "range_"]).withColumn("inner_", F.lag(values, -step).over(along))
    # A struct of the range itself is never null, so that null means the range's end.
    near = F.coalesce("inner_", "edge_")
    return rows.withColumns({f"{prefix}{n}": near[n] for n in names}).drop("inner_", "edge_", "range_")


def running(rows: DataFrame, values: dict[str, tuple[str, Column]], keys: list[str] = KEYS, at: str = "frame") -> DataFrame:
    """rows with running values up to each row, rows of the same `at` included: name -> ("sum" or "max", column)."""
    folds = {"sum": F.sum, "max": F.max}
    rows = ranged(rows.withColumns({f"{n}_": c for n, (_, c) in values.items()}), at)
    along = Window.partitionBy(*keys, "range_").orderBy(at)  # by default up to the last row of the same `at`
    whole = rows.groupBy(*keys, "range_").agg(*[folds[f](f"{n}_").alias(n) for n, (f, _) in values.items()])
    before = whole.select(*keys, "range_", *[folds[f](n).over(_before(keys)).alias(f"{n}_before") for n, (f, _) in values.items()])
    rows = rows.join(before, [*keys, "range_"])
    for n, (f, _) in values.items():
        inner, earlier = folds[f](f"{n}_").over(along), F.col(f"{n}_before")
        rows = rows.withColumn(n, F.greatest(inner, earlier) if f == "max" else F.when(inner.isNull() & earlier.isNull(), None).otherwise(F.coalesce(inner, F.lit(0)) + F.coalesce(earlier, F.lit(0))))
    return rows.drop("range_", *[f"{n}_" for n in values], *[f"{n}_before" for n in values])


def counted(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """rows with n, the number of rows of their key, by a join with the counts."""
    return rows.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)

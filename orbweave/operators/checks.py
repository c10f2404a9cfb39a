"""Consistency checks: each returns the rows that break a rule, or counts by state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions import geometry


def misplaced(df: DataFrame, columns: Sequence[str], box: Sequence[float], cells: Sequence[int]) -> DataFrame:
    """Rows whose stored cid isn't that of their place."""
    return df.where(F.col("cid") != geometry.point_cell([F.col(c) for c in columns], box, cells))


def not_useful(points: DataFrame, useful: DataFrame) -> DataFrame:
    return points.join(useful, "cid", "left_anti")


def compared(fast: DataFrame, slow: DataFrame) -> DataFrame:
    """(status, n) of two tables (gid, n): OK, OVER or UNDER, MISS where only the slow one has any."""
    both = fast.select("gid", F.col("n").alias("a")).join(slow.select("gid", F.col("n").alias("b")), "gid", "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    status = F.when(a == b, "OK").when((a == 0) & (b > 0), "MISS").when(a > b, "OVER").otherwise("UNDER")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def differing(left: DataFrame, right: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Points of two results (gid, kernel_idx, overdensity) that one lacks or that differ."""
    r = right.withColumnRenamed("overdensity", "other")
    both = left.join(r, ["gid", "kernel_idx"], "full")
    return both.where(F.col("overdensity").isNull() | F.col("other").isNull() | (F.abs(F.col("overdensity") - F.col("other")) > tolerance)).select("gid", "kernel_idx", "overdensity", "other")


def pyramid(cells: DataFrame, side: int) -> DataFrame:
    """Parents (cubes of 2 x 2 x 2 cells) whose count isn't that of all their children. cells: i, j, k, n, parent_n."""
    up = [F.expr(f"{c} div 2").alias(c) for c in "ijk"]
    return cells.groupBy(*up).agg(F.sum("n").alias("children"), F.max("parent_n").alias("parent")).where("children != parent")


def diagnosis(point: DataFrame, particles: DataFrame, box: Sequence[float], cells: Sequence[int], radius: float) -> DataFrame:
    """About points (gid, gx, gy, gz) and one radius: gid, inside (the box), cid, n (particles in the sphere), nearest (distance of the
    nearest particle in reach, null without one), in_cell (particles of the point's own cell)."""
    from orbweave.operators.kernel import in_reach

    g = [F.col(c) for c in ("gx", "gy", "gz")]
    own = point.select("gid", geometry.inside_box(g, box).alias("inside"), geometry.point_cell(g, box, cells).alias("cid"))
    near = in_reach(point, particles, box, radius).groupBy("gid").agg(F.count("*").alias("n"), F.sqrt(F.min("r2")).alias("nearest"))
    held = particles.select(geometry.point_cell([F.col(c) for c in "xyz"], box, cells).alias("cid")).join(own.select("cid").distinct(), "cid", "left_semi").groupBy("cid").agg(F.count("*").alias("in_cell"))
    out = own.join(near, "gid", "left").join(held, "cid", "left")
    return out.select("gid", "inside", "cid", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "nearest", F.coalesce("in_cell", F.lit(0)).cast("long").alias("in_cell"))

"""Cells: histograms, offsets, neighbours, useful cells, chunks of a file, balanced ranges."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions import geometry


def top_cells(spark: SparkSession, box: Sequence[float], cells: Sequence[int]) -> DataFrame:
    """All cells with indices and places."""
    a, b, c = cells
    ijk = [F.expr(f"cid div {b * c}"), F.expr(f"(cid div {c}) % {b}"), F.expr(f"cid % {c}")]
    out = spark.range(a * b * c).withColumnRenamed("id", "cid").select("cid", *[v.cast("int").alias(n) for v, n in zip(ijk, "ijk", strict=True)])
    return out.select("*", *[(F.col(n) * F.lit(length / m)).alias(f"l{x}") for n, x, length, m in zip("ijk", "xyz", box, cells, strict=True)])


def assign(df: DataFrame, columns: Sequence[str], box: Sequence[float], cells: Sequence[int]) -> DataFrame:
    return df.withColumn("cid", geometry.point_cell([F.col(c) for c in columns], box, cells))


def histogram(df: DataFrame, spark: SparkSession, n_cells: int, mass: str | None = "mass") -> DataFrame:
    """(cid, n, mass) of every cell, empty ones too; df has cid."""
    sums = [F.count("*").alias("n"), *([F.sum(mass).alias("mass")] if mass else [])]
    found = spark.range(n_cells).withColumnRenamed("id", "cid").join(df.groupBy("cid").agg(*sums), "cid", "left")
    return found.select("cid", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *([F.coalesce("mass", F.lit(0.0)).alias("mass")] if mass else []))


def running_start(df: DataFrame, key: str, n: str, stride: int = 4096) -> DataFrame:
    """Adds `start`, the sum of n over smaller keys, in two levels: within blocks of keys, and over the blocks' sums."""
    blocks = df.withColumn("block", F.expr(f"{key} div {stride}"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    sums = blocks.groupBy("block").agg(F.sum(n).alias("total")).withColumn("base", before(Window.orderBy("block"), "total")).select("block", "base")
    inner = blocks.withColumn("within", before(Window.partitionBy("block").orderBy(key), n))
    return inner.join(sums, "block").withColumn("start", F.col("within") + F.col("base")).drop("block", "within", "base")


def reach(radius: float, width: float, cells: int) -> list[int]:
    """Distinct offsets of neighbours on one axis, each once."""
    n = min(math.ceil(radius / width) + 1, cells)
    return sorted({o % cells for o in range(-n, n + 1)})


def neighbours(df: DataFrame, box: Sequence[float], cells: Sequence[int], radius: float) -> DataFrame:
    """(cid, neighbour) of the cells in df, without the cell itself."""
    a, b, c = cells
    out = df.select("cid").distinct()
    for n, expr, length, m in zip("ijk", (f"cid div {b * c}", f"(cid div {c}) % {b}", f"cid % {c}"), box, cells, strict=True):
        out = out.withColumn(f"o{n}", F.explode(F.array(*map(F.lit, reach(radius, length / m, m))))).withColumn(n, (F.expr(expr) + F.col(f"o{n}")) % m)
    return out.select("cid", geometry.cell_number([F.col(n) for n in "ijk"], cells).alias("neighbour")).where("cid != neighbour")


def useful(points: DataFrame, box: Sequence[float], cells: Sequence[int], radius: float) -> DataFrame:
    """Cells with points, and their neighbours."""
    own = points.select("cid").distinct()
    return own.union(neighbours(own, box, cells, radius).select("neighbour")).distinct()


def chunks(cells: DataFrame, gap: float = -1.0, stride: int = 4096) -> DataFrame:
    """Runs of useful cells that are contiguous in the file: (chunk, first_cid, last_cid, start, n). cells: cid, n, start,
    useful. Runs closer than `gap` rows merge. In two levels, as running_start(): within blocks of cells, and over the blocks."""
    within = Window.partitionBy("block").orderBy("cid")
    over = Window.orderBy("block")
    rows = cells.where("useful").select("cid", "n", "start", (F.col("start") + F.col("n")).alias("stop"), F.expr(f"cid div {stride}").alias("block"))
    ends = rows.groupBy("block").agg(F.max("stop").alias("end")).select("block", F.lag("end").over(over).alias("before"))
    last = F.coalesce(F.lag("stop").over(within), F.col("before"))
    far = F.col("start") - F.col("last")
    opens = F.when(F.col("last").isNull() | ((far != 0) & ~(far < F.lit(float(gap)))), 1).otherwise(0)
    marked = rows.join(ends, "block").withColumn("last", last).withColumn("opens", opens)
    bases = marked.groupBy("block").agg(F.sum("opens").alias("n_opens"))
    bases = bases.select("block", F.coalesce(F.sum("n_opens").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = marked.join(bases, "block").withColumn("chunk", F.sum("opens").over(within) + F.col("base") - 1)
    return numbered.groupBy("chunk").agg(F.min("cid").alias("first_cid"), F.max("cid").alias("last_cid"), F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("n"))


def balanced_ranges(counts: DataFrame, parts: int) -> DataFrame:
    """(cid, rank): cells in order fill a rank until it has its share of rows or more. counts: cid, n.

    Where a rank ends depends on where the one before it ended, so the ends are found in order, in one fold that keeps only them;
    cells are then told their rank by the ends.
    """
    share = counts.agg(F.expr(f"sum(n) div {parts}").alias("share"))
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("cid", "n"))).alias("cells")).crossJoin(F.broadcast(share))
    full = f"a.have + c.n >= share AND size(a.ends) < {parts - 1}"
    fold = f"""aggregate(cells, named_struct('have', 0L, 'ends', cast(array() as array<bigint>)),
      (a, c) -> named_struct('have', IF({full}, 0L, a.have + c.n), 'ends', IF({full}, array_append(a.ends, c.cid), a.ends)), a -> a.ends)"""
    ends = listed.select(F.expr(fold).alias("ends"))
    return counts.crossJoin(F.broadcast(ends)).select("cid", F.expr("cast(size(filter(ends, e -> e < cid)) as bigint)").alias("rank"))


def row_positions(points: DataFrame) -> DataFrame:
    """(gid, cid, position): places in the output, by cell and number. points: gid, cid."""
    starts = running_start(points.groupBy("cid").agg(F.count("*").alias("n")), "cid", "n").select("cid", "start")
    own = points.select("gid", "cid", (F.row_number().over(Window.partitionBy("cid").orderBy("gid")) - 1).alias("at"))
    return own.join(starts, "cid").select("gid", "cid", (F.col("start") + F.col("at")).alias("position"))

"""Prepared snapshots (see operators.convert): metadata, cells, and scans of just the particles that a run can need."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import cells as C

#: From this share of useful particles on everything is read.
FULL_SHARE = 0.75
#: Ranges of cells in one filter, at most; beyond it useful cells are joined.
MOST_RANGES = 200
#: Cells that are broadcast, at most.
BROADCAST_CELLS = 1_000_000
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Meta:
    box: tuple[float, ...]
    cells: tuple[int, ...]
    n_total: int
    redshift: float


def read_meta(spark: SparkSession, path: str) -> Meta:
    r = spark.read.parquet(f"{path}/meta").first()
    return Meta(tuple(r["box"]), tuple(r["cdim"]), r["n_total"], r["redshift"])


def everywhere(meta: Meta, radius: float) -> bool:
    """Whether any point reaches all cells."""
    return all(len(C.reach(radius, length / n, n)) == n for length, n in zip(meta.box, meta.cells, strict=True))


def useful_cells(spark: SparkSession, path: str, points: DataFrame, radius: float) -> DataFrame:
    """(cid, n, start, useful) of the snapshot's cells. points: gx, gy, gz."""
    meta = read_meta(spark, path)
    near = C.useful(C.assign(points, ("gx", "gy", "gz"), meta.box, meta.cells), meta.box, meta.cells, radius)
    stored = spark.read.parquet(f"{path}/cells").select("cid", "n", "start")
    return stored.join(near.withColumn("useful", F.lit(True)), "cid", "left").withColumn("useful", F.coalesce("useful", F.lit(False)))


def load(cells: DataFrame) -> DataFrame:
    """One row of counters: cells, useful_cells, occupied_cells, particles, useful_particles, share (of useful particles, 0 if there
    are none), most (particles of the fullest useful cell)."""
    own = lambda c: F.coalesce(F.sum(F.when(F.col("useful"), c)), F.lit(0))
    out = cells.agg(F.count("*").alias("cells"), F.count_if("useful").alias("useful_cells"), F.count_if(F.col("n") > 0).alias("occupied_cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("particles"), own(F.col("n")).alias("useful_particles"), F.coalesce(F.max(F.when(F.col("useful"), F.col("n"))), F.lit(0)).alias("most"))
    return out.withColumn("share", F.when(F.col("particles") > 0, F.col("useful_particles") / F.col("particles")).otherwise(0.0))


def scan(spark: SparkSession, path: str, points: DataFrame, radius: float, gap_fraction: float = 0.01) -> DataFrame:
    """x, y, z, mass of the particles in cells that a sphere can reach, and of short gaps between these.

    Files hold ranges of cells and row groups the least and greatest, so ranges of useful cells, with gaps of fewer than gap_fraction
    of all particles filled, become a filter that the scan pushes down. With very many ranges particles are joined to the useful
    cells instead; from FULL_SHARE on, or where spheres reach everywhere, all are read.
    """
    particles = spark.read.parquet(f"{path}/particles")
    meta, whole = read_meta(spark, path), particles.select("x", "y", "z", "mass")
    if everywhere(meta, radius):
        return whole
    cells = useful_cells(spark, path, points, radius)
    counted = load(cells).first()
    log.info("%d of %d cells and %.1f %% of the particles can be reached", counted["useful_cells"], counted["cells"], 100 * counted["share"])
    if counted["share"] >= FULL_SHARE:
        return whole
    found = C.chunks(cells, gap_fraction * meta.n_total).where("n > 0").select("first_cid", "last_cid").limit(MOST_RANGES + 1).collect()
    if len(found) > MOST_RANGES:
        near = cells.where("useful AND n > 0").select("cid")
        return particles.join(F.broadcast(near) if counted["useful_cells"] <= BROADCAST_CELLS else near, "cid", "left_semi").select("x", "y", "z", "mass")
    inside = [F.col("cid").between(r["first_cid"], r["last_cid"]) for r in found]
    return particles.where(reduce(lambda a, b: a | b, inside) if inside else F.lit(False)).select("x", "y", "z", "mass")


def load_by_range(cells: DataFrame, parts: int) -> DataFrame:
    """(rank, cells, useful_cells, particles, useful_particles, efficiency): cells dealt in order into ranges of near equal numbers
    of particles; efficiency is the mean range's particles over the fullest's."""
    ranks = C.balanced_ranges(cells.select("cid", "n"), parts)
    own = F.coalesce(F.sum(F.when(F.col("useful"), F.col("n"))), F.lit(0))
    by = cells.join(ranks, "cid").groupBy("rank").agg(F.count("*").alias("cells"), F.count_if("useful").alias("useful_cells"), F.sum("n").alias("particles"), own.alias("useful_particles"))
    most = by.agg(F.max("particles").alias("most"), F.avg("particles").alias("mean"))
    return by.crossJoin(F.broadcast(most)).withColumn("efficiency", F.when(F.col("most") > 0, F.col("mean") / F.col("most")).otherwise(1.0)).drop("most", "mean")


def part_offsets(results: DataFrame, part: str = "part") -> DataFrame:
    """(part, n, start): rows of each part of an output and of all parts before it."""
    return C.running_start(results.groupBy(part).agg(F.count("*").alias("n")), part, "n")


def octree(particles: DataFrame, box: Sequence[float], cells: Sequence[int], most: int, deepest: int = 8) -> DataFrame:
    """(level, i, j, k, n): the leaves of cells that are parted in eight while they hold more than `most` particles; level 0 are the
    given cells. Only occupied leaves are listed. All levels' counts are sums of the deepest one's."""
    from orbweave.functions import geometry

    at = [geometry.cell_axis(F.col(x), length, n << deepest).alias(c) for x, c, length, n in zip("xyz", "ijk", box, cells, strict=True)]
    fine = particles.select(*at).groupBy("i", "j", "k").agg(F.count("*").alias("n"))
    every = fine.withColumn("level", F.explode(F.expr(f"sequence(0, {deepest})")))
    up = lambda c, more: F.expr(f"shiftright({c}, {deepest} - level + {more})")
    counts = every.select("level", *[up(c, 0).alias(c) for c in "ijk"], "n").groupBy("level", "i", "j", "k").agg(F.sum("n").alias("n"))
    parents = counts.select((F.col("level") + 1).alias("level"), *[F.col(c).alias(f"up_{c}") for c in "ijk"], F.col("n").alias("above"))
    own = counts.withColumns({f"up_{c}": F.expr(f"IF(level = 0, {c}, shiftright({c}, 1))") for c in "ijk"})
    leaf = (F.col("n") <= most) | (F.col("level") == deepest)
    return own.join(parents, ["level", "up_i", "up_j", "up_k"], "left").where(leaf & ((F.col("level") == 0) | (F.col("above") > most))).select("level", "i", "j", "k", "n")

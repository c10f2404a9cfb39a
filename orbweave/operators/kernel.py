"""The range join: counts and masses of the particles in spheres around points of a periodic box.

Points are copied to the cells that their largest sphere can reach. A cell is judged by its least and greatest distance to the
point: where no particle of it can lie between two radii, the cell's count and mass are taken as a whole; where one can, it is
parted in eight and these are judged, down to cells of a few particles. What is still open then is joined to particles by cell, an
equi-join that shuffles or broadcasts and that adaptive execution can split. Judging needs no data, so all levels are one stage.
A particle or cell counts once, for the smallest sphere that holds it; larger spheres add up the smaller ones' sums, so one pass
serves all radii.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions import cosmology, geometry
from orbweave.operators import dense

G = ("gx", "gy", "gz")
IJK = ("i", "j", "k")
#: Particles of a smallest cell, about, and levels at most.
LEAF, DEEPEST = 256, 6
#: Bits of a cell's number on an axis that are left when all are used: 3 * 20 fit a long.
AXIS_CELLS = 1 << 20
OPEN = -1
#: More partitions than any table has.
STRETCH = 1 << 24
#: Rows for cells that a join may broadcast. Spark takes exploded points for as small as the points they come from, and would send
#: millions of them through the driver.
FEW_ROWS = 1 << 15


@dataclass(frozen=True)
class Levels:
    """Cells on each axis at level 0, the offsets from the point's own that its largest sphere reaches, and the deepest level."""

    cells: tuple[int, ...]
    offsets: tuple[tuple[int, ...], ...]
    deepest: int

    def at(self, level: int) -> list[int]:
        return [n << level for n in self.cells]


def levels(box: Sequence[float], radius: float, particles: int) -> Levels:
    """Level 0 has cells as wide as the radius or wider; the deepest has some LEAF particles a cell."""
    cells = tuple(max(1, min(AXIS_CELLS >> DEEPEST, int(length // radius))) for length in box)
    offsets = []
    for length, n in zip(box, cells, strict=True):
        reach = math.ceil(radius / (length / n))
        offsets.append(tuple(range(n)) if 2 * reach + 1 >= n else tuple(sorted({o % n for o in range(-reach, reach + 1)})))
    per_cell = particles / math.prod(cells)
    return Levels(cells, tuple(offsets), max(0, min(DEEPEST, math.floor(math.log(max(per_cell, 1) / LEAF, 8) + 0.5))))


def copied(points: DataFrame, box: Sequence[float], plan: Levels) -> DataFrame:
    """Points at each level-0 cell in reach: gid, gx, gy, gz, i, j, k. Each cell is listed once, also where spheres are wider than
    the box."""
    out = points.select("gid", *G)
    for a, g, length, n, offsets in zip(IJK, G, box, plan.cells, plan.offsets, strict=True):
        out = out.withColumn(a, F.explode(F.array(*map(F.lit, offsets)))).withColumn(a, (geometry.cell_axis(F.col(g), length, n) + F.col(a)) % n)
    return out


def judged(rows: DataFrame, box: Sequence[float], radii: Sequence[float], cells: Sequence[int]) -> DataFrame:
    """rows with OPEN replaced in the column sphere by the number of the sphere that all of the cell belongs to, where there is one;
    cells beyond all spheres go. Distances are generated, not projected: a projection would be put into every place that uses it,
    and the code of a stage would grow beyond what the JVM compiles."""
    centre = [geometry.to_centre(F.col(c), F.col(g), n, length).alias(f"d{c}") for c, g, n, length in zip(IJK, G, cells, box, strict=True)]
    near2, far2 = geometry.cell_gaps([F.col(f"d{c}") for c in IJK], cells, box)
    near2 = F.when(F.col("sphere") == OPEN, near2).otherwise(0.0).alias("near2")
    gaps = rows.select("*", F.inline(F.array(F.struct(*centre)))).select("*", F.inline(F.array(F.struct(near2, far2.alias("far2")))))
    kept = gaps.where(geometry.in_sphere(F.col("near2"), radii[-1]))
    first, last = (geometry.spheres_beyond(F.col(c), radii) for c in ("near2", "far2"))
    verdict = F.when(F.col("sphere") != OPEN, F.col("sphere")).when(first == last, first).otherwise(OPEN)
    return kept.select("gid", *G, *IJK, "level", verdict.alias("sphere"))


def searched(points: DataFrame, box: Sequence[float], radii: Sequence[float], plan: Levels) -> DataFrame:
    """gid, gx, gy, gz, i, j, k, level, sphere: cells taken whole for a sphere, at any level, and OPEN ones of the deepest."""
    rows = judged(copied(points, box, plan).select("*", F.lit(0).alias("level"), F.lit(OPEN).alias("sphere")), box, radii, plan.cells)
    for level in range(1, plan.deepest + 1):
        parts = F.explode(F.when(F.col("sphere") == OPEN, F.expr("sequence(0, 7)")).otherwise(F.expr("array(-1)")))
        # coalesce() moves no row; it ends a stretch of generated code, which else grows too long for the JVM to compile
        rows = rows.coalesce(STRETCH).select("gid", *G, *IJK, "level", "sphere", parts.alias("part"))
        deeper = [F.when(F.col("part") < 0, F.col(c)).otherwise(F.col(c) * 2 + F.shiftright("part", s).bitwiseAND(1)).alias(c) for c, s in zip(IJK, (2, 1, 0), strict=True)]
        rows = rows.select("gid", *G, *deeper, F.when(F.col("part") < 0, F.col("level")).otherwise(level).alias("level"), "sphere")
        rows = judged(rows, box, radii, plan.at(level))
    return rows.coalesce(STRETCH)


def numbered(rows: DataFrame, plan: Levels, level: int | None = None) -> Column:
    """The cell's number at its level."""
    if level is not None:
        return geometry.cell_number([F.col(c) for c in IJK], plan.at(level))
    at = lambda n: F.call_function("shiftleft", F.lit(n).cast("long"), F.col("level"))
    i, j, k = (F.col(c).cast("long") for c in IJK)
    return (i * at(plan.cells[1]) + j) * at(plan.cells[2]) + k


def most_rows(points: int, plan: Levels, radii: Sequence[float], box: Sequence[float]) -> int:
    """About, and rather too many: searched()'s rows, as all copies and the cells of a cube around each sphere at every deeper level."""
    deeper = sum(math.prod(min(n, 2 * r * n / length + 2) for n, length in zip(plan.at(level), box, strict=True)) for level in range(1, plan.deepest + 1) for r in radii)
    return math.ceil(points * (math.prod(map(len, plan.offsets)) + deeper))


def cell_sums(home: DataFrame, plan: Levels) -> DataFrame:
    """level, cell, n, mass of every occupied cell of every level; upper ones are summed from the deepest. home: i, j, k, mass."""
    leaf = home.groupBy(*IJK).agg(F.count("*").alias("n"), F.sum("mass").alias("mass"))
    up = leaf.withColumn("level", F.explode(F.array(*map(F.lit, range(plan.deepest + 1)))))
    up = up.withColumns({c: F.expr(f"shiftright({c}, {plan.deepest} - level)") for c in IJK})
    return up.withColumn("cell", numbered(up, plan)).groupBy("level", "cell").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by cell. A join makes far more rows than it reads, so that neither the files' splits nor the bytes read tell how
    many tasks it needs; and without this a broadcast join has only those splits."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def homes(particles: DataFrame, box: Sequence[float], plan: Levels) -> DataFrame:
    cells = plan.at(plan.deepest)
    return particles.select("x", "y", "z", "mass", *[geometry.cell_axis(F.col(a), length, n).alias(c) for a, c, length, n in zip(geometry.AXES, IJK, box, cells, strict=True)])


def with_distance(pairs: DataFrame, box: Sequence[float]) -> tuple[DataFrame, Column]:
    """(pairs with the separation on each axis, generated as in judged(); their squared distance)."""
    d = [geometry.apart(F.col(a) - F.col(g), length).alias(f"d{a}") for a, g, length in zip(geometry.AXES, G, box, strict=True)]
    return pairs.select("*", F.inline(F.array(F.struct(*d)))), geometry.squares([F.col(f"d{a}") for a in geometry.AXES])


def beside(rows: DataFrame, many: bool) -> DataFrame:
    """rows for cells as a join may have them: many are sorted and spilled, never broadcast or held in a hash table."""
    return rows.hint("merge") if many else rows


def found_pairs(home: DataFrame, rows: DataFrame, box: Sequence[float], plan: Levels, radius: float, many: bool) -> tuple[DataFrame, Column]:
    """(gid, mass and separations of the particles in the rows' cells, which are of the deepest level, within the radius; squared
    distance). The join itself judges the distance, so that no row is made for the pairs beyond, which are four of five."""
    left = home.select("x", "y", "z", "mass", numbered(home, plan, plan.deepest).alias("cell"))
    left = left if home.isStreaming else spread(left, "cell")
    right = rows.select("gid", *G, numbered(rows, plan, plan.deepest).alias("cell"))
    near = geometry.in_sphere(geometry.distance2([F.col(a) for a in geometry.AXES], [F.col(g) for g in G], box), radius)
    return with_distance(left.join(beside(right, many), "cell").drop("cell").where(near), box)


def sphere_sums(points: DataFrame, particles: DataFrame, box: Sequence[float], radii: Sequence[float], n_particles: int, n_points: int | None = None) -> DataFrame:
    """(gid, sphere, n, mass): particles beyond radius sphere - 1 up to radius sphere. radii ascend."""
    plan = levels(box, radii[-1], n_particles)
    many = most_rows(points.count() if n_points is None else n_points, plan, radii, box) > FEW_ROWS
    rows, home = searched(points, box, radii, plan), homes(particles, box, plan)
    if not plan.deepest:  # cells are as wide as the radius, and hardly any lies in a sphere
        pairs, r2 = found_pairs(home, rows, box, plan, radii[-1], many)
        return pairs.select("gid", "mass", geometry.spheres_beyond(r2, radii).alias("sphere")).groupBy("gid", "sphere").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"))
    # one join for both: whole cells meet their sums by level, open ones their particles
    key = lambda cell, level: (F.shiftleft(cell, 3) + (F.lit(level) if isinstance(level, int) else level) + 1).alias("cell")
    single = home.select(key(numbered(home, plan, plan.deepest), OPEN), "x", "y", "z", F.lit(1).cast("long").alias("n"), "mass")
    sums = cell_sums(home, plan).select(key(F.col("cell"), F.col("level")), *[F.lit(0.0).alias(a) for a in geometry.AXES], "n", "mass")
    wanted = rows.select("gid", *G, "sphere", key(numbered(rows, plan), F.when(F.col("sphere") == OPEN, OPEN).otherwise(F.col("level"))))
    both, r2 = with_distance(spread(single.unionByName(sums), "cell").join(beside(wanted, many), "cell").drop("cell"), box)
    whole = F.col("sphere") != OPEN
    kept = both.where(whole | geometry.in_sphere(r2, radii[-1]))
    sphere = F.when(whole, F.col("sphere")).otherwise(geometry.spheres_beyond(r2, radii))
    return kept.select("gid", sphere.alias("sphere"), "n", "mass").groupBy("gid", "sphere").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))


def kernel_sums(points: DataFrame, particles: DataFrame, box: Sequence[float], radii: Sequence[float], density: float, n_particles: int | None = None) -> DataFrame:
    """One row a point, with n_k, mass_k and delta_k for each radius by its place in the list; empty spheres have 0, 0, -1.
    n_particles, about, sets the depth; without it particles are counted."""
    ordered = sorted(set(map(float, radii)))
    n_particles, n_points, sums = particles.count() if n_particles is None else n_particles, points.count(), []
    if dense.fits(particles, box, ordered[-1], n_points, n_particles):
        part = dense.sums(points, particles, box, ordered, n_particles)
        for k, r in enumerate(radii):
            sums += [F.sum(f"{c}_{ordered.index(float(r))}").alias(f"{c}_{k}") for c in ("n", "mass")]
    else:
        part = sphere_sums(points, particles, box, ordered, n_particles, n_points)
        for k, r in enumerate(radii):
            inside = F.col("sphere") <= ordered.index(float(r))
            sums += [F.sum(F.when(inside, F.col("n"))).alias(f"n_{k}"), F.sum(F.when(inside, F.col("mass"))).alias(f"mass_{k}")]
    found = points.select("gid", *G).join(part.groupBy("gid").agg(*sums), "gid", "left")
    out = ["gid", *G]
    for k, r in enumerate(radii):
        mass = F.coalesce(f"mass_{k}", F.lit(0.0))
        out += [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}"), mass.alias(f"mass_{k}"), cosmology.overdensity(mass, r, density).alias(f"delta_{k}")]
    return found.select(*out)


def in_reach(points: DataFrame, particles: DataFrame, box: Sequence[float], radius: float) -> DataFrame:
    """(gid, mass, r2) of every particle within the radius of a point, in one level of cells; particles may be a stream."""
    plan = levels(box, radius, 0)
    many = not particles.isStreaming and most_rows(points.count(), plan, [radius], box) > FEW_ROWS
    pairs, r2 = found_pairs(homes(particles, box, plan), searched(points, box, [radius], plan), box, plan, radius, many)
    return pairs.select("gid", "mass", r2.alias("r2"))


def long_form(wide: DataFrame, radii: Sequence[float]) -> DataFrame:
    """(gid, kernel_idx, radius, n, mass, overdensity): equal radii stay apart."""
    rows = [F.struct(F.lit(k).alias("kernel_idx"), F.lit(float(r)).alias("radius"), F.col(f"n_{k}").alias("n"), F.col(f"mass_{k}").alias("mass"), F.col(f"delta_{k}").alias("overdensity")) for k, r in enumerate(radii)]
    return wide.select("gid", F.explode(F.array(*rows)).alias("r")).select("gid", "r.*")


def exhaustive(points: DataFrame, particles: DataFrame, box: Sequence[float], radius: float) -> DataFrame:
    """(gid, n, mass) by comparing all pairs: the check of the join, for small inputs."""
    r2 = geometry.distance2([F.col(a) for a in geometry.AXES], [F.col(g) for g in G], box)
    both = particles.crossJoin(points).where(geometry.in_sphere(r2, radius)).groupBy("gid").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"))
    return points.select("gid").join(both, "gid", "left").select("gid", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("mass", F.lit(0.0)).alias("mass"))

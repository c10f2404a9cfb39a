"""The range join where many points meet many particles each: pairs are judged in matrices, not as rows.

The box is parted in blocks some radii wide. A particle goes to its own block, a point to all blocks that its largest sphere reaches,
and a block's points and particles meet in one task. There points of a small cell are taken together, with the particles of the
columns along z that their spheres can reach: a product of matrices gives all squared distances, and a second one the counts and
masses. Pairs at a surface, nearer to it than rounding, are judged anew by the plain distance, so that results are those of the
plain formula. Blocks of very many rows are dealt over several tasks, each with a part of the points and a part of the particles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.functions import geometry

G = ("gx", "gy", "gz")
#: Pairs in spheres, about, and points from which on this join is used.
MANY_PAIRS, MANY_POINTS = 10**8, 1 << 15
#: Particles of a block, about; particles or points of a task, at most, about.
BLOCK_ROWS, TASK_ROWS = 1 << 18, 1 << 19
#: Least width of a block in largest radii: a point is copied to 3.4 blocks at 4. Blocks on an axis, if so many are wide enough.
BLOCK_RADII, BLOCKS = 4, 4
#: A small cell's cost, in pairs; rows and columns of a matrix; small cells whose columns are looked up at once; surface pairs kept.
CELL_COST, ROWS, COLUMNS, CELLS, SURFACE = 10**5, 48, 4096, 1024, 1 << 20
#: Whole numbers up to this are single precision's own.
WHOLE = 1 << 24


def fits(particles: DataFrame, box: Sequence[float], radius: float, n_points: int, n_particles: int) -> bool:
    """Whether the pairs are many and no sphere meets a block from two sides."""
    pairs = n_points * n_particles * 4 / 3 * math.pi * radius**3 / math.prod(box)
    plain = not particles.isStreaming and isinstance(particles.schema["mass"].dataType, T.DoubleType)
    return plain and n_points > MANY_POINTS and pairs > MANY_PAIRS and all(radius * 2 * BLOCK_RADII <= length for length in box)


def block_counts(box: Sequence[float], radius: float, n_particles: int) -> tuple[int, ...]:
    width = max(BLOCK_RADII * radius, min(min(box) / BLOCKS, (math.prod(box) * BLOCK_ROWS / max(n_particles, 1)) ** (1 / 3)))
    return tuple(max(2, int(length // width)) for length in box)


def placed(df: DataFrame, columns: Sequence[str], box: Sequence[float]) -> DataFrame:
    """Rows that have a place; the others are in no sphere."""
    for c, length in zip(columns, box, strict=True):
        df = df.where(F.col(c).isNotNull() & ~F.isnan(geometry.wrapped(F.col(c), length)))
    return df


def copied(points: DataFrame, box: Sequence[float], radius: float, blocks: Sequence[int]) -> DataFrame:
    """Points with each block in reach."""
    axes = []
    for a, g, length, n in zip("ijk", G, box, blocks, strict=True):
        at, reach = geometry.wrapped(F.col(g), length), radius + length * 1e-9
        low, high = (F.floor((at + F.lit(d)) * F.lit(n / length)) for d in (-reach, reach))
        points = points.withColumn(a, F.explode(F.sequence(low, high)))
        axes.append(F.pmod(F.col(a), F.lit(n)))
    return points.withColumn("block", geometry.cell_number(axes, blocks)).drop(*"ijk")


def shares(df: DataFrame) -> dict[int, int]:
    """Into how many tasks the rows of a block go, where they are more than one task's."""
    counts = df.groupBy("block").count().where(F.col("count") > TASK_ROWS).collect()
    return {r["block"]: math.ceil(r["count"] / TASK_ROWS) for r in counts}


def share(of: dict[int, int]) -> Column:
    if not of:
        return F.lit(1).cast("long")
    return F.coalesce(F.create_map(*[F.lit(x).cast("long") for item in of.items() for x in item])[F.col("block")], F.lit(1).cast("long"))


def dealt(df: DataFrame, own: dict[int, int], other: dict[int, int]) -> DataFrame:
    """df with `own`, one of its block's shares, and `other`, each of the other side's shares in turn."""
    part = F.pmod(F.monotonically_increasing_id(), F.col("of")) if own else F.lit(0).cast("long")
    each = F.explode(F.sequence(F.lit(0).cast("long"), share(other) - 1)) if other else F.lit(0).cast("long")
    return df.withColumn("of", share(own)).withColumn("own", part).drop("of").withColumn("other", each)


def sums(points: DataFrame, particles: DataFrame, box: Sequence[float], radii: Sequence[float], n_particles: int) -> DataFrame:
    """(gid, n_0, mass_0, ...): counts and masses up to each of the ascending radii, in one or more rows that add up for a gid; points
    with no particle have none."""
    blocks = block_counts(box, radii[-1], n_particles)
    home = placed(particles, geometry.AXES, box).select(*geometry.AXES, F.coalesce("mass", F.lit(0.0)).alias("mass"), geometry.cell_number([geometry.cell_axis(F.col(a), length, n) for a, length, n in zip(geometry.AXES, box, blocks, strict=True)], blocks).alias("block"))
    away = copied(placed(points.select("gid", *G), G, box), box, radii[-1], blocks)
    many_p, many_g = shares(home), shares(away)
    most_p, most_g = (max(m.values(), default=1) for m in (many_p, many_g))
    task = lambda p, g: ((F.col("block") * most_p + F.col(p)) * most_g + F.col(g)).alias("task")
    left = dealt(home, many_p, many_g).select(task("own", "other"), *geometry.AXES, "mass")
    right = dealt(away, many_g, many_p).select(task("other", "own"), "gid", *G)
    fields = [points.schema["gid"], *[T.StructField(f"{c}_{k}", t) for k in range(len(radii)) for c, t in (("n", T.LongType()), ("mass", T.DoubleType()))]]
    work = block_sums(tuple(box), tuple(radii), blocks, most_p * most_g)
    # a partition has about a block, however few the session's partitions are: a block is far more work than its bytes tell
    spark = points.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, math.prod(blocks))
    left, right = (df.repartition(n, "task") for df in (left, right))
    return left.groupBy("task").cogroup(right.groupBy("task")).applyInArrow(work, T.StructType(fields))


def block_sums(box: Sequence[float], radii: Sequence[float], blocks: Sequence[int], tasks: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = key[0].as_py() // tasks
        ijk = np.array([block // (blocks[1] * blocks[2]), block // blocks[2] % blocks[1], block % blocks[2]])
        p, g = (np.stack([t[c].to_numpy() for c in names]) for t, names in ((left, geometry.AXES), (right, G)))
        n, mass = pair_sums(p, left["mass"].to_numpy(), g, np.array(box), radii, ijk, np.array(blocks))
        found = np.flatnonzero(n[-1])
        columns = [right["gid"].take(pa.array(found))]
        for k in range(len(radii)):
            columns += [pa.array(n[k, found]), pa.array(mass[k, found])]
        return pa.table(columns, ["gid", *[f"{c}_{k}" for k in range(len(radii)) for c in ("n", "mass")]])

    return work


def pair_sums(p: np.ndarray, mass: np.ndarray, g: np.ndarray, box: np.ndarray, radii: Sequence[float], ijk: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, masses), a row a radius and a column a point, of particles p around points g, which lie in a block or are in reach of it."""
    n_g = g.shape[1]
    count, total = np.zeros((len(radii), n_g), np.int64), np.zeros((len(radii), n_g))
    if not (n_g and p.shape[1]):
        return count, total
    far, width = radii[-1], box / blocks
    # a sum of products is no choice for masses that aren't numbers, nor an image for places beyond the box: all pairs are judged anew
    plain = bool(np.isfinite(mass).all() and all(((c >= 0) & (c <= box[:, None])).all() for c in (p, g)))
    middle = ((ijk + 0.5) * width)[:, None]

    def local(c: np.ndarray) -> np.ndarray:
        d = np.mod(c, box[:, None]) - middle
        return d - box[:, None] * np.rint(d / box[:, None])

    # particles by column along z, and within it by z
    low, slack = -width / 2, 1e-9 * float(width.max())
    side = max(far / 4, float(width.max()) / 64)
    n_x, n_y = (max(1, math.ceil(w / side)) for w in width[:2])
    size_x, size_y, span = width[0] / n_x, width[1] / n_y, 2 * float(width[2])
    x, y, z = local(p)
    i, j = (np.clip(np.floor((c - c0) / s), 0, m - 1) for c, c0, s, m in ((x, low[0], size_x, n_x), (y, low[1], size_y, n_y)))
    place = (i * n_y + j) * span + np.clip(z - low[2], 0, span / 2)
    order = np.argsort(place)
    place = place[order]
    # points by small cell
    at = local(g)
    cell = cell_width(far, p.shape[1] / float(np.prod(width)), n_g / float(np.prod(width + 2 * far)))
    a, b, c = (np.floor((v - v.min()) / cell).astype(np.int64) for v in at)
    number = (a * (int(b.max()) + 1) + b) * (int(c.max()) + 1) + c
    dealt_out = np.argsort(number, kind="stable")
    at, number = at[:, dealt_out], number[dealt_out]
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    stops = np.r_[starts[1:], n_g]
    least, most = np.minimum.reduceat(at, starts, axis=1), np.maximum.reduceat(at, starts, axis=1)
    square = (at * at).sum(axis=0)
    # single precision where few pairs are then too near to a surface, and where it can add up the masses without rounding
    near = 3 * float((width / 2 + far).max()) ** 2 + far * float(box.max()) * 1e-3
    kind, near = (np.float32, 2e-6 * near) if 2e-6 * near < 1e-3 * radii[0] ** 2 else (np.float64, 1e-12 * near)
    whole = plain and bool((mass == np.rint(mass)).all()) and float(np.abs(mass).max()) * COLUMNS <= WHOLE
    terms = np.stack([-2 * x, -2 * y, -2 * z, x * x + y * y + z * z, np.ones_like(x)]).astype(kind)[:, order]
    weights = np.stack([np.ones_like(mass), mass]).astype(np.float32 if whole else np.float64)[:, order]
    places, space = np.arange(p.shape[1], dtype=np.int32), [np.empty(0, t) for t in (kind, weights.dtype, np.int32)]
    beyond, chosen = np.empty(ROWS * COLUMNS, kind), np.empty(ROWS * COLUMNS, weights.dtype)
    wide, tight = np.zeros(ROWS * COLUMNS, bool), np.zeros(ROWS * COLUMNS, bool)
    for k, radius in enumerate(radii):
        factors = np.stack([*at, np.ones(n_g), square - radius * radius], axis=1).astype(kind)
        n_k, mass_k = np.zeros(n_g), np.zeros(n_g)
        open_g, open_p, held = [], [], 0

        def judge() -> None:
            """The pairs at surfaces, by the plain distance."""
            nonlocal held
            if held:
                who, what = dealt_out[np.concatenate(open_g)], order[np.concatenate(open_p)]
                d = np.abs(p[:, what] - g[:, who])
                d = np.minimum(d, np.abs(box[:, None] - d))
                inside = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= radius * radius  # noqa: B023
                who, what = who[inside], what[inside]
                count[k] += np.bincount(who, minlength=n_g)  # noqa: B023
                total[k] += np.bincount(who, mass[what], n_g)  # noqa: B023
                open_g.clear(), open_p.clear()  # noqa: B023
                held = 0

        for first in range(0, len(starts), CELLS):
            cells = slice(first, first + CELLS)
            who, begin, end = reached(place, least[:, cells], most[:, cells], low, radius, slack, (size_x, size_y), (n_x, n_y), span)
            bounds = np.searchsorted(who, np.arange(len(starts[cells]) + 1)).tolist()
            begin, end = begin.tolist(), end.tolist()
            for q, (start, stop) in enumerate(zip(starts[cells].tolist(), stops[cells].tolist(), strict=True)):
                runs = list(zip(begin[bounds[q] : bounds[q + 1]], end[bounds[q] : bounds[q + 1]], strict=True))
                if not runs:
                    continue
                n_some = sum(v - u for u, v in runs)
                if n_some > len(space[2]):
                    space = [np.empty(n_some * 5 // 4 * m, t) for m, t in ((5, kind), (2, weights.dtype), (1, np.int32))]
                some, weight, which = (s[: m * n_some].reshape(m, n_some) for m, s in zip((5, 2, 1), space, strict=True))
                np.concatenate([terms[:, u:v] for u, v in runs], axis=1, out=some)
                np.concatenate([weights[:, u:v] for u, v in runs], axis=1, out=weight)
                np.concatenate([places[u:v] for u, v in runs], out=which[0])
                for c0 in range(0, some.shape[1], COLUMNS):
                    part = some[:, c0 : c0 + COLUMNS]
                    height = -(-(stop - start) // -(-(stop - start) // ROWS))
                    for r0 in range(start, stop, height):
                        r1 = min(r0 + height, stop)
                        shape = (r1 - r0, part.shape[1])
                        size = shape[0] * shape[1]
                        d, taken, outer, inner = beyond[:size], chosen[:size], wide[:size], tight[:size]
                        np.matmul(factors[r0:r1], part, out=d.reshape(shape))
                        np.less_equal(d, near, out=outer)
                        if plain:
                            np.less_equal(d, -near, out=inner)
                            np.copyto(taken, inner)
                            both = weight[:, c0 : c0 + COLUMNS] @ taken.reshape(shape).T
                            n_k[r0:r1] += both[0]
                            mass_k[r0:r1] += both[1]
                            np.not_equal(outer, inner, out=outer)
                        padded = -(-size // 64) * 64
                        wide[size:padded] = False
                        words = (wide[:padded].view(np.uint64) != 0).view(np.uint64)
                        if words.any():
                            lines = np.flatnonzero(words)
                            bits = np.flatnonzero(wide[:padded].reshape(-1, 64)[lines])
                            row, column = np.divmod(lines[bits // 64] * 64 + bits % 64, shape[1])
                            open_p.append(which[0, c0 + column])
                            open_g.append(row + r0)
                            held += len(row)
                            if held > SURFACE:
                                judge()
        judge()
        count[k, dealt_out] += n_k.astype(np.int64)
        total[k, dealt_out] += mass_k
    return count, total


def cell_width(radius: float, particles: float, points: float) -> float:
    """The width at which a point costs least: particles in reach of its cell, and its part of the cell's own cost. Rows a volume."""
    w = radius * 2.0 ** (np.arange(-12, 5) / 3)
    pairs = (w**3 + 6 * w**2 * radius + 3 * math.pi * w * radius**2 + 4 / 3 * math.pi * radius**3) * particles
    return float(w[np.argmin(pairs + CELL_COST / (w**3 * points))])


def reached(place: np.ndarray, least: np.ndarray, most: np.ndarray, low: np.ndarray, radius: float, slack: float, size: tuple[float, float], n: tuple[int, int], span: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of points, begin, end) of the stretches of particles that spheres around the cells' points can reach, by cell."""
    at, gap = [], []
    for v in (0, 1):
        first = np.floor((least[v] - radius - slack - low[v]) / size[v]).astype(np.int64)
        last = np.floor((most[v] + radius + slack - low[v]) / size[v]).astype(np.int64)
        column = first[:, None] + np.arange(int((last - first).max()) + 1)
        edge = low[v] + column * size[v]
        away = np.maximum(np.maximum(edge - most[v][:, None], least[v][:, None] - edge - size[v]) - slack, 0.0)
        at.append(column)
        gap.append(np.where((column >= 0) & (column < n[v]), away * away, np.inf))
    half2 = (radius + slack) ** 2 - gap[0][:, :, None] - gap[1][:, None, :]
    who, i, j = np.nonzero(half2 >= 0)
    half = np.sqrt(half2[who, i, j]) + slack
    base = (at[0][who, i] * n[1] + at[1][who, j]) * span
    begin = np.searchsorted(place, base + np.clip(least[2][who] - half - low[2], 0, span / 2))
    end = np.searchsorted(place, base + np.clip(most[2][who] + half - low[2], 0, span / 2), side="right")
    some = end > begin
    return who[some], begin[some], end[some]

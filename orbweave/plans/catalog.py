"""The engine's queries over the given tables, and their SQL: particles come from lineitem, halos from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions import cosmology, geometry
from orbweave.operators import cells as C
from orbweave.operators import checks, convert, grids, kernel, summary
from orbweave.plans.run import union_snapshots
from orbweave.sources import snapshot, tables

BOX, CUBE, SIDE = (64.0, 64.0, 64.0), (8, 8, 8), 8
RADII = (2.0, 4.0, 6.0)
DENSITY = cosmology.mean_density(0.681, 0.256, 0.048611)
G = ("gx", "gy", "gz")
USEFUL_RADIUS = 3.0

# ---- tables


def particles(spark: SparkSession, d: str, box=BOX) -> DataFrame:
    at = ["(l_orderkey * 97 + l_linenumber * 31) % 4096", "(l_partkey * 193 + l_linenumber * 57) % 4096", "(l_suppkey * 389 + l_orderkey * 11) % 4096"]
    return spark.read.parquet(f"{d}/lineitem.parquet").select(*[(F.expr(e) * F.lit(length / 4096)).alias(c) for e, length, c in zip(at, box, "xyz", strict=True)], F.col("l_quantity").alias("mass"))


def particles_sql(box=BOX) -> str:
    at = ["(l_orderkey * 97 + l_linenumber * 31) % 4096", "(l_partkey * 193 + l_linenumber * 57) % 4096", "(l_suppkey * 389 + l_orderkey * 11) % 4096"]
    return "SELECT " + ", ".join(f"({e}) * {length / 4096}::DOUBLE AS {c}" for e, length, c in zip(at, box, "xyz", strict=True)) + ", l_quantity AS mass FROM lineitem"


def lattice_sql(box=BOX, n: int = SIDE) -> str:
    ijk = (f"id // {n * n}", f"(id // {n}) % {n}", f"id % {n}")
    return "SELECT id AS gid, " + ", ".join(f"(({e}) + 0.5::DOUBLE) * {length}::DOUBLE / {float(n)}::DOUBLE AS {c}" for e, length, c in zip(ijk, box, G, strict=True)) + f" FROM (SELECT unnest(range({n**3})) AS id)"


def halos(spark: SparkSession, d: str) -> DataFrame:
    at = ["(o_orderkey * 97) % 4096", "(o_custkey * 193) % 4096", "(o_orderkey * 11 + o_custkey * 389) % 4096"]
    # every seventh halo is given no mass, for the filter
    mass = F.when(F.col("o_orderkey") % 7 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice"))
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("gid"), *[(F.expr(e) * F.lit(1 / 64)).alias(c) for e, c in zip(at, "xyz", strict=True)], mass.alias("mass"))


HALOS_SQL = "SELECT o_orderkey AS gid, " + ", ".join(f"(({e}) % 4096) / 64::DOUBLE AS {c}" for e, c in zip(("o_orderkey * 97", "o_custkey * 193", "o_orderkey * 11 + o_custkey * 389"), G, strict=True)) + ", o_totalprice AS mass FROM orders WHERE o_orderkey % 7 != 0 AND o_totalprice > 0"

# ---- SQL parts


def near_sql(a: str, b: str, length: float) -> str:
    d = f"({a} - {b})"
    return f"(CASE WHEN {d} > {length / 2} THEN {d} - {length}::DOUBLE WHEN {d} < {-length / 2} THEN {d} + {length}::DOUBLE ELSE {d} END)"


def r2_sql(box=BOX) -> str:
    x, y, z = (near_sql(f"p.{a}", f"g.{b}", length) for a, b, length in zip("xyz", G, box, strict=True))
    return f"({x}*{x} + {y}*{y} + {z}*{z})"


def kernel_sql(radii=RADII, box=BOX, points: str | None = None) -> str:
    sums = ", ".join(f"count(*) FILTER (r2 <= {r * r}) AS n_{k}, coalesce(sum(mass) FILTER (r2 <= {r * r}), 0)::DOUBLE AS mass_{k}" for k, r in enumerate(radii))
    out = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}, coalesce(mass_{k}, 0)::DOUBLE AS mass_{k}, round(coalesce(mass_{k}, 0)::DOUBLE / {cosmology.sphere(r)!r}::DOUBLE / {DENSITY!r}::DOUBLE - 1, 9) AS delta_{k}" for k, r in enumerate(radii))
    return f"""WITH p AS ({particles_sql(box)}), g AS ({points or lattice_sql(box)}),
 near AS (SELECT gid, p.mass, {r2_sql(box)} AS r2 FROM p, g WHERE {r2_sql(box)} <= {max(radii) ** 2}), s AS (SELECT gid, {sums} FROM near GROUP BY gid)
 SELECT g.gid, g.gx, g.gy, g.gz, {out} FROM g LEFT JOIN s ON g.gid = s.gid"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in df.columns if c.startswith(("delta_", "overdensity"))})


def wide(spark: SparkSession, d: str, radii=RADII, box=BOX, points: DataFrame | None = None) -> DataFrame:
    points = grids.uniform(spark, box, SIDE) if points is None else points
    return rounded(kernel.kernel_sums(points, particles(spark, d, box), box, radii, DENSITY))


def results(spark: SparkSession, d: str) -> DataFrame:
    return rounded(kernel.long_form(wide(spark, d), RADII))


RESULTS_SQL = "WITH w AS (" + kernel_sql() + ")" + " UNION ALL ".join(f" SELECT gid, {k}::INTEGER AS kernel_idx, {r}::DOUBLE AS radius, n_{k} AS n, mass_{k} AS mass, delta_{k} AS overdensity FROM w" for k, r in enumerate(RADII))


def axis_sql(x: str, length: float, n: int, face: str = " + 1e-12") -> str:
    return f"greatest(0, least({n - 1}, floor((({x} % {length}) + {length}) % {length} * {n / length}::DOUBLE{face})))::BIGINT"


def cid_sql(columns=("x", "y", "z"), face: str = " + 1e-12") -> str:
    i, j, k = (axis_sql(c, length, n, face) for c, length, n in zip(columns, BOX, CUBE, strict=True))
    return f"({i} * {CUBE[1] * CUBE[2]} + {j} * {CUBE[2]} + {k})"


CELLS_SQL = f"SELECT c.cid, coalesce(h.n, 0)::BIGINT AS n, coalesce(h.mass, 0)::DOUBLE AS mass FROM (SELECT unnest(range(512)) AS cid) c LEFT JOIN (SELECT {cid_sql()} AS cid, count(*) AS n, sum(mass) AS mass FROM ({particles_sql()}) GROUP BY 1) h USING (cid)"
OFFSETS_SQL = f"SELECT cid, n, mass, coalesce(sum(n) OVER (ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM ({CELLS_SQL})"
#: Points of the useful-cell queries: a few of the random ones.
FEW = 12


def random_sql(n: int, seed: int = 42) -> str:
    axes = []
    for i, name in enumerate(G):
        a = f"((id * {grids.AXIS[i]} + {seed * 1000003 + i * 12345677}) % {grids.PRIME})"
        for f, s in grids.ROUNDS:
            a = f"list_transform([({a} * {f}) % {grids.PRIME}], lambda v: xor(v, v >> {s}))[1]"
        axes.append(f"({a} % {grids.PRIME})::DOUBLE / {float(grids.PRIME)}::DOUBLE * 64.0::DOUBLE AS {name}")
    return f"SELECT id AS gid, {', '.join(axes)} FROM (SELECT unnest(range({n}::BIGINT)) AS id)"


def few_points(spark: SparkSession) -> DataFrame:
    return C.assign(grids.random(spark, BOX, FEW), G, BOX, CUBE)


_OFFS = C.reach(USEFUL_RADIUS, 8.0, 8)
NEIGHBOURS_SQL = f"""WITH own AS (SELECT DISTINCT {cid_sql(G)} AS cid FROM ({random_sql(FEW)})), o AS (SELECT unnest({_OFFS}) AS o),
 nb AS (SELECT DISTINCT cid, ((cid // 64 + a.o) % 8 * 64 + (cid // 8 % 8 + b.o) % 8 * 8 + (cid % 8 + c.o) % 8)::BIGINT AS neighbour FROM own, o a, o b, o c) """
USEFUL_SQL = NEIGHBOURS_SQL + ", useful AS (SELECT cid FROM own UNION SELECT neighbour FROM nb) "


def useful(spark: SparkSession) -> DataFrame:
    return C.useful(few_points(spark), BOX, CUBE, USEFUL_RADIUS)


def placed_particles(spark: SparkSession, d: str) -> DataFrame:
    return C.assign(particles(spark, d), ("x", "y", "z"), BOX, CUBE)


def offsets(spark: SparkSession, d: str) -> DataFrame:
    return C.running_start(C.histogram(placed_particles(spark, d), spark, 512), "cid", "n")


def flagged(spark: SparkSession, d: str) -> DataFrame:
    mark = useful(spark).withColumn("useful", F.lit(True))
    return offsets(spark, d).join(mark, "cid", "left").withColumn("useful", F.coalesce("useful", F.lit(False)))


def chunks_sql(gap: float) -> str:
    return USEFUL_SQL + f""", rows AS (SELECT cid, n, start, start + n AS stop FROM ({OFFSETS_SQL}) JOIN useful USING (cid)),
 m AS (SELECT *, lag(stop) OVER (ORDER BY cid) AS prev FROM rows),
 k AS (SELECT *, sum(CASE WHEN prev IS NULL OR (start != prev AND NOT start - prev < {gap}) THEN 1 ELSE 0 END) OVER (ORDER BY cid) - 1 AS chunk FROM m)
 SELECT chunk::BIGINT AS chunk, min(cid)::BIGINT AS first_cid, max(cid)::BIGINT AS last_cid, min(start)::BIGINT AS start, (max(stop) - min(start))::BIGINT AS n FROM k GROUP BY chunk"""


GAP, RANKS = 500.0, 7
PARTITION_SQL = f"""WITH RECURSIVE c AS ({CELLS_SQL}), t AS (SELECT (sum(n) // {RANKS})::BIGINT AS share FROM c),
 f(cid, rank, next_rank, have) AS (
  SELECT cid, 0::BIGINT, CASE WHEN n >= share AND {RANKS} > 1 THEN 1 ELSE 0 END::BIGINT, CASE WHEN n >= share AND {RANKS} > 1 THEN 0 ELSE n END::BIGINT FROM c, t WHERE cid = 0
  UNION ALL SELECT c.cid, f.next_rank, CASE WHEN f.have + c.n >= share AND f.next_rank < {RANKS - 1} THEN f.next_rank + 1 ELSE f.next_rank END::BIGINT,
   CASE WHEN f.have + c.n >= share AND f.next_rank < {RANKS - 1} THEN 0 ELSE f.have + c.n END::BIGINT FROM f JOIN c ON c.cid = f.cid + 1, t)
 SELECT cid::BIGINT AS cid, rank FROM f"""


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines made of orders: comments, blanks, short ones, words, trailing text, points beyond the box."""
    k = F.col("o_orderkey")
    number = lambda e: F.format_string("%.4f", F.expr(e) / F.lit(64.0))
    xyz = [number("(o_orderkey * 97) % 4400"), number("(o_custkey * 193) % 4096"), number("(o_orderkey * 11) % 4096")]
    line = F.when(k % 11 == 0, F.concat(F.lit("  # "), *xyz)).when(k % 11 == 1, F.lit("   ")).when(k % 11 == 2, F.concat_ws(" ", *xyz[:2])).when(k % 11 == 3, F.concat_ws("\t", *xyz, F.lit("7 8"))).when(k % 11 == 4, F.lit("one two three")).otherwise(F.concat_ws(" ", *xyz))
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("at"), line.alias("value"))


LINES_SQL = """SELECT o_orderkey AS gid, round((o_orderkey * 97) % 4400 / 64::DOUBLE, 4) AS gx, round((o_custkey * 193) % 4096 / 64::DOUBLE, 4) AS gy, round((o_orderkey * 11) % 4096 / 64::DOUBLE, 4) AS gz
 FROM orders WHERE o_orderkey % 11 NOT IN (0, 1, 2, 4) AND (o_orderkey * 97) % 4400 < 4096"""
SMALL, FEWER = 4, (5.0,)


def brute_and_fast(spark: SparkSession, d: str) -> DataFrame:
    points = grids.uniform(spark, BOX, SMALL)
    fast = kernel.kernel_sums(points, particles(spark, d), BOX, FEWER, DENSITY).select("gid", F.col("n_0").alias("n"))
    return checks.compared(fast, kernel.exhaustive(points, particles(spark, d), BOX, FEWER[0]))


# ---- rows broken on purpose, which the checks must report


def moved(df: DataFrame, which: str) -> DataFrame:
    """Rows that meet a condition are given the next cell."""
    return df.withColumn("cid", F.when(F.expr(which), (F.col("cid") + 1) % 512).otherwise(F.col("cid")))


def broken_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the join with some set to 0, some too high, some too low, against all pairs."""
    points = grids.uniform(spark, BOX, SMALL)
    slow = kernel.exhaustive(points, particles(spark, d), BOX, FEWER[0]).select("gid", "n")
    n = F.when(F.col("gid") % 8 == 1, F.lit(0)).when(F.col("gid") % 8 == 3, F.col("n") + 2).when(F.col("gid") % 8 == 5, F.greatest(F.col("n") - 1, F.lit(0))).otherwise(F.col("n"))
    return checks.compared(slow.withColumn("n", n.cast("long")), slow)


def broken_results(spark: SparkSession, d: str) -> DataFrame:
    """A result against itself without some points and with others changed."""
    whole = results(spark, d).select("gid", "kernel_idx", "overdensity")
    other = whole.where("gid % 50 != 7").withColumn("overdensity", F.col("overdensity") + F.when(F.col("gid") % 60 == 9, 0.25).otherwise(0.0))
    return checks.differing(whole, other).withColumn("other", F.round("other", 9))


def halved(spark: SparkSession, d: str) -> DataFrame:
    """A level of the cell pyramid: 8^3 cells and the counts of their 4^3 parents, of which some are one too high."""
    p = particles(spark, d)
    fine = C.histogram(C.assign(p, ("x", "y", "z"), BOX, CUBE), spark, 512).join(C.top_cells(spark, BOX, CUBE), "cid")
    up = C.histogram(C.assign(p, ("x", "y", "z"), BOX, (4, 4, 4)), spark, 64).select(F.col("cid").alias("parent"), (F.col("n") + F.when(F.col("cid") % 9 == 4, 1).otherwise(0)).alias("parent_n"))
    parent = F.expr("(i div 2) * 16 + (j div 2) * 4 + k div 2")
    return checks.pyramid(fine.withColumn("parent", parent).join(up, "parent").drop("parent"), 2)


LEAVES, MOST, DEEP = (4, 4, 4), 50, 5
OCTREE_SQL = f"""WITH c AS (SELECT level::INTEGER AS level, floor(x * (4 << level) / 64)::INTEGER AS i, floor(y * (4 << level) / 64)::INTEGER AS j, floor(z * (4 << level) / 64)::INTEGER AS k, count(*) AS n
  FROM ({particles_sql()}), (SELECT unnest(range({DEEP + 1})) AS level) GROUP BY ALL)
 SELECT c.level, c.i, c.j, c.k, c.n FROM c LEFT JOIN c AS u ON u.level = c.level - 1 AND u.i = c.i // 2 AND u.j = c.j // 2 AND u.k = c.k // 2
 WHERE (c.n <= {MOST} OR c.level = {DEEP}) AND (c.level = 0 OR u.n > {MOST})"""
FLAGGED_SQL = USEFUL_SQL + f", f AS (SELECT o.cid, o.n, u.cid IS NOT NULL AS u FROM ({OFFSETS_SQL}) o LEFT JOIN useful u ON o.cid = u.cid) "
RANGES_SQL = FLAGGED_SQL + f""", b AS (SELECT rank, count(*) AS cells, count(*) FILTER (u) AS useful_cells, sum(n)::BIGINT AS particles, coalesce(sum(n) FILTER (u), 0)::BIGINT AS useful_particles FROM f JOIN ({PARTITION_SQL.replace("WITH RECURSIVE c AS", "WITH RECURSIVE cc AS").replace(" FROM c)", " FROM cc)").replace("FROM c, t", "FROM cc AS c, t").replace("JOIN c ON", "JOIN cc AS c ON").replace(" f(cid", " ff(cid").replace("FROM f JOIN", "FROM ff AS f JOIN").replace("rank FROM f", "rank FROM ff")}) USING (cid) GROUP BY rank)
 SELECT *, round((SELECT avg(particles) / max(particles) FROM b), 9) AS efficiency FROM b"""
DIAGNOSIS_SQL = f"""WITH p AS (SELECT *, {cid_sql()} AS cid FROM ({particles_sql()})), g AS (SELECT *, {cid_sql(G)} AS cid FROM ({random_sql(FEW)})),
 near AS (SELECT gid, count(*) AS n, sqrt(min(r2)) AS nearest FROM (SELECT gid, {r2_sql()} AS r2 FROM p, g WHERE {r2_sql()} <= 9) GROUP BY gid), h AS (SELECT cid, count(*) AS n FROM p GROUP BY cid)
 SELECT g.gid, true AS inside, g.cid, coalesce(near.n, 0)::BIGINT AS n, round(nearest, 9) AS nearest, coalesce(h.n, 0)::BIGINT AS in_cell FROM g LEFT JOIN near USING (gid) LEFT JOIN h ON g.cid = h.cid"""
LONG, NONCUBIC, TWICE = (20.0, 40.0, 60.0), (32.0, 64.0, 128.0), (3.0, 3.0)
QUERIES = {
    "kernel_density_uniform": wide,
    "kernel_counts_long": results,
    "kernel_single_radius": lambda s, d: wide(s, d, (5.0,)),
    "kernel_large_radius": lambda s, d: wide(s, d, LONG),
    "kernel_small_radius": lambda s, d: wide(s, d, (0.25,)),
    "kernel_mixed_radii": lambda s, d: wide(s, d, (0.5, 12.0, 30.0, 60.0)),
    "kernel_noncubic": lambda s, d: wide(s, d, box=NONCUBIC),
    "kernel_duplicate_radii": lambda s, d: wide(s, d, TWICE),
    "kernel_exhaustive": lambda s, d: kernel.exhaustive(grids.uniform(s, BOX, SMALL), particles(s, d), BOX, FEWER[0]),
    "kernel_random_points": lambda s, d: wide(s, d, points=grids.random(s, BOX, 300)),
    "grid_uniform": lambda s, d: grids.uniform(s, BOX, 16),
    "grid_random_hash": lambda s, d: grids.random(s, BOX, 5000),
    "grid_from_points": lambda s, d: tables.points_from_lines(text_lines(s, d), BOX),
    "halo_points_positive_mass": lambda s, d: tables.halo_points(halos(s, d)),
    "kernel_at_halos": lambda s, d: wide(s, d, (1.0, 2.0), points=halos(s, d).where("mass > 0").select("gid", *[F.col(a).alias(b) for a, b in zip("xyz", G, strict=True)])),
    "cell_assign": lambda s, d: placed_particles(s, d),
    "cell_histogram": lambda s, d: C.histogram(placed_particles(s, d), s, 512),
    "cell_offsets": offsets,
    "top_cells": lambda s, d: C.top_cells(s, BOX, CUBE),
    "neighbour_cells": lambda s, d: C.neighbours(few_points(s), BOX, CUBE, USEFUL_RADIUS),
    "useful_cells": lambda s, d: useful(s),
    "particles_useful_semi": lambda s, d: placed_particles(s, d).join(useful(s), "cid", "left_semi").select("x", "y", "z", "mass", "cid"),
    "particles_unused_anti": lambda s, d: placed_particles(s, d).join(useful(s), "cid", "left_anti").select("x", "y", "z", "mass", "cid"),
    "read_chunks": lambda s, d: C.chunks(flagged(s, d)),
    "read_chunks_gapfilled": lambda s, d: C.chunks(flagged(s, d), GAP),
    "greedy_partition": lambda s, d: C.balanced_ranges(C.histogram(placed_particles(s, d), s, 512), RANKS),
    "load_counters": lambda s, d: snapshot.load(flagged(s, d)).withColumn("share", F.round("share", 9)),
    "load_by_range": lambda s, d: snapshot.load_by_range(flagged(s, d), RANKS).withColumn("efficiency", F.round("efficiency", 9)),
    "octree_leaves": lambda s, d: snapshot.octree(particles(s, d), BOX, LEAVES, MOST, DEEP),
    "part_offsets": lambda s, d: snapshot.part_offsets(results(s, d).withColumn("part", F.col("gid") % 7)),
    "text_points_malformed": lambda s, d: tables.malformed(text_lines(s, d)).select(F.col("at").alias("line")),
    "text_points_outside": lambda s, d: tables.outside(text_lines(s, d), BOX),
    "point_diagnosis": lambda s, d: checks.diagnosis(grids.random(s, BOX, FEW), particles(s, d), BOX, CUBE, 3.0).withColumn("nearest", F.round("nearest", 9)),
    "grid_points_per_cell": lambda s, d: C.running_start(C.histogram(C.assign(grids.random(s, BOX, 5000), G, BOX, CUBE), s, 512, None), "cid", "n"),
    "output_row_position": lambda s, d: C.row_positions(C.assign(grids.random(s, BOX, 5000), G, BOX, CUBE)),
    "convert_particles": lambda s, d: convert.prepared(particles(s, d, (66.0, 64.0, 64.0)), BOX, CUBE),
    "convert_offsets": lambda s, d: convert.with_offsets(convert.prepared(particles(s, d, (66.0, 64.0, 64.0)), BOX, CUBE), CUBE),
    "inferred_box": lambda s, d: s.createDataFrame([tables.box_of(particles(s, d))], "x double, y double, z double"),
    "total_mass": lambda s, d: particles(s, d).agg(F.count("*").alias("n"), F.sum("mass").alias("mass")),
    "summary_stats": lambda s, d: summary.stats(results(s, d).persist()).withColumns({c: F.round(c, 8) for c in ("mean", "median", "std")}),
    "summary_signs": lambda s, d: summary.signs(results(s, d)).withColumns({f"percent_{c}": F.round(f"percent_{c}", 9) for c in ("over", "under", "zero")}),
    "summary_histogram": lambda s, d: summary.histogram(results(s, d)),
    "summary_extremes": lambda s, d: summary.extremes(results(s, d)),
    "summary_bounds": lambda s, d: summary.bounds(grids.random(s, BOX, 5000)),
    "summary_spacing": lambda s, d: summary.spacing(grids.random(s, BOX, 5000)).withColumn("spacing", F.round("spacing", 9)),
    "validate_brute_vs_fast": brute_and_fast,
    "validate_broken_counts": broken_counts,
    "validate_point_cells": lambda s, d: checks.misplaced(moved(few_points(s), "gid % 3 = 0"), G, BOX, CUBE).select("gid", "cid"),
    "validate_useful_cells": lambda s, d: checks.not_useful(few_points(s), useful(s).where("cid % 4 != 1")).select("gid", "cid"),
    "validate_particle_cells": lambda s, d: checks.misplaced(moved(placed_particles(s, d), "mass = 7"), ("x", "y", "z"), BOX, CUBE).select("mass", "cid"),
    "validate_pyramid": halved,
    "validate_same_results": broken_results,
    "multi_snapshot_union": lambda s, d: union_snapshots({0: wide(s, d, (5.0,)), 1: wide(s, d, (5.0,), NONCUBIC)}),
    "mean_density": lambda s, d: s.createDataFrame([(0.681, 0.304611, cosmology.mean_density(0.681, 0.304611, 0.0)), (0.6736, 0.31, cosmology.mean_density(0.6736, 0.31, 0.0))], "h double, omega double, density double").withColumn("density", F.round("density", 9)),
}
CLAMPED_SQL = "SELECT greatest(0::DOUBLE, least(x, 63.99999999999999::DOUBLE)) AS x, y, z, mass FROM (" + particles_sql((66.0, 64.0, 64.0)) + ")"
PREPARED_SQL = f"SELECT *, (least(7, floor(x / 8)) * 64 + least(7, floor(y / 8)) * 8 + least(7, floor(z / 8)))::BIGINT AS cid FROM ({CLAMPED_SQL})"
_R = f"WITH r AS ({RESULTS_SQL}) "
_BINS = " ".join(f"WHEN overdensity >= {a} AND overdensity < {b} THEN {i}" for i, (a, b) in enumerate(zip(summary.EDGES, summary.EDGES[1:], strict=False)))
ORACLES = {
    "kernel_density_uniform": kernel_sql(),
    "kernel_counts_long": RESULTS_SQL,
    "kernel_single_radius": kernel_sql((5.0,)),
    "kernel_large_radius": kernel_sql(LONG),
    "kernel_small_radius": kernel_sql((0.25,)),
    "kernel_mixed_radii": kernel_sql((0.5, 12.0, 30.0, 60.0)),
    "kernel_noncubic": kernel_sql(box=NONCUBIC),
    "kernel_duplicate_radii": kernel_sql(TWICE),
    "kernel_exhaustive": f"SELECT gid, n_0 AS n, mass_0 AS mass FROM ({kernel_sql(FEWER, points=lattice_sql(n=SMALL))})",
    "kernel_random_points": kernel_sql(points=random_sql(300)),
    "grid_uniform": lattice_sql(n=16),
    "grid_random_hash": random_sql(5000),
    "grid_from_points": LINES_SQL,
    "halo_points_positive_mass": f"SELECT gx, gy, gz, mass FROM ({HALOS_SQL})",
    "kernel_at_halos": kernel_sql((1.0, 2.0), points=HALOS_SQL),
    "cell_assign": f"SELECT *, {cid_sql()} AS cid FROM ({particles_sql()})",
    "cell_histogram": CELLS_SQL,
    "cell_offsets": OFFSETS_SQL,
    "top_cells": "SELECT cid, (cid // 64)::INTEGER AS i, (cid // 8 % 8)::INTEGER AS j, (cid % 8)::INTEGER AS k, (cid // 64) * 8::DOUBLE AS lx, (cid // 8 % 8) * 8::DOUBLE AS ly, (cid % 8) * 8::DOUBLE AS lz FROM (SELECT unnest(range(512)) AS cid)",
    "neighbour_cells": NEIGHBOURS_SQL + "SELECT cid, neighbour FROM nb WHERE cid != neighbour",
    "useful_cells": USEFUL_SQL + "SELECT cid FROM useful",
    "particles_useful_semi": USEFUL_SQL + f"SELECT * FROM (SELECT *, {cid_sql()} AS cid FROM ({particles_sql()})) WHERE cid IN (SELECT cid FROM useful)",
    "particles_unused_anti": USEFUL_SQL + f"SELECT * FROM (SELECT *, {cid_sql()} AS cid FROM ({particles_sql()})) WHERE cid NOT IN (SELECT cid FROM useful)",
    "read_chunks": chunks_sql(-1.0),
    "read_chunks_gapfilled": chunks_sql(GAP),
    "greedy_partition": PARTITION_SQL,
    "load_counters": FLAGGED_SQL + "SELECT count(*) AS cells, count(*) FILTER (u) AS useful_cells, count(*) FILTER (n > 0) AS occupied_cells, sum(n)::BIGINT AS particles, coalesce(sum(n) FILTER (u), 0)::BIGINT AS useful_particles, coalesce(max(n) FILTER (u), 0)::BIGINT AS most, round(coalesce(sum(n) FILTER (u), 0)::DOUBLE / sum(n), 9) AS share FROM f",
    "load_by_range": RANGES_SQL,
    "octree_leaves": OCTREE_SQL,
    "part_offsets": _R + "SELECT gid % 7 AS part, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY gid % 7 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r GROUP BY gid % 7",
    "text_points_malformed": "SELECT o_orderkey AS line FROM orders WHERE o_orderkey % 11 IN (2, 4)",
    "text_points_outside": LINES_SQL.replace("< 4096", ">= 4096"),
    "point_diagnosis": DIAGNOSIS_SQL,
    "grid_points_per_cell": f"WITH h AS (SELECT cid, count(g) AS n FROM (SELECT unnest(range(512)) AS cid) LEFT JOIN (SELECT 1 AS g, {cid_sql(G)} AS cid FROM ({random_sql(5000)})) USING (cid) GROUP BY cid) SELECT cid, n, coalesce(sum(n) OVER (ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM h",
    "output_row_position": f"SELECT gid, cid, row_number() OVER (ORDER BY cid, gid) - 1 AS position FROM (SELECT gid, {cid_sql(G)} AS cid FROM ({random_sql(5000)}))",
    "convert_particles": PREPARED_SQL,
    "convert_offsets": f"WITH h AS (SELECT c.cid, coalesce(h.n, 0)::BIGINT AS n, coalesce(h.mass, 0)::DOUBLE AS mass FROM (SELECT unnest(range(512)) AS cid) c LEFT JOIN (SELECT cid, count(*) AS n, sum(mass) AS mass FROM ({PREPARED_SQL}) GROUP BY cid) h USING (cid)) SELECT *, coalesce(sum(n) OVER (ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM h",
    "inferred_box": f"SELECT max(x) AS x, max(y) AS y, max(z) AS z FROM ({particles_sql()})",
    "total_mass": f"SELECT count(*) AS n, sum(mass)::DOUBLE AS mass FROM ({particles_sql()})",
    "summary_stats": _R + "SELECT kernel_idx, radius, min(overdensity) AS low, max(overdensity) AS high, round(avg(overdensity), 8) AS mean, round(median(overdensity), 8) AS median, round(stddev_pop(overdensity), 8) AS std FROM r GROUP BY ALL",
    "summary_signs": _R + "SELECT kernel_idx, " + ", ".join(f"count(*) FILTER (overdensity {op} 0) AS n_{c}, round(100::DOUBLE * count(*) FILTER (overdensity {op} 0) / count(*), 9) AS percent_{c}" for op, c in ((">", "over"), ("<", "under"), ("=", "zero"))) + " FROM r GROUP BY ALL",
    "summary_histogram": _R + f", b AS (SELECT kernel_idx, max(overdensity) OVER (PARTITION BY kernel_idx) AS most, overdensity FROM r) SELECT kernel_idx, bin::INTEGER AS bin, count(*) AS n FROM (SELECT kernel_idx, CASE WHEN overdensity > 10 THEN 7 WHEN overdensity = 10 AND most > 10 THEN 7 WHEN overdensity = 10 THEN 6 {_BINS} END AS bin FROM b) WHERE bin IS NOT NULL GROUP BY ALL",
    "summary_extremes": _R + "SELECT kernel_idx, (list(gid ORDER BY overdensity, gid))[1] AS gid_low, (list(gid ORDER BY overdensity DESC, gid))[1] AS gid_high FROM r GROUP BY kernel_idx",
    "summary_bounds": "SELECT " + ", ".join(f"min({c}) AS {c}_low, max({c}) AS {c}_high" for c in G) + f" FROM ({random_sql(5000)})",
    "summary_spacing": f"WITH g AS ({random_sql(100)}) SELECT round(min(d), 9) AS spacing FROM (SELECT sqrt((a.gx-b.gx)*(a.gx-b.gx) + (a.gy-b.gy)*(a.gy-b.gy) + (a.gz-b.gz)*(a.gz-b.gz)) AS d FROM g a JOIN g b ON a.gid < b.gid) WHERE d > 0",
    "validate_brute_vs_fast": "SELECT 'OK' AS status, 64::BIGINT AS n",
    "validate_broken_counts": f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN gid % 8 = 1 AND n > 0 THEN 'MISS' WHEN gid % 8 = 3 THEN 'OVER' WHEN gid % 8 = 5 AND n = 1 THEN 'MISS' WHEN gid % 8 = 5 AND n > 1 THEN 'UNDER' ELSE 'OK' END AS status FROM (SELECT gid, n_0 AS n FROM ({kernel_sql(FEWER, points=lattice_sql(n=SMALL))}))) GROUP BY status",
    "validate_point_cells": f"SELECT gid, (cid + 1) % 512 AS cid FROM (SELECT gid, {cid_sql(G)} AS cid FROM ({random_sql(FEW)})) WHERE gid % 3 = 0",
    "validate_useful_cells": f"SELECT gid, cid FROM (SELECT gid, {cid_sql(G)} AS cid FROM ({random_sql(FEW)})) WHERE cid % 4 = 1",
    "validate_particle_cells": f"SELECT mass, ({cid_sql()} + 1) % 512 AS cid FROM ({particles_sql()}) WHERE mass = 7",
    "validate_pyramid": f"SELECT (p // 16)::BIGINT AS i, (p // 4 % 4)::BIGINT AS j, (p % 4)::BIGINT AS k, n AS children, n + 1 AS parent FROM (SELECT r.p, count(x)::BIGINT AS n FROM (SELECT unnest(range(64)) AS p) r LEFT JOIN ({particles_sql()}) ON floor(x / 16) * 16 + floor(y / 16) * 4 + floor(z / 16) = r.p GROUP BY r.p) WHERE p % 9 = 4",
    "validate_same_results": f"SELECT gid, kernel_idx, overdensity, CASE WHEN gid % 50 != 7 THEN round(overdensity + 0.25::DOUBLE, 9) END AS other FROM ({RESULTS_SQL}) WHERE gid % 50 = 7 OR gid % 60 = 9",
    "multi_snapshot_union": f"SELECT *, 0::INTEGER AS snap FROM ({kernel_sql((5.0,))}) UNION ALL SELECT *, 1::INTEGER AS snap FROM ({kernel_sql((5.0,), NONCUBIC)})",
    "mean_density": f"SELECT h, omega, round(3 * (100 * h) * (100 * h) / (8 * pi() * {cosmology.G!r}::DOUBLE) * omega, 9) AS density FROM (VALUES (0.681::DOUBLE, 0.304611::DOUBLE), (0.6736::DOUBLE, 0.31::DOUBLE)) AS t(h, omega)",
}

"""A whole run from a parameter file: python -m orbweave.plans.run PARAMS NTHREADS [SNAPSHOT] [VERBOSITY]"""

from __future__ import annotations

import logging
import sys

from pyspark import SparkConf
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from orbweave import config
from orbweave.operators import cells, grids, kernel
from orbweave.sources import snapshot, tables


def run(spark: SparkSession, job: config.Job) -> None:
    """The source is a folder as operators.convert.write() leaves it; results go to the target. Raises EmptyGrid after writing
    empty results if there are no points."""
    meta = snapshot.read_meta(spark, job.source)
    box, dim = meta.box, meta.cells
    points = grids.make(spark, job.grid, box)
    particles = snapshot.scan(spark, job.source, points, job.grid.largest, job.gap_fraction)
    wide = kernel.kernel_sums(points, particles, box, job.grid.radii, job.density, meta.n_total)
    placed = cells.assign(wide, ("gx", "gy", "gz"), box, dim)
    if not job.write_masses:
        placed = placed.drop(*[f"mass_{k}" for k in range(len(job.grid.radii))])
    per_cell = cells.running_start(cells.histogram(cells.assign(points, ("gx", "gy", "gz"), box, dim), spark, dim[0] * dim[1] * dim[2], None), "cid", "n")
    n = points.count()
    header = {"NGridPoint": n, "Simulation_CDim": list(dim), "BoxSize": list(box), "MaxKernelRadius": job.grid.largest, "Redshift": meta.redshift, "KernelRadii": list(job.grid.radii)}
    tables.write_results(placed, job.target, header, per_cell)
    if not n:
        raise config.EmptyGrid("no evaluation points")


def union_snapshots(results: dict[int, "object"]):
    """Results of several snapshots in one table, with a column snap."""
    out = None
    for snap, df in sorted(results.items()):
        df = df.withColumn("snap", F.lit(snap))
        out = df if out is None else out.unionByName(df)
    return out


def main(argv: list[str] | None = None) -> int:
    args = config.arguments(argv)
    logging.basicConfig(level=logging.INFO if args.verbosity else logging.WARNING)
    # a master that spark-submit or the environment names stays; without one the run is local
    known = "spark.master" in dict(SparkConf().getAll())
    builder = SparkSession.builder.appName("orbweave")
    spark = (builder if known else builder.master(f"local[{args.nthreads}]")).getOrCreate()
    try:
        run(spark, config.job(args.params, args.snapshot))
    except Exception as e:
        logging.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

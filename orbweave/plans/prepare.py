"""Preparing a snapshot: python -m orbweave.plans.prepare SOURCE TARGET --coordinates x y z --masses mass [--box L [L L]] [--cells N [N N]]"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import convert
from orbweave.sources import tables


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    a = argparse.ArgumentParser(prog="orbweave.plans.prepare")
    a.add_argument("source", help="a Parquet folder, or an HDF5 file if h5py is installed")
    a.add_argument("target")
    a.add_argument("--coordinates", nargs="+", default=["x", "y", "z"], help="three columns, or one that holds three numbers")
    a.add_argument("--masses", default="mass")
    a.add_argument("--box", nargs="+", type=float, help="one length or three; else from the header, else the largest coordinates")
    a.add_argument("--cells", nargs="+", type=int, default=[16])
    a.add_argument("--redshift", type=float, default=0.0)
    return a.parse_args(argv)


def named(df: DataFrame, coordinates: list[str], masses: str) -> DataFrame:
    """x, y, z, mass from columns of any name; coordinates are three columns or one array. Wrong shapes raise."""
    if len(coordinates) == 3:
        return tables.read_columns(df, dict(zip(("x", "y", "z", "mass"), [*coordinates, masses], strict=True)))
    if len(coordinates) != 1 or not {coordinates[0], masses} <= set(df.columns):
        raise ValueError(f"coordinates (N, 3) and masses (N) are needed; there are {df.columns}")
    place = F.col(coordinates[0])
    if df.where(F.size(place) != 3).limit(1).count():
        raise ValueError("coordinates must be (N, 3)")
    return df.select(*[place[i].cast("double").alias(c) for i, c in enumerate("xyz")], F.col(masses).cast("double").alias("mass"))


def prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    header = None
    if args.source.endswith((".h5", ".hdf5")):
        from orbweave.sources import hdf5

        hdf5.register(spark)
        raw = spark.read.format("hdf5").option("coordinates", args.coordinates[0]).option("masses", args.masses).load(args.source)
        header, particles = hdf5.header(args.source).get("BoxSize"), raw.select("x", "y", "z", "mass")
    else:
        particles = named(spark.read.parquet(args.source), args.coordinates, args.masses)
    box = tables.box_of(particles, args.box, header)
    cells = tuple(args.cells * 3 if len(args.cells) == 1 else args.cells)
    if len(cells) != 3 or len(box) != 3 or min(cells) < 1:
        raise ValueError("the box and the cells need one number or three")
    convert.write(particles, args.target, box, cells, args.redshift)


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    logging.basicConfig(level=logging.INFO)
    try:
        prepare(SparkSession.builder.appName("orbweave-prepare").getOrCreate(), args)
    except Exception as e:
        logging.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

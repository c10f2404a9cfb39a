"""Snapshot preparation: clamp, bucket, sort by cell, offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions import geometry
from orbweave.operators import cells as C


def prepared(particles: DataFrame, box: Sequence[float], cells: Sequence[int]) -> DataFrame:
    """Particles clamped into the box, with their cell."""
    inside = particles.select(*[geometry.clamped(F.col(c), length).alias(c) for c, length in zip("xyz", box, strict=True)], "mass")
    return inside.withColumn("cid", geometry.bucket_number([F.col(c) for c in "xyz"], box, cells))


def with_offsets(rows: DataFrame, cells: Sequence[int]) -> DataFrame:
    """(cid, n, mass, start) of all cells."""
    n = cells[0] * cells[1] * cells[2]
    return C.running_start(C.histogram(rows, rows.sparkSession, n), "cid", "n")


def write(particles: DataFrame, path: str, box: Sequence[float], cells: Sequence[int], redshift: float = 0.0) -> None:
    """particles in order of cell (a range exchange, so files hold ranges of cells and scans can skip), cells, and header."""
    rows = prepared(particles, box, cells)
    rows.repartitionByRange("cid").sortWithinPartitions("cid").write.mode("overwrite").parquet(f"{path}/particles")
    done = rows.sparkSession.read.parquet(f"{path}/particles")
    with_offsets(done, cells).write.mode("overwrite").parquet(f"{path}/cells")
    meta = [(list(map(float, box)), list(map(int, cells)), [length / n for length, n in zip(box, cells, strict=True)], done.count(), float(redshift))]
    rows.sparkSession.createDataFrame(meta, "box array<double>, cdim array<int>, cell_size array<double>, n_total bigint, redshift double").write.mode("overwrite").parquet(f"{path}/meta")

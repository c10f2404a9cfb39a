"""Particles as a stream against fixed points: additive counts and masses, kept by (point, kernel)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions import geometry
from orbweave.operators.kernel import in_reach


def running_sums(points: DataFrame, stream: DataFrame, box: Sequence[float], radii: Sequence[float]) -> DataFrame:
    """For output modes complete and update: (gid, n_k, mass_k)."""
    near = in_reach(points, stream, box, max(radii))
    sums = []
    for k, r in enumerate(radii):
        inside = geometry.in_sphere(F.col("r2"), r)
        sums += [F.count(F.when(inside, 1)).alias(f"n_{k}"), F.sum(F.when(inside, F.col("mass")).otherwise(0.0)).alias(f"mass_{k}")]
    return near.groupBy("gid").agg(*sums)

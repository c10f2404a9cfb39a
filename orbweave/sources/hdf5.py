"""HDF5 snapshots as a Spark data source and as a target, where h5py is installed; nothing else needs it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a partition.
ROWS = 1 << 20
SCHEMA = "x double, y double, z double, mass double"


def library():
    try:
        import h5py
    except ImportError as e:
        raise ImportError("HDF5 files need the package h5py on the driver and all executors") from e
    return h5py


def header(path: str) -> dict:
    """Attributes of the group Header."""
    with library().File(path, "r") as f:
        return {k: np.asarray(v).tolist() for k, v in f["Header"].attrs.items()} if "Header" in f else {}


class Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class ParticleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.places, self.masses = options["path"], options.get("coordinates", "PartType1/Coordinates"), options.get("masses", "PartType1/Masses")

    def partitions(self) -> list[Rows]:
        with library().File(self.path, "r") as f:
            for key in (self.places, self.masses):
                if key not in f:
                    raise ValueError(f"{self.path} has no dataset {key}")
            shape, n = f[self.places].shape, f[self.masses].shape
            if len(shape) != 2 or shape[1] != 3 or n != (shape[0],):
                raise ValueError(f"coordinates (N, 3) and masses (N) are needed, not {shape} and {n}")
        return [Rows(i, min(i + ROWS, shape[0])) for i in range(0, shape[0], ROWS)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with library().File(self.path, "r") as f:
            place, mass = (f[k][partition.start : partition.stop].astype(np.float64) for k in (self.places, self.masses))
        yield pa.RecordBatch.from_arrays([*(pa.array(place[:, i]) for i in range(3)), pa.array(mass)], ["x", "y", "z", "mass"])


class Particles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hdf5"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ParticleReader:
        return ParticleReader(dict(self.options))


def register(spark: SparkSession) -> None:
    library()
    spark.dataSource.register(Particles)


def write_results(results: DataFrame, path: str, attributes: dict) -> None:
    """Results in order of cell and point as one file, batch by batch; for results that one file is wanted of."""
    h5 = library()
    ordered = results.orderBy("cid", "gid")
    with h5.File(path, "w") as f:
        f.create_group("Header").attrs.update(attributes)
        sets = {}
        for rows in ordered.toLocalIterator(prefetchPartitions=True):
            for c, v in rows.asDict().items():
                sets.setdefault(c, []).append(v)
        for c, v in sets.items():
            f.create_dataset(f"Grids/{c}", data=np.asarray(v), chunks=True)

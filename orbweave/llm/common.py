"""What the operators share: the shared folder, written tables, slices of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Python code works on slices of an Arrow batch of about so many bytes, whatever the batch's size.
SLICE_BYTES = 4 << 20
#: Rows and bytes of an Arrow batch, at most.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder if driver and executors
    are one process (tests); on a cluster that would be each machine's own, so it is refused."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="orbweave-")
        context._conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, tag)
    small_batches(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written() tables whose readers have been written themselves."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Rows that go to Python at once have a bound in number and bytes: batches lie beside the executor's heap, several a task."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps, whose results are in written tables."""
    for _ in range(2):  # the first finds the tables' plans, the second what only these held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_held: dict[tuple, Any] = {}


def held(make: Callable, *args) -> Any:
    """make(*args), which a worker keeps for later tasks until something else is asked for. Spark gives a worker to one operator
    after another, so it only keeps what the present one needs."""
    if (key := (make, *args)) not in _held:
        _held.clear()
        give_back()
        _held[key] = make(*args)
    return _held[key]


def let_go() -> None:
    """Free what an earlier operator has left in this worker."""
    if _held:
        _held.clear()
        give_back()


def give_back() -> None:
    """Free memory goes back to the system, which a worker else keeps beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names that aren't among those taken."""
    low = {c.lower() for c in taken}
    return [next(x for n in range(len(low) + 1) if (x := f"{w}_{n}") not in low) for w in wanted]


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows, each of at most `size` (SLICE_BYTES) bytes of text unless one row alone has more."""
    n = batch.num_rows
    if not n:
        return
    ends = text_offsets(batch.column(batch.schema.get_field_index(column)))
    begin = 0
    while begin < n:
        stop = int(np.searchsorted(ends, ends[begin] + (size or SLICE_BYTES), side="right")) - 1
        stop = min(n, max(begin + 1, stop))
        yield batch.slice(begin, stop - begin)
        begin = stop


def text_offsets(texts: pa.Array) -> np.ndarray:
    """n + 1 byte offsets of a string array into its data buffer; nulls have no bytes."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = texts.buffers()[1]
    if offsets is None or not len(texts):
        return np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, n + 1 offsets); a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = text_offsets(texts)
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def local_path(uri: str) -> str | None:
    """The path of a file URI, None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def put_file(uri: str, data: bytes | memoryview, attempt: str) -> None:
    """Write a file whole or not at all, so a repeated task leaves the same file."""
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.{attempt}", "wb") as f:
            f.write(data)
        os.replace(f"{path}.{attempt}", path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(f"{path}.{attempt}") as f:
        f.write(data)
    store.move(f"{path}.{attempt}", path)


def map_file(uri: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where it is a file, else read."""
    if path := local_path(uri):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)

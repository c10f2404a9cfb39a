"""Operator 2: quality by importance resampling.

Words and word pairs are hashed into buckets. Two generative models, bags of hashed n-grams, are counted: one of target text
(documents labelled good), one of all raw text. A document's log weight is the log ratio of its probabilities under the two, the
sum over its n-grams. Gumbel noise is added and the largest k are taken, which is sampling without replacement by weight; k is a
share of all rows. The k-th largest is found by counting, not by a sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import common
from orbweave.llm.hashing import M1, mix, word_hashes
from orbweave.llm.shards import TOP, find_splitters
from orbweave.llm.toxicity import held_out

BUCKET_BITS = 16
#: The share of rows taken.
SHARE = 0.7
#: Labelled ids are broadcast up to this number, else joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of text hashed at once.
TEXT_BYTES = 1 << 20
#: Keys of the choice: parts of 1 of a noisy weight, weights within +-FAR, bits of the id's hash that break ties.
PARTS, FAR, TIE_BITS = 1 << 20, 1 << 29, 12


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the text) of all words, then of all pairs of adjacent words of some texts."""
    data, at = common.text_bytes(texts)
    w, bounds = word_hashes(data, at, False)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    within = owner[1:] == owner[:-1]
    h = np.concatenate([mix(w), mix(w[:-1] * M1 + w[1:])[within]])
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.concatenate([owner, owner[1:][within]])


def count_models(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(target, raw) counts by bucket over all rows (text, target)."""
    size = 1 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        n = np.zeros((2, size), np.int64)
        for batch in batches:
            for part in common.text_slices(batch, size=TEXT_BYTES):
                found, owner = buckets(part.column(0))
                good = part.column(1).fill_null(False).to_numpy(zero_copy_only=False)
                n[1] += np.bincount(found, minlength=size)
                n[0] += np.bincount(found[good[owner]], minlength=size)
        some = np.flatnonzero(n[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[0][some]), pa.array(n[1][some])], ["bucket", "target", "raw"])

    found = rows.mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    out = np.zeros((2, size), np.int64)
    for i, c in enumerate(("target", "raw")):
        out[i, found.column("bucket").to_numpy()] = found.column(c).to_numpy()
    return out[0], out[1]


def resample(df: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = 42, temperature: float = 1.0, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Per row: doc_id, n_grams, log_weight, gumbel_key, selected (whether among the round(share * rows) of largest key).

    Target text is that of rows labelled 1 whose crc32(doc_id) mod 5 isn't 0; the others stay for held-out tests. Null and empty
    texts have no n-grams and weight 0 in logarithm, as text that tells nothing. Log weights are divided by the temperature: 1 is
    the method, more lets length decide less. Noise depends on the id and the seed, so
    repeated rows have one key; ties, to 2^-20, are broken by a hash of the id, and rows equal in that too are taken or left
    together. Without target labels all weights are equal. An empty table gives an empty one; further columns aren't read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    good = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).alias("y")).where("y = 1").where(~held_out(F.col("doc_id"))).select("doc_id", F.lit(True).alias("target")).distinct()
    near = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    target, raw = count_models(docs.join(near, "doc_id", "left").select("text", "target"))
    ratio = np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw))) if target.sum() else np.zeros(len(raw))
    sent = spark.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        for batch in batches:
            for part in common.text_slices(batch, size=TEXT_BYTES):
                found, owner = buckets(part.column(1))
                n = np.bincount(owner, minlength=part.num_rows)
                weight = np.bincount(owner, sent.value[found], part.num_rows) / temperature
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(weight)], ["doc_id", "n_grams", "log_weight"])

    weighed = docs.mapInArrow(run, "doc_id long, n_grams long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    noisy = weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    place = F.floor(F.greatest(F.lit(-float(FAR)), F.least(F.lit(float(FAR)), F.col("gumbel_key"))) * float(PARTS)).cast("long") + FAR * PARTS
    rows = common.written(noisy.withColumn("key", F.shiftleft(place, TIE_BITS).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << TIE_BITS) - 1)))), "weights")
    n = rows.count()
    cut = find_splitters(rows.select("key", F.lit(1).cast("long").alias("size")), [n - round(share * n)], 0)[0] if n else 0
    return rows.select("doc_id", "n_grams", "log_weight", "gumbel_key", (F.col("key") >= F.lit(min(cut, TOP - 1))).alias("selected"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

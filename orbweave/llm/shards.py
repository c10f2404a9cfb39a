"""Operator 7: shards of near equal bytes by a histogram sort, in DataFrame operations only.

The sort key is a hash of the text followed by a hash of the document's id, 63 bits. Equal texts stand together, and a large
group of them can still be parted. Splitters are found by counting: each round sums the exact bytes and rows in bins of the key
ranges that hold a wanted boundary, and goes on with the bins that hold it. What a round brings to the driver has a fixed bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm import common

TOP = 1 << 63
FIRST_BINS, NEXT_BINS = 4096, 256


def sort_key(text: Column, key: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 33), 32).bitwiseOR(F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF)))


def byte_size(text: Column, overhead: int) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)


@dataclass
class Boundary:
    target: int
    low: int = 0
    high: int = TOP
    below: int = 0  # exact bytes below low
    inside: int = 0
    done: bool = False

    def splitter(self) -> int:
        return self.low if self.target - self.below <= self.below + self.inside - self.target else self.high


def find_splitters(keys: DataFrame, targets: list[int], within: float) -> list[int]:
    """For each target a splitter with near that much `size` at keys below it: within the tolerance, or as near as a single row
    (or rows of one key) allows. Targets ascend; keys are from 0 to 2^63 - 1."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    wanted = [Boundary(t, inside=total) for t in targets]
    bins = FIRST_BINS
    while total and (ranges := sorted({(b.low, b.high) for b in wanted if not b.done})):
        steps = [max(1, -(-(high - low) // bins)) for low, high in ranges]
        found = None
        for i, ((low, high), step) in enumerate(zip(ranges, steps, strict=True)):
            inside = (F.col("key") >= F.lit(low)) & (F.col("key") <= F.lit(high - 1))
            number = F.expr(f"(key - {low}L) div {step}L + {i * bins}L")
            found = F.when(inside, number) if found is None else found.when(inside, number)
        counted = keys.select(found.alias("bin"), "size").where("bin is not null").groupBy("bin").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        by_range: dict[int, list] = {}
        for r in sorted(counted.collect()):
            by_range.setdefault(r["bin"] // bins, []).append(r)
        for b in wanted:
            if b.done:
                continue
            i = ranges.index((b.low, b.high))
            start, step, below = b.low, steps[i], b.below
            for r in by_range[i]:
                if below + r["size"] > b.target or r is by_range[i][-1]:
                    break
                below += r["size"]
            low = start + (r["bin"] - i * bins) * step
            b.low, b.high, b.below, b.inside = low, min(b.high, low + step), below, r["size"]
            near = min(b.target - below, below + r["size"] - b.target)
            b.done = near <= within or r["n"] == 1 or b.high - b.low == 1
        bins = NEXT_BINS
    return [b.splitter() for b in wanted]


def even_splitters(keys: DataFrame, parts: int, tolerance: float) -> list[int]:
    """Splitters between parts of equal size, to within tolerance of a part."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    return find_splitters(keys, [total * i // parts for i in range(1, parts)], tolerance * total / parts)


def shard_of(splitters: list[int], key: str = "key") -> Column:
    found = [F.when(F.col(key) >= F.lit(s), 1).otherwise(0) if s < TOP else F.lit(0) for s in splitters]
    return sum(found, F.lit(0)).cast("int")


def keyed(df: DataFrame, overhead: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    kept = F.col(text)
    return df.select(F.col(key).cast("long").alias("doc_id"), byte_size(kept, overhead).alias("size"), F.crc32(F.coalesce(kept, F.lit("")).cast("binary")).alias("text_crc32"), sort_key(kept, F.col(key)).alias("key"))


def ranked(placed: DataFrame) -> DataFrame:
    """Adds slot, the place in the shard by (key, doc_id, text_crc32). Rows are dealt into ranges of that order, counted by range
    and numbered within each, so no task holds a shard and slots don't depend on where the ranges end."""
    order = [F.col(c) for c in ("key", "doc_id", "text_crc32")]
    dealt = common.written(placed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shard-ranges")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # as many rows as ranges and shards
    bases = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", before.alias("base"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order)) - 1
    return dealt.withColumn("within", within).join(bases, ["shard", "part"]).withColumn("slot", (F.col("within") + F.col("base")).cast("long"))


def assign_shards(df: DataFrame, shards: int = 40, overhead: int = 16, tolerance: float = 0.001, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    Size is the UTF-8 bytes of the text plus overhead; a null text has none. Shards are ranges of the sort key, slots number the
    rows of a shard from 0 without gaps in its order. Repeated rows each get a slot; rows of equal key and text have one sort key
    and are never parted; a null key has the hash of null. An empty table gives an empty one; with fewer rows than shards some
    stay empty. Further columns aren't read, whatever their names.
    """
    rows = common.written(keyed(df, overhead, text, key), "shard-keys")
    placed = ranked(rows.withColumn("shard", shard_of(even_splitters(rows, shards, tolerance))))
    common.discard(rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, shards: int = 40, overhead: int = 16, tolerance: float = 0.001, text: str = "text", key: str = "doc_id") -> str:
    """Write df, all its columns, as one folder a shard, sorted by the sort key: the splitters come from the keys alone, so the
    texts are exchanged once, in ranges of the sort key. Returns the name of the folders' column: shard_0, or one with a higher
    number if df has that."""
    rows = common.written(keyed(df, overhead, text, key), "shard-keys")
    splitters = even_splitters(rows, shards, tolerance)
    common.discard(rows)
    name, place = common.free_names(df.columns, "shard", "key")
    placed = df.withColumn(place, sort_key(df[text], df[key])).withColumn(name, shard_of(splitters, place))
    placed.repartitionByRange(place).sortWithinPartitions(place).drop(place).write.partitionBy(name).parquet(path)
    return name


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(common.documents(spark, sf_dir))

"""Operator 10: near-duplicates by b-bit MinHash.

Sets of equal content become one representative, named by the number of one of its rows. Bands of minima propose candidates:
a band's bucket isn't turned into all its pairs, its least member, the pivot, is paired with each other. Packed low bits of the
minima estimate a pair's similarity, corrected for chance agreement, and drop pairs far below the threshold; the rest is
confirmed on the full sets. Sets are hashed once for each representative that has a candidate, and a pivot's set is sent once to
each block of its members.

Members of a pivot that stay in different components may be linked to each other. Each is written as its symmetric difference to
the pivot's set, from which the overlap of any two follows: |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|. Blocks of members are compared by
their bits, and where these allow a link multiplied as 0/1 matrices of the differences' elements; a block returns no pairs but those
that join two of its components. Sets are held by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import common
from orbweave.llm.hashing import M1, mix, shingle_sets

#: Bits kept of each minimum.
BITS = 4
#: Standard deviations below the threshold at which an estimate drops a pair.
MARGIN = 6.5
#: Members of a pivot that one block holds with it, and elements of their sets.
PIVOT_ROWS, BLOCK_ITEMS = 256, 1 << 20
#: Rows of a block of members: at least so many, a SPREADth of a larger group's, or fewer if their elements pass BLOCK_ITEMS.
BLOCK_ROWS, SPREAD = 128, 16
#: Elements of one product of two blocks.
COLUMNS = 1 << 12
#: Hashes mapped at once; bytes of text hashed at once.
CHUNK, TEXT_BYTES = 1 << 14, 1 << 20
#: Elements of differences given out at once.
OUT_ITEMS = 1 << 18
#: Ids that are broadcast, at most; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Number of equal nibbles in a byte of two signatures' exclusive or.
EQUAL = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)


class Hasher:
    """Minima of bands * rows linear maps of the upper 32 bits of hashes."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        n = bands * rows
        draw = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, (2, n), np.uint32)
        self.bands, self.rows, self.a, self.b = bands, rows, draw[0] | np.uint32(1), draw[1]
        self.band_seed = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row a set, none of which is empty; sets are taken together up to CHUNK hashes, which stay in the cache."""
        out = np.empty((len(sets), len(self.a)), np.uint32)
        ends = np.cumsum([len(x) for x in sets])
        i = 0
        while i < len(sets):
            begin = ends[i] - len(sets[i])
            j = max(i + 1, int(np.searchsorted(ends, begin + CHUNK, side="right")))
            x = (np.concatenate(sets[i:j]).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
            starts = np.concatenate([[0], ends[i : j - 1] - begin])
            y = np.empty_like(x)
            for k, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
                np.multiply(x, a, out=y)
                np.add(y, b, out=y)
                out[i:j, k] = np.minimum.reduceat(y, starts)
            i = j
        return out

    def bits(self, low: np.ndarray) -> np.ndarray:
        """BITS low bits of each mixed minimum, two minima a byte: one row of bytes a set."""
        x = (mix(low.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        if x.shape[1] % 2:
            x = np.concatenate([x, np.zeros((len(x), 1), np.uint8)], axis=1)
        return x[:, ::2] | x[:, 1::2] << BITS

    def keys(self, low: np.ndarray) -> np.ndarray:
        """One row of band keys a set."""
        m = low.reshape(len(low), self.bands, self.rows).astype(np.uint64)
        h = np.tile(self.band_seed, (len(low), 1))
        for i in range(self.rows):
            h = mix(h * M1 + m[:, :, i])
        return h.view(np.int64)


class Estimate:
    """Similarities from packed signatures, corrected for chance agreement of the bits."""

    def __init__(self, percent: int, hashes: int):
        self.hashes, self.chance = hashes, 2.0**-BITS
        j = percent / 100
        match = j + (1 - j) * self.chance
        #: MARGIN deviations below the threshold.
        self.least = j - MARGIN * math.sqrt(match * (1 - match) / hashes) / (1 - self.chance)

    def allows(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which rows y may reach the threshold with x (one row, or as many)."""
        agree = EQUAL[x ^ y].sum(axis=-1, dtype=np.int64) - self.hashes % 2
        return (agree / self.hashes - self.chance) / (1 - self.chance) >= self.least


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def set_keys(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())


def features(df: DataFrame, k: int, bands: int, rows: int, text: str, key: str) -> DataFrame:
    """Per row: row (a number of its own), doc_id, text_hash, n_shingles, and of non-empty sets set_key, bits, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        hasher = Hasher(bands, rows)
        for batch in batches:
            for part in common.text_slices(batch, size=TEXT_BYTES):
                sets = shingle_sets(*common.text_bytes(part.column(3)), k)
                full = np.array([len(s) > 0 for s in sets])
                low = hasher.minima([s for s in sets if len(s)])
                packed, banded = iter(hasher.bits(low)), hasher.keys(low)
                bits = pa.array([next(packed).tobytes() if f else None for f in full], pa.binary())
                ends = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(banded.ravel()))
                columns = [*part.columns[:3], pa.array([len(s) for s in sets], pa.int64()), set_keys(sets), bits, keys]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "text_hash", "n_shingles", "set_key", "bits", "bands"])

    rows_in = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    return rows_in.mapInArrow(run, "row long, doc_id long, text_hash long, n_shingles long, set_key binary, bits binary, bands array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """Of (doc_id, text): doc_id, set_key, items (the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch, size=TEXT_BYTES):
                sets = shingle_sets(*common.text_bytes(part.column(1)), k)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), set_keys(sets), items], ["doc_id", "set_key", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_key binary, items array<long>")


def among(df: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """df's rows that are (left_semi) or aren't (left_anti) among ids: broadcast up to BROADCAST_IDS, else by a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge"), on, how)


def list_values(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a list column, which share its buffer."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def compared(pairs: DataFrame, sets: DataFrame, percent: int, hashes: int) -> DataFrame:
    """Of pairs (a, b): a, b, n (size of b's set), bits, linked, and where a has several members d (hashes that only one of both
    sets has). sets: rep, n, bits, items. Members of a pivot are dealt into blocks, each with the pivot's set in front."""
    sized = pairs.join(sets.select(F.col("rep").alias("b"), "n"), "b")
    load = sized.groupBy("a").agg(F.count("*").alias("m"), F.greatest(F.ceil(F.count("*") / PIVOT_ROWS), F.ceil(F.sum("n") / BLOCK_ITEMS)).cast("int").alias("blocks"))
    dealt = common.written(pairs.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), (F.col("m") > 1).alias("more")), "dealt")
    columns = ["a", "block", "b", "more", "n", "bits", "items"]
    members = dealt.join(sets, F.col("b") == F.col("rep")).select(*columns)
    pivots = dealt.select("a", "block").distinct().join(sets, F.col("a") == F.col("rep")).select("a", "block", F.lit(None).cast("long").alias("b"), F.lit(False).alias("more"), "n", "bits", "items")
    near = Estimate(percent, hashes)
    names = ["a", "b", "n", "bits", "linked", "d"]

    def flush(rows: list) -> pa.RecordBatch:
        a, b, n, bits, linked, d = zip(*rows, strict=True)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in d])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(linked, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(d)))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, signature, none, rows, held = np.zeros(0, np.int64), None, np.zeros(0, np.int64), [], 0
        for batch in batches:
            plain = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "more", "n", "bits")), strict=True)
            for (a, b, more, n, bits), items in zip(plain, list_values(batch.column("items")), strict=True):
                if b is None:
                    pivot, signature = items.copy(), np.frombuffer(bits, np.uint8)
                    continue
                may = bool(near.allows(signature, np.frombuffer(bits, np.uint8))) and 100 * min(n, len(pivot)) >= percent * max(n, len(pivot))
                d = np.setxor1d(pivot, items, assume_unique=True) if may or more else none
                # |x ^ y| of x and y decides: 100 * both >= percent * union
                linked = may and (100 - percent) * (n + len(pivot)) >= (100 + percent) * len(d)
                rows.append((a, b, n, bits, linked, d if more else none))
                held += len(rows[-1][-1]) + 64
                if held > OUT_ITEMS:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)

    blocks = members.unionByName(pivots).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    out = common.written(blocks.mapInArrow(run, "a long, b long, n long, bits binary, linked boolean, d array<long>"), "compared")
    common.discard(dealt)
    return out


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each x with each y; all hold distinct values."""
    out = np.zeros((len(x), len(y)), np.float32)
    flat = [np.concatenate(s) if s else np.zeros(0, np.int64) for s in (x, y)]
    both = np.intersect1d(*flat)
    if not len(both):
        return out
    found = []
    for s, f in zip((x, y), flat, strict=True):
        at = np.minimum(np.searchsorted(both, f), len(both) - 1)
        real = both[at] == f
        found.append((np.repeat(np.arange(len(s)), [len(v) for v in s])[real], at[real]))
    for begin in range(0, len(both), COLUMNS):
        ones = []
        for s, (row, at) in zip((x, y), found, strict=True):
            inside = (at >= begin) & (at < begin + COLUMNS)
            m = np.zeros((len(s), min(COLUMNS, len(both) - begin)), np.float32)
            m[row[inside], at[inside] - begin] = 1
            ones.append(m)
        out += ones[0] @ ones[1].T
    return out


class Rows:
    """A block's members: b, n, label, x (a stranger's copy), bits, d."""

    def __init__(self):
        self.b, self.n, self.label, self.x, self.bits, self.d = [], [], [], [], [], []

    def links(self, percent: int, near: Estimate) -> list[tuple[int, int]]:
        """Links from strangers to others, only those that join two labels not joined before."""
        stranger, label = np.array(self.x, bool), np.array(self.label, np.int64)
        xs, ys = np.flatnonzero(stranger), np.flatnonzero(~stranger)
        if not len(xs) or not len(ys):
            return []
        bits = np.frombuffer(b"".join(self.bits), np.uint8).reshape(len(self.bits), -1)
        hit = np.zeros((len(xs), len(ys)), bool)
        for i, x in enumerate(xs):
            other = np.flatnonzero(label[ys] != label[x])
            hit[i, other] = near.allows(bits[x], bits[ys[other]])
        rows, columns = hit.any(axis=1), hit.any(axis=0)
        xs, ys, hit = xs[rows], ys[columns], hit[np.ix_(rows, columns)]
        if not len(xs):
            return []
        n, size = np.array(self.n), np.array([len(v) for v in self.d])
        apart = size[xs][:, None] + size[ys][None, :] - 2 * overlaps([self.d[i] for i in xs], [self.d[i] for i in ys]).astype(np.int64)
        hit &= (100 - percent) * (n[xs][:, None] + n[ys][None, :]) >= (100 + percent) * apart
        out = []
        for i, x in enumerate(xs):
            at = ys[hit[i]]
            at = at[label[at] != label[x]]
            while len(at):
                y = at[0]
                out.append((min(self.b[x], self.b[y]), max(self.b[x], self.b[y])))
                label[label == label[y]] = label[x]
                at = at[label[at] != label[x]]
        return out


def joined_in_blocks(members: DataFrame, percent: int, hashes: int) -> DataFrame:
    """Pairs (a, b) that link different labels in a pivot's group. members: a, b, n, bits, d, label, stranger (its label isn't a's).

    Of two members with different labels one is a stranger, so blocks of strangers meet blocks of all members.
    """
    rows = lambda c: F.greatest(F.lit(BLOCK_ROWS), F.least(F.lit(BLOCK_ROWS * SPREAD), F.ceil(F.col(c) / SPREAD)))
    parts = lambda n, items: F.greatest(F.ceil(F.col(n) / rows(n)), F.ceil(F.col(items) / BLOCK_ITEMS)).cast("int")
    length = F.size("d").cast("long")
    sums = members.groupBy("a").agg(F.count("*").alias("n_y"), F.sum(length).alias("i_y"), F.count_if("stranger").alias("n_x"), F.sum(F.when(F.col("stranger"), length)).alias("i_x"))
    dealt = members.join(sums.select("a", parts("n_x", "i_x").alias("g_x"), parts("n_y", "i_y").alias("g_y")), "a")
    place = lambda g: F.pmod(F.xxhash64("b"), F.col(g)).cast("int")
    every = lambda g: F.explode(F.sequence(F.lit(0), F.col(g) - 1))
    columns = ["a", "b", "n", "label", "bits", "d"]
    x = dealt.where("stranger").select(*columns, F.lit(True).alias("x"), place("g_x").alias("i"), every("g_y").alias("j"))
    y = dealt.select(*columns, F.lit(False).alias("x"), every("g_x").alias("i"), place("g_y").alias("j"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    near = Estimate(percent, hashes)

    def solve(block: Rows) -> Iterator[pa.RecordBatch]:
        if found := block.links(percent, near):
            yield pa.RecordBatch.from_arrays([pa.array([p[s] for p in found], pa.int64()) for s in (0, 1)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = Rows(), None
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("a", "i", "j")), strict=True)
            values = zip(*(batch.column(c).to_pylist() for c in ("b", "n", "label", "x", "bits")), strict=True)
            for key, (b, n, label, x, bits), d in zip(keys, values, list_values(batch.column("d")), strict=True):
                if key != at:
                    yield from solve(block)
                    block, at = Rows(), key
                block.b.append(b), block.n.append(n), block.label.append(label), block.x.append(x), block.bits.append(bits)
                block.d.append(d.copy())  # a view would hold the whole batch
        yield from solve(block)

    blocks = x.unionByName(y).repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")
    return blocks.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, label): the least vertex reachable, for every vertex of links (a, b). Labels pass along links and are then looked up
    at the label itself, so a chain of n links takes about log n rounds; each round's table is written, and the one before goes."""
    pairs = common.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = common.written(pairs.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        told = pairs.join(labels, pairs["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(told, labels["v"] == told["a"]).select("v", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        at = labels.select(F.col("v").alias("w"), F.col("label").alias("further"))
        new = common.written(new.join(at, F.col("label") == F.col("w"), "left").select("v", F.least("label", "further").alias("label"), "old"), "labels")
        common.discard(labels)
        if not new.where("label != old").limit(1).count():
            common.discard(pairs)
            return new
        labels = new


def judged(df: DataFrame, k: int, percent: int, bands: int, rows: int, text: str, key: str) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, grp (a number of the row's component; null if its id is null or its set empty),
    component_id, kept. See near_duplicates()."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    feats = common.written(features(df, k, bands, rows, text, key), "minhash")
    filled = feats.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = common.written(filled.groupBy("set_key").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least")), "reps")
    of_rep = filled.withColumnRenamed("row", "rep").join(reps.select("rep"), "rep", "left_semi")
    in_band = of_rep.select("rep", F.explode("bands").alias("band"))
    shared = in_band.groupBy("band").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a < most").select("band", "a")
    pairs = common.written(in_band.join(shared, "band").where("rep != a").select("a", F.col("rep").alias("b")).distinct(), "pairs")
    wanted = common.written(among(of_rep.select("rep", "doc_id", "set_key", F.col("n_shingles").alias("n"), "bits"), pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), ["rep"], "left_semi"), "wanted")
    found = full_sets(among(docs, wanted.select("doc_id").distinct(), ["doc_id"], "left_semi"), k)
    once = found.groupBy("doc_id", "set_key").agg(F.first("items").alias("items"))
    sets = common.written(wanted.join(once, ["doc_id", "set_key"]).select("rep", "n", "bits", "items"), "sets")
    common.discard(wanted)
    apart = compared(pairs, sets, percent, bands * rows)
    common.discard(sets, pairs)
    labels = components(apart.where("linked"))
    common.release_shuffles(spark)
    of = lambda c: labels.select(F.col("v").alias(c), F.col("label").alias(f"{c}_label"))
    own = F.coalesce("b_label", "b")
    members = apart.where("size(d) > 0").select("a", "b").join(of("b"), "b", "left").join(of("a"), "a", "left").select("a", "b", own.alias("label"), (own != F.coalesce("a_label", "a")).alias("stranger"))
    members = common.written(members, "members")
    # where all members are in the pivot's component nothing is left to join
    mixed = members.groupBy("a").agg(F.bool_or("stranger").alias("any")).where("any").select("a")
    more = common.written(joined_in_blocks(apart.select("a", "b", "n", "bits", "d").join(members.join(mixed, "a", "left_semi"), ["a", "b"]), percent, bands * rows), "joined")
    common.discard(apart, members)
    label = labels
    if more.limit(1).count():
        # what joins the components found so far is small beside their links
        told = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
        top = components(told.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
        known = labels.select("v", "label").unionByName(more.select(F.explode(F.array("a", "b")).alias("v")).join(labels, "v", "left_anti").distinct().withColumn("label", F.col("v")))
        label = known.join(top.select(F.col("v").alias("label"), F.col("label").alias("top")), "label", "left").select("v", F.coalesce("top", "label").alias("label"))
    # of each set: its component and that component's least id
    linked = common.written(reps.join(label.select(F.col("v").alias("rep"), "label"), "rep"), "linked")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    single = reps.join(linked, "rep", "left_anti").select("set_key", F.col("rep").alias("grp"), F.col("least").alias("component_id"))
    verdict = linked.join(least, "label").select("set_key", F.col("label").alias("grp"), "component_id").unionByName(single)
    common.release_shuffles(spark)
    out = feats.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(verdict, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "grp", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, bands: int = 50, rows: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct k-word shingles; component_id is
    the least doc_id reachable, kept whether the row has it. Fewer than k words are one shingle; null or empty texts and white
    space have an empty set, are linked with nothing and kept. Repeated rows have equal results. Rows of one id but different
    texts are documents of their own. Rows of a null id are single and kept. Empty tables give empty ones; further columns
    aren't read, whatever their names.

    A pair at the threshold has no band in common in (1 - s ** rows) ** bands of cases: 2.4e-9 with these defaults at 0.8,
    5.7e-10 with 45 bands of 6 at 0.85; estimates drop a true pair in fewer than 1e-10.
    """
    return judged(df, k, percent, bands, rows, text, key).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, bands: int = 50, rows: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df's rows, all columns, but of each group of near-duplicates (as in near_duplicates) only one: that of least id, then of
    least hash of the text. Of rows equal in id and text one stays, too. Rows of null ids and without words all stay."""
    rows_of = judged(df, k, percent, bands, rows, text, key).where("grp IS NOT NULL").groupBy("grp", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    rows_of = common.written(rows_of, "groups")
    best = rows_of.groupBy("grp").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"))
    i, h = common.free_names(df.columns, "id", "hash")
    stays = F.struct("doc_id", "text_hash") == F.col("best")
    ruled = common.written(rows_of.join(best, "grp").select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), stays.alias("stays"), "copies").where("NOT stays OR copies > 1"), "ruled")
    common.discard(rows_of)
    same = (df[key].cast("long") == F.col(i)) & (text_hash(df[text]) == F.col(h))
    match = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    out = df.join(match(ruled.where("NOT stays").select(i, h).distinct()), same, "left_anti")
    twice = ruled.where("stays").select(i, h).distinct()
    if twice.limit(1).count():
        whole = F.struct(*[df[c] for c in df.columns])
        first = out.join(match(twice), same, "left_semi").groupBy(df[key].cast("long").alias(i), text_hash(df[text]).alias(h)).agg(F.first(whole).alias("row"))
        out = out.join(match(twice), same, "left_anti").unionByName(first.select("row.*"))
    common.release_shuffles(df.sparkSession)
    return out


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), k=3, percent=85, bands=45, rows=6)


OP10_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS gs FROM d),
sh AS (SELECT rid, len(gs) AS n, unnest(gs) AS g FROM s),
links AS (SELECT a.rid AS x, b.rid AS y FROM sh a JOIN sh b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(v, u) AS (SELECT rid, rid FROM d UNION SELECT reach.v, both_ways.y FROM reach JOIN both_ways ON reach.u = both_ways.x),
c AS (SELECT v, min(doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.u GROUP BY v)
SELECT doc_id, len(gs)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.v = s.rid
"""

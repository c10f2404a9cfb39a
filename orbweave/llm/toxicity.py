"""Operator 3: toxicity by compression distance.

Text is read in windows of running words. Two dictionaries are trained by zstandard: one on ordinary text, one on the windows of
toxic documents that hold what recurs there in ever new contexts and hardly in ordinary documents. Ordinary windows that the toxic
dictionary still shortens train a third part, which both sides get. A window is compressed with the ordinary dictionary, and with
the toxic one in front of it, behind a fixed stretch that both have; its distance is the bytes that the toxic one saves. What both
know costs the same, so clean windows lie at 0 or below. A text is judged by its greatest distance, its number of windows, and how
many of them pass each threshold; the weights of these are calibrated on documents that no dictionary was made from.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orbweave.llm import common

CARRIER = b"|0123456789|"
#: Labelled documents of each class to fit and calibrate on, at most, the first by a hash of their id; and their bytes, at most.
TOXIC_DOCS, ORDINARY_DOCS, FIT_BYTES = 1500, 3000, 48 << 20
#: Bytes from which a window is full; longer words are cut into overlapping parts.
WINDOW, LONGEST_WORD, OVERLAP = 24, 64, 16
#: Bytes of the dictionaries, and the trainer's segment and match sizes for them.
ORDINARY_BYTES, TOXIC_BYTES, HARD_BYTES = 16384, 3072, 2048
ORDINARY_FIT, TOXIC_FIT = {"k": 64, "d": 8}, {"k": 16, "d": 8}
#: Distances that windows are counted beyond; that of an ordinary window which is hard.
THRESHOLDS, HARD = range(2, 9), 3
#: A recurring stretch: bytes, least contexts (and least share of toxic documents), times as many documents as among ordinary ones.
SHORTEST, LONGEST, CONTEXTS, SHARE, RATIO = 5, 12, 5, 0.01, 15


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split() if text else []


def windows(words: list[bytes]) -> list[bytes]:
    """Adjacent words up to WINDOW bytes or more, with a space around."""
    out, held, size = [], [], 0
    for w in words:
        if len(w) > LONGEST_WORD:
            out += [b" " + w[i : i + LONGEST_WORD] + b" " for i in range(0, len(w) - OVERLAP, LONGEST_WORD - OVERLAP)]
            continue
        held.append(w)
        size += len(w) + 1
        if size >= WINDOW:
            out.append(b" " + b" ".join(held) + b" ")
            held, size = [], 0
    if held:
        out.append(b" " + b" ".join(held) + b" ")
    return out


def prefixes(word: bytes) -> list[bytes]:
    w = b" " + word
    return [w[:n] for n in range(SHORTEST, min(LONGEST, len(w)) + 1)]


def recurring(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Word beginnings that toxic documents have in many contexts; copies of a document have one context each."""
    n_toxic, n_ordinary = max(1, len(toxic)), max(1, len(ordinary))
    in_toxic, in_ordinary = Counter(), Counter()
    for words in toxic:
        in_toxic.update({g for w in set(words) for g in prefixes(w)})
    may = {g for g, k in in_toxic.items() if k >= CONTEXTS}
    del in_toxic
    for words in ordinary:
        in_ordinary.update({g for w in set(words) for g in prefixes(w)} & may)
    least = max(CONTEXTS, SHARE * n_toxic)
    may = {g for g in may if in_ordinary[g] * 100 <= n_ordinary}
    contexts = defaultdict(set)
    for words in toxic:
        around = [b"", *words, b""]
        for i, w in enumerate(words):
            for g in prefixes(w):
                if g in may:
                    contexts[g].add(zlib.crc32(around[i] + b" " + around[i + 2]))
    count = {g: len(c) for g, c in contexts.items()}
    good = {g for g, k in count.items() if k >= least and k / n_toxic > RATIO * (in_ordinary[g] + 0.5) / n_ordinary}
    longer = defaultdict(int)
    for g in good:
        longer[g[:-1]] = max(longer[g[:-1]], count[g])
    kept: list[bytes] = []
    for g in sorted((g for g in good if longer[g] < 0.8 * count[g]), key=lambda g: (len(g), g)):
        if not any(g.startswith(k) for k in kept):
            kept.append(g)
    return sorted(kept, key=lambda g: (count[g], g))


def trained(samples: list[bytes], size: int, how: dict) -> bytes:
    """A dictionary by zstandard's trainer; of too little text for it, the text itself."""
    if sum(map(len, samples)) > 4 * size:
        try:
            return zstandard.train_dictionary(size, samples, **how).as_bytes()
        except zstandard.ZstdError:
            pass  # the trainer refuses samples that are too few or too short
    return b"".join(samples)[:size]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


class Distance:
    """Bytes that the toxic dictionary saves."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        how = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=6, min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)

        def compressor(content: bytes):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress

        self.plain, self.bad = compressor(ordinary + CARRIER), compressor(toxic + ordinary + CARRIER)

    def of(self, found: list[bytes]) -> np.ndarray:
        plain, bad = self.plain, self.bad
        return np.array([len(plain(x)) - len(bad(x)) for x in (CARRIER + w for w in found)], np.int64)

    def inputs(self, found: list[bytes]) -> list[float]:
        x = self.of(found)
        beyond = [np.log1p((x >= c).sum()) for c in THRESHOLDS]
        return [1.0, float(x.max()) if len(x) else 0.0, *beyond, np.log1p(len(x))]

    def score(self, text: str | None, weights: np.ndarray) -> float:
        found = windows(words_of(text))
        return float(1 / (1 + np.exp(-np.clip(weights @ self.inputs(found), -30, 30)))) if found else 0.0


def distance(ordinary: bytes, toxic: bytes) -> Distance:
    return common.held(Distance, ordinary, toxic)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """rows: (text, label). Every other document of a class makes the dictionaries, the others calibrate, however many there are.
    Without both classes on both sides every score is near 0."""
    toxic, ordinary = ([words_of(t) for t, y in rows if y == c] for c in (1, 0))
    if len(toxic) < 2 or len(ordinary) < 2:
        return Model(b"", b"", (-30.0,) + (0.0,) * (len(THRESHOLDS) + 2))
    plain = [w for words in ordinary[::2] for w in windows(words)]
    found = [w for words in toxic[::2] for w in windows(words)]
    marks = recurring(toxic[::2], ordinary[::2])
    bad = trained([w for w in found if any(m in w for m in marks)] or found, TOXIC_BYTES, TOXIC_FIT)
    base = trained([b" ".join(words) for words in ordinary[::2] if words], ORDINARY_BYTES, ORDINARY_FIT)
    hard = [w for w, x in zip(plain, Distance(base, bad).of(plain), strict=True) if x >= HARD]
    base = trained(hard, HARD_BYTES, TOXIC_FIT) + base
    d = Distance(base, bad)
    x = np.array([d.inputs(windows(w)) for half in (toxic[1::2], ordinary[1::2]) for w in half])
    y = np.array([1] * len(toxic[1::2]) + [0] * len(ordinary[1::2]))
    return Model(base, bad, tuple(logistic(x, y).tolist()))


def held_out(key) -> Column:
    """The rows that nothing is learned from."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def training_rows(df: DataFrame, labels: DataFrame, text: str, key: str, label: str) -> list[tuple[str | None, int]]:
    """Labelled rows that aren't held out, at most TOXIC_DOCS and ORDINARY_DOCS of at most FIT_BYTES in all; ids and lengths are
    ranked, then texts looked up. Of an id's texts the least counts, of its labels the greatest."""
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sizes = docs.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size"))
    place = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ranked = sizes.join(known, "doc_id").withColumn("place", place).where(F.col("place") <= F.when(F.col("y") == 1, TOXIC_DOCS).otherwise(ORDINARY_DOCS))
    ids, total = {}, 0
    for r in sorted(ranked.collect(), key=lambda r: (r["place"] / (TOXIC_DOCS if r["y"] == 1 else ORDINARY_DOCS), r["y"])):
        if total + (r["size"] or 0) <= FIT_BYTES:
            ids[r["doc_id"]], total = int(r["y"]), total + (r["size"] or 0)
    wanted = df.sparkSession.createDataFrame(list(ids.items()), "doc_id long, y int")
    rows = docs.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).collect()  # no more than the bounds
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def scored(df: DataFrame, model: Model, text: Column, through: list[Column]) -> DataFrame:
    """The columns to pass through, and score; null and empty texts have no window and the score 0."""
    spark = df.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        d, w = distance(m.ordinary, m.toxic), np.array(m.weights)
        for batch in batches:
            for part in common.text_slices(batch):
                values = pa.array([d.score(t, w) for t in part.column(0).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, values], [*part.schema.names, "score"])

    rows = df.select(text.alias("text"), F.struct(F.lit(0).alias("_"), *through).alias("through"))
    schema = StructType().add("text", "string").add("through", rows.schema["through"].dataType).add("score", "double")
    return rows.mapInArrow(run, schema)


def toxicity(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Fit on labelled rows of df that aren't held out, score all rows of df: doc_id, held_out, score, predicted (1 from 0.5 on).

    Null and empty texts score 0. Equal texts score alike, so do repeated rows; a null id is never held out and never learned
    from; texts of any length are read whole; an empty table gives an empty one; without labels every score is near 0;
    further columns aren't read, whatever their names.
    """
    out = scored(df, fit(training_rows(df, labels, text, key, label)), F.col(text), [F.col(key).cast("long").alias("doc_id")])
    key_of = F.col("through.doc_id")
    return out.select(key_of.alias("doc_id"), F.coalesce(held_out(key_of), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """df's rows, all columns, that toxicity() doesn't predict toxic."""
    rest = [c for c in df.columns if c != text]
    out = scored(df, fit(training_rows(df, labels, text, key, label)), F.col(text), [df[c] for c in rest]).where("score < 0.5")
    return out.select(*[F.col("text").alias(c) if c == text else F.col("through").getField(c).alias(c) for c in df.columns])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

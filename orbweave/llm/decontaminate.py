"""Operator 1: benchmark decontamination by a prefix-filtered set join.

Each item-sized window of the benchmark is a set of word shingles; a document window contains it only if it has all of them, so
the window's rarest shingle, by its count over all documents, is a sufficient prefix. Documents are probed for those shingles
only. A found shingle fixes the place of the window (positional bound), which must lie in the document (length bound); then the
words are compared. The benchmark is taken in blocks of bounded size; each is broadcast, passed over all documents, and leaves a
table of the documents that it hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import common
from orbweave.llm.hashing import M1, mix
from orbweave.llm.minhash import text_hash

WINDOW = 13
#: Words of a shingle.
SHINGLE = 3
#: Bytes of benchmark text in a block, about: what is broadcast at once has this bound.
BLOCK_BYTES = 8 << 20
#: Hit documents that are broadcast, at most; more are joined by a shuffle.
BROADCAST_HITS = 1_000_000
TABLE = bytes(0x20 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased."""
    return text.translate(TABLE).split()


IN_WORD = np.frombuffer(TABLE, np.uint8) != 0x20


def word_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of words of each text data[at[i] : at[i + 1]]."""
    solid = IN_WORD[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    first[edges] = solid[edges]
    return np.diff(np.searchsorted(np.flatnonzero(first), at))


def shingle_keys(words: np.ndarray, size: int) -> np.ndarray:
    """Keys of `size` adjacent word numbers; 0 where a word isn't one of the block's. Keys only find places: words are compared
    there."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key, known = np.full(n, size, np.uint64), np.ones(n, bool)
    for i in range(size):
        key = mix(key * M1 + words[i : i + n].astype(np.uint64))
        known &= words[i : i + n] > 0
    return np.where(known, key >> np.uint64(1) | np.uint64(1), np.uint64(0)).view(np.int64)


class Block:
    """Windows of some items, by length, with the shingles they consist of."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        split = [(str(i), words_of((t or "").encode())) for i, t in items]
        self.number = {w: n for n, w in enumerate(sorted(set(chain.from_iterable(w for _, w in split))), 1)}
        found: dict[int, dict[tuple, set]] = {}
        for item, words in split:
            n = min(window, len(words))
            ids = [self.number[w] for w in words]
            for i in range(len(ids) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.windows = {n: np.array(list(d), np.int64) for n, d in found.items()}
        self.items = {n: [sorted(x) for x in d.values()] for n, d in found.items()}
        sizes = {min(SHINGLE, n) for n in found}
        self.shingles = {s: np.unique(np.concatenate([self.keys(n).ravel() for n in found if min(SHINGLE, n) == s])) for s in sizes}
        self.prefix: dict[int, tuple] = {}

    def keys(self, n: int) -> np.ndarray:
        """windows x shingles of each."""
        w, s = self.windows[n], min(SHINGLE, n)
        return np.stack([shingle_keys(row, s) for row in w])

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Take each window's rarest shingle for its prefix."""
        for n in self.windows:
            s, keys = min(SHINGLE, n), self.keys(n)
            known = self.shingles[s]
            count = np.array([counts.get((s, int(k)), 0) for k in known])
            offset = count[np.searchsorted(known, keys)].argmin(axis=1)
            prefix = keys[np.arange(len(keys)), offset]
            by = np.argsort(prefix, kind="stable")
            self.prefix[n] = (prefix[by], offset[by], by)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words], np.int64)

    def occurrences(self, n: int, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of each occurrence; begin and end are those of the document of each word."""
        prefix, offset, window = self.prefix[n]
        keys = shingle_keys(words, min(SHINGLE, n))
        at = np.flatnonzero(keys)
        at = at[np.isin(keys[at], prefix)]
        low, high = np.searchsorted(prefix, keys[at], "left"), np.searchsorted(prefix, keys[at], "right")
        many = high - low
        at, entry = np.repeat(at, many), np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(many) else low, many) + np.arange(many.sum())
        start = at - offset[entry]
        inside = (start >= begin[at]) & (start + n <= end[at])
        start, entry = start[inside], entry[inside]
        same = np.ones(len(start), bool)
        for i in range(n):
            same &= words[start + i] == self.windows[n][window[entry], i]
        return start[same], window[entry[same]]


def slices_of_words(part: pa.RecordBatch, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of all documents, n + 1 bounds)."""
    data, at = common.text_bytes(part.column(part.schema.get_field_index("text")))
    split = [words_of(data[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
    return block.numbers(list(chain.from_iterable(split))), bounds


def count_shingles(docs: DataFrame, block) -> dict[tuple[int, int], int]:
    """Occurrences of the block's shingles over all documents; no more entries than the block has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        b = block.value
        total = {s: np.zeros(len(k), np.int64) for s, k in b.shingles.items()}
        for batch in batches:
            for part in common.text_slices(batch):
                words, _ = slices_of_words(part, b)
                for s, known in b.shingles.items():
                    keys = shingle_keys(words, s)
                    keys = keys[keys > 0]
                    i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    total[s] += np.bincount(i[known[i] == keys], minlength=len(known))
        for s, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s, np.int32)), pa.array(b.shingles[s][some]), pa.array(n[some])], ["size", "shingle", "n"])

    rows = docs.select("text").mapInArrow(run, "size int, shingle long, n long").groupBy("size", "shingle").agg(F.sum("n").alias("n"))
    return {(r["size"], r["shingle"]): r["n"] for r in rows.collect()}


def probe(docs: DataFrame, block) -> DataFrame:
    """The documents (doc_id, text_hash) that the block hits, with spans (pairs of word positions) and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        b = block.value
        for batch in batches:
            for part in common.text_slices(batch):
                words, bounds = slices_of_words(part, b)
                doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                begin, end = bounds[doc], bounds[doc + 1]
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                for n in b.windows:
                    start, window = b.occurrences(n, words, begin, end)
                    for s, w, d in zip(start.tolist(), window.tolist(), doc[start].tolist(), strict=True):
                        spans.setdefault(d, []).append((s - bounds[d], s - bounds[d] + n))
                        items.setdefault(d, set()).update(b.items[n][w])
                hit = sorted(spans)
                columns = [*(part.column(c).take(pa.array(hit, pa.int64())) for c in (0, 1)), pa.array([np.array(spans[d], np.int64).tobytes() for d in hit], pa.binary()), pa.array([sorted(items[d]) for d in hit], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "spans", "items"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, spans binary, items array<string>")


def summed(hits: DataFrame) -> DataFrame:
    """Per hit document: n_hit, n_items, items_sha256, over all blocks' spans and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, n_items, sha = [], [], []
            for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, z = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2).T
                edge = np.zeros(int(z.max()) + 1, np.int64)
                np.add.at(edge, a, 1)
                np.add.at(edge, z, -1)
                n_hit.append(int((np.cumsum(edge) > 0).sum()))
                own = sorted(set(chain.from_iterable(items)))
                n_items.append(len(own)), sha.append(hashlib.sha256(",".join(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string())], ["hit_id", "hit_hash", "n_hit", "n_items", "items_sha256"])

    merged = hits.groupBy("doc_id", "text_hash").agg(F.collect_set("spans").alias("spans"), F.collect_list("items").alias("items"))
    return merged.mapInArrow(run, "hit_id long, hit_hash long, n_hit long, n_items long, items_sha256 string")


def counted(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch):
                n = word_counts(*common.text_bytes(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], ["doc_id", "text_hash", "n_words"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_words long")


def hit_documents(df: DataFrame, benchmark: DataFrame, window: int, text: str, key: str, item: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, text of all rows; of documents that any window hits: hit_id, hit_hash, n_hit, n_items, items_sha256)."""
    spark = df.sparkSession
    bench = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    docs = df.select(F.col(key).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    found = []
    for i in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i) if blocks > 1 else bench
        block = Block([(r["item"], r["text"]) for r in rows.collect()], window)
        sent = spark.sparkContext.broadcast(block)
        block.order(count_shingles(docs, sent))
        sent.unpersist()
        sent = spark.sparkContext.broadcast(block)
        found.append(common.written(probe(docs, sent), "hits"))
        sent.unpersist()
    hits = common.written(summed(reduce(DataFrame.unionByName, found)), "hit-documents")
    common.discard(*found)
    return docs, hits


def near(hits: DataFrame) -> DataFrame:
    return F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits.hint("merge")


def decontaminate(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, part: int = 20, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of df: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and part * n_hit >= n_words).

    Null and empty texts have no words and aren't contaminated; items without words have no window; repeated rows have equal
    results, rows of one id but different texts their own; repeated items count once; an empty benchmark hits nothing; an
    item of any length is taken whole; further columns aren't read, whatever their names.
    """
    docs, hits = hit_documents(df, benchmark, window, text, key, item, item_text)
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    out = counted(docs).join(near(hits), same, "left")
    none = hashlib.sha256(b"").hexdigest()
    out = out.select("doc_id", "n_words", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items")], F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * part >= F.col("n_words")))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, part: int = 20, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """df's rows, all columns, without the contaminated ones (as in decontaminate)."""
    docs, hits = hit_documents(df, benchmark, window, text, key, item, item_text)
    i, h = common.free_names(df.columns, "id", "hash")
    sizes = counted(docs.join(near(hits), docs["doc_id"].eqNullSafe(hits["hit_id"]) & (docs["text_hash"] == hits["hit_hash"]), "left_semi")).distinct()
    bad = sizes.join(near(hits), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))).where(F.col("n_hit") * part >= F.col("n_words"))
    gone = common.written(bad.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)), "contaminated")
    return df.join(near(gone), df[key].cast("long").eqNullSafe(F.col(i)) & (text_hash(df[text]) == F.col(h)), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, n, ws[i:i+n-1] AS w FROM (SELECT item, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT rid, n, i, ws[i:i+n-1] AS w FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
m AS (SELECT rid, i, dw.n, item FROM dw JOIN bw USING (n, w)),
h AS (SELECT rid, count(DISTINCT p) AS k FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS k, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(h.k, 0)::BIGINT AS n_hit, coalesce(it.k, 0)::BIGINT AS n_items, sha256(coalesce(it.s, '')) AS items_sha256,
 coalesce(h.k, 0) > 0 AND 20 * coalesce(h.k, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN it USING (rid)
"""

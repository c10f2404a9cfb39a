"""Operator 8: removal of repeated 50-byte strings by prefix-free parsing.

A rolling hash marks triggers: of the grams that a 50-byte window holds, the one of least hash. Consecutive windows of one
trigger form a phrase, so equal windows always lie in phrases of one trigger, and phrases cut the windows of a text into
disjoint runs. The parse is the sequence of phrases, each a trigger and a hash of its bytes; the dictionary has each phrase once,
with the least document that holds it.

1. Parse: phrases meet by trigger. A phrase whose bytes also are in a smaller document goes as a whole. Phrases of a trigger that
   only one document has are done. Each task first does this among its own phrases, so copies don't travel.
2. Dictionary: of triggers with several different phrases the bytes are fetched, and the suffixes of these phrases are sorted to
   the depth of 50 bytes, equal ones in order of document: the corpus order of just the windows that can repeat. A window that
   follows an equal one of a smaller document goes.
3. The runs that go are joined to their documents.

Phrases travel as arrays, one row for a task and hash range. No string is sorted to more than 50 bytes, as matches need no more.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orbweave.llm import common

LENGTH, GRAM = 50, 16
#: Bytes hashed at once; longer texts are parsed in segments, which only cuts a phrase in two.
SEGMENT = 1 << 21
#: Windows of one phrase at most, phrases that a task holds, windows sorted at once, text bytes a hash range.
PHRASE, HELD, SORTED, RANGE_BYTES = 4096, 300_000, 200_000, 4 << 20
SPLIT = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 64, 256, np.uint64)
BASE = 0x5851F42D4C957F2D
M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: A phrase: trigger, hash of its bytes, document (its place in a list), first window, number of windows.
RECORD = np.dtype([("h", "<u8"), ("e", "<u8"), ("d", "<u4"), ("s", "<u4"), ("n", "<u2")])
OUT = "kind int, part int, doc_id long, text_hash long, blob binary"
GONE, WANTED, PHRASES = 0, 1, 2


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1 and their inverses, modulo 2^64."""

    def of(b: int) -> np.ndarray:
        x = np.full(n, b, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)

    return of(BASE), of(pow(BASE, -1, 1 << 64))


class Rolling:
    """Polynomial hashes of any substring of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(SEGMENT + 4 * LENGTH + PHRASE)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(SPLIT[data] * up[: len(data)], out=self.sums[1:])

    def grams(self, n: int) -> np.ndarray:
        x = self.sums[n:] - self.sums[:-n]
        return mix(x * self.down[: len(x)])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` adjacent values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: -(width - have)], x[width - have :]) if width > have else x


def phrases(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """RECORDs of the texts data[bounds[i] : bounds[i + 1]], at most SEGMENT + LENGTH bytes in all; s counts in data."""
    if len(data) < LENGTH:
        return np.zeros(0, RECORD)
    roll = Rolling(data)
    least = sliding_least(roll.grams(GRAM), LENGTH - GRAM + 1)
    n = len(data) - LENGTH + 1
    inside = np.ones(n + 1, bool)
    for b in bounds[1:].tolist():
        inside[max(0, b - LENGTH + 1) : b] = False
    inside[n:] = False
    first = np.ones(n, bool)
    first[1:] = least[1:] != least[:-1]
    first[bounds[:-1][bounds[:-1] < n]] = True
    at = np.flatnonzero(first & inside[:n])
    if not len(at):
        return np.zeros(0, RECORD)
    ends = np.flatnonzero(~inside)  # a phrase ends with its text's last window, or before the next phrase
    stop = np.minimum(np.append(at[1:], n), ends[np.searchsorted(ends, at)])
    size = stop - at
    if (size > PHRASE).any():
        many = -(-size // PHRASE)
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at, stop = np.repeat(at, many) + k * PHRASE, np.repeat(stop, many)
        stop = np.minimum(stop, at + PHRASE)
        size = stop - at
    out = np.empty(len(at), RECORD)
    out["h"], out["e"] = least[at], roll.between(at, stop + LENGTH - 1)
    out["d"], out["s"], out["n"] = np.searchsorted(bounds, at, side="right") - 1, at, size
    return out


def parsed(texts: pa.Array) -> np.ndarray:
    """RECORDs of all texts, d counting texts and s bytes of the text."""
    data, at = common.text_bytes(texts)
    found, i = [], 0
    while i < len(texts):
        if at[i + 1] - at[i] > SEGMENT:
            for s in range(int(at[i]), int(at[i + 1]), SEGMENT):
                x = phrases(part := data[s : min(s + SEGMENT + LENGTH - 1, at[i + 1])], np.array([0, len(part)]))
                x["s"] += np.uint32(s - at[i])
                x["d"] = i
                found.append(x)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(at, at[i] + SEGMENT, side="right")) - 1)
        x = phrases(data[at[i] : at[j]], at[i : j + 1] - at[i])
        x["d"] += np.uint32(i)
        x["s"] -= (at[x["d"]] - at[i]).astype(np.uint32)
        found.append(x)
        i = j
    return np.concatenate(found) if found else np.zeros(0, RECORD)


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = functools.reduce(np.logical_or, (k[1:] != k[:-1] for k in keys))
    return new


def by_phrase(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x sorted by trigger, bytes and document; which of them have the same phrase in a smaller document)."""
    x = x[np.lexsort((x["s"], ids[x["d"]], x["e"], x["h"]))]
    doc, new = ids[x["d"]], group_starts(x["h"], x["e"])
    least = doc[new][np.cumsum(new) - 1] if len(x) else doc
    return x, doc > least


def pack(x: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> bytes:
    """Column by column, in order of document; the list of documents only has those that occur."""
    x = x[np.lexsort((x["s"], x["d"]))]
    used, d = np.unique(x["d"], return_inverse=True)
    head = np.array([len(x), len(used)], "<i8")
    return b"".join([head.tobytes(), ids[used].tobytes(), hashes[used].tobytes(), *(np.ascontiguousarray(c).tobytes() for c in (x["h"], x["e"], d.astype("<u4"), x["s"], x["n"]))])


def unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(records, ids, hashes, rest of each blob)."""
    rows, ids, hashes, rest, docs = [], [], [], [], 0
    for b in blobs:
        n, m = np.frombuffer(b, "<i8", 2).tolist()
        at = 16
        own = np.empty(n, RECORD)
        for out, kind, size in ((ids, "<i8", m), (hashes, "<i8", m)):
            out.append(np.frombuffer(b, kind, size, at))
            at += 8 * size
        for c in RECORD.names:
            own[c] = np.frombuffer(b, RECORD[c], n, at)
            at += n * RECORD[c].itemsize
        own["d"] += np.uint32(docs)
        docs += m
        rows.append(own)
        rest.append(np.frombuffer(b, np.uint8, offset=at))
    cat = lambda v, kind: np.concatenate(v) if v else np.zeros(0, kind)
    return cat(rows, RECORD), cat(ids, np.int64), cat(hashes, np.int64), rest


def per_document(kind: int, x: np.ndarray, ids: np.ndarray, hashes: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row a document, with its records (h, s, n)."""
    x = x[np.lexsort((x["s"], x["d"]))]
    new = np.flatnonzero(group_starts(x["d"])) if len(x) else np.zeros(0, int)
    d = x["d"][new]
    fields = ["h", "s", "n"] if kind == WANTED else ["s", "n"]
    flat = np.empty(len(x), [(c, RECORD[c]) for c in fields])
    for c in fields:
        flat[c] = x[c]
    blobs = [b.tobytes() for b in np.split(flat, new[1:])] if len(x) else []
    part = (mix(ids[d].view(np.uint64)) % np.uint64(parts)).astype(np.int32) if len(d) else np.zeros(0, np.int32)
    return batch_of(np.full(len(d), kind, np.int32), part, ids[d], hashes[d], blobs)


def batch_of(kind, part, ids, hashes, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(blobs, pa.binary())], ["kind", "part", "doc_id", "text_hash", "blob"])


def parse_documents(docs: DataFrame, parts: int) -> DataFrame:
    def flush(x: list, ids: list, hashes: list) -> Iterator[pa.RecordBatch]:
        ids, hashes = np.concatenate(ids), np.concatenate(hashes)
        x, gone = by_phrase(np.concatenate(x), ids)
        if gone.any():
            yield per_document(GONE, x[gone], ids, hashes, parts)
        x = x[~gone]
        part = mix(x["h"]) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        x, part = x[order], part[order]
        for y in np.split(x, np.flatnonzero(part[1:] != part[:-1]) + 1):
            if len(y):
                yield batch_of([PHRASES], [int(mix(y["h"][:1])[0] % np.uint64(parts))], [None], [None], [pack(y, ids, hashes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        x, ids, hashes, rows, docs = [], [], [], 0, 0
        for batch in batches:
            for part in common.text_slices(batch):
                own = parsed(part.column(2))
                own["d"] += np.uint32(docs)
                x.append(own), ids.append(part.column(0).to_numpy()), hashes.append(part.column(1).to_numpy())
                rows, docs = rows + len(own), docs + part.num_rows
                if rows >= HELD:
                    yield from flush(x, ids, hashes)
                    x, ids, hashes, rows, docs = [], [], [], 0, 0
        if rows:
            yield from flush(x, ids, hashes)

    return docs.mapInArrow(run, OUT)


def meet(table: pa.Table, parts: int) -> Iterator[pa.RecordBatch]:
    """The phrases of one range of triggers: what goes, and what is wanted of the dictionary."""
    common.let_go()
    kinds = np.asarray(table.column("kind"))
    for batch in table.filter(pa.array(kinds == GONE)).to_batches():
        yield batch
    x, ids, hashes, _ = unpack(table.filter(pa.array(kinds == PHRASES)).column("blob").to_pylist())
    if not len(x):
        return
    # triggers of several phrases only
    h = np.sort(x["h"])
    again = np.unique(h[1:][h[1:] == h[:-1]])
    if not len(again):
        return
    x = x[again[np.minimum(np.searchsorted(again, x["h"]), len(again) - 1)] == x["h"]]
    x, gone = by_phrase(x, ids)
    if gone.any():
        yield per_document(GONE, x[gone], ids, hashes, parts)
    x = x[~gone]
    # triggers with different phrases in different documents
    new = group_starts(x["h"])
    group, doc = np.cumsum(new) - 1, ids[x["d"]]
    starts = np.flatnonzero(new)
    several = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
    x = x[several[group]]
    if len(x):
        yield per_document(WANTED, x, ids, hashes, parts)


def fetch(asked: DataFrame, parts: int) -> DataFrame:
    """Rows (doc_id, text_hash, text, blobs) to the bytes of the wanted phrases, by range of triggers."""
    wanted = np.dtype([("h", "<u8"), ("s", "<u4"), ("n", "<u2")])

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([r for r, *_ in held])
        d = np.repeat(np.arange(len(held)), [len(r) for r, *_ in held])
        part = mix(x["h"]) % np.uint64(parts)
        ids, hashes = np.array([h[1] for h in held]), np.array([h[2] for h in held])
        for p in np.unique(part).tolist():
            at = np.flatnonzero(part == p)
            at = at[np.lexsort((x["s"][at], d[at]))]
            y = np.zeros(len(at), RECORD)
            y["h"], y["s"], y["n"], y["d"] = x["h"][at], x["s"][at], x["n"][at], d[at]
            body = b"".join([held[i][3][s : s + n + LENGTH - 1] for i, s, n in zip(d[at].tolist(), y["s"].tolist(), y["n"].tolist(), strict=True)])
            yield batch_of([PHRASES], [p], [None], [None], [pack(y, ids, hashes) + body])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i, t, text, blobs in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                r = np.concatenate([np.frombuffer(b, wanted) for b in blobs])
                held.append((r, i, t, (text or "").encode()))
                size += len(held[-1][3]) + 100 * len(r)
                if size > 64 << 20:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return asked.mapInArrow(run, OUT)


def sort_suffixes(table: pa.Table, parts: int) -> Iterator[pa.RecordBatch]:
    """The dictionary of one range of triggers: its suffixes in order to the depth of LENGTH bytes."""
    common.let_go()
    x, ids, hashes, rest = unpack(table.column("blob").to_pylist())
    body = np.concatenate(rest) if rest else np.zeros(0, np.uint8)
    size = x["n"].astype(np.int64) + LENGTH - 1
    place = np.cumsum(size) - size
    order = np.lexsort((ids[x["d"]], x["h"]))
    x, place = x[order], place[order]
    n = x["n"].astype(np.int64)
    edges = np.append(np.flatnonzero(group_starts(x["h"])), len(x)) if len(x) else np.zeros(1, int)
    upto = np.concatenate([[0], np.cumsum(n)])
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(upto[edges], upto[edges[i]] + SORTED, side="right")) - 1)
        a, b = edges[i], edges[j]
        i = j
        total = int(upto[b] - upto[a])
        rounds = -(-total // (2 * SORTED))
        for c in range(rounds):  # more than one only for a trigger with very many different phrases
            yield from suffix_round(x[a:b], place[a:b], body, ids, hashes, parts, rounds, c)


def suffix_round(x: np.ndarray, place: np.ndarray, body: np.ndarray, ids: np.ndarray, hashes: np.ndarray, parts: int, rounds: int, c: int) -> Iterator[pa.RecordBatch]:
    n = x["n"].astype(np.int64)
    owner = np.repeat(np.arange(len(x)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = place[owner] + step
    views = np.lib.stride_tricks.sliding_window_view(body, LENGTH)
    if rounds > 1:  # by the first and last bytes: equal windows are in one round
        ends = (body[at + i].astype(np.int64) for i in (0, LENGTH // 2, LENGTH - 1))
        mine = functools.reduce(lambda a, b: a * 257 + b, ends) % rounds == c
        owner, step, at = owner[mine], step[mine], at[mine]
    if not len(at):
        return
    windows = np.ascontiguousarray(views[at]).view(f"S{LENGTH}").ravel()
    doc = ids[x["d"]][owner]
    by_doc = np.argsort(doc, kind="stable")
    order = by_doc[np.argsort(windows[by_doc], kind="stable")]
    w, doc = windows[order], doc[order]
    new = group_starts(w)
    gone = order[doc > doc[new][np.cumsum(new) - 1]]
    if len(gone):
        gone = np.sort(gone)
        o, s = owner[gone], step[gone]
        first = np.ones(len(gone), bool)
        first[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)
        f = np.flatnonzero(first)
        y = np.zeros(len(f), RECORD)
        y["d"], y["s"], y["n"] = x["d"][o[f]], x["s"][o[f]] + s[f], np.diff(np.append(f, len(gone)))
        yield per_document(GONE, y, ids, hashes, parts)


def runs_gone(blobs: list[bytes] | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, last byte + 1) of the maximal runs of removed bytes."""
    x = np.concatenate([np.frombuffer(b, [("s", "<u4"), ("n", "<u2")]) for b in blobs or []] or [np.zeros(0, [("s", "<u4"), ("n", "<u2")])])
    edge = np.zeros(size + 2, np.int64)
    np.add.at(edge, x["s"].astype(np.int64) + 1, 1)
    np.add.at(edge, x["s"].astype(np.int64) + x["n"] + LENGTH, -1)
    covered = np.diff(np.concatenate([(np.cumsum(edge) > 0).astype(np.int8), [0]]))
    return np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)


def suffix_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = True, carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, with with_text the remaining `text` (null for null), and the columns to carry.

    Each byte covered by a 50-byte string that also starts in a document of smaller doc_id is removed; strings are judged on
    the input. A null text is an empty one; texts under 50 bytes stay. Rows of a null id neither lose bytes nor cause it, nor do
    rows of equal id to each other. Where a cut falls inside a character, what is left of that character isn't in `text`, but
    in the digest. Empty tables give empty ones; further columns aren't read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(F.col(text).isNull().alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry or [])]).alias("carried"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, total // RANGE_BYTES)
    by_part = lambda rows, f: rows.groupBy("part").applyInArrow(lambda table: pa.Table.from_batches([*f(table, parts)], schema=empty.schema), OUT)
    empty = batch_of([], [], [], [], [])
    first = common.written(by_part(parse_documents(docs.select("doc_id", "text_hash", "text").where(f"doc_id IS NOT NULL AND octet_length(text) >= {LENGTH}"), parts), meet), "parse")
    common.release_shuffles(spark)
    plain = docs.select("doc_id", "text_hash", "text")
    blobs = lambda rows: rows.groupBy("doc_id", "text_hash").agg(F.collect_list("blob").alias("blobs"))
    asked = plain.join(blobs(first.where(F.col("kind") == WANTED)), ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "blobs")
    second = common.written(by_part(fetch(asked, parts), sort_suffixes), "suffixes")
    common.release_shuffles(spark)
    gone = blobs(first.where(F.col("kind") == GONE).unionByName(second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch):
                data, at = common.text_bytes(part.column(1))
                rows = []
                for i, a, b, blobs in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), part.column(2).to_pylist(), strict=True):
                    left = data[a:b].tobytes()
                    starts, stops = runs_gone(blobs, b - a) if blobs else (np.zeros(0, int), np.zeros(0, int))
                    if len(starts):
                        cuts = zip([0, *stops.tolist()], [*starts.tolist(), b - a], strict=True)
                        left = b"".join([left[s:e] for s, e in cuts])
                    rows.append((i, b - a, b - a - len(left), len(starts), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*made, part.column(3)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "carried"]
    schema = StructType()
    for name, kind in zip(names, ["long"] * 4 + ["string"] * 2 + [docs.schema["carried"].dataType], strict=True):
        schema = schema.add(name, kind)
    out = docs.join(gone, ["doc_id", "text_hash"], "left").select("doc_id", "text", "blobs", "carried").mapInArrow(run, schema)
    own = [F.col("carried").getField(f"c{i}").alias(c) for i, c in enumerate(carry or [])]
    left = F.when(~F.col("carried.none"), F.col("text")).alias("text")
    return out.select(*names[:5], *([left] if with_text else []), *own)


def cut_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", n_chars: str | None = None) -> DataFrame:
    """df's rows, all columns, with the text that suffix_dedup() leaves, and its number of characters in a column n_chars, if
    there is one of that name."""
    marked = df.select(F.col(key).alias("id"), F.col(text).alias("body"), F.struct(F.lit(0).alias("_"), *[df[c] for c in df.columns if c != text]).alias("row"))
    cut = suffix_dedup(marked, text="body", key="id", carry=["row"])
    size = lambda c: F.length("text").cast(df.schema[c].dataType)
    return cut.select(*[F.col("text").alias(c) if c == text else size(c).alias(c) if c == n_chars else F.col("row").getField(c).alias(c) for c in df.columns])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(common.documents(spark, sf_dir), with_text=False)


OP8_SQL = """
WITH b AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS h FROM documents),
w AS (SELECT rid, doc_id, i, h[i:i+49] AS win FROM (SELECT rid, doc_id, h, unnest(range(1, octet_length(h) - 48)) AS i FROM b WHERE octet_length(h) >= 50)),
f AS (SELECT win, min(doc_id) AS first_id FROM w GROUP BY win),
gone AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM w JOIN f USING (win) WHERE doc_id > first_id),
marked AS (SELECT rid, i, sum(CASE WHEN prev IS NULL OR i > prev + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM gone),
runs AS (SELECT rid, run, min(i) AS a, max(i) + 49 AS z FROM marked GROUP BY rid, run),
gaps AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) + 1 AS since FROM runs),
cut AS (SELECT rid, count(*) AS n_spans, sum(z - a + 1) AS n_removed, max(z) AS tail, string_agg(CASE WHEN since < a THEN hex(h[since:a-1]) ELSE '' END, '' ORDER BY a) AS hx FROM gaps JOIN b USING (rid) GROUP BY rid)
SELECT doc_id, octet_length(h)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
 sha256(unhex(coalesce(hx, '') || CASE WHEN coalesce(tail, 0) < octet_length(h) THEN hex(h[coalesce(tail, 0) + 1:octet_length(h)]) ELSE '' END)) AS kept_sha256
FROM b LEFT JOIN cut USING (rid)
"""

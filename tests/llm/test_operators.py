"""The text operators against brute force, the libraries or SQL, on a small table with the odd cases in it."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbweave.llm import bpe, decontaminate, minhash, pieces, quality, resampling, shards, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, key string, label double, spans string"
ITEMS = [(1, " ".join(f"item{i}" for i in range(20))), (2, "Short, item"), (3, None), (4, "..."), (5, "Short item")]


def texts():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = prose(120), prose(60)
    near = base.split()
    near[50] = "changed"
    out = [None, "", " \n\t ", "one", "one two", "a" * 3000, "\x00nul \x1c|#*", base, base, " ".join(near), base.upper()]
    out += [prose(30) + " " + passage + " " + prose(r.randint(0, 40)) for _ in range(4)]
    out += [prose(8) + " " + ITEMS[0][1] + ". " + prose(5), "x short ITEM y", "line one\nline one\nline two " + prose(60), prose(20000)]
    out += [prose(r.randint(1, 200)) + " 日本 ΑΣ <|endoftext|> <s> ½" for _ in range(20)]
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}", 0, 1, "x", "k", 0.5, "y") for i, t in enumerate(texts())]
    return out + [out[7], (None, "a null id " * 20, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    """The set itself: tuples of k words, or of all words if there are fewer."""
    w = (text or "").encode().lower().split()
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.word_vocabulary())
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in rows]
    assert pairs(bpe.count_tokens(docs, bpe.word_vocabulary()), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert bpe.count_tokens(empty, bpe.word_vocabulary()).count() == 0


def test_every_character_below_u0250():
    """Alone, beside letters, between them, beside digits and signs: counts and ids are the library's."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.word_vocabulary())
    counter, coder = bpe.MergeCounter(bpe.word_vocabulary()), bpe.WordEncoder(bpe.word_vocabulary())
    texts = [t for c in map(chr, range(0x250)) for t in (c, "a" + c, c + "b", "AB" + c + "cd", c + c, "1" + c + "2", "." + c + "!", "é" + c + "Ł x")]
    r = random.Random(8)
    texts += ["".join(chr(r.randrange(0x20, 0x250)) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    texts += ["".join(r.choice("aBé Ɓ1'.ſ<>s|\u0301\u1e9eİ日") for _ in range(r.randint(1, 12))) for _ in range(3000)]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == [len(w) for w in want]
    assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts)] == want


def test_token_files(spark, docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.word_vocabulary())
    for name, df, own in (("a", docs, rows), ("b", empty, [])):
        files = bpe.write_token_files(df, bpe.word_vocabulary(), f"file://{tmp_path}/{name}", 2)
        got = bpe.read_token_files(spark, f"file://{tmp_path}/{name}", files, None).orderBy("start").collect()
        order = sorted(own, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
        assert [r["doc_id"] for r in got] == [r[0] for r in order]
        at = 0
        for r, (_, t, *_) in zip(got, order, strict=True):
            want = lib.encode(t or "", add_special_tokens=False).ids + [2]
            assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(want), want)
            at += len(want)
    digest = bpe.ids_digest
    assert digest(np.array([1, 2], "<u2"))["ids_crc32"] == zlib.crc32(b"\1\0\0\0\2\0\0\0")


def test_pieces(docs, rows, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.piece_path())
    coded = pieces.encode(docs, pieces.piece_path())
    assert pairs(coded, "doc_id", "ids") == sorted(((i, lib.encode(t or "")) for i, t, *_ in rows), key=str)
    back = pieces.decode(coded, pieces.piece_path())
    assert pairs(back, "doc_id", "text") == sorted(((i, t or "") for i, t, *_ in rows), key=str)
    assert pieces.encode(empty, pieces.piece_path()).count() == 0
    m = pieces.PieceModel(pieces.piece_path())
    assert list(m.stream("▁" + "the" * 100)) == m.merged("▁" + "the" * 100)


def test_decontaminate(spark, docs, rows, empty, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())

    def one(i, t):
        w, hit, items = split(t), set(), set()
        for item, x in ITEMS:
            v = split(x)
            n = min(13, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[a : a + n]:
                        hit |= set(range(s, s + n))
                        items.add(str(item))
        return (i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))

    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted((one(i, t) for i, t, *_ in rows), key=str)
    assert any(w[2] for w in want)
    assert pairs(decontaminate.decontaminate(docs, bench), *columns) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 64)  # several blocks
    assert pairs(decontaminate.decontaminate(docs, bench), *columns) == want
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count()


def test_suffix_dedup(docs, rows, empty, monkeypatch):
    seen, want = {}, []
    for i, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            if i is not None:
                seen[b[s : s + 50]] = min(i, seen.get(b[s : s + 50], i))
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if i is not None and seen[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        want.append((i, len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest()))
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert any(w[2] for w in want)
    assert pairs(suffixes.suffix_dedup(docs), *columns) == sorted(want, key=str)
    assert suffixes.suffix_dedup(empty).count() == 0


def test_phrases_hold_every_window_once(monkeypatch):
    """Also where texts are parsed in segments and phrases are cut."""
    r = random.Random(12)
    texts = ["".join(r.choice("ab c") for _ in range(n)) for n in (0, 49, 50, 51, 700, 3000)] + ["z" * 900, None]
    for segment, phrase in ((1 << 21, 4096), (256, 16), (64, 3)):
        monkeypatch.setattr(suffixes, "SEGMENT", segment)
        monkeypatch.setattr(suffixes, "PHRASE", phrase)
        suffixes.powers.cache_clear()
        got = [[0] * max(0, len(t or "") - 49) for t in texts]
        trigger = {}
        for x in suffixes.parsed(pa.array(texts)):
            for i in range(int(x["s"]), int(x["s"]) + int(x["n"])):
                got[x["d"]][i] += 1
                window = texts[x["d"]][i : i + 50]
                assert trigger.setdefault(window, x["h"]) == x["h"]
        assert all(set(g) <= {1} for g in got)
    suffixes.powers.cache_clear()


def test_texts_longer_than_a_segment(spark):
    r = random.Random(13)
    long = "".join(r.choice("abcdefgh ") for _ in range(suffixes.SEGMENT + 60_000))
    part = long[suffixes.SEGMENT - 30_000 : suffixes.SEGMENT + 30_000]
    df = spark.createDataFrame([(1, long), (2, part), (3, "x" * 40 + part + "y" * 60), (4, "y" * 60)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["text"]) for r in suffixes.suffix_dedup(df).collect()}
    assert got == {1: (0, 0, long), 2: (60_000, 1, ""), 3: (60_000, 1, "x" * 40 + "y" * 60), 4: (60, 1, "")}


def test_near_duplicates(docs, rows, empty):
    sets = {i: shingles(t, 3) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = minhash.near_duplicates(docs, k=3, percent=85, bands=45, rows=6)
    want = [(i, len(sets[i]), root(i), root(i) == i) for i, *_ in rows if i is not None]
    assert pairs(got.where("doc_id IS NOT NULL"), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=str)
    assert got.where("doc_id IS NULL AND kept").count() == 1
    assert minhash.near_duplicates(empty).count() == 0


def test_sql_of_whole_tables(spark):
    """The queries that have SQL, on the smallest tables."""
    from orbweave.llm import queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        want = con.sql(sql)
        columns = sorted(want.columns)
        assert pairs(queries.QUERIES[name](spark, folder), *columns) == sorted(want.select(*columns).fetchall(), key=str), name


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 101)], "a long, b long")
    assert pairs(minhash.components(links), "v", "label") == sorted([(i, 1) for i in range(1, 41)] + [(i, 100) for i in (100, 101, 102)], key=str)


def test_shards(spark, docs, rows, empty, tmp_path):
    got = shards.assign_shards(docs, 5).collect()
    assert len(got) == len(rows)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    assert shards.assign_shards(empty).count() == 0
    # whole rows, with columns named shard and key, in the same shards
    name = shards.write_shards(docs, f"file://{tmp_path}/s", 5)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert pairs(back, "doc_id", "text", "shard", "key") == pairs(docs, "doc_id", "text", "shard", "key")
    of = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in got}
    assert all(of[r["doc_id"], zlib.crc32((r["text"] or "").encode())] == r[name] for r in back.collect())


def test_shards_against_a_sort(spark):
    """Bytes, slots and groups by brute force, with ties, repeated rows, and a text that a third of the rows have."""
    r = random.Random(2)
    rows = [(i, "hot " * 20 if i % 3 == 0 else "x" * r.randint(0, 120)) for i in range(1200)] + [(7, "x")] * 5 + [(None, "y"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    key = {(k["doc_id"], k["text"]): k["key"] for k in df.withColumn("key", shards.sort_key(F.col("text"), F.col("doc_id"))).collect()}
    order = sorted(rows, key=lambda x: (key[x], x[0] is not None, x[0] or 0, zlib.crc32((x[1] or "").encode())))
    results = []
    for parts in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(pairs(shards.assign_shards(df, 6, tolerance=0.01), "doc_id", "size", "text_crc32", "shard", "slot"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
    size = [0] * 6
    for _, n, _, s, _ in results[0]:
        size[s] += n
    assert max(size) - min(size) <= 0.02 * sum(size) / 6 + 2 * 136, size
    ranked = sorted(results[0], key=lambda x: (x[3], x[4]))
    assert [(i, zlib.crc32((t or "").encode())) for i, t in order] == [(x[0], x[2]) for x in ranked]
    hot = {s for _, _, c, s, _ in results[0] if c == zlib.crc32(b"hot " * 20)}
    assert hot == set(range(min(hot), max(hot) + 1))


def test_splitters_of_a_hot_key(spark):
    hot = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(30064771072) + F.col("id")).otherwise(F.col("id") * 3074457345618258).cast("long").alias("key"), F.lit(1).cast("long").alias("size"))
    cuts = shards.even_splitters(hot, 6, 0.01)
    below = [hot.where(F.col("key") < c).count() for c in cuts]
    assert all(abs(b - 500 * i) <= 6 for i, b in enumerate(below, 1)), below


def test_quality_rules(docs, rows, empty):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({quality.OP9_SQL})").fetchall()
    assert pairs(quality.adaptive_rules(docs), *columns) == sorted(want, key=str)
    assert quality.adaptive_rules(empty).count() == 0


def test_fences_of_small_groups(spark):
    """A group of least_rows rows has fences of its own, one row less takes its language's."""
    r = random.Random(4)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(n)) for _ in range(60))
    rows = [(i, text(5), "en", "plain") for i in range(300)] + [(1000 + i, text(40), "en", "long") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = lambda n: quality.adaptive_rules(df, least_rows=n).where("kept AND doc_id >= 1000").count()
    assert (kept(30), kept(31)) == (30, 0)


def test_sketch_buckets(spark):
    v = spark.range(0, 70000, 7).withColumn("b", quality.bucket(F.col("id"))).withColumn("low", quality.least_of(F.col("b")))
    assert v.where("low > id OR (id - low) * 100 > id").count() == 0


@pytest.fixture(scope="module")
def marked(spark):
    r = random.Random(3)
    words = ["".join(r.choice("etaoins") for _ in range(r.randint(2, 7))) for _ in range(500)]
    bad = ["grobnik", "flapdoodle", "snarkwit"]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(words) for _ in range(60)]
        if i % 4 == 0:
            w[r.randrange(60)] = w[r.randrange(60)] = r.choice(bad)
        rows.append((i, " ".join(w) if i % 5 else " ".join(x + "#%" for x in w)))
        labels.append((i, int(i % 5 != 0), int(i % 4 == 0)))
    return spark.createDataFrame(rows + [(None, None), (700, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(marked, empty):
    df, labels = marked
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, labels).collect()}
    assert len(got) == 602 and got[700]["predicted"] == got[None]["predicted"] == 0
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in range(600) if got[i]["held_out"]} == set(held)
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.9 * len(held)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(df, labels.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_of_odd_tables(spark, marked):
    """Columns named like the results pass through, repeated rows share a verdict, and partitions don't matter."""
    df, labels = marked
    odd = df.union(df.where("doc_id < 30")).withColumns({c: F.lit(7) for c in ("score", "predicted", "through", "held_out")})
    plain = dict(pairs(toxicity.toxicity(df, labels), "doc_id", "score"))
    again = pairs(toxicity.toxicity(odd.repartition(7), labels), "doc_id", "score")
    assert len(again) == 632 and dict(again) == plain
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns
    want = [(i, t, 7, 7, 7, 7) for i, t in pairs(odd, "doc_id", "text") if plain[i] < 0.5]
    assert pairs(kept, *odd.columns) == sorted(want, key=str)


def test_toxicity_fits_within_its_bounds(marked, monkeypatch):
    df, labels = marked
    monkeypatch.setattr(toxicity, "TOXIC_DOCS", 10)
    monkeypatch.setattr(toxicity, "ORDINARY_DOCS", 20)
    rows = toxicity.training_rows(df, labels, "text", "doc_id", "toxic")
    assert (sum(y for _, y in rows), len(rows)) == (10, 30)
    monkeypatch.setattr(toxicity, "FIT_BYTES", 5000)
    assert sum(len(t.encode()) for t, _ in toxicity.training_rows(df, labels, "text", "doc_id", "toxic")) <= 5000


def test_resampling(spark, marked, empty):
    df, labels = marked
    got = {r["doc_id"]: r for r in resampling.resample(df, labels, 0.5).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    # brute force: both models, the sum of log ratios, the noise, the largest half
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1} - set(held)
    grams = {i: [int(b) for b in resampling.buckets(pa.array([t], pa.string()))[0]] for i, t in text.items()}
    assert all(len(g) == max(0, 2 * len((text[i] or "").split()) - 1) for i, g in grams.items())
    raw = Counter(b for g in grams.values() for b in g)
    target = Counter(b for i in good for b in grams[i])
    size = 1 << resampling.BUCKET_BITS
    ratio = lambda b: math.log((target[b] + 1) / (target.total() + size)) - math.log((raw[b] + 1) / (raw.total() + size))
    noise = {r["doc_id"]: -math.log(-math.log(((r["h"] % (1 << 64) >> 11) + 0.5) / (1 << 53))) for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(42)).alias("h")).collect()}
    want = {i: sum(map(ratio, g)) for i, g in grams.items()}
    assert all(abs(got[i]["log_weight"] - w) < 1e-9 * (1 + abs(w)) and got[i]["n_grams"] == len(grams[i]) for i, w in want.items())
    keys = {i: w + noise[i] for i, w in want.items()}
    assert all(abs(got[i]["gumbel_key"] - k) < 1e-6 for i, k in keys.items())
    best = sorted(keys, key=keys.get, reverse=True)[:301]
    assert {i for i, r in got.items() if r["selected"]} == set(best)
    high, low = ([got[i]["log_weight"] for i in held if (i % 5 != 0) == y] for y in (True, False))
    assert min(high) > max(low)
    assert resampling.resample(empty, labels).count() == 0
    # repeated rows have one weight and verdict; further columns don't matter; without labels length means nothing
    more = df.union(df.where("doc_id < 20")).withColumn("key", F.lit("x")).withColumn("selected", F.lit(1)).withColumn("n_grams", F.lit(0))
    again = resampling.resample(more, labels, 0.5).collect()
    assert len(again) == 622 and all(len({(r["log_weight"], r["selected"]) for r in again if r["doc_id"] == i}) == 1 for i in range(20))
    assert {r["log_weight"] for r in resampling.resample(df, labels.limit(0)).collect()} == {0.0}


def test_group_of_near_copies_around_the_threshold(spark):
    """One original's copies with so many edits that some are linked to it, some only to each other and some to nothing."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(900)]
    base, out = [r.choice(words) for _ in range(150)], []
    for _ in range(260):
        copy = list(base)
        for _ in range(r.randint(1, 6)):
            copy[r.randrange(150)] = r.choice(words)
        out.append(copy)
        if r.random() < 0.2:
            out.append(copy[:100] + [r.choice(words)] + copy[101:])
    sets = [shingles(" ".join(c), 3) for c in out]
    label = list(range(len(out)))
    for i, x in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and 100 * (both := len(x & sets[j])) >= 85 * (len(x) + len(sets[j]) - both):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if v == old else v for v in label]
    assert sum(label.count(v) == 1 for v in set(label)) > 3 and sum(label.count(v) > 1 for v in set(label)) > 2
    docs = spark.createDataFrame([(i, " ".join(c)) for i, c in enumerate(out)], "doc_id long, text string")
    got = minhash.near_duplicates(docs, k=3, percent=85, bands=45, rows=6)
    assert dict(pairs(got, "doc_id", "component_id")) == dict(enumerate(label))

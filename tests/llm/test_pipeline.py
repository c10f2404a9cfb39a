"""The pipeline's stages and a whole run against brute force, on a small table with the odd cases in it."""

import random
import re

import pytest
import xxhash

import corpus_pipeline
from orbweave.llm import pieces, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string, n_bytes int, text_hash string, row int, id_0 int, carried string, n_hit int"
REST = ("en", "s", 0, 0.25, "p", 1, "h", 2, 3, "c", 4)
ITEM = " ".join(f"question{i}" for i in range(20))


def table():
    r = random.Random(17)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(600)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base, other = prose(60), prose(150), prose(40)
    near = base.split()
    near[75] = "changed"
    far = base.split()
    for i in range(0, 150, 6):
        far[i] = "x" + far[i]
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, " ".join(far)), (5, base.upper()), (6, None), (7, ""), (8, " \n "), (9, None)]
    rows += [(10, other), (10, other), (10, prose(30)), (11, other), (12, "tiny text"), (13, "tiny text"), (None, base), (None, base)]
    rows += [(20 + i, prose(20) + " " + passage + " " + prose(r.randint(1, 30))) for i in range(4)]
    rows += [(30, prose(5) + " " + ITEM + " " + prose(5)), (31, ITEM), (32, prose(900) + " " + ITEM), (33, prose(9000)), (34, "é" * 2000)]
    labels = []
    for i in range(100, 160):
        w = prose(40).split()
        if i % 3 == 0:
            w[5] = w[25] = r.choice(["grobnik", "flapdoodle"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 3 == 0)))
    n = lambda t: None if t is None else len(t)
    return [(i, t, *REST[:2], n(t), *REST[3:]) for i, t in rows], labels


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rows, labels = table()
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def not_toxic(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{folder}/labels.parquet"), "text", "doc_id", "toxic"))
    d, w = toxicity.Distance(model.ordinary, model.toxic), toxicity.np.array(model.weights)
    return [r for r in rows if not r[1] or d.score(r[1], w) < 0.5]


def one_of_near(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append(set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    live = [i for i, s in enumerate(sets) if s and rows[i][0] is not None]
    for i in live:
        for j in live:
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    kept = [r for i, r in enumerate(rows) if i not in live]
    signed = lambda t: (h := xxhash.xxh64((t or "").encode(), seed=42).intdigest()) - ((h >> 63) << 64)
    for x in {label[i] for i in live}:
        kept.append(min((rows[i] for i in live if label[i] == x), key=lambda r: (r[0], signed(r[1]))))
    return kept


def cut(rows):
    first = {}
    for r in rows:
        b = (r[1] or "").encode()
        for s in range(len(b) - 49):
            if r[0] is not None:
                first[b[s : s + 50]] = min(r[0], first.get(b[s : s + 50], r[0]))
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if r[0] is not None and first[b[s : s + 50]] < r[0]:
                gone[s : s + 50] = b"\1" * 50
        left = None if r[1] is None else bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        out.append((r[0], left, *r[2:4], None if left is None else len(left), *r[5:]))
    return out


def clean(rows):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    item, out = split(ITEM), []
    for r in rows:
        w, hit = split(r[1]), set()
        for a in range(len(item) - 12):
            hit |= {p for s in range(len(w) - 12) if w[s : s + 13] == item[a : a + 13] for p in range(s, s + 13)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(r)
    return out


def coded(rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.piece_path())
    return [(r[0], ids := lib.encode(r[1] or ""), len(ids)) for r in rows]


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_and_run(spark, data):
    folder, rows = data
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = rows
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (lambda x: not_toxic(spark, folder, x), one_of_near, cut, clean, coded), strict=True):
        before, expected = len(expected), brute(expected)
        got = stage(spark, docs, folder)
        assert plain(got) == sorted(expected, key=str), name
        if name in ("toxicity", "minhash", "decontaminate"):
            assert got.columns == docs.columns and len(expected) < before, name
        if name != "sentencepiece":
            docs = spark.createDataFrame(expected, SCHEMA).repartition(3)
    assert plain(corpus_pipeline.run(spark, folder)) == sorted(expected, key=str)


def test_no_rows(spark, data, tmp_path):
    folder, _ = data
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_an_innocent_row_of_a_repeated_id_stays(spark, data):
    text = " ".join(f"word{i}" for i in range(50))
    df = spark.createDataFrame([(1, text), (2, text), (2, "another text that nothing else has in it")], "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["minhash"](spark, df, data[0])
    assert plain(got) == [(1, text), (2, "another text that nothing else has in it")]

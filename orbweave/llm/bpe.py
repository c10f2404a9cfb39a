"""Operators 4 and 6: token counts by heap-and-linked-list merging, and flat token files.

Both first cut a text into the vocabulary's words. Words repeat, so each worker keeps the answers for those it has seen, up to
a bound.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import common

#: Words whose answers a worker keeps; beyond it starts anew, so memory is bounded whatever the texts hold.
CACHE = 700_000
#: Longer words aren't kept.
CACHE_CHARS = 64
#: Of the characters below U+0250: letters and digits in the sense of the vocabulary's pattern, after lower-casing.
LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")
#: Characters for which the library's own normalizer and splitter are asked: all from U+0250, those below whose small letter is
#: from U+0250, and four that are white space to Python only.
BEYOND = "".join(chr(c) for c in range(0x250) if max(chr(c).lower()) >= "\u0250")
ODD = re.compile(f"[\u0250-\U0010ffff{BEYOND}\x1c-\x1f]")
SPACE = re.compile("[ \t\n\r]+")


def words_of(text: str, specials: re.Pattern | None) -> list[str]:
    """The words of a text. A stretch between white space that needs the library comes whole, behind one space."""
    odd = ODD.search(text) or specials and "<" in text and specials.search(text)
    if not odd:
        return WORD.findall(text.lower())
    out: list[str] = []
    for x in SPACE.split(text):
        if x:
            out += [" " + x] if ODD.search(x) or specials and specials.search(x) else WORD.findall(x.lower())
    return out


def special_pattern(spec: dict) -> re.Pattern | None:
    found = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, found))) if found else None


def check_pattern(spec: dict) -> None:
    """words_of() stands for one normalizer and one splitting pattern; refuse others."""
    kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    split = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
    if kinds != ["NFC", "Replace", "Lowercase"] or split != ["Split", "ByteLevel"] or spec["model"].get("end_of_word_suffix") != "</w>":
        raise ValueError("a word vocabulary (NFC, white space, lower case; words, word ends) is needed")


class MergeCounter:
    """Counts the tokens of a BPE vocabulary in the tokenizers format without making an id.

    The vocabulary's own normalizer and splitter cut a piece into words; merging is done here. The symbols of a word are a
    linked list; a heap holds every adjacent pair that has a rank; the lowest is popped, leftmost first, and a pair that no
    longer stands is skipped. The count is the number of first symbols less the number of merges.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        check_pattern(spec)
        model = spec["model"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.suffix = model.get("end_of_word_suffix") or ""
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.specials = special_pattern(spec)
        self.bytes = dict(enumerate(byte_letters()))
        self.seen: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Symbols of one word less merges."""
        symbols = list(word)
        if self.suffix:
            symbols[-1] += self.suffix
        n = len(symbols)
        if n < 2:
            return n
        ranks, after, before = self.ranks, [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # one of the two has been merged since
            merges += 1
            symbols[i], symbols[j] = left + right, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return n - merges

    def plain(self, piece: str) -> int:
        if not piece:
            return 0
        clean = self.normalizer.normalize_str(piece) if self.normalizer else piece
        return sum(self.word(w) for w, _ in self.splitter.pre_tokenize_str(clean))

    def stretch(self, piece: str) -> int:
        if self.specials and self.specials.search(piece):
            return len(self.specials.findall(piece)) + sum(map(self.plain, self.specials.split(piece)))
        return self.plain(piece)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words, seen, total = words_of(text, self.specials), self.seen, 0
        try:
            return sum([seen[w] for w in words])
        except KeyError:
            pass
        for w in words:
            n = seen.get(w)
            if n is None:
                n = self.stretch(w[1:]) if w[0] == " " else self.word(w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes))
                if len(w) <= CACHE_CHARS:
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen[w] = n
            total += n
        return total


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be printed, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def merge_counter(path: str) -> MergeCounter:
    """One a worker, which later tasks find with what it has kept."""
    return common.held(MergeCounter, path)


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_bytes, n_tokens, over_limit.

    A null text is an empty one: no bytes, no tokens, not over the limit. Repeated rows and keys each get their own row, a null
    key is kept, an empty table gives an empty one, further columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merge_counter(tokenizer_path)
        for batch in batches:
            for part in common.text_slices(batch):
                n = pa.array(map(counter.count, part.column(1).to_pylist()), pa.int64())
                size = np.diff(common.text_bytes(part.column(1))[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


class WordEncoder:
    """Ids of whole texts as little-endian bytes, by the tokenizers library on the words not seen before."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        check_pattern(spec)
        self.specials, self.library = special_pattern(spec), Tokenizer.from_file(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.ends = np.zeros(size, bool)
        self.ends[[i for x, i in self.library.get_vocab().items() if x.endswith("</w>")]] = True
        self.seen: dict[str, bytes] = {}

    def ask(self, words: list[str]) -> dict[str, bytes]:
        """A word's ids don't depend on its neighbours, and only the last of them ends a word: words are asked for together."""
        whole = [w for w in words if w[0] == " "]
        found = {w: np.asarray(e.ids, self.dtype).tobytes() for w, e in zip(whole, self.library.encode_batch([w[1:] for w in whole], add_special_tokens=False), strict=True)}
        for i in range(0, len(words), 4096):
            part = [w for w in words[i : i + 4096] if w[0] != " "]
            ids = np.asarray(self.library.encode(" ".join(part), add_special_tokens=False).ids, self.dtype)
            at = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else []
            if len(at) != len(part):  # words that would join or part
                found |= {w: np.asarray(self.library.encode(w, add_special_tokens=False).ids, self.dtype).tobytes() for w in part}
                continue
            data, begin = ids.tobytes(), 0
            for w, stop in zip(part, (at * ids.itemsize).tolist() if len(part) else [], strict=True):
                found[w] = data[begin:stop]
                begin = stop
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [words_of(x, self.specials) if x else [] for x in texts]
        if len(self.seen) > CACHE:
            self.seen.clear()
        seen = self.seen
        new = [x for x in set().union(*split) if x not in seen]
        if new:
            seen.update(self.ask(new))
        out = [b"".join(map(seen.__getitem__, words)) for words in split]
        for x in new:
            if len(x) > CACHE_CHARS:
                del seen[x]
        return out


def word_encoder(path: str) -> WordEncoder:
    return common.held(WordEncoder, path)


def write_token_files(df: DataFrame, tokenizer_path: str, folder: str, end_id: int, text: str = "text", key: str = "doc_id") -> list[dict]:
    """Write the ids of every text in ascending key order; return the manifest, one entry a file.

    Format, for file number p: `p.ids`, flat unsigned little-endian integers (16 bits if the vocabulary fits, else 32), each
    document followed by end_id; `p.off`, n + 1 signed 64-bit offsets in ids from the file's start; `p.key`, n signed 64-bit
    keys (the least value stands for null). The manifest has the file's name, documents, ids and base: the ids in all files
    before it, by a prefix sum over the files. Rows of equal keys follow each other in order of text. A null text has only the
    end id; an empty table gives no file. A repeated task replaces its files by the same.
    """
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_encoder(tokenizer_path)
        end = np.asarray([end_id], coder.dtype).tobytes()
        ids, lengths, keys = [], [], []
        for batch in batches:
            for part in common.text_slices(batch):
                for x in coder.encode(part.column(1).to_pylist()):
                    ids += [x, end]
                    lengths.append((len(x) + len(end)) // len(end))
                keys.append(part.column(0).fill_null(np.iinfo(np.int64).min).to_numpy())
        if not lengths:
            return
        context = TaskContext.get()
        name, attempt = f"{context.partitionId():08d}", str(context.taskAttemptId())
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        common.put_file(f"{folder}/{name}.ids", b"".join(ids), attempt)
        common.put_file(f"{folder}/{name}.off", offsets.tobytes(), attempt)
        common.put_file(f"{folder}/{name}.key", np.concatenate(keys).astype("<i8").tobytes(), attempt)
        yield pa.RecordBatch.from_pylist([{"name": name, "docs": len(lengths), "ids": int(offsets[-1]), "dtype": coder.dtype}])

    files = sorted((r.asDict() for r in rows.mapInArrow(run, "name string, docs long, ids long, dtype string").collect()), key=lambda r: r["name"])
    base = 0
    for x in files:
        x["base"] = base
        base += x["ids"]
    common.put_file(f"{folder}/manifest.json", json.dumps(files).encode(), "driver")
    return files


def read_token_files(spark: SparkSession, folder: str, files: list[dict], per_document: Callable[[np.ndarray], dict] | None, schema: str = "") -> DataFrame:
    """Per document: doc_id, start, n_tokens, and what per_document makes of its ids (or the ids, if it is None)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x in frame.to_dict("records"):
                ids = common.map_file(f"{folder}/{x['name']}.ids", x["dtype"])
                offsets = common.map_file(f"{folder}/{x['name']}.off", "<i8")
                keys = pd.array(common.map_file(f"{folder}/{x['name']}.key", "<i8"), dtype="Int64")
                keys[keys == np.iinfo(np.int64).min] = pd.NA
                for i in range(0, x["docs"], 4096):
                    at = offsets[i : i + 4097]
                    out = pd.DataFrame({"doc_id": keys[i : i + len(at) - 1], "start": at[:-1] + x["base"], "n_tokens": np.diff(at)})
                    own = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
                    more = pd.DataFrame([per_document(v) for v in own]) if per_document else pd.DataFrame({"ids": [v.astype(np.int64) for v in own]})
                    yield pd.concat([out, more], axis=1)

    listed = spark.createDataFrame([(x["name"], x["docs"], x["ids"], x["base"], x["dtype"]) for x in files], "name string, docs long, ids long, base long, dtype string")
    return listed.repartition(max(1, len(files))).mapInPandas(run, "doc_id long, start long, n_tokens long, " + (schema or "ids array<long>"))


def ids_digest(ids: np.ndarray) -> dict:
    return {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.documents(spark, sf_dir), word_vocabulary())


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "tokens")
    files = write_token_files(common.documents(spark, sf_dir), word_vocabulary(), folder, end_id=2)
    return read_token_files(spark, folder, files, ids_digest, "ids_crc32 long")

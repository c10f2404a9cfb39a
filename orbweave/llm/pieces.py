"""Operator 5: SentencePiece encoding and decoding by a streaming Viterbi search.

The text is read once from left to right. For each position one backpointer is kept, to the start of the last piece of the best
path to it. No piece is longer than the longest of the vocabulary, so only so many positions can still be continued; whenever
the paths of all of these pass through one boundary, the pieces up to it are final and are given out. Memory is bounded by that
window and the undecided stretch.

The vocabulary is a BPE model: the library joins the best-ranked adjacent pair again and again, which no sum of scores gives.
So paths aren't ranked by sums. A path may be continued by a piece only if the two last pieces stay as they are when joined text
is merged by rank; such a path is the only one to its position, and it is the library's.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import common

SPACE = "▁"
#: Stretches and pairs of pieces that a worker keeps; longer stretches aren't kept.
CACHE, CACHE_CHARS = 250_000, 64
#: Code of a character that is no piece; bits of a code.
UNKNOWN, CODE_BITS = 1 << 21, 22


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(library.vocab_size())
        if len(ids) > UNKNOWN:
            raise ValueError("the vocabulary is too large")
        special = {i for i in ids if library.is_byte(i) or library.is_control(i) or library.is_unknown(i)}
        self.ids = {library.id_to_piece(i): i for i in ids if i not in special and not library.is_unused(i)}
        self.scores = {p: library.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(library.id_to_piece(i)[1:-1], 16): i for i in ids if library.is_byte(i)}
        if len(self.bytes) != 256 or library.encode(" ab", out_type=str)[0][:1] != SPACE or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a model with byte fallback, a leading space and spaces only at the start of pieces is needed")
        piece = {i: library.id_to_piece(i) for i in ids}
        byte_of = {i: b for b, i in self.bytes.items()}
        #: Bytes of each id; special ones have none.
        self.text = [bytes([byte_of[i]]) if i in byte_of else b"" if i in special else piece[i].replace(SPACE, " ").encode() for i in ids]
        self.is_byte = np.array([i in byte_of for i in ids])
        self.widest = max(map(len, self.ids))
        #: By character: what may follow it in a piece, and the id of the piece that ends here or 0.
        self.tree: dict[str, tuple[dict, int]] = {}
        for p, i in self.ids.items():
            node = self.tree
            for c in p[:-1]:
                node = node.setdefault(c, ({}, 0))[0]
            node[p[-1]] = (node[p[-1]][0] if p[-1] in node else {}, i)
        #: Pairs of characters within pieces; between any others no piece reaches across.
        self.joins = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.pattern = self.stretches()
        self.stays: dict[int, bool] = {}
        self.seen: dict[str, bytes] = {}

    def stretches(self) -> re.Pattern:
        """Spaces with what follows them: letters, or characters that no piece puts beside a letter."""
        loose = {c for c in {*map(chr, range(128)), *chain.from_iterable(self.joins)} if not c.isalpha()} - {" ", SPACE}
        while near := {c for j in self.joins if SPACE not in j for c, d in (j, j[::-1]) if c in loose and d not in loose}:
            loose -= near
        others = re.escape("".join(sorted(loose)))
        return re.compile(f"{SPACE}*[^{SPACE}{others}]+|{SPACE}*[{others}]+|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string by rank: the adjacent pair of best score first, the leftmost of equals."""
        parts, score = list(text), self.scores.get
        heap = [(-s, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (s := score(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, "", after[j]
            if (k := after[i]) >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (s := score(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (-s, x, parts[x], parts[y]))
        return [p for p in parts if p]

    def may_follow(self, a: str, b: str, key: int) -> bool:
        """Whether a and b (or b alone, after nothing) stay as they are; key stands for both."""
        if len(self.stays) >= CACHE:
            self.stays.clear()
        known = self.stays[key] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def stream(self, text: str) -> Iterator[str]:
        """The pieces of one stretch, each as soon as it is final."""
        stays, widest, n = self.stays, self.widest, len(text)
        back, last = {0: 0}, {0: 0}  # position: start and code of the last piece of the path to it
        done = 0
        for start in range(n):
            if (a := last.get(start)) is None:
                continue
            node = self.tree
            for end, c in enumerate(text[start : start + widest], start + 1):
                if (found := node.get(c)) is not None:
                    node, b = found
                elif end == start + 1:
                    node, b = {}, UNKNOWN + ord(c)
                else:
                    break
                if b and end not in last:
                    key = a << CODE_BITS | b
                    if (known := stays.get(key)) is None:
                        known = self.may_follow(text[back[start] : start], text[start:end], key)
                    if known:
                        back[end], last[end] = start, b
            if start - done > 2 * widest:
                live = {p for p in back if p > start}
                while len(live) > 1:  # walk the latest back until all meet
                    p = max(live)
                    live.remove(p)
                    live.add(max(done, back[p]))
                (meet,) = live
                if meet > done:
                    yield from path(text, back, done, meet)
                    # the piece before `meet` is still needed to judge its follower
                    back, last, done = {p: s for p, s in back.items() if p >= meet}, {p: b for p, b in last.items() if p >= meet}, meet
        yield from path(text, back, done, n)

    def segments(self, text: str) -> Iterator[str]:
        """Parts of a stretch that no piece reaches across."""
        begin = 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in self.joins:
                yield text[begin:i]
                begin = i
        yield text[begin:]

    def kept(self, text: str, ids: bytes) -> bytes:
        if len(text) <= CACHE_CHARS:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[text] = ids
        return ids

    def segment(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.stream(text):
            if (i := self.ids.get(piece)) is not None:
                ids.append(i)
            else:
                ids += [self.bytes[b] for b in piece.encode("utf-8", "replace")]
        return self.kept(text, struct.pack(f"<{len(ids)}i", *ids))

    def stretch(self, text: str) -> bytes:
        parts = list(self.segments(text))
        if len(parts) == 1:
            return self.segment(text)
        get = self.seen.get
        return self.kept(text, b"".join([get(x) or self.segment(x) for x in parts]))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        get = self.seen.get
        return np.frombuffer(b"".join([get(x) or self.stretch(x) for x in self.pattern.findall(SPACE + text.replace(" ", SPACE))]), "<i4")

    def decode(self, ids: Iterable[int]) -> str:
        """Pieces put together, bytes as UTF-8 (with U+FFFD for what isn't), without the leading space."""
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def path(text: str, back: dict[int, int], begin: int, end: int) -> list[str]:
    """The pieces between two boundaries."""
    out = []
    while end > begin:
        out.append(text[back[end] : end])
        end = back[end]
    return out[::-1]


def piece_model(path: str) -> PieceModel:
    return common.held(PieceModel, path)


def map_texts(df: DataFrame, path: str, make: Callable, schema: str, text: str, key: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for part in common.text_slices(batch):
                made = [make(model, t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in zip(*made, strict=True))], ["doc_id", *names])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, {schema}")


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, ids, n_tokens. Null and empty texts have no ids; repeated rows have equal ones, an empty table gives an
    empty one, further columns aren't read."""
    make = lambda m, t: (ids := m.encode(t), len(ids))
    return map_texts(df, path, make, "ids array<int>, n_tokens long", text, key)


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, text. Null ids give null, no ids the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else model.decode(x) for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest(model: PieceModel, text: str | None) -> tuple:
    """What the query returns: counts, digests of the ids and of the decoded text, and whether that is the text."""
    ids = model.encode(text)
    decoded = model.decode(ids.tolist())
    return len(text or ""), len(ids), int(model.is_byte[ids].sum()), zlib.crc32(ids), hashlib.sha256(decoded.encode()).hexdigest(), decoded == (text or "")


DIGEST = "n_chars long, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_texts(common.documents(spark, sf_dir), piece_path(), digest, DIGEST, "text", "doc_id")

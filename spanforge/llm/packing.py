"""Packing by shortest-pack-first over the length histogram.

1. Every document becomes token ids plus an end id, cut into pieces of at most
   the sequence length.  This is a narrow map.
2. Lengths are counted: at most ``size`` numbers, whatever the corpus, so the
   histogram may go to the driver.  There, lengths are placed longest first,
   each into the shortest packs that still have room, and whole groups of equal
   packs are updated by their count, never pack by pack.
3. Each piece gets its rank among pieces of its length, from counts by (length,
   salt); rank and length name its pattern, its pack and its offset.

A length that a third of all pieces share is spread over the salts, so no
window holds more than about the square root of the rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import Scratch, binaries, binary_text

SIZE, END = 2048, 1

#: Words that the fast way takes: printable ASCII and the letters of Latin-1, whose lower case and
#: canonical composition are themselves single characters.  All others go through the whole library.
SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own pre-token pattern (fixed value), over those characters.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: visible Latin-1 stays, the rest follows from 256 on."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(stay)]
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe(dict):
    """Word bytes to the little-endian ids of that word.

    The tokenizer drops white space and never merges across it, so words stand
    alone; texts that hold one of its special strings are encoded whole.
    """

    MEMO = 500_000
    _made: dict[str, "WordBpe"] = {}

    @classmethod
    def of(cls, path: str) -> "WordBpe":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.pre: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.MEMO:
            self.clear()
        text = word.decode()
        if SIMPLE.fullmatch(text):
            if len(self.pre) >= self.MEMO:
                self.pre.clear()
            ids = b"".join(map(self.pre_token, PRE_TOKEN.findall(text.lower())))
        else:
            ids = self.library(text)
        self[word] = ids
        return ids

    def pre_token(self, text: str) -> bytes:
        ids = self.pre.get(text)
        if ids is None:
            letters = text if text.isascii() else "".join(self.letters[b] for b in text.encode())
            ids = self.pre[text] = np.array([t.id for t in self.tokenizer.model.tokenize(letters)], "<u4").tobytes()
        return ids

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        if any(s in text for s in self.special):
            return self.library(text.decode())
        return b"".join(map(self.__getitem__, text.split()))


def cut_documents(docs: DataFrame, tokenizer: str, size: int, end: int, with_ids: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last = WordBpe.of(tokenizer), np.array([end], "<u4").tobytes()
        for batch in batches:
            of, start, length, crc, total, ids = [], [], [], [], [], []
            for row, text in enumerate(binaries(batch.column("text"))):
                data = bpe.ids(text) + last
                n = len(data) // 4
                for at in range(0, n, size):
                    piece = data[4 * at : 4 * (at + size)]
                    of.append(row)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(of, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    return binary_text(docs, "doc_id").mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int] | list[int]]]:
    """Patterns (count, lengths in order) for a histogram of lengths.

    Longest lengths come first; each goes into the packs that are shortest so far
    and have room.  A step moves a whole group of equal packs, or part of it, so
    the work follows the number of lengths and patterns, not of documents.
    """
    groups: dict[int, list[list]] = {}  # fill -> [[count, lengths]]
    fills: list[int] = []

    def put(count: int, lengths: list[int], fill: int) -> None:
        if fill not in groups:
            groups[fill] = []
            insort(fills, fill)
        for g in groups[fill]:
            if g[1] == lengths:
                g[0] += count
                return
        groups[fill].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if fills and fills[0] + length <= size:
                fill = fills[0]
                group = groups[fill][-1]
                take = min(left, group[0])
                group[0] -= take
                if not group[0]:
                    groups[fill].pop()
                    if not groups[fill]:
                        del groups[fill]
                        fills.pop(bisect_left(fills, fill))
                put(take, [*group[1], length], fill + length)
                left -= take
            else:
                each = size // length  # no pack has room: open as many as hold the rest
                full, over = divmod(left, each)
                if full:
                    put(full, [length] * each, length * each)
                if over:
                    put(1, [length] * over, length * over)
                left = 0
    return [(count, lengths) for fill in fills for count, lengths in groups[fill]]


def slots(patterns: list[tuple[int, list[int]]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence and offset of each slot, in order of ranks."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for count, lengths in patterns:
        at = 0
        for length in lengths:
            found.setdefault(length, []).append((used.get(length, 0), sequence, at))
            used[length] = used.get(length, 0) + count
            at += length
        sequence += count
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in found.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: (doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset).

    A null or empty text is the end id alone.  Repeated rows are packed each on
    their own; among equal pieces the order is by doc_id, start and checksum, and
    pieces equal in all of these may change places.  No rows give no rows.  Very
    long texts become many pieces.  Other columns of docs are not read.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    pieces = Scratch(docs.sparkSession, "pieces").keep(cut_documents(docs, path, size, end, with_ids))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    place = slots(shortest_pack_first(histogram, size), size)

    salts = max(1, int(sum(histogram.values()) ** 0.5))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(offsets, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("salt", "base")
    names = [*pieces.columns, "rank"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length):
                rows = np.flatnonzero(length == value)
                first, start, at = place[int(value)]
                slot = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = start[slot] + rank[rows] - first[slot], at[slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in pieces_columns), pa.array(sequence), pa.array(offset)], names=[*pieces_columns, "sequence_id", "offset"])

    pieces_columns = list(pieces.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*names).mapInArrow(placed, f"{fields}, sequence_id long, offset long")

"""Benchmark decontamination by suffix arrays over the training texts.

Each task turns its documents into shards of about ``SHARD_WORDS`` words, builds
a suffix array over the words of the shard, and binary-searches every suffix of
every benchmark item in it, all suffixes side by side, one word deeper at a
time.  The depth at which a suffix's range empties is its longest verbatim match
in the shard; the range at window depth holds the places of that window.  A
document lies in one shard whole, so nothing is shuffled.

Words that no item has cannot be part of a match.  They become a separator, and
runs between separators that are shorter than the shortest window are left out
of the suffix array: no window can lie in them.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text (a longer item is a
block); each block is broadcast by itself, with its items' names, and every shard is
searched for every block, so neither the driver nor a task ever holds more than a
block of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import binaries, lean

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 8 << 20

#: Bytes of words: digits, a-z (A-Z lower-cased) and all of multi-byte characters; the rest becomes a space.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


@dataclass
class Block:
    """Some items, as word ids with separators; one entry of the window columns for each window start."""

    ids: dict[bytes, int]
    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    item: np.ndarray
    names: list[str | None]
    longest: int
    least: int


def make_block(items: list[tuple[str | None, bytes]], window: int) -> Block:
    ids: dict[bytes, int] = Ids()
    text, start, length, item = [0], [], [], []
    longest = 0
    names: dict[str | None, int] = {}
    for name, content in items:
        words = split(content)
        if not words:
            continue
        n = min(window, len(words))
        number = names.setdefault(name, len(names))
        at = len(text)
        for i in range(len(words) - n + 1):
            start.append(at + i)
            length.append(n)
            item.append(number)
        for w in words:
            text.append(ids.get(w) or ids.setdefault(w, len(ids) + 1))
        text.append(0)
        longest = max(longest, len(words))
    as_array = lambda x: np.array(x, np.int64)
    return Block(ids, as_array(text), as_array(start), as_array(length), as_array(item), list(names), longest, min(length, default=1))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in order of their first `depth` symbols at least, by prefix doubling."""
    n = len(text)
    rank, h = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        ordered = rank[order]
        rank = np.empty(n, np.int64)
        steps = np.empty(n, np.int64)
        if n:
            steps[0] = 0
        steps[1:] = ordered[1:] != ordered[:-1]
        rank[order] = np.cumsum(steps)
        if h >= depth or not n or rank[order[-1]] == n - 1:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: n - h] = rank[h:] + 1 if h < n else 0
        rank = rank * (n + 1) + ahead
        order = np.argsort(rank, kind="stable")
        h *= 2


def bound(keys: np.ndarray, array: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray, after: bool) -> np.ndarray:
    """For each range, the first place whose symbol at `depth` is not below (or, after, is above) the one asked for."""
    lo, hi = lo.copy(), hi.copy()
    last = len(keys) - 1
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        middle = (lo[open_] + hi[open_]) >> 1
        found = keys[np.minimum(array[middle] + depth, last)]
        right = found <= symbol[open_] if after else found < symbol[open_]
        lo[open_[right]] = middle[right] + 1
        hi[open_[~right]] = middle[~right]


def search(text: np.ndarray, array: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window start of the block: longest match of its suffix, and the range of its window in the array."""
    n = len(block.start)
    longest = np.zeros(n, np.int64)
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    active = np.arange(n)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(array), np.int64)
    depth = 0
    while len(active):
        symbol = block.text[block.start[active] + depth]
        real = symbol > 0
        active, lo, hi, symbol = active[real], lo[real], hi[real], symbol[real]
        below = bound(text, array, depth, lo, hi, symbol, after=False)
        hi = bound(text, array, depth, below, hi, symbol, after=True)
        alive = below < hi
        active, lo, hi = active[alive], below[alive], hi[alive]
        depth += 1
        longest[active] = depth
        whole = block.length[active] == depth
        first[active[whole]], last[active[whole]] = lo[whole], hi[whole]
    return longest, first, last


@dataclass
class Found:
    n_words: list[int]
    hits: list[np.ndarray]
    items: list[set[str | None]]
    longest: list[int]


def match(texts: list[bytes], blocks: Iterable[Block]) -> Found:
    """Hits of the blocks' windows in a shard of documents: merged [start, end) word intervals, items and longest match."""
    words = [split(t) for t in texts]
    out = Found([len(w) for w in words], [np.empty((0, 2), np.int64)] * len(texts), [set() for _ in texts], [0] * len(texts))
    total = sum(out.n_words) + len(texts) + 1
    owner = np.repeat(np.arange(len(texts)), [n + 1 for n in out.n_words])
    base = np.concatenate([[0], np.cumsum([n + 1 for n in out.n_words])])
    change = np.zeros(total + 1, np.int64)
    for block in blocks:
        if not len(block.start):
            continue
        flat = np.zeros(total, np.int64)
        for i, w in enumerate(words):
            flat[base[i] : base[i] + len(w)] = np.fromiter(map(block.ids.__getitem__, w), np.int64, len(w))
        edges = np.diff(np.concatenate([[0], (flat > 0).astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long_ = end - begin >= block.least
        begin, end = begin[long_], end[long_]
        if not len(begin):
            continue
        sizes = end - begin + 1  # each run and a separator behind it
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        text = flat[at]
        text[np.cumsum(sizes) - 1] = 0
        array = suffix_array(text, block.longest)
        array = array[text[array] > 0]
        longest, first, last = search(text, array, block)
        some = np.flatnonzero(last > first)
        for lo, hi, length in {(int(first[i]), int(last[i]), int(block.length[i])) for i in some}:
            places = at[array[lo:hi]]
            np.add.at(change, places, 1)
            np.add.at(change, places + length, -1)
        by_range: dict[int, list[int]] = {}
        for i in some:
            by_range.setdefault(int(first[i]) * (1 << 32) + int(last[i]), []).append(i)
        for windows in by_range.values():
            i = windows[0]
            numbers = {block.names[int(block.item[j])] for j in windows}
            for doc in np.unique(owner[at[array[first[i] : last[i]]]]):
                out.items[doc] |= numbers
        # a document's longest match: the deepest suffix among those that start in it at the deepest places
        for i in some[np.argsort(-longest[some], kind="stable")]:
            deep = int(longest[i])
            for doc in np.unique(owner[at[deepest(text, array, block, int(i), int(first[i]), int(last[i]), deep)]]):
                out.longest[doc] = max(out.longest[doc], deep)
    covered = np.cumsum(change[:-1]) > 0
    edges = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    for doc in np.unique(owner[begin]) if len(begin) else []:
        mine = owner[begin] == doc
        out.hits[doc] = np.stack([begin[mine], end[mine]], 1) - base[doc]
    return out


def deepest(text: np.ndarray, array: np.ndarray, block: Block, i: int, lo: int, hi: int, depth: int) -> np.ndarray:
    """Places in [lo, hi) of the array where the suffix of window i matches `depth` symbols."""
    pattern = block.text[block.start[i] : block.start[i] + depth]
    n = int(block.length[i])
    places = array[lo:hi]
    for k in range(n, depth):  # one word deeper at a time, so only places are held
        places = places[text[np.minimum(places + k, len(text) - 1)] == pattern[k]]
    return places


class Benchmark:
    """The items in blocks, each a broadcast of bounded size; a worker reads one block at a time."""

    def __init__(self, items: DataFrame, window: int, block_bytes: int = BLOCK_BYTES):
        context = items.sparkSession.sparkContext
        self.blocks = []
        rows, size = [], 0
        found = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
        for r in found.toLocalIterator():
            if rows and size + len(r["text"] or b"") > block_bytes:
                self.blocks.append(context.broadcast(make_block(rows, window)))
                rows, size = [], 0
            rows.append((r["item_id"], bytes(r["text"] or b"")))
            size += len(r["text"] or b"")
        if rows:
            self.blocks.append(context.broadcast(make_block(rows, window)))


def one_by_one(blocks: list) -> Iterator[Block]:
    """The blocks' values; of several, each is dropped again before the next is read."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            b.__dict__.pop("_value", None)


def shards(batch: pa.RecordBatch, text: str, words: int = SHARD_WORDS) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive rows of a batch whose texts have about so many words together."""
    texts = binaries(batch.column(text))
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"") // 6 + 1
        if size >= words:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, spans) for every row of docs.

    spans are the merged word intervals [start, end) that windows cover, longest
    is the longest verbatim match that starts with a whole window.  Null and empty
    texts have no words; items without words match nothing; items of fewer words
    than a window are one window; equal items and repeated rows count each by
    their own id or row; an item without an id is one of its own, with an empty
    name.  Of equally long matches any may be the longest.  Texts of any length are
    read whole, in shards of whole texts.  An empty table on either side gives no rows or no hits.
    """
    blocks = Benchmark(items, window).blocks

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for at, texts in shards(batch, "text"):
                got = match(texts, one_by_one(blocks))
                hit = [int((h[:, 1] - h[:, 0]).sum()) for h in got.hits]
                digests = [hashlib.sha256(",".join(sorted(i or "" for i in x)).encode()).hexdigest() for x in got.items]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(texts)),
                        pa.array(got.n_words, pa.int64()),
                        pa.array(hit, pa.int64()),
                        pa.array([len(x) for x in got.items], pa.int64()),
                        pa.array(digests, pa.string()),
                        pa.array([h > 0 for h in hit], pa.bool_()),
                        pa.array(got.longest, pa.int64()),
                        pa.array([[{"start": int(a), "end": int(b)} for a, b in h] for h in got.hits], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, spans array<struct<start:long,end:long>>"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(scan, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns as they are, without those whose text has a window of an item.

    Null and empty texts have no window and stay; repeated rows stay or go alike;
    texts of any length are read whole; without items all rows stay, without rows
    there are none.  Columns may have any names.
    """
    blocks = Benchmark(items, window).blocks

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for at, texts in shards(batch, "text"):
                keep = pa.array([not len(h) for h in match(texts, one_by_one(blocks)).hits], pa.bool_())
                yield batch.slice(at, len(texts)).filter(keep)

    return docs.mapInArrow(clean, docs.schema)

"""Substring dedup: every window of words that also starts earlier loses its words.

Comparing every document with the index of every shard would cost the square of
the corpus, so shards are formed by content.  Each window of ``window`` words has
a minimizer, the smallest hash among its runs of ``K`` words; equal windows have
equal minimizers.  Consecutive windows with one minimizer make a segment.

1. Segments' minimizers meet in buckets; only those found twice or more go on.
   This leaves out all text that repeats nothing.
2. The words of those segments travel to the shard of their minimizer.
3. Each shard builds a compressed FM-index over its segments, in the order of
   document and place, and streams the segments through it by backward search.
   The matching statistics name, for every window, the first place it occurs at;
   a window whose first place is not its own is an interval to remove.
4. Intervals return to their documents.

A minimizer that ``HOT`` segments or more share would fill one shard.  Its segments
are marked by a join, cut into single windows, and spread by the windows' own hash,
after each task has settled the windows that it holds twice by itself; a window that
every document has then sends one row for each task.  What a task makes of its
texts depends on slices of a few megabytes, not on the size of a batch.

A row is known by its id and, where an id has several texts, by a hash of its text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StringType, StructField, StructType

from spanforge.llm.common import MIX_A, MIX_B, WORD_CODES, Scratch, binaries, lean, mix, slices, trimmed
from spanforge.llm.fm_index import FmIndex, ranks

WINDOW = 20
K = 6
#: Entries of a bucket and words of a shard, about; segments of a minimizer from which it is cut up.
ENTRIES, SHARD_WORDS, HOT = 400_000, 600_000, 2_000
#: Bytes of text that a task works on at a time.
SLICE = 4 << 20
#: Hot minimizers that are broadcast; more are joined by a shuffle.  Numbers that a task keeps of what it has sent.
HOT_BROADCAST, MEMO = 100_000, 100_000


def multilinear(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k codes: a sum with fixed odd factors, then a finaliser."""
    n = max(0, len(codes) - k + 1)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * MIX_A) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for i in range(k if n else 0):
        out += codes[i : i + n] * factors[i]
    return mix(out)


def segments(codes: np.ndarray, sizes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, text, first window, number of windows) of the segments of texts that stand one after another."""
    empty = np.empty(0, np.int64)
    n = len(codes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), empty, empty, empty
    grams = multilinear(codes, k) ^ MIX_B
    width, done = window - k + 1, 1
    least, place = grams, np.arange(len(grams))
    while done < width:  # the first smallest hash over 1, 2, 4, ... places, then over the whole width
        step = min(done, width - done)
        right = least[step:] < least[: len(least) - step]
        least = np.where(right, least[step:], least[: len(least) - step])
        place = np.where(right, place[step:], place[: len(place) - step])
        done += step
    base = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)[:n]
    inside = np.arange(n) + window <= (base + sizes)[text]  # windows that do not run into the next text
    # a new place is a new segment even if the hash is the same, so text that repeats itself counts its minimizer twice
    change = np.ones(n, bool)
    change[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    group = np.cumsum(change & inside) - 1
    windows = np.bincount(group[inside], minlength=len(first))
    return least[first], text[first], first - base[text[first]], windows


ENTRY = [("key", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("start", "<u4"), ("windows", "<u2"), ("count", "<u4")]


def squeeze(columns: list[np.ndarray]) -> bytes:
    """Columns as byte planes; documents come in order, so only the keys keep their size."""
    planes = []
    for (name, kind), c in zip(ENTRY, columns, strict=True):
        c = np.ascontiguousarray(np.diff(c, prepend=c.dtype.type(0)) if name == "doc" else c).astype(kind)
        planes.append(c.view(np.uint8).reshape(len(c), -1).T.tobytes())
    return len(columns[0]).to_bytes(4, "little") + zlib.compress(b"".join(planes), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    raw, at = zlib.decompress(data[4:]), 0
    out = np.zeros(n, ENTRY)
    for name, kind in ENTRY:
        width = np.dtype(kind).itemsize
        value = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n)
        out[name] = np.cumsum(value) if name == "doc" else value
        at += n * width
    return out


def bucketed(columns: list[np.ndarray], bucket: np.ndarray, buckets: int, name: str = "bucket") -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    of = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    data = [squeeze([c[order[cuts[b] : cuts[b + 1]]] for c in columns]) for b in of]
    return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(data, pa.binary())], names=[name, "entries"])


def in_order(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes], pa.Array]:
    """Ids, marks and texts of some rows in order of id and mark, and that order."""
    ids, mark = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "mark"))
    order = np.lexsort((mark, ids))
    texts = binaries(part.column("text"))
    return ids[order], mark[order], [texts[j] for j in order], pa.array(order)


def minimizer_entries(texts: DataFrame, window: int, k: int, buckets: int) -> DataFrame:
    """(bucket, entries): segments by their minimizer.

    A minimizer that a task has met once goes to its bucket.  One that it meets
    again is a repeat for sure: its segments go to buckets by document, and the
    minimizer's bucket only gets their number, once a task.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.empty(0, np.uint64)  # minimizers met twice, and how many of their segments went by document
        number_of = np.empty(0, np.int64)

        def told() -> pa.RecordBatch:
            zero = np.zeros(len(known), np.int64)
            columns = [known, zero, zero, zero.astype(np.uint32), zero.astype(np.uint16), number_of.astype(np.uint32)]
            return bucketed(columns, ((known >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), buckets)

        for part in lean(s for batch in batches for s in slices(batch, "text", SLICE)):
            ids, mark, texts_, _ = in_order(part)
            codes = [WORD_CODES.of(t.split()) for t in texts_]
            key, text, start, number = segments(np.concatenate(codes), np.array([len(c) for c in codes]), window, k)
            if not len(key):
                continue
            doc, start, number = ids[text], start.astype(np.uint32), number.astype(np.uint16)
            values, back, often = np.unique(key, return_inverse=True, return_counts=True)
            many = (often > 1) | np.isin(values, known)
            once = ~many[back]
            known, where = np.unique(np.concatenate([known, values[many]]), return_inverse=True)
            number_of = np.bincount(where, np.concatenate([number_of, often[many]]), len(known)).astype(np.int64)
            spread = mix(doc.astype(np.uint64) * MIX_A) % np.uint64(buckets)
            own = (key >> np.uint64(20)) % np.uint64(buckets)
            # count 1: a single segment; 0: known to repeat; without windows: the number of those
            yield bucketed([key, doc, mark[text], start, number, once.astype(np.uint32)], np.where(once, own, spread).astype(np.int64), buckets)
            if len(known) > MEMO:
                yield told()
                known, number_of = known[:0], number_of[:0]
        if len(known):
            yield told()

    return texts.mapInArrow(emit, "bucket long, entries binary")


def repeated_segments(entries: DataFrame, hot: int) -> DataFrame:
    """(doc_id, mark, key, start, windows): segments whose minimizer repeats; without doc_id, a minimizer found `hot` times or more."""

    def meet(table: pa.Table) -> pa.Table:
        e = np.concatenate([unsqueeze(x) for x in binaries(table.column("entries").combine_chunks())])
        known, rest = e[e["count"] == 0], e[e["count"] > 0]
        values, back = np.unique(rest["key"], return_inverse=True)
        total = np.bincount(back, rest["count"], len(values)).astype(np.int64)
        single = rest[(rest["windows"] > 0) & (total[back] > 1)]
        out = np.concatenate([known, single])
        large = values[total >= hot]
        null = np.concatenate([np.zeros(len(out), bool), np.ones(len(large), bool)])
        zero = np.zeros(len(large), np.int64)
        columns = {c: np.concatenate([out[c].astype(np.int64), zero]) for c in ("doc", "mark", "start", "windows")}
        key = np.concatenate([out["key"], large]).view(np.int64)
        return pa.table({"doc_id": pa.array(columns["doc"], pa.int64(), mask=null), "mark": pa.array(columns["mark"]), "key": pa.array(key), "start": pa.array(columns["start"]), "windows": pa.array(columns["windows"])})

    return entries.groupBy("bucket").applyInArrow(lambda t: trimmed(meet(t)), "doc_id long, mark long, key long, start long, windows long")


def gathered(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of `values` that begin there and have those sizes, one after another."""
    at = np.cumsum(sizes) - sizes
    return values[np.repeat(begin - at, sizes) + np.arange(int(sizes.sum()))]


def packed_pieces(shard: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray, begin: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[list[int], list[bytes]]:
    """For each shard, its pieces' heads and codes in one block."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    of, data = [], []
    for rows in np.split(order, cuts) if len(order) else []:
        head = np.stack([doc[rows], mark[rows], start[rows], sizes[rows]]).astype("<i8")
        of.append(int(shard[rows[0]]))
        # words as places in the block's own list of them: most bytes of the places are zero
        words, place = np.unique(gathered(codes, begin[rows], sizes[rows]), return_inverse=True)
        planes = place.astype("<u4").view(np.uint8).reshape(-1, 4).T
        data.append(len(rows).to_bytes(4, "little") + len(words).to_bytes(4, "little") + zlib.compress(head.tobytes() + words.astype("<u8").tobytes() + planes.tobytes(), 1))
    return of, data


def unpack_segments(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    raw = zlib.decompress(data[8:])
    words = np.frombuffer(raw, "<u8", m, 32 * n)
    planes = np.frombuffer(raw, np.uint8, offset=32 * n + 8 * m).reshape(4, -1)
    return np.frombuffer(raw, "<i8", 4 * n).reshape(4, n), words[np.ascontiguousarray(planes.T).view("<u4").ravel()]


class Sent:
    """Hot windows that this task has sent on already, with the first place it knows of each; a bounded memo."""

    def __init__(self) -> None:
        self.hash, self.place = np.empty(0, np.uint64), np.empty((3, 0), np.int64)

    def later(self, h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(again, lead) for windows in order of place (id, mark, start): the later ones, and those to be sent on."""
        every, places = np.concatenate([self.hash, h]), np.concatenate([self.place, place], 1)
        order = np.lexsort((np.arange(len(every)), places[2], places[1], places[0], every))
        lead = np.ones(len(every), bool)
        lead[1:] = every[order][1:] != every[order][:-1]
        first = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
        of = np.empty(len(every), np.int64)
        of[order] = first
        old = len(self.hash)
        again = (places != places[:, of]).any(0)[old:]
        new = of[old:] == np.arange(old, len(every))
        self.hash, self.place = every[order][lead], places[:, order[lead]]
        if len(self.hash) > MEMO:
            self.__init__()
        return again, new


def words_to_shards(joined: DataFrame, window: int, shards: int) -> DataFrame:
    """(shard, doc_id, mark, start, stop, segments): packed segments for shards, and intervals that a task settles by itself.

    joined: doc_id, mark, text, segs (segments of the text, not null).
    """
    schema = "shard long, doc_id long, mark long, start long, stop long, segments binary"
    names = ["shard", "doc_id", "mark", "start", "stop", "segments"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Sent()
        for part in lean(s for batch in batches for s in slices(batch, "text", SLICE)):
            ids, marks, texts, order = in_order(part)
            words = [WORD_CODES.of(t.split()) for t in texts]
            codes = np.concatenate(words)
            base = np.cumsum([len(w) for w in words]) - [len(w) for w in words]
            mine = part.column("segs").take(order)
            flat, per = mine.flatten(), np.diff(mine.offsets.to_numpy())
            key, start, n, is_hot = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("key", "start", "windows", "hot"))
            text = np.repeat(np.arange(len(texts)), per)
            by = np.lexsort((start, text))
            key, start, n, text, is_hot = key[by], start[by], n[by], text[by], is_hot[by].astype(bool)
            # segments of a text that follow one another with one minimizer travel as one piece
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + n[:-1])
            at = np.flatnonzero(new)
            n = np.add.reduceat(n, at) if len(at) else n
            key, start, text, is_hot = key[at], start[at], text[at], is_hot[at]
            cold = ~is_hot
            doc, mark, begin = ids[text], marks[text], base[text] + start
            sent = [((key[cold] & 0x7FFFFFFFFFFFFFFF) % shards, doc[cold], mark[cold], start[cold], begin[cold], n[cold] + window - 1)]
            settled = np.empty((3, 0), np.int64)
            if is_hot.any():
                w_at = gathered(np.arange(len(codes)), begin[is_hot], n[is_hot])
                of = np.repeat(text[is_hot], n[is_hot])
                where = np.stack([ids[of], marks[of], w_at - base[of]])
                h = multilinear(codes, window)[w_at]
                again, lead = memo.later(h, where)
                settled = where[:, again]
                sent.append(((h[lead] % np.uint64(shards)).astype(np.int64), *where[:, lead], w_at[lead], np.full(int(lead.sum()), window)))
            to, data = packed_pieces(*(np.concatenate(x) for x in zip(*sent, strict=True)), codes)
            if to:
                none = pa.nulls(len(to), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), none, none, none, none, pa.array(data, pa.binary())], names=names)
            if settled.shape[1]:
                d, m, s, e = merged(*settled, window)
                yield pa.RecordBatch.from_arrays([pa.array((mix(d.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)), *(pa.array(x) for x in (d, m, s, e)), pa.nulls(len(d), pa.binary())], names=names)

    return joined.mapInArrow(emit, schema)


def merged(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Windows as intervals [start, stop), those of a row that touch or overlap made one."""
    order = np.lexsort((start, mark, doc))
    doc, mark, start = doc[order], mark[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] > start[:-1] + window)
    at = np.flatnonzero(new)
    return doc[at], mark[at], start[at], np.maximum.reduceat(start, at) + window if len(at) else start


def repeats_in_shard(table: pa.Table, window: int) -> pa.Table:
    """Word intervals [start, stop) of windows that start earlier too, by the shard's index; and intervals already settled."""
    packed = table.column("segments").combine_chunks()
    done = packed.is_null()
    heads, words = [], []
    for x in binaries(packed.drop_null()):
        head, codes = unpack_segments(x)
        heads.append(head)
        words.append(codes)
    names = ("doc_id", "mark", "start", "stop")
    ready = [table.column(c).combine_chunks().filter(done).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
    if heads:
        head, flat = np.concatenate(heads, 1), np.concatenate(words)
        del heads, words
        from_ = np.cumsum(head[3]) - head[3]
        order = np.lexsort((head[2], head[1], head[0]))
        head = head[:, order]
        size = head[3] + 1
        begin = np.cumsum(size) - size
        text = np.zeros(int(size.sum()), np.int64)
        inside = np.ones(len(text), bool)
        inside[begin + head[3]] = False
        text[inside] = ranks(gathered(flat, from_[order], head[3]))[1] + 1
        del flat, inside
        index = FmIndex(text, window)
        place, _, earliest = index.matching(begin, begin + head[3])
        segment = np.searchsorted(begin, [place, earliest], "right") - 1
        of = head[:2, segment]  # id and mark, of the place and of the earliest
        at = head[2][segment] + np.stack([place, earliest]) - begin[segment]
        again = (of[:, 0] != of[:, 1]).any(0) | (at[0] != at[1])
        found = merged(of[0, 0][again], of[1, 0][again], at[0][again], window)
        ready = [np.concatenate(x) for x in zip(ready, found, strict=True)]
    return pa.table(dict(zip(names, (pa.array(x) for x in ready), strict=True)))


def with_repeats(docs: DataFrame, window: int, k: int, *more: str) -> DataFrame:
    """(doc_id, text, rest, spans): text in bytes, the columns `more` as a struct, and word intervals to remove or null."""
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id has to be an integer, as smaller ids come first")
    scratch = Scratch(spark, "substring")
    rest = F.struct(*[F.col(f"`{c}`") for c in more]) if more else F.lit(None).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), rest.alias("rest"))
    # ids with several texts; only their rows need a mark besides the id
    marks = texts.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("mark")).groupBy("doc_id")
    several = scratch.keep(marks.agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).filter("lo < hi").select("doc_id", F.lit(True).alias("several")), "several")
    if several.isEmpty():
        texts = texts.withColumn("mark", F.lit(0).cast("long"))
    else:
        texts = texts.join(several, "doc_id", "left").withColumn("mark", F.when(F.col("several"), F.coalesce(F.xxhash64("text"), F.lit(0))).otherwise(0)).drop("several")
    content = texts.filter("doc_id is not null and text is not null").select("doc_id", "mark", "text")
    size = content.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    entries = size // 6 // ((window - k) // 2 + 1) + 1
    found = scratch.keep(repeated_segments(minimizer_entries(content, window, k, int(max(12, entries // ENTRIES))), HOT), "segments")
    scratch.free()  # the shuffle of the entries is done with
    hot = found.filter("doc_id is null").select("key", F.lit(True).alias("hot"))
    mine = found.filter("doc_id is not null")
    words = mine.agg(F.coalesce(F.sum(F.col("windows") + F.lit(window - 1)), F.lit(0))).first()[0]
    shards = int(max(12, words // SHARD_WORDS))
    few = hot.limit(HOT_BROADCAST + 1).count() <= HOT_BROADCAST
    told = mine.join(F.broadcast(hot) if few else hot, "key", "left")
    segs = F.collect_set(F.struct("key", "start", "windows", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("segs")
    per_doc = told.groupBy("doc_id", "mark").agg(segs)
    joined = content.join(per_doc, ["doc_id", "mark"])
    sent = words_to_shards(joined, window, shards)
    spans = sent.groupBy("shard").applyInArrow(lambda t: trimmed(repeats_in_shard(t, window)), "doc_id long, mark long, start long, stop long")
    by_row = spans.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    by_row = scratch.keep(by_row, "spans")
    scratch.free(found)
    return texts.join(by_row, ["doc_id", "mark"], "left").drop("mark")


def removed(n: int, spans: list[dict] | None) -> np.ndarray:
    """A flag for each of n words that lies in a span."""
    change = np.zeros(n + 1, np.int64)
    for s in spans or ():
        change[min(s["start"], n)] += 1
        change[min(s["stop"], n)] -= 1
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs.

    A word goes if it lies in a window of `window` words that also starts in a
    row of a smaller doc_id, or earlier in the same row; windows are those of the
    given texts.  Null, empty and short texts have no windows.  Rows that repeat id
    and text are one row, and none of them is earlier; rows that share an id but not
    their text are told apart and ordered by a hash of the text.  Rows without an id
    keep all words and are earlier than none.  doc_id has to be an integer.  No rows
    give no rows; texts of any length are read whole; other columns are not read.
    """
    rows = with_repeats(docs, window, k)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(s for batch in batches for s in slices(batch, "text")):
            n, gone, sha = [], [], []
            for text, spans in zip(binaries(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                words = (text or b"").split()
                if spans:
                    out = removed(len(words), spans)
                    kept = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
                else:
                    kept = words
                n.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "text", "spans").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_words(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words in spans; each goes with the white space behind it."""
    import re

    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    out = removed(len(words), spans)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
    kept, at = [], 0
    for i, j in zip(edges[::2], edges[1::2], strict=True):
        kept.append(text[at : words[i][0]])
        at = words[j][0] if j < len(words) else len(text)
    kept.append(text[at:])
    return b"".join(kept).rstrip() if out.any() else text


def drop_repeats(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """docs with repeated passages cut out of text and n_chars (if there) set anew; rows left without a word go.

    What is cut is as in remove_repeats, with the same rules for nulls, ids and
    repeated rows.  Rows from which nothing is cut stay as they are, empty and
    null ones too; no rows give no rows.  Columns may have any names.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = with_repeats(docs, window, k, *others)
    fields = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), rows.schema["rest"]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in lean(s for batch in batches for s in slices(batch, "text")):
            spans = part.column("spans").to_pylist()
            new = [cut_words(t, s) if s and t is not None else t for t, s in zip(binaries(part.column("text")), spans, strict=True)]
            left = pa.array([not s or bool((t or b"").split()) for t, s in zip(new, spans, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(new, pa.binary()).cast(pa.string()), part.column("rest")], names=["doc_id", "text", "rest"]).filter(left)

    out = rows.select("doc_id", "text", "rest", "spans").mapInArrow(cut, fields)
    columns = {c: F.col("rest").getField(c) for c in others}
    if "n_chars" in others:
        columns["n_chars"] = F.when(F.col("text").isNull(), columns["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    columns |= {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text")}
    return out.select(*[columns[c].alias(c) for c in docs.columns])

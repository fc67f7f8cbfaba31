"""Language-model scores by online logistic context mixing.

Coding.  The most frequent words of the training texts (``HEAD``) and one escape
symbol are the leaves of a Huffman tree, so a token is a path of bits, about ten
on average.  An escaped word costs, beyond the escape's bits, its smoothed share
among all words outside the head; those words' counts are joined by a shuffle, so
no vocabulary of the corpus is ever broadcast.

Bit predictors.  Each bit is predicted in four contexts: the tree node alone, node
and previous word, node and two previous words (both hashed into counter tables of
at most ``TABLE_BITS`` bits), and node within the same document so far.  The
last one learns online while a document is read.

Mixing.  The predictors' log-odds are added with weights; a gate made of the
predictors' confidences and the node's depth picks the weight set.  A last stage
maps the mixed probability through adaptive interpolated tables, one for each
depth, and averages.  Both start from a fit over all training texts, each bit's own
count left out: a Newton step, whose sums by gate and by map cell add up
over tasks, so neither order nor partitions matter.  From there on each document
learns by itself: every ``BATCH`` bits its own weights and maps are updated.  The
counters cover all training texts too: each task counts into tables of its own, and
the tables are added in a tree of bounded fan-in.

Texts are cut into words twice, to count them and to write each document's symbols;
counting, fitting and scoring read the symbols.

Every prediction uses earlier tokens only, so the score is the logarithm of a
proper probability of the text's words and its end.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import MIX_A, MIX_B, Scratch, binaries, lean, mix, slices

HEAD = 65_536
HEAD_WORD_BYTES = 64
TABLE_BITS = 22
ROUNDS, BATCH = 1, 1_024
#: Tokens of a run of documents, about: of whose bits inputs are made at a time, that are fitted, that are scored.
NEAR, FITTED, SCORED = 3_500, 32_000, 96_000
#: Bytes of texts that are cut into words at a time.
CUT = 8 << 20
FAN_IN = 64
#: No word holds a line feed.
END = b"\n"
A = 0.4
#: The constant that is mixed beside the four predictors.
ALWAYS = np.float32(0.3)
GATES, DEPTHS = 16, 8
APM_STEPS, APM_EDGE = 33, 8.0
#: Log-odds of a predictor are within the edge, in steps of a 14-bit number.
EDGE, STEP = 12.0, 8_191 / 12.0
#: What the fit's first weights count for, and rates of learning inside a document.
RIDGE, RATE, MAP_PRIOR = 8.0, 0.005, 255.0


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (binary, no nulls) in order, A-Z lower-cased, as strings that need not be UTF-8, and each text's number of words."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.cast(texts, pa.string(), safe=False)))
    sizes = pc.list_value_length(found).to_numpy().astype(np.int64)
    words = found.flatten()
    filled = pc.greater(pc.binary_length(words), 0)
    full = filled.to_numpy(zero_copy_only=False)
    if not full.all():  # white space at a text's ends leaves empty words
        of = np.repeat(np.arange(len(sizes)), sizes)
        words, sizes = words.filter(filled), np.bincount(of[full], minlength=len(sizes))
    return words, sizes


def held_out(doc_id: str = "doc_id"):
    """Rows whose id's checksum leaves 1 when divided by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all tokens; counted in each task first."""

    def merged(some: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(some).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, ends = [], 0
        for batch in batches:
            for part in slices(batch, "text", CUT):
                words, sizes = split(part.column("text"))
                found = words.value_counts()
                some.append(pa.table({"word": found.field("values").cast(pa.binary()), "n": found.field("counts")}))
                ends += len(sizes)
            if sum(map(len, some)) > 1_000_000:
                some = [merged(some)]
                if len(some[0]) > 500_000:
                    yield from some.pop().to_batches()
        if some:
            yield from merged(some).to_batches()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"])

    return train.select("text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Code:
    """The Huffman paths of the head's words and of the escape, which is the last symbol."""

    words: list[bytes]
    counts: np.ndarray
    offset: np.ndarray = field(init=False)
    size: np.ndarray = field(init=False)
    #: Node, depth (at most DEPTHS - 1) and bit of each step of each path, in one number.
    path: np.ndarray = field(init=False)
    log_odds: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.counts)
        weight = [int(c) for c in self.counts] + [0] * (n - 1)
        parent, side = np.full(2 * n - 1, -1, np.int64), np.zeros(2 * n - 1, np.int8)
        heap = [(w, i) for i, w in enumerate(weight[:n])]
        heapq.heapify(heap)
        odds = np.zeros(max(n - 1, 1), np.float32)
        for node in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = node
            side[j] = 1
            weight[node] = a + b
            odds[node - n] = np.log((b + A) / (a + A))
            heapq.heappush(heap, (a + b, node))
        self.log_odds = np.clip(odds, -EDGE, EDGE)
        steps, at = [], 0
        self.offset, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for leaf in range(n):
            path = []
            node = leaf
            while parent[node] >= 0:
                path.append((parent[node] - n, side[node]))
                node = parent[node]
            self.offset[leaf], self.size[leaf] = at, len(path)
            at += len(path)
            steps += [node << 4 | min(depth, DEPTHS - 1) << 1 | int(bit) for depth, (node, bit) in enumerate(reversed(path))]
        self.path = np.array(steps, np.int32)

    @property
    def escape(self) -> int:
        return len(self.words)

    def symbols(self, words: pa.Array) -> np.ndarray:
        """Symbols of strings; the escape where a word is not in the head."""
        head = pc.cast(pa.array(self.words, pa.binary()), pa.string(), safe=False)
        return pc.fill_null(pc.index_in(words, value_set=head), self.escape).to_numpy().astype(np.int64)


@dataclass
class Bits:
    """The decisions of a run of whole documents: document, node, bit, depth (at most DEPTHS - 1) and slots of each."""

    of: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    depth: np.ndarray
    slots: list[np.ndarray]


def decisions(code: Code, symbols: np.ndarray, doc: np.ndarray, table_bits: int) -> Bits:
    size = code.size[symbols]
    flat = np.repeat(code.offset[symbols] - (np.cumsum(size) - size), size)
    flat += np.arange(len(flat))
    path = code.path.take(flat)
    node, low = path >> 4, path.astype(np.uint8)
    start = np.uint64(code.escape + 1)
    before = [np.full(len(symbols), start), np.full(len(symbols), start)]
    for k, b in enumerate(before, 1):
        if len(symbols) > k:
            same = doc[k:] == doc[:-k]
            b[k:][same] = symbols[:-k][same].astype(np.uint64)
    one = mix((before[0] + np.uint64(1)) * MIX_A)
    two = mix(one + (before[1] + np.uint64(1)) * MIX_B)
    shift = np.uint64(64 - table_bits)
    n = node.astype(np.uint64)
    n += np.uint64(1)
    n *= MIX_B
    slots = []
    for h in (one, two):
        slot = np.repeat(h, size)
        slot ^= n
        slot *= MIX_A
        slot >>= shift
        slots.append(slot.view(np.int64))
    return Bits(np.repeat(doc.astype(np.int32), size), node, low & np.uint8(1), (low >> 1) & np.uint8(DEPTHS - 1), slots)


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int]]:
    """Consecutive documents with about so many tokens together: from and to document, from and to token."""
    ends, at, begin = np.cumsum(sizes), 0, 0
    while at < len(sizes):
        to = min(len(sizes), int(np.searchsorted(ends, begin + most, "left")) + 1)
        yield at, to, begin, int(ends[to - 1])
        at, begin = to, int(ends[to - 1])


def packed(symbols: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
    """Each document's symbols in two binaries: 16 bits a token, and the bits above these."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    made = []
    for x in (symbols.astype("<u2"), (symbols >> 16).astype(np.uint8)):
        made.append(pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends * np.int32(x.itemsize)), pa.py_buffer(x)]))
    return made


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of a batch of packed documents in order, and each document's number of tokens."""

    def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends)

    if not batch.num_rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    (low, _), (high, sizes) = flat(batch.column("low"), "<u2"), flat(batch.column("high"), "u1")
    return low.astype(np.int64) | high.astype(np.int64) << 16, sizes.astype(np.int64)


def symbol_runs(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of a batch of packed documents: first document, symbols, document of each token."""
    symbols, sizes = unpacked(batch)
    for at, to, begin, end in runs(sizes, most):
        yield at, symbols[begin:end], np.repeat(np.arange(to - at), sizes[at:to])


def pack_counts(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as they need, compressed; the first byte says how many."""
    most = x.max(initial=0)
    kind = "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4"
    raw = x.astype(kind).tobytes()
    return bytes([int(kind[2])]) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_counts(x: bytes, n: int) -> np.ndarray:
    size = x[0]
    return np.frombuffer(pa.decompress(x[1:], n * size, codec="zstd", asbytes=True), f"<u{size}").astype(np.int64)


def count_tables(train: DataFrame, code, table_bits: int, scratch: Scratch) -> list[np.ndarray]:
    """Counters [slot, bit] of the two hashed contexts over all training texts, 16 bits each."""
    step = min(1 << 16, 1 << table_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = code.value
        part = TaskContext.get().partitionId()
        tables = [np.zeros(2 << table_bits, np.uint32) for _ in range(2)]
        some = False
        for batch in batches:
            for _, symbols, doc in symbol_runs(batch, NEAR):
                bits = decisions(own, symbols, doc, table_bits)
                for table, slot in zip(tables, bits.slots, strict=True):
                    np.add.at(table, 2 * slot + bits.bit, np.uint32(1))
                some = True
        for k, table in enumerate(tables if some else []):
            for at in range(0, len(table), 2 * step):
                part_of = table[at : at + 2 * step]
                if part_of.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k * (1 << table_bits) + at // 2]), pa.array([part], pa.int64()), pa.array([pack_counts(part_of)], pa.binary())], names=["block", "part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack_counts(x, 2 * step) for x in binaries(table.column("counts").combine_chunks()))
        return pa.table({"block": table.column("block")[:1], "part": pa.array([min(table.column("part").to_pylist()) // FAN_IN], pa.int64()), "counts": pa.array([pack_counts(np.minimum(total, 0xFFFFFFFF))], pa.binary())})

    schema = "block long, part long, counts binary"
    parts = train.rdd.getNumPartitions()
    found = train.select("low", "high").mapInArrow(count, schema)
    while parts > 1:
        grouped = found.groupBy("block", (F.col("part") / F.lit(FAN_IN)).cast("long").alias("near"))
        found, parts = grouped.applyInArrow(lambda key, t: add(t), schema), -(-parts // FAN_IN)
    tables = [np.zeros((1 << table_bits, 2), np.uint16) for _ in range(2)]
    for r in scratch.keep(found, "tables").toLocalIterator():  # at most 2 * 2**table_bits counters
        k, at = divmod(r["block"], 1 << table_bits)
        counts = unpack_counts(bytes(r["counts"]), 2 * step).reshape(-1, 2)
        most = counts.max(1, keepdims=True)
        scaled = np.where(most > 65_535, counts * 65_535 // np.maximum(most, 1), counts)
        tables[k][at : at + len(counts)] = scaled
    return tables


def own_history(bits: Bits) -> tuple[np.ndarray, np.ndarray]:
    """For each decision, how often its node took bit 0 and bit 1 earlier in the same document.

    Decisions come by document, so node and place together as one number, sorted,
    put those of a node and document side by side, in order.
    """
    n = len(bits.node)
    wide = max(n, int(bits.node.max(initial=0)) + 1) > 1 << 16
    kind, half = (np.uint64, 32) if wide else (np.uint32, 16)
    key = bits.node.astype(kind)
    key <<= kind(half)
    key |= np.arange(n, dtype=kind)
    key.sort()
    place = (key & kind((1 << half) - 1)).astype(np.int64)
    key >>= kind(half)
    found = ((bits.of.astype(np.uint32) << np.uint32(1)) | bits.bit).take(place)
    bit = found & np.uint32(1)
    found >>= np.uint32(1)
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    new[1:] |= found[1:] != found[:-1]
    # decisions so far in the low half, ones among them in the high half; less those before each group's first
    both = np.cumsum(bit, dtype=kind)
    both -= bit
    both <<= kind(half)
    both += np.arange(n, dtype=kind)
    first = np.flatnonzero(new)
    both -= np.repeat(both[first], np.diff(first, append=n))
    out = np.empty(n, kind)
    out[place] = both
    ones = out >> kind(half)
    out &= kind((1 << half) - 1)
    out -= ones
    signed = f"i{out.itemsize}"
    return out.view(signed).astype(np.float32), ones.view(signed).astype(np.float32)


def level(total: np.ndarray) -> np.ndarray:
    """Confidence of a counter by its total: none, up to 2, up to 14, more."""
    return (total > 0).astype(np.uint8) + (total > 2) + (total > 14)


def odds(zeros: np.ndarray, ones: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Log-odds of bit 1 from counts as floats."""
    ratio = ones + np.float32(A)
    ratio /= zeros + np.float32(A)
    return np.log(ratio, out=ratio if out is None else out)


def compact(table: np.ndarray) -> np.ndarray:
    """Counters as 16 bits a slot: log-odds in 14, confidence in 2; a score then looks at one number a context."""
    zeros, ones = table[:, 0].astype(np.float32), table[:, 1].astype(np.float32)
    return (np.rint(np.clip(odds(zeros, ones), -EDGE, EDGE) * STEP).astype(np.int16) << 2) | level(zeros + ones).astype(np.int16)


def left_out(table: np.ndarray) -> np.ndarray:
    """Compact numbers [slot, bit] of a table's counters less a decision's own count."""
    step = 1 << 18
    out = np.empty(table.shape, np.int16)
    for at in range(0, len(table), step):
        part = table[at : at + step]
        for bit in range(2):
            less = part.copy()
            less[:, bit] -= less[:, bit] > 0
            out[at : at + step, bit] = compact(less)
    return out


def inputs(code: Code, tables: list[np.ndarray], bits: Bits, x: np.ndarray) -> np.ndarray:
    """Puts the predictors' log-odds into x, one row for each decision; the gate of each decision, whose last digit is the depth.

    tables: compact ones; or of two columns, from which each decision's own count is left out.
    """
    x[:, 0] = code.log_odds.take(bits.node)
    gate = np.zeros(len(bits.node), np.uint8)
    for k, (table, slot) in enumerate(zip(tables, bits.slots, strict=True), 1):
        found = table.take(slot if table.ndim == 1 else 2 * slot + bits.bit)
        np.multiply(found >> 2, np.float32(1 / STEP), out=x[:, k], casting="unsafe")
        gate *= 4
        gate += found.astype(np.uint8) & np.uint8(3)
    n0, n1 = own_history(bits)
    x[:, 3] = odds(n0, n1)
    gate *= 2
    gate += n0 + n1 > 2
    gate *= DEPTHS
    gate += bits.depth
    return gate


def prepared(code: Code, tables: list[np.ndarray], symbols: np.ndarray, doc: np.ndarray, table_bits: int) -> tuple[np.ndarray, ...]:
    """Inputs, gate and bit of all decisions of a run, and each document's number of them; made for a few documents at a time."""
    size = code.size[symbols]
    n = int(size.sum())
    x, gate, bit, a = np.empty((n, 4), np.float32), np.empty(n, np.uint8), np.empty(n, np.uint8), 0
    for _, _, begin, end in runs(np.bincount(doc), NEAR):
        bits = decisions(code, symbols[begin:end], doc[begin:end], table_bits)
        b = a + len(bits.node)
        gate[a:b], bit[a:b] = inputs(code, tables, bits, x[a:b]), bits.bit
        a = b
    return x, gate, bit, np.bincount(doc, size).astype(np.int64)


def rows_at(x: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Rows of four 32-bit numbers; taken as one 128-bit number each."""
    return x.view(np.complex128).ravel().take(i).view(np.float32).reshape(-1, 4)


def added(x: np.ndarray) -> np.ndarray:
    """Sums of rows of four."""
    pairs = x.view(np.complex64)
    pairs = pairs[:, 0] + pairs[:, 1]
    return pairs.real + pairs.imag


def squash(s: np.ndarray) -> np.ndarray:
    out = np.negative(s)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


@dataclass
class Mixer:
    """Weight sets by gate, and the last stage's maps by depth."""

    weights: np.ndarray = field(default_factory=lambda: np.tile(np.array([0.3, 0.4, 0.2, 0.15, 0.0], np.float32), (2 * GATES * DEPTHS, 1)))
    maps: np.ndarray = field(default_factory=lambda: np.tile(squash(np.linspace(-APM_EDGE, APM_EDGE, APM_STEPS)), (DEPTHS, 1)))

    def online(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Natural logarithm of each document's bits, of which size says how many it has; each learns from its own earlier batches.

        All documents take their next batch side by side, the longest first, so
        those that go on are always the first ones.
        """
        order = np.argsort(-size, kind="stable")
        first, size = (np.cumsum(size) - size)[order], size[order]
        # pieces of BATCH decisions, each document's first one, then each one's second, and so on
        pieces = -(-size // BATCH)
        own = np.repeat(np.arange(len(size)), pieces)
        step = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        turns = np.argsort(step, kind="stable")
        own, step = own[turns], step[turns]
        cut = np.minimum(size[own] - step * BATCH, BATCH)
        ends = np.cumsum(cut)
        i = np.repeat(first[own] + step * BATCH - (ends - cut), cut)
        i += np.arange(len(i))
        x, gate, bit = rows_at(x, i), gate.take(i), bit.take(i)
        gates, cells = len(self.weights), self.maps.size
        sets, row = gate.astype(np.int64), (gate & np.uint8(DEPTHS - 1)) * np.int64(APM_STEPS)
        p = np.empty(len(bit), np.float32)
        # one for all, until documents have their own
        weights, last, maps = np.ascontiguousarray(self.weights[:, :4]), self.weights[:, 4], self.maps.astype(np.float32).ravel()
        rise = np.diff(maps, append=maps[-1:])
        going = np.bincount(step)
        stops = ends[np.cumsum(going) - 1].tolist()
        for t, (a, b) in enumerate(zip([0, *stops], stops, strict=False)):
            set_ = sets[a:b]
            s = mixed(x[a:b], weights, last, set_)
            low, share = place(s)
            cell = row[a:b] + low
            flat = squash(s)
            p[a:b] = refined(flat, maps, rise, cell, share)
            if t + 1 == len(stops):
                break
            # the documents that go on have whole batches, which come first
            more = int(going[t + 1])
            n = more * BATCH
            set_, cell = set_[:n], cell[:n]
            if not t:
                weights, last, maps = np.tile(weights, (more, 1)), np.tile(last, more), np.tile(maps, more)
                whose = np.repeat(own[going[0] :], cut[going[0] :])
                sets[b:] += whose * gates
                row[b:] += whose * cells
                whose = np.repeat(np.arange(more), BATCH)
                set_, cell = set_ + whose * gates, cell + whose * cells
            error = bit[a : a + n] - flat[:n]
            m = more * gates
            rate = RATE / np.sqrt(np.maximum(np.bincount(set_, minlength=m), 1))
            for k in range(4):
                weights[:m, k] += rate * np.bincount(set_, error * x[a : a + n, k], m)
            last[:m] += ALWAYS * rate * np.bincount(set_, error, m)
            hit, ones = map_sums(cell, share[:n], bit[a : a + n], more * cells)
            now = maps[: more * cells]
            now += (ones - hit * now) / (hit + MAP_PRIOR)
            rise = np.diff(now, append=now[-1:])
        p -= bit ^ np.uint8(1)  # p where the bit is 1, p - 1 elsewhere
        np.abs(p, out=p)
        np.log(p, out=p)
        logs = np.add.reduceat(p, ends - cut, dtype=np.float64) if len(p) else np.empty(0)
        out = np.zeros(len(order))
        out[order[: len(going) and going[0]]] = np.bincount(own, logs)
        return out

    def stepped(self, sums: np.ndarray) -> Mixer:
        """The mixer after one Newton step from the sums of fit_sums; sets that were never seen stay."""
        gates, k = self.weights.shape
        parts = np.split(sums, np.cumsum([gates * k, gates * k * (k + 1) // 2, self.maps.size]))
        slope, upper = parts[0].reshape(k, gates).T, parts[1].reshape(-1, gates)
        bend = np.zeros((gates, k, k))
        for u, (i, j) in zip(upper, PAIRS, strict=True):
            bend[:, i, j] = bend[:, j, i] = u
        before = self.weights.astype(np.float64)
        slope = slope - RIDGE * (before - Mixer().weights)
        step = np.linalg.solve(bend + RIDGE * np.eye(k), slope[..., None])[..., 0]
        hit, ones = (m.reshape(self.maps.shape) for m in parts[2:])
        return Mixer((before + np.clip(step, -0.5, 0.5)).astype(np.float32), (ones + 30.0 * Mixer().maps) / (hit + 30.0))


PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]


def mixed(x: np.ndarray, weights: np.ndarray, last: np.ndarray, set_: np.ndarray) -> np.ndarray:
    """Weighted log-odds; weights by set, last: those of the constant."""
    each = rows_at(weights, set_)
    each *= x
    s = last.take(set_)
    s *= ALWAYS
    s += added(each)
    return np.clip(s, -14, 14, out=s)


def place(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower map cell of log-odds, and the share of the upper one."""
    at = np.clip(s, -APM_EDGE, APM_EDGE - 1e-5)
    at += np.float32(APM_EDGE)
    at *= np.float32((APM_STEPS - 1) / (2 * APM_EDGE))
    low = at.astype(np.int32)
    at -= low
    return low, at


def refined(flat: np.ndarray, maps: np.ndarray, rise: np.ndarray, cell: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Probabilities of bit 1 after the last stage, from those before it; rise: from each map cell to the next."""
    p = rise.take(cell)
    p *= share
    p += maps.take(cell)
    p += flat
    p *= np.float32(0.5)
    return np.clip(p, 1e-6, 1 - 1e-6, out=p)


def map_sums(cell: np.ndarray, share: np.ndarray, bit: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Hits and ones by map cell: a decision's upper cell gets its share, the lower one the rest."""
    pair = cell * 2
    pair += bit
    upper = np.bincount(pair, share, 2 * cells)
    both = np.bincount(pair, minlength=2 * cells) - upper
    both[2:] += upper[:-2]
    return both[::2] + both[1::2], both[1::2]


def fit_sums(code: Code, tables: list[np.ndarray], mixer: Mixer, batch: pa.RecordBatch, table_bits: int) -> np.ndarray:
    """Slopes and second derivatives by gate, and hits and ones by map cell, added over all bits of the packed documents."""
    gates, cells = len(mixer.weights), mixer.maps.size
    slope, bend = np.zeros((gates, 5)), np.zeros((gates, 5, 5))
    hit, ones = np.zeros(cells), np.zeros(cells)
    for _, symbols, doc in symbol_runs(batch, FITTED):
        x, gate, bit, _ = prepared(code, tables, symbols, doc, table_bits)
        if not len(gate):
            continue
        weights, last = np.ascontiguousarray(mixer.weights[:, :4]), mixer.weights[:, 4]
        alike = (mixer.weights == mixer.weights[0]).all()  # as they are at first
        s = np.clip(x @ weights[0] + ALWAYS * last[0], -14, 14) if alike else mixed(x, weights, last, gate)
        p = squash(s)
        low, share = place(s)
        more = map_sums((gate & np.uint8(DEPTHS - 1)) * np.int64(APM_STEPS) + low, share, bit, cells)
        hit += more[0]
        ones += more[1]
        order = np.argsort(gate, kind="stable")  # decisions of a gate side by side
        gate, x = gate.take(order), rows_at(x, order)
        both = np.empty((len(p), 2), np.float32)
        both[:, 0], both[:, 1] = p * (1 - p), bit - p
        both = both.view(np.complex64).ravel().take(order)
        right = np.empty((len(p), 6), np.float32)
        for k in range(4):
            np.multiply(x[:, k], both.real, out=right[:, k])
        np.multiply(both.real, ALWAYS, out=right[:, 4])
        right[:, 5] = both.imag
        begin = np.flatnonzero(np.diff(gate, prepend=~gate[:1]))
        end = [*begin[1:].tolist(), len(gate)]
        for g, i, j in zip(gate[begin].tolist(), begin.tolist(), end, strict=True):
            total = x[i:j].T @ right[i:j]
            bend[g, :4] += total[:, :5]
            slope[g, :4] += total[:, 5]
        total = ALWAYS * np.add.reduceat(right[:, 4:], begin, axis=0, dtype=np.float64)
        bend[gate[begin], 4, 4] += total[:, 0]
        slope[gate[begin], 4] += total[:, 1]
    upper = [bend[:, i, j] for i, j in PAIRS]
    return np.concatenate([slope.T.ravel(), *upper, hit, ones])


def fit(train: DataFrame, code, tables: list[np.ndarray], table_bits: int) -> Mixer:
    """Weights and maps from all training texts, in a fixed number of rounds over them."""
    context = train.sparkSession.sparkContext
    counters = context.broadcast([left_out(t) for t in tables])
    mixer = Mixer()
    for _ in range(ROUNDS):
        now = mixer

        def gather(batches: Iterator[pa.RecordBatch], now: Mixer = now) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in lean(batches):
                got = fit_sums(code.value, counters.value, now, batch, table_bits)
                total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

        found = train.select("low", "high").mapInArrow(gather, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # a fixed number of sums
        if not found:
            break
        mixer = mixer.stepped(np.array([r["x"] for r in sorted(found)]))
    counters.destroy()
    return mixer


def log_probabilities(code: Code, tables: list[np.ndarray], mixer: Mixer, symbols: np.ndarray, doc: np.ndarray, table_bits: int) -> np.ndarray:
    """Natural logarithm of each document's coded symbols."""
    out = np.zeros(int(doc[-1]) + 1 if len(doc) else 0)
    x, gate, bit, size = prepared(code, tables, symbols, doc, table_bits)
    if len(gate):
        out[:] = mixer.online(x, gate, bit, size)
    return out


def tails(words: pa.Array, doc: np.ndarray, n_docs: int) -> pa.Array:
    """Each document's words as a list of (word, n)."""
    found = words.dictionary_encode()
    most = max(1, len(found.dictionary))
    pairs, n = np.unique(doc.astype(np.int64) * most + found.indices.to_numpy(), return_counts=True)
    ends = np.searchsorted(pairs, np.arange(n_docs + 1) * most)
    each = pa.StructArray.from_arrays([found.dictionary.take(pa.array(pairs % most)).cast(pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)


def encoded(texts: pa.Array, code: Code) -> dict[str, pa.Array]:
    """Of each text: n_tokens, n_known, base (added logarithms of its head words' counts), symbols in low and high, and its other words."""
    words, sizes = split(texts)
    n_docs, doc = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    end = code.words.index(END) if END in code.words else code.escape
    symbols = np.full(len(words) + n_docs, end, np.int64)
    found = code.symbols(words)
    symbols[np.arange(len(words)) + doc] = found
    out = found == code.escape
    other, of = words.filter(pa.array(out)), doc[out]
    if end == code.escape:
        other, of = pa.concat_arrays([other, pa.array([END.decode()] * n_docs, pa.string())]), np.concatenate([of, np.arange(n_docs)])
    doc, sizes = np.repeat(np.arange(n_docs), sizes + 1), sizes + 1
    known = symbols != code.escape
    low, high = packed(symbols, sizes)
    return {
        "n_tokens": pa.array(sizes, pa.int64()),
        "n_known": pa.array(np.bincount(doc[known], minlength=n_docs), pa.int64()),
        "base": pa.array(np.bincount(doc[known], np.log10(code.counts + 0.5)[symbols[known]], n_docs), pa.float64()),
        "low": low,
        "high": high,
        "tail": tails(other, of, n_docs),
    }


def score(docs: DataFrame, head: int = HEAD, table_bits: int | None = None) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of docs.

    A null or empty text is the end token alone; bits_per_byte is then null.
    Repeated rows are scored each, and all count in training if not held out.
    Without training rows all words are unknown and base_score is 0.  Ties in
    frequency at the head's edge go by the words' bytes.  No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    texts = docs.select("doc_id", held_out().alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    train = texts.filter(~F.col("held_out"))
    counts = scratch.keep(word_counts(train), "counts")
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # a fixed number of short words: the bound of what is broadcast
    top = counts.filter(F.length("word") <= HEAD_WORD_BYTES).orderBy(F.desc("c"), "word").limit(head).collect()
    n_head = sum(r["c"] for r in top)
    made = Code([bytes(r["word"]) for r in top], np.array([*(r["c"] for r in top), max(1, n_all - n_head)], np.int64))
    code = spark.sparkContext.broadcast(made)
    if table_bits is None:
        per_token = float((made.size * made.counts).sum()) / max(1, made.counts.sum())
        table_bits = int(np.clip(np.ceil(np.log2(max(1.0, n_all * per_token / 8))), 12, TABLE_BITS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, low binary, high binary, tail array<struct<word:binary,n:long>>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CUT):
                columns = {c: part.column(c) for c in ("doc_id", "held_out")}
                columns["n_bytes"] = pc.binary_length(part.column("text")).cast(pa.int64())
                columns |= encoded(part.column("text"), code.value)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = scratch.keep(texts.mapInArrow(encode, schema).withColumn("row", F.monotonically_increasing_id()), "rows")
    train = rows.filter(~F.col("held_out"))
    tables = count_tables(train, code, table_bits, scratch)
    mixer = fit(train, code, tables, table_bits)
    model = spark.sparkContext.broadcast(([compact(t) for t in tables], mixer))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (counters, learned) = code.value, model.value
        for batch in lean(batches):
            logs = [log_probabilities(own, counters, learned, symbols, doc, table_bits) for _, symbols, doc in symbol_runs(batch, SCORED)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in plain), pa.array(np.concatenate([np.empty(0), *logs]) / np.log(10), pa.float64())],
                names=[*plain, "score"],
            )

    plain = ["doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base", "row"]
    schema = f"doc_id {kind}, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, row long, score double"
    scores = scratch.keep(rows.select(*plain, "low", "high").mapInArrow(scored, schema), "scores")
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    joined = tail.join(counts.hint("shuffle_hash"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    per_row = joined.groupBy("row").agg(
        F.sum("n").alias("t_n"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("t_known"),
        F.sum(F.col("n") * F.log10(F.col("c") + F.lit(0.5))).alias("t_log"),
    )
    whole = float(np.log10(n_all + 0.5 * (v_all + 1)))
    outside = float(np.log10((n_all - n_head) + 0.5 * (v_all - len(top) + 1)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = scores.join(per_row, "row", "left")
    score_ = F.col("score") + zero("t_log") - zero("t_n") * F.lit(outside)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("t_known")).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("t_log") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        score_.alias("score"),
        F.when(F.col("n_bytes") > 0, -score_ / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )

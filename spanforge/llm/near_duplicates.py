"""Similarity join on word shingles by parity sketches.

Sketch.  Every distinct shingle flips one bit of a sketch, at a place given by its
hash.  A bit is set when an odd number of shingles hit it, so the number of bits
in which two sketches differ is at most the number of shingles in which the two
sets differ.  For the join a sketch is not written out: it is cut into P parts, and
a part is carried as the exclusive-or of its bits' codes.

Pigeonhole.  Sets of sizes a and b at the threshold t differ in at most
d = (1 - t) / (1 + t) * (a + b) shingles.  Sizes fall into bands so that partners lie
in one band or in two that touch; for each such group d has a fixed bound, and
with P = d + 1 + w parts any linked pair agrees on at least w + 1 of them.  Each
set may therefore leave out its w most frequent part keys: among the parts a pair
agrees on, the rarest is preceded by w others in both sets alike, so it stays in
both.  Very common shingles and empty parts cost those spare keys and no pairs.

Sets, not rows, are joined: a set is known by 64 bits of its own, so copies are one
and rows that share an id but not their text are two.  Keys travel in packed
columns to buckets, and only keys of two different sets or more come out.

Hubs.  Each key names one hub, the set with most keys among its own; sets that
share a key with the same hub meet in that hub's group once, however many keys
they share.  Two sets that share a key always meet in its hub's group.  A group is
cut into blocks of bounded size; written-out sketches rule out almost all pairs of
a block in array operations, and the others are verified there and then on the
sets themselves, unless verified links connect them already.  Most groups are one
block and then done.  Of groups with more, only blocks that hold different
components meet once more.  So no pair is asked twice, no possible link is left
unasked, and a block sends on one link at most for every two components it joins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import LOWER, MIX_A, MIX_B, WORD_CODES, Scratch, binaries, fresh, lean, mix, rolling, slices, trimmed
from spanforge.llm.components import components

#: Entries of a bucket of keys; shingles and sets of a block; shingles of a task's group of blocks, about.
ENTRIES, BLOCK_SHINGLES, BLOCK_SETS, GROUP_SHINGLES = 400_000, 250_000, 4_096, 500_000
#: The buckets of keys are shuffled in so many turns, which bounds what lies on disk twice.
TURNS = 4


class Bands:
    """Size bands for a threshold num / den, and each group's bounds."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(edges[-1] * den // num + 1)
        self.edges = np.array(edges, np.int64)
        self.differ = (den - num) * 2 * (self.edges[1:] - 1) // (den + num)
        self.spare = np.where(self.differ > 0, np.maximum(1, self.differ // 4), 0)
        self.parts = self.differ + 1 + self.spare

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of k words; of the whole text if it has fewer words."""
    codes = WORD_CODES.of(text.translate(LOWER).split())
    if not len(codes):
        return np.empty(0, np.uint64)
    return np.unique(rolling(codes, min(k, len(codes))) ^ np.uint64(0 if len(codes) >= k else len(codes)))


def node_of(s: np.ndarray) -> int:
    """A set's own number: 64 bits from all its shingles, signed."""
    x = np.bitwise_xor.reduce(mix(s + MIX_A)) ^ mix(np.add.reduce(mix(s ^ MIX_B), keepdims=True))[0]
    return int(x.view(np.int64))


#: Columns of packed keys: bytes that travel, and the kind.
ENTRY = [("key", 5, "<u8"), ("node", 8, "<u8"), ("n", 4, "<u4"), ("group", 2, "<u2")]


def squeeze(columns: list[np.ndarray]) -> bytes:
    """Columns as byte planes after one another, the key cut to five bytes; sizes come sorted and shrink to little."""
    parts = []
    for (name, width, kind), c in zip(ENTRY, columns, strict=True):
        c = np.ascontiguousarray(np.diff(c, prepend=c.dtype.type(0)) if name == "n" else c).astype(kind)
        parts.append(c.view(np.uint8).reshape(len(c), -1)[:, :width].T.tobytes())
    return len(columns[0]).to_bytes(4, "little") + zlib.compress(b"".join(parts), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    raw, at = zlib.decompress(data[4:]), 0
    out = np.zeros(n, [(name, kind) for name, _, kind in ENTRY])
    for name, width, kind in ENTRY:
        full = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        full[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        value = full.view(kind).reshape(n)
        out[name] = np.cumsum(value, dtype=kind) if name == "n" else value
        at += n * width
    return out


def part_keys(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, set, group): the part keys of sets in their own band's group and the next."""
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    z, place = mix(flat ^ MIX_A), flat >> np.uint64(24)
    both = []
    for up in (0, 1):
        group = bands.of(n) + up
        parts = bands.parts[group]
        base = np.cumsum(parts) - parts
        slot = np.repeat(base, n) + (place % np.repeat(parts, n).astype(np.uint64)).astype(np.int64)
        xor = np.zeros(int(parts.sum()), np.uint64)
        np.bitwise_xor.at(xor, slot, z)
        part = np.arange(len(xor)) - np.repeat(base, parts)
        where = mix(np.repeat(group, parts).astype(np.uint64) * MIX_B + part.astype(np.uint64))
        rows = np.repeat(np.arange(len(n)), parts)
        both.append((mix(xor ^ where), rows, group[rows]))
    return tuple(np.concatenate(x) for x in zip(*both, strict=True))


def sketch_rows(docs: DataFrame, k: int, bands: Bands, buckets: int) -> DataFrame:
    """One pass over the texts: (doc_id, mark, n, node) of each row, and (bucket, entries) with packed part keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # sets whose keys this task has sent; a bounded memo, copies beyond it are joined later
        for part in lean(s for batch in batches for s in slices(batch, "text")):
            found = [shingles(t, k) for t in binaries(part.column("text"))]
            nodes = [node_of(s) if len(s) else 0 for s in found]
            new = []
            for s, node in zip(found, nodes, strict=True):
                if len(s) and node not in sent:
                    sent.add(node)
                    new.append((len(s), node, s))
            if len(sent) > 100_000:
                sent.clear()
            of, data = packed(new) if new else ([], [])
            rows, none = part.num_rows, lambda kind, m=len(of): pa.nulls(m, kind)
            long = lambda x, m=len(of): pa.array([*x, *[None] * m], pa.int64())
            columns = [*(pa.concat_arrays([part.column(c), none(part.column(c).type)]) for c in ("doc_id", "mark")), long(len(s) for s in found), long(nodes), pa.array([None] * rows + of, pa.int64()), pa.array([None] * rows + data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n", "node", "bucket", "entries"])

    def packed(new: list) -> tuple[list[int], list[bytes]]:
        new.sort(key=lambda x: x[0])
        key, rows, group = part_keys([s for _, _, s in new], bands)
        n, node = np.array([x[0] for x in new], np.uint32), np.array([x[1] for x in new], np.int64).view(np.uint64)
        bucket = ((key >> np.uint64(48)) * np.uint64(0x10001) + (key >> np.uint64(40))) % np.uint64(buckets)
        order = np.lexsort((rows, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64)) if buckets < len(key) else None
        if cuts is None:  # more buckets than keys: only those that occur
            of, first = np.unique(bucket[order], return_index=True)
            edges = np.append(first, len(key))
            spans = [(int(b), int(edges[i]), int(edges[i + 1])) for i, b in enumerate(of)]
        else:
            spans = [(b, int(cuts[b]), int(cuts[b + 1])) for b in range(buckets) if cuts[b] < cuts[b + 1]]
        columns = [c[order] for c in (key, node[rows], n[rows], group.astype(np.uint16))]
        return [b for b, _, _ in spans], [squeeze([c[i:j] for c in columns]) for _, i, j in spans]

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(emit, "doc_id long, mark long, n long, node long, bucket long, entries binary")


def shared_keys(packed: DataFrame) -> DataFrame:
    """(key, node, n, grp, often): keys that two different sets or more have."""

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        bucket = np.array([key[0].as_py()], np.uint64) * MIX_B
        e = np.concatenate([unsqueeze(x) for x in binaries(table.column("entries").combine_chunks())])
        e = e[np.lexsort((e["node"], e["group"], e["key"]))]
        new_key = np.ones(len(e), bool)
        new_key[1:] = (e["key"][1:] != e["key"][:-1]) | (e["group"][1:] != e["group"][:-1])
        new_set = new_key.copy()
        new_set[1:] |= e["node"][1:] != e["node"][:-1]
        number = np.cumsum(new_key) - 1
        often = np.bincount(number[new_set], minlength=len(e) and number[-1] + 1)
        keep = new_set & (often[number] > 1)
        f, often = e[keep], often[number[keep]]
        whole = mix(f["key"] * MIX_A ^ mix(f["group"].astype(np.uint64) + bucket))
        columns = {"key": whole.view(np.int64), "node": f["node"].view(np.int64), "n": f["n"].astype(np.int64), "grp": f["group"].astype(np.int64), "often": often.astype(np.int64)}
        return pa.table({name: pa.array(x) for name, x in columns.items()})

    return packed.groupBy("bucket").applyInArrow(lambda key, t: trimmed(meet(key, t)), "key long, node long, n long, grp long, often long")


def sets_at(docs: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """(bucket, part, side, of, node, shingles): the sets of the texts whose id and hash have places (rep, mark, node, places).

    The sets are made where the texts lie and go straight to the buckets of their places.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # sets that this task has sent; a bounded memo for rows that repeat id and text
        for part in lean(s for batch in batches for s in slices(batch, "text")):
            found = [shingles(t, k) for t in binaries(part.column("text"))]
            own = []
            for s, node in zip(found, part.column("node").to_pylist(), strict=True):
                # texts of one id may share a hash
                own.append(node not in sent and len(s) > 0 and node_of(s) == node)
                if own[-1]:
                    sent.add(node)
            if len(sent) > 100_000:
                sent.clear()
            rows = part.select(["node", "places"]).filter(pa.array(own, pa.bool_()))
            packed = pa.array([s.tobytes() for s, yes in zip(found, own, strict=True) if yes], pa.binary())
            yield pa.RecordBatch.from_arrays([*rows.columns, packed], names=["node", "places", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    texts = texts.join(places, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("hash") == F.col("mark"))).select("node", "places", "text")
    made = texts.mapInArrow(make, f"node long, places {places.schema['places'].dataType.simpleString()}, shingles binary")
    return made.select("node", "shingles", F.explode("places").alias("p")).select("p.*", "node", "shingles")


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Written-out parity sketches, a row each, in four bits or more for each shingle of the smallest set."""
    bits = 1 << max(8, (4 * min(len(s) for s in sets) - 1).bit_length())
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = (np.concatenate(sets) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(of * bits + place, minlength=len(sets) * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").reshape(len(sets), -1).view(np.uint64)


def common_with(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of the other sets has in common with a."""
    flat = np.concatenate(others)
    hit = a[np.minimum(np.searchsorted(a, flat), len(a) - 1)] == flat
    ends = np.cumsum([len(o) for o in others])
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def compare_blocks(table: pa.Table, num: int, den: int, every: bool = False) -> pa.Table:
    """Links (u, v) verified on the sets, from rows (part, side, node, of, shingles).

    Sides 0 and 1 are two blocks of a group: only pairs across them are compared;
    a part of side 2 alone is one block, all its pairs are compared, side 3 marks
    its hub.  of is a component known so far.  Pairs that verified links connect
    already are left out, unless every link is asked for.
    """
    part, side, node, of = (table.column(c).to_numpy() for c in ("part", "side", "node", "of"))
    nodes, at, row = np.unique(node, return_index=True, return_inverse=True)
    packed = table.column("shingles").combine_chunks()
    sets = [np.frombuffer(packed[int(i)].as_buffer(), np.uint64) for i in at]
    size = np.array([len(s) for s in sets], np.int64)
    label = np.unique(of[at], return_inverse=True)[1]  # of each set: its component, as it grows
    found: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.lexsort((-side, part))  # hubs first
    for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        whole = side[rows[0]] >= 2
        if whole:
            left = right = row[rows][np.sort(np.unique(row[rows], return_index=True)[1])]
        else:
            left, right = (np.unique(row[rows[side[rows] == s]]) for s in (0, 1))
        if not len(left) or not len(right) or len(left) + len(right) < 2:
            continue
        quick = len(left) + len(right) > 16
        if quick:
            both = left if whole else np.concatenate([left, right])
            written = sketches([sets[i] for i in both])
            mine, facing = (written, written) if whole else (written[: len(left)], written[len(left) :])
        for i, a in enumerate(left.tolist()):
            begin = i + 1 if whole else 0
            others = right[begin:]
            n = size[others]
            # at the threshold, sets of a and b shingles differ in (den - num) / (den + num) * (a + b) at most
            open_ = (den * np.minimum(n, size[a]) >= num * np.maximum(n, size[a])) & (others != a)
            if not every:
                open_ &= label[others] != label[a]
            open_ = np.flatnonzero(open_)
            if quick and len(open_):
                differ = np.bitwise_count(facing[begin:][open_] ^ mine[i]).sum(1, dtype=np.int64)
                open_ = open_[differ * (den + num) <= (den - num) * (size[a] + n[open_])]
            if not len(open_):
                continue
            b = others[open_]
            common = common_with(sets[a], [sets[j] for j in b.tolist()])
            b = b[den * common >= num * (size[a] + size[b] - common)]
            if not len(b):
                continue
            if not every:  # one link for each component that joins
                joined, first = np.unique(label[b], return_index=True)
                b = b[first]
                label[np.isin(label, joined)] = label[a]
            found.append((np.full(len(b), nodes[a]), nodes[b]))
    u, v = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))
    return pa.table({"u": pa.array(np.minimum(u, v), pa.int64()), "v": pa.array(np.maximum(u, v), pa.int64())})


class Join:
    """The steps of one join, with their tables."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int, name: str = "near"):
        self.docs, self.k, self.num, self.den = docs, k, num, den
        self.scratch = scratch = Scratch(docs.sparkSession, name)
        bands = Bands(num, den)
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        share = 2.2 * 1.25 * 2 * (den - num) / (den + num)
        buckets = max(12, int(size / 6.5 * share / ENTRIES))
        rows = scratch.keep(sketch_rows(docs, k, bands, buckets), "rows")
        #: (doc_id, mark, n, node) of every row; and the smallest id of every set
        self.meta = scratch.keep(rows.filter("bucket is null").select("doc_id", "mark", "n", "node"), "meta")
        first = [F.min("doc_id").alias("rep"), F.coalesce(F.min_by("mark", "doc_id"), F.min("mark")).alias("mark")]
        self.classes = scratch.keep(self.meta.filter("n > 0").groupBy("node").agg(*first), "classes")
        raw = None
        for turn in range(TURNS):
            now = scratch.keep(shared_keys(rows.filter(F.col("bucket") % TURNS == turn).select("bucket", "entries")), "keys")
            raw = now if raw is None else raw.union(now)
            scratch.free()
        scratch.free(rows)
        # each set leaves out its most frequent keys, as many as the group has to spare
        rank = F.row_number().over(Window.partitionBy("node", "grp").orderBy(F.desc("often"), "key"))
        spare = F.element_at(F.lit(bands.spare.astype(np.int32)), (F.col("grp") + 1).cast("int"))
        kept = raw.repartition("node").withColumn("rank", rank).filter(F.col("rank") > spare)
        weight = F.count(F.lit(1)).over(Window.partitionBy("node"))
        open_ = scratch.keep(kept.select("key", "node", "n", weight.alias("weight")), "open")
        scratch.free(raw)
        hub = open_.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"))
        self.members = scratch.keep(open_.join(hub, "key").select("hub", "node", "n").distinct(), "members")
        scratch.free(open_)
        blocks = F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_SETS)))
        self.groups = scratch.keep(self.members.groupBy("hub").agg(blocks.alias("blocks"), F.sum("n").alias("room")), "groups")
        self.room = self.groups.agg(F.coalesce(F.sum("room"), F.lit(0))).first()[0]
        scratch.free()

    def compared(self, parts: DataFrame, every: bool = False, most: bool = True) -> DataFrame:
        """Links from rows (part, side, node, of, n): the sets come to their parts, several parts to a task's group.

        Most texts have a place in the first pass, so it deals them out, without a sort; later
        places are few, and written, so that their size is known and texts may stay where they are.
        """
        num, den = self.num, self.den
        room = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        buckets = max(12, room // GROUP_SHINGLES)
        place = F.struct(F.pmod("part", F.lit(buckets)).alias("bucket"), "part", "side", "of")
        places = parts.groupBy("node").agg(F.collect_list(place).alias("places")).join(self.classes, "node")
        places = places.hint("shuffle_hash") if most else self.scratch.keep(places, "places")
        full = sets_at(self.docs, places, self.k)
        found = full.groupBy("bucket").applyInArrow(lambda t: trimmed(compare_blocks(t, num, den, every)), "u long, v long")
        return self.scratch.keep(found.distinct(), "links")

    def within(self, every: bool = False) -> DataFrame:
        """Links inside all blocks, and of hubs to all blocks of their groups."""
        cut = self.members.join(self.groups.select("hub", "blocks"), "hub")
        own = cut.select("hub", "node", "n", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), F.when(F.col("node") == F.col("hub"), 3).otherwise(2).alias("side"))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
        hubs = cut.filter("blocks > 1 and node = hub").select("hub", "node", "n", each, F.lit(3).alias("side"))
        parts = self.scratch.keep(own.union(hubs).select(F.xxhash64("hub", "block").alias("part"), "side", "node", F.col("node").alias("of"), "n"), "within")
        return self.compared(parts, every)

    def across(self, found: DataFrame | None) -> DataFrame | None:
        """Links between blocks of one group; found: (node, component) so far, or None if every link is asked for.

        A component that fills a block or more has blocks of its own, which need
        not meet each other; the others share blocks.
        """
        large = self.groups.filter("blocks > 1").select("hub")
        if large.isEmpty():
            return None
        rows = self.members.join(large, "hub", "left_semi")
        if found is None:
            rows = rows.withColumn("of", F.col("node"))
        else:
            rows = rows.join(found, "node", "left").withColumn("of", F.coalesce("component", "node")).drop("component")
        blocks = lambda n, c: F.greatest(F.ceil(n / F.lit(BLOCK_SHINGLES)), F.ceil(c / F.lit(BLOCK_SETS)))
        per = rows.groupBy("hub", "of").agg(F.sum("n").alias("room"), F.count(F.lit(1)).alias("many"))
        per = per.withColumn("alone", (F.col("room") >= BLOCK_SHINGLES) | (F.col("many") >= BLOCK_SETS))
        rest = lambda c: F.coalesce(F.sum(F.when(~F.col("alone"), F.col(c))), F.lit(0))
        hubs = per.groupBy("hub").agg(F.count(F.lit(1)).alias("components"), F.greatest(F.lit(1), blocks(rest("room"), rest("many"))).alias("shared"))
        per = per.join(hubs.filter("components > 1"), "hub")
        mine = F.when(F.col("alone"), blocks(F.col("room"), F.col("many")))
        per = per.select("hub", "of", "alone", mine.alias("mine"), "shared")
        whose = F.when(F.col("alone"), F.xxhash64("of", F.pmod(F.xxhash64("node"), F.col("mine")))).otherwise(F.pmod(F.xxhash64("of"), F.col("shared")))
        kind = F.when(F.col("alone"), F.col("of"))
        placed = self.scratch.keep(rows.join(per, ["hub", "of"]).select("hub", "node", "n", "of", whose.alias("block"), kind.alias("kind")), "placed")
        one = placed.groupBy("hub", "block").agg(F.min("kind").alias("kind"))
        two = one.select("hub", F.col("block").alias("other"), F.col("kind").alias("kind2"))
        meet = one.join(two, "hub").filter("block <= other and (kind is null or kind2 is null or kind <> kind2)")
        meet = meet.select("hub", "block", "other", F.xxhash64("hub", "block", "other").alias("part"))
        first = meet.select("hub", "block", "part", F.when(F.col("block") == F.col("other"), 2).otherwise(0).alias("side"))
        second = meet.filter("block <> other").select("hub", F.col("other").alias("block"), "part", F.lit(1).alias("side"))
        parts = placed.join(first.union(second), ["hub", "block"]).select("part", "side", "node", "of", "n")
        return self.compared(self.scratch.keep(parts, "across"), found is None, most=False)

    def joined(self) -> DataFrame:
        """(node, component) of all sets that have a link."""
        links = self.within()
        found = components(links, self.scratch)
        more = self.across(found)
        if more is not None and not more.isEmpty():
            found = components(links.union(more), self.scratch)
        self.scratch.free(self.members)
        return found

    def rows_of(self) -> DataFrame:
        """(doc_id, mark, n, node, group, component_id) of every row; group is a set in its component, the same for all."""
        found = self.joined()
        named = self.classes.join(found, "node", "left").withColumn("group", F.coalesce("component", "node"))
        least = named.groupBy("group").agg(F.min("rep").alias("component_id"))
        of = named.select("node", "group").join(least, "group")
        out = self.meta.join(of, "node", "left")
        return out.select("doc_id", "mark", "n", "node", "group", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    A row's set is its distinct runs of k lower-cased words, or the whole text as
    one run if it has fewer words.  Rows link when den * common >= num * union;
    component_id is the smallest doc_id that can be reached.  Null, empty and
    blank texts have empty sets and are linked with nothing.  Equal texts share a
    set; rows that share an id but not their text have each their own set and
    links.  No rows give no rows.  doc_id is an integer; a row without one belongs
    to the component of its text, which may have no id.  Sets are told apart by 64
    bits.  Texts of any length are read whole; other columns are not read.
    """
    rows = Join(docs, k, num, den).rows_of()
    kind = docs.schema["doc_id"].dataType
    return rows.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def links(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, and the membership of rows: (a, b) with a < b, and (doc_id, n_shingles, class).

    a, b and class number sets; copies are one set and not expanded into pairs.
    Every pair that shares a key is verified, so the number of links of a row can
    be counted: those of its class, weighted by the members on the other side.
    Null, empty, repeated and nameless rows count as in near_duplicates; a row
    without words has no class.
    """
    join = Join(docs, k, num, den, "links")
    inside = join.within(every=True)
    more = join.across(None)
    pairs = inside if more is None else inside.union(more).distinct()
    kind = docs.schema["doc_id"].dataType
    members = join.meta.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("class"))
    return pairs.select(F.col("u").alias("a"), F.col("v").alias("b")), members


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, all columns, of one document from each component: the one with the smallest id.

    If several texts of a component have that id, the one with the smallest hash
    stays; of rows that repeat both id and text, the one whose columns have the
    smallest hash.  Texts of other components under the same id stay as well, and
    so do all rows without an id and all without a word.  No rows give no rows.
    """
    rows = Join(docs, k, num, den).rows_of()
    own = rows.filter("doc_id is not null and (n = 0 or doc_id = component_id)")
    # rows without a word are components of their own; rows that repeat id and text count as one
    chosen = own.groupBy("doc_id", F.coalesce("group", "mark").alias("group")).agg(F.min("mark").alias("mark")).select("doc_id", "mark").distinct()
    mark, id_, place = (fresh(docs, x) for x in ("mark", "wanted_id", "place"))
    marked = docs.withColumn(mark, F.xxhash64("text"))
    chosen = chosen.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark + "2"))
    kept = marked.join(chosen, (F.col("doc_id") == F.col(id_)) & (F.col(mark) == F.col(mark + "2")))
    order = Window.partitionBy("doc_id", mark).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = kept.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).select(*[f"`{c}`" for c in docs.columns])
    return kept.unionByName(docs.filter("doc_id is null"))

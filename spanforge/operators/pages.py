"""Words of whole documents as columns in Arrow batches: the steps of assembly and layout without joins and windows.

A task reads documents in runs of about ``RUN`` bytes.  Words of a run are numpy
columns, sorted by document and place, so a window is a look at the row before, a sum
within a block is a difference of running sums, and strings are only cut and joined by
Arrow.  Nothing is shuffled but the texts.  A document's words are in memory at once.
Results are those of ``assembly.placed_words``, ``assembly.coloured_entities`` and
``layout.recognised_records``.  Colours are numbers, 0 for none.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from spanforge.operators.assembly import BLOCK_GAP, LINE_GAP
from spanforge.operators.layout import STRIP

#: Bytes of texts whose words are columns at a time.
RUN = 2 << 20


def whole(batches: Iterator[pa.RecordBatch], key: str, size: str, most: int = RUN) -> Iterator[pa.Table]:
    """Rows sorted by a key in runs of about so many bytes of a column of strings; rows of a key stay together, those with nulls go."""
    held: list[pa.Table] = []
    for batch in batches:
        found = pa.Table.from_batches([batch])
        found = found.filter(pc.and_(pc.is_valid(found[key]), pc.is_valid(found[size])))
        if not len(found):
            continue
        rows = pa.concat_tables([*held, found]).combine_chunks()
        first = np.flatnonzero(changes(rows[key]))
        before = np.cumsum(pc.binary_length(rows[size]).to_numpy().astype(np.int64))[first - 1]
        before[0] = 0
        cuts = first[np.flatnonzero(np.diff(before // most, prepend=-1))].tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield rows.slice(a, b - a).combine_chunks()
        held = [rows.slice(cuts[-1])]
    yield from held


def changes(*columns) -> np.ndarray:
    """Whether a row differs from the one before in some column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        x = c if isinstance(c, np.ndarray) else c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        new[1:] |= x[1:] != x[:-1] if isinstance(x, np.ndarray) else pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return new


def flat(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def lengths(texts: pa.Array) -> np.ndarray:
    return pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def before(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Sums of the numbers before each one among the rows from the last new one on."""
    sums = np.cumsum(x) - x
    return sums - np.repeat(sums[new], np.diff(np.flatnonzero(new), append=len(x)))


def tokens(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """Ids of documents; document, place and text of all words of columns doc_id and text, which white space parts."""
    texts = flat(rows["text"])
    found = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(texts, r"[ \t\n\r\f]+", " "), " "), " ")
    sizes = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
    new = changes(rows["doc_id"])
    doc = np.repeat(np.cumsum(new) - 1, sizes)
    word = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((word, doc)) if not new.all() else None  # an id with several texts
    words = found.flatten()
    if order is not None:
        doc, word, words = doc[order], word[order], words.take(pa.array(order))
    return flat(rows["doc_id"].filter(pa.array(new))), doc, word, words


def joined(pieces: pa.Array, first: np.ndarray) -> pa.Array:
    """Pieces from each first row up to the next one, as one string."""
    ends = np.append(np.flatnonzero(first), len(pieces)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pieces), "")


def structs(ends: np.ndarray, **columns) -> pa.ListArray:
    """A list of structs for each pair of neighbouring ends."""
    made = [pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(made, names=list(columns)))


# --- places of words in documents ------------------------------------------------------------------


def placed(words: dict, blocks: dict) -> dict:
    """Pieces in the order of the text: doc, page, start, end, color, text with the space or line feed before it.

    words: doc, page, block, line, color, y0, y1 and text, sorted by document, page,
    block and word; blocks: doc, page, block, position, band, col, x0, y0, x1, y1,
    rotation.  All are whole numbers, not negative but for the edges.  The rules are those of ``assembly.block_pieces`` and ``assembly.block_places``.
    """
    pages, names = 1 + max(words["page"].max(initial=0), blocks["page"].max(initial=0)), 1 + max(words["block"].max(initial=0), blocks["block"].max(initial=0))
    number = lambda t: (t["doc"].astype(np.int64) * pages + t["page"]) * names + t["block"]
    order = np.lexsort((blocks["position"], blocks["page"], blocks["doc"]))
    b = {k: v[order] for k, v in blocks.items()}
    keys = number(b)
    by_key = np.argsort(keys)
    at = np.searchsorted(keys, number(words), sorter=by_key)
    row = by_key[np.minimum(at, len(keys) - 1)] if len(keys) else np.zeros(len(at), np.int64)
    known = keys[row] == number(words) if len(keys) else np.zeros(len(at), bool)
    w = {k: v[known] for k, v in words.items() if k != "text"} | {"of": row[known]}
    text = words["text"].filter(pa.array(known))
    n = len(w["of"])
    new = changes(w["of"])
    end = np.append(new[1:], True)[:n]
    i = np.arange(n)
    behind = np.minimum(i + 1, max(n - 1, 0))
    hyphen = pc.ends_with(text, "-").to_numpy(zero_copy_only=False).astype(bool)
    open_ = hyphen & ~end & (w["line"][behind] != w["line"])
    feed = ~new & (w["line"] != np.roll(w["line"], 1)) & (w["y0"] - np.roll(w["y1"], 1) > LINE_GAP)
    # the last word before that is not open, in the block
    closed = np.concatenate([[-1], np.maximum.accumulate(np.where(open_, -1, i))])[:n]
    closed = np.maximum(closed, np.maximum.accumulate(np.where(new, i, 0)) - 1)
    head = open_ & ((i - closed) % 2 == 1)
    stays = ~(np.concatenate([[False], head])[:n] & ~new)
    last = text.filter(pa.array(end))
    color = np.where(head & (w["color"] == 0), w["color"][behind], w["color"])[stays]
    some = np.flatnonzero(head)
    closed_text = pc.binary_join_element_wise(pc.utf8_slice_codeunits(text.take(pa.array(some)), 0, -1), text.take(pa.array(some + 1)), "")
    text = pc.replace_with_mask(text, pa.array(head), closed_text).filter(pa.array(stays))
    of, feed = w["of"][stays], feed[stays]
    first = changes(of)
    long = lengths(text)
    inner = before(long + 1, first)

    # blocks with words: how many characters they take, and whether a line feed stands behind
    m = len(keys)
    size = np.bincount(of, long + 1, m).astype(np.int64)
    full = size > 0
    ends = np.zeros(m, bool)
    ends[w["of"][new]] = pc.match_substring_regex(pc.utf8_trim(last, " "), "[:.?]$").to_numpy(zero_copy_only=False).astype(bool)
    new_page = changes(b["doc"], b["page"])
    ahead = np.minimum(np.arange(m) + 1, max(m - 1, 0))
    line = lambda y: np.round(y / 3)
    gap = np.where(b["rotation"] == 90, b["x0"][ahead] - b["x1"], b["y0"][ahead] - b["y1"])
    turned = np.isin(b["rotation"], (90, 270))
    parted = (b["band"][ahead] != b["band"]) | (b["col"][ahead] != b["col"]) | np.where(turned, ends | (gap > BLOCK_GAP), line(b["y0"][ahead]) != line(b["y0"]))
    parted &= ~np.append(new_page[1:], True)[:m]
    # of the last block with words before, on the page
    j = np.arange(m)
    source = np.concatenate([[-1], np.maximum.accumulate(np.where(full, j, -1))])[:m]
    block_feed = (source >= np.maximum.accumulate(np.where(new_page, j, 0))) & parted[source]
    starts = before(size, changes(b["doc"]))

    start = starts[of] + inner
    glue = np.where(start == 0, 0, np.where(np.where(inner == 0, block_feed[of], feed), 2, 1))
    order = np.lexsort((start, b["doc"][of]))
    of, start, color, glue, long = of[order], start[order], color[order], glue[order], long[order]
    pieces = pc.binary_join_element_wise(pa.array(["", " ", "\n"]).take(pa.array(glue)), text.take(pa.array(order)), "")
    return {"doc": b["doc"][of], "page": b["page"][of], "start": start, "end": start + long, "color": color, "text": pieces}


def placed_documents(ids: pa.Array, pieces: dict) -> pa.RecordBatch:
    """A row for each document with words: doc_id, text, and words as structs of start, end, color and page."""
    first = changes(pieces["doc"])
    ends = np.append(np.flatnonzero(first), len(first))
    each = structs(ends, **{c: pieces[c].astype(np.int32) for c in ("start", "end", "color", "page")})
    return pa.RecordBatch.from_arrays([ids.take(pa.array(pieces["doc"][first])), joined(pieces["text"], first), each], names=["doc_id", "text", "words"])


def inside_lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.StructArray]:
    """The row of each struct of a column of lists, and the structs."""
    column = flat(column)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten()


def coloured_sentences(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(doc_id, sentence_id, page, sentence, runs): sentences with a coloured word, numbered by page and place.

    batch: doc_id, words as in placed_documents, sentences as structs of ss, se and
    text, in order and apart.  runs are words of one colour side by side, structs of
    start, end and color, by the sentence's characters; words that leave a sentence don't count.
    """
    doc, found = inside_lists(batch.column("words"))
    ws, we, color, page = (found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end", "color", "page"))
    of, sentences = inside_lists(batch.column("sentences"))
    ss, se = (sentences.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ss", "se"))
    wide = 2 + max(we.max(initial=0), se.max(initial=0))
    at = np.searchsorted(of * wide + ss, doc * wide + ws, "right") - 1
    held = (at >= 0) & (of[at] == doc) & (we <= se[at]) if len(of) else np.zeros(len(at), bool)
    ws, we, color, page, at = ws[held], we[held], color[held], page[held], at[held]
    new = changes(at)
    page = np.repeat(page[new], np.diff(np.flatnonzero(new), append=len(at)))
    begin = np.flatnonzero(changes(at, color))
    end = np.append(begin[1:], len(at))[: len(begin)] - 1
    begin, end = begin[color[begin] > 0], end[color[begin] > 0]
    sentence, page = at[begin], page[begin]
    first = changes(sentence)
    n_runs = np.diff(np.flatnonzero(first), append=len(first))
    start, stop, color = ws[begin] - ss[sentence], we[end] - ss[sentence], color[begin]
    runs = structs(np.append(0, np.cumsum(n_runs)), start=start.astype(np.int32), end=stop.astype(np.int32), color=color.astype(np.int32))
    sentence, page = sentence[first], page[first]
    doc = of[sentence]
    order = np.lexsort((sentence, page, doc))
    number = np.empty(len(order), np.int32)
    new = changes(doc)
    number[order] = 1 + before(np.ones(len(order), np.int64), new)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(page.astype(np.int32)), sentences.field("text").take(pa.array(sentence)), runs],
        names=["doc_id", "sentence_id", "page", "sentence", "runs"],
    )


def found_sentences(documents: DataFrame, schema: str) -> DataFrame:
    """coloured_sentences of rows (doc_id, words, sentences), of a bounded number of words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(sizes, dtype=np.int64) // (RUN // 4)
            cuts = [*np.flatnonzero(changes(part)).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield coloured_sentences(batch.slice(a, b - a))

    return documents.select("doc_id", "words", "sentences").mapInArrow(run, schema)


# --- recognised words ------------------------------------------------------------------------------


def at_strips(t: dict, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and strip of each strip that a rectangle touches."""
    low, high = np.floor_divide(t["y0"], height).astype(np.int64), np.floor_divide(t["y1"], height).astype(np.int64)
    n = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def recognised_colors(words: dict, drawings: dict, share: float = 0.35, height: int = STRIP) -> np.ndarray:
    """The colour of the drawing that covers most of each word, if at least a share of its area; the greater number of equal ones, 0 for none.

    Pairs meet in strips of a height, which has no part in the result; lines' heights are best.
    """
    (w, ws), (d, ds) = at_strips(words, height), at_strips(drawings, height)
    low = min(ws.min(initial=0), ds.min(initial=0))
    wide = 1 + max(ws.max(initial=0), ds.max(initial=0)) - low
    wk, dk = words["doc"][w] * wide + ws - low, drawings["doc"][d] * wide + ds - low
    by_key = np.argsort(dk, kind="stable")
    dk, d = dk[by_key], d[by_key]
    from_, to = np.searchsorted(dk, wk, "left"), np.searchsorted(dk, wk, "right")
    n = to - from_
    pair = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    d, w, ws = d[np.repeat(from_, n) + pair], np.repeat(w, n), np.repeat(ws, n)
    upper = np.maximum(words["y0"][w], drawings["y0"][d])
    across = np.minimum(words["x1"][w], drawings["x1"][d]) - np.maximum(words["x0"][w], drawings["x0"][d])
    hit = (across > 0) & (ws == np.floor_divide(upper, height))  # each pair in one strip only
    w, d, upper, across = w[hit], d[hit], upper[hit], across[hit]
    shared = across * np.maximum(np.minimum(words["y1"][w], drawings["y1"][d]) - upper, 0)
    area = np.maximum(words["x1"] - words["x0"], 0) * np.maximum(words["y1"] - words["y0"], 0)
    hit = (shared > 0) & (shared >= share * area[w])
    w, color, shared = w[hit], drawings["color"][d[hit]], shared[hit]
    order = np.lexsort((color, shared, w))
    out = np.zeros(len(words["doc"]), np.int64)
    out[w[order]] = color[order]  # the last one stays
    return out


@functools.cache
def kinds() -> np.ndarray:
    """The kind of each code point: 0 for white space, 1 for a visible character, 2 for one that joins words, 3 for one of words."""
    points = np.delete(np.arange(sys.maxunicode + 1, dtype="<u4"), np.s_[0xD800:0xE000])
    each = pa.array(list(points.tobytes().decode("utf-32-le")))
    found = lambda pattern: pc.match_substring_regex(each, pattern).to_numpy(zero_copy_only=False)
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    out[points] = np.where(found(r"[\p{L}\p{N}_]"), 3, np.where(found(r"['’\-]"), 2, np.where(found(r"[\p{Z}\s\x0B]"), 0, 1)))
    return out


def tagged(sentences: pa.Array, runs: pa.ListArray, palette: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
    """Tokens of sentences, as by ``layout.token_spans``, and their BIO tags, as by ``layout.span_tags``."""
    whole = "\n".join([*sentences.to_pylist(), ""])  # no token holds a line feed
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    kind = kinds()[points]
    word = kind == 3
    inner = np.zeros(len(word), bool)
    inner[1:-1] = (kind[1:-1] == 2) & word[:-2] & word[2:]
    word |= inner
    alone = ~word & (kind > 0)
    start = np.flatnonzero(alone | (word & ~np.append(False, word[:-1])))
    end = np.flatnonzero(alone | (word & ~np.append(word[1:], False))) + 1
    # each sentence's place among all characters, and its number of tokens
    size = lengths(sentences) + 1
    at = np.cumsum(size) - size
    ends = np.append(0, np.searchsorted(start, at + size))
    of_run, run = inside_lists(runs)
    first, last, color = (run.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end", "color"))
    k = np.searchsorted(at[of_run] + first, start, "right") - 1
    held = (k >= 0) & (end <= (at[of_run] + last)[k]) if len(color) else np.zeros(len(start), bool)
    k = np.where(held, k, -1)
    go_on = held & (k == np.append(-1, k[:-1]))
    names = ["O", *[prefix + c for c in palette for prefix in ("B-", "I-")]]
    tag = np.where(held, 2 * color[k] - 1 + go_on, 0) if len(color) else np.zeros(len(start), np.int64)
    # bytes of the tokens alone
    width = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
    text = np.frombuffer(whole.encode(), np.uint8)[np.repeat(word | alone, width)]
    places = np.append(0, np.cumsum(width))
    offsets = np.append(0, np.cumsum(places[end] - places[start])).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text)))
    ends = pa.array(ends.astype(np.int32))
    return pa.ListArray.from_arrays(ends, tokens), pa.ListArray.from_arrays(ends, pa.array(names).take(pa.array(tag)))


def with_tags(found: pa.RecordBatch, palette: list[str]) -> pa.RecordBatch:
    """Adds tokens and ner_tags to recognised sentences."""
    made = tagged(found.column("sentence"), found.column("runs"), palette)
    return pa.RecordBatch.from_arrays([*found.columns, *made], names=[*found.schema.names, "tokens", "ner_tags"])


def recognised_sentences(ids: pa.Array, words: dict) -> pa.RecordBatch:
    """(doc_id, sentence_id, sentence, runs): paragraphs and table cells with a coloured word, in order of place.

    words: doc, block, paragraph, line, word, x0, y0, color, cell (-1 for none) and
    text; groups, their order and numbers are those of ``layout.recognised_records``.
    """
    celled = words["cell"] >= 0
    group = (celled.astype(np.int64), np.where(celled, words["cell"], words["block"]), np.where(celled, 0, words["paragraph"]))
    order = np.lexsort((words["x0"], words["word"], words["line"], *group[::-1], words["doc"]))
    w = {k: v[order] for k, v in words.items() if k != "text"}
    text = words["text"].take(pa.array(order))
    new = changes(w["doc"], *(g[order] for g in group))
    long = lengths(text)
    glue = np.where(new, 0, np.where(w["line"] != np.roll(w["line"], 1), 2, 1))
    size = long + (glue > 0)
    end = before(size, new) + size
    pieces = pc.binary_join_element_wise(pa.array(["", " ", "\n"]).take(pa.array(glue)), text, "")
    number = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    begin = np.flatnonzero(changes(number, w["color"]))
    stop = np.append(begin[1:], len(number))[: len(begin)] - 1
    begin, stop = begin[w["color"][begin] > 0], stop[w["color"][begin] > 0]
    kept, n_runs = np.unique(number[begin], return_counts=True)
    runs = structs(np.append(0, np.cumsum(n_runs)), start=(end[begin] - long[begin]).astype(np.int32), end=end[stop].astype(np.int32), color=w["color"][begin].astype(np.int32))
    least = lambda c: np.minimum.reduceat(w[c], first)[kept] if len(first) else np.empty(0, np.int64)
    doc = w["doc"][first][kept]
    place = np.lexsort((least("word"), least("x0"), least("y0"), doc))
    ids_of = np.empty(len(place), np.int32)
    ids_of[place] = 1 + before(np.ones(len(place), np.int64), changes(doc))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(ids_of, pa.int32()), joined(pieces, new).take(pa.array(kept)), runs], names=["doc_id", "sentence_id", "sentence", "runs"])

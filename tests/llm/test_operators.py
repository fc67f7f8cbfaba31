"""The ten operators against brute force, SQL or the library, with nulls, ties, empty tables and odd columns."""

import hashlib
import html
import json
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from spanforge.llm import chat, decontamination, html_extract, licenses, lm_scoring, near_duplicates, packing, quality, substring_dedup, token_counts
from spanforge.llm.common import LOWER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
D = "/root/testdata/sf0.001"


def words(text, lower=False):
    data = (text or "").encode()
    return (data.translate(LOWER) if lower else data).split()


@pytest.fixture(scope="module")
def rows():
    """Random documents with copies, near copies, shared passages, and edge cases."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(250)] + ["The", "the", "é", "x,", "<|endoftext|>"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [some(n) for n in (15, 20, 25, 60)]
    bases = [some(rng.choice([3, 9, 30, 90, 200])) for _ in range(12)]
    out = []
    for i in range(160):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            text += rng.choice(passages) + some(5)
        if rng.random() < 0.05:
            text += ["again"] * 45
        out.append((i * 7 % 163, rng.choice([" ", "\n", "  "]).join(text)))
    out += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), out[3], out[3], (905, "long " * 3000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], SCHEMA).withColumn("n", F.lit("clash")).withColumn("word", F.lit(1)).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# --- near duplicates ---------------------------------------------------------------------


def shingles_plain(text, k):
    w = words(text, lower=True)
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components_plain(rows, k, num, den):
    sets, parent = [], {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in rows:
        sets.append((i, shingles_plain(t, k)))
        parent.setdefault(i, i)
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(s), root(i)) for i, s in sets)


@pytest.mark.parametrize("k, num, block", [(4, 85, 2048), (5, 80, 4)])
def test_near_duplicates(docs, rows, k, num, block, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_SETS", block)
    got = sorted(map(tuple, near_duplicates.near_duplicates(docs, k, num, 100).collect()))
    assert got == components_plain(rows, k, num, 100)


def test_keep_one(docs, rows, empty):
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in components_plain(rows, 5, 80, 100)})
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_every_link(docs, rows, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_SETS", 7)
    pairs, members = near_duplicates.links(docs, 4, 85, 100)
    texts = dict(rows)
    of = {r.doc_id: r["class"] for r in members.collect()}
    got = {frozenset((r.a, r.b)) for r in pairs.collect()}
    sets = {c: shingles_plain(texts[d], 4) for d, c in of.items() if c is not None}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert got == want and want


def test_two_texts_under_one_id(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(5, a), (5, b), (7, a + " z"), (9, b + " z"), (9, b + " z"), (3, "c " * 9)], "doc_id long, text string")
    got = near_duplicates.near_duplicates(df, 5, 80, 100).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 5), (5, 5), (7, 5), (9, 5), (9, 5)]
    assert sorted((r.doc_id, r.text) for r in near_duplicates.keep_one(df).collect()) == sorted([(3, "c " * 9), (5, a), (5, b)])
    clash = df.selectExpr("doc_id", "text", "'x' as mark", "1 as node", "2 as place")
    assert near_duplicates.keep_one(clash).columns == clash.columns and near_duplicates.keep_one(clash).count() == 3


def test_rows_without_id_are_kept(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "en", "s", 1), (5, "a b c d e f", "en", "s", 1), (None, None, None, None, None)], SCHEMA)
    assert near_duplicates.keep_one(df).count() == 3
    assert sorted((r.doc_id or 0, r.component_id) for r in near_duplicates.near_duplicates(df).filter("n_shingles > 0").collect()) == [(0, 5), (5, 5)]
    assert substring_dedup.remove_repeats(df).count() == 3
    assert lm_scoring.score(df).count() == 3 and packing.pack(df).count() == 3


# --- repeated passages -------------------------------------------------------------------


def repeats_plain(rows, window=20):
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, (i, j)), (i, j))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {j + x for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] != (i, j) for x in range(window)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [2000, 4])
def test_substring_dedup(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect())) == repeats_plain(rows)


def test_index_finds_what_is_there():
    import numpy as np

    from spanforge.llm.fm_index import FmIndex

    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 400)
    index = FmIndex(text, 6)
    for n in range(1, 8):
        for at in range(0, 390, 7):
            pattern = text[at : at + n]
            if (pattern > 0).all():
                lo, hi = index.find(pattern)
                assert hi - lo == sum((text[j : j + n] == pattern).all() for j in range(len(text) - n + 1))
    assert index.find(np.array([9])) == (0, 0)


def test_repeats_of_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (4, b), (4, b), (None, a), (6, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert got == [(0, 30, 0), (1, 30, 0), (2, 30, 0), (2, 30, 30), (4, 30, 30), (4, 30, 30), (6, 0, 0)]
    clash = df.selectExpr("doc_id", "text", "'x' as spans", "1 as segs", "2 as mark", "array(3) as rest")
    out = substring_dedup.drop_repeats(clash)
    assert out.columns == clash.columns and {tuple(r[2:5]) for r in out.collect()} == {("x", 1, 2)}
    with pytest.raises(TypeError):
        substring_dedup.remove_repeats(df.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_drop_repeats_keeps_other_text(docs, rows, empty):
    out = substring_dedup.drop_repeats(docs)
    assert out.columns == docs.columns and substring_dedup.drop_repeats(empty).count() == 0
    want = {i: (n, g) for i, n, g, _ in repeats_plain(rows)}
    for r in out.collect():
        n, gone = want[r.doc_id]
        assert len(words(r.text)) == n - gone
        assert gone == 0 or r.n_chars == len(r.text)
    dropped = {i for i, _ in rows} - {r.doc_id for r in out.collect()}
    assert dropped == {i for i, (n, g) in want.items() if g and n == g}


# --- decontamination -----------------------------------------------------------------------


def hits_plain(rows, items, window):
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    known = {}
    for name, t in items:
        w = split(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            known.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in known}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in known:
                    hit |= set(range(j, j + n))
                    found |= known[tuple(w[j : j + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_decontamination(spark, docs, rows, empty, block, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontamination.Benchmark.__init__, "__defaults__", (block,))
    some = [t for _, t in rows if t and len(t.split()) > 20][:4]
    items = [(1, " ".join(some[0].split()[3:18])), (2, some[1].upper()), (3, None), (4, "..."), (5, "one"), (6, "w1 w2"), (7, " ".join(some[0].split()[3:18]))]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs, df).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = hits_plain(rows, items, 10)
    assert sorted(map(tuple, got.collect())) == want
    clean = decontamination.decontaminate(docs, df)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted(w[0] for w in want if not w[5])
    assert decontamination.contamination(empty, df).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(docs, df.limit(0)).collect())


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "z a b c d e f z")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "q a b c d e f q")], "item_id long, text string")
    row = decontamination.contamination(docs, items, 3).first()
    assert (row.longest, row.n_hit, [(s.start, s.end) for s in row.spans]) == (6, 6, [(1, 7)])


# --- packing, token counts -------------------------------------------------------------------


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = packing.pack(docs, size=256, with_ids=True).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in rows:
        want[i, tuple([*t.encode(text or "", add_special_tokens=False).ids, 1])] += 1
    pieces = {}
    for r in got:
        assert len(r.ids) == r.length <= 256 and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    found = Counter()
    for (i, n), some in pieces.items():
        copies = sum(r.start == 0 for r in some)
        by_start = {}
        for r in some:
            by_start.setdefault(r.start, []).append(tuple(r.ids))
        assert all(len(x) == copies and len(set(x)) == 1 for x in by_start.values())
        found[i, tuple(x for s in sorted(by_start) for x in by_start[s][0])] += copies
    assert found == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in sequences.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r.length for r in got) / (256 * len(sequences)) > 0.9
    assert packing.pack(empty).count() == 0


def test_shortest_pack_first():
    rng = random.Random(3)
    histogram = Counter(min(100, int(rng.lognormvariate(3, 1)) + 1) for _ in range(5000))
    patterns = packing.shortest_pack_first(dict(histogram), 100)
    placed = Counter()
    for count, lengths in patterns:
        assert sum(lengths) <= 100
        for n in lengths:
            placed[n] += count
    assert placed == histogram and packing.shortest_pack_first({}, 100) == []


def test_word_bpe_is_the_library():
    import public_tokenizers

    bpe = packing.WordBpe.of(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    texts = ["", "a<|endoftext|>b", "Don't It'S 12ab", "É ß ÿ × œ Ωσς İ", "x　y é", "\x00\x7f \x85", "naïve café"]
    texts += ["".join(rng.choice("aB'sTé ×!9Ñ÷.\n\xa0ſK") for _ in range(25)) for _ in range(300)]
    assert all(bpe.ids(t.encode()) == bpe.library(t) for t in texts)


def test_token_counts(docs, rows, empty):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted(map(tuple, token_counts.count_tokens(docs, limit=100).collect()))
    size = lambda t: len(model.encode(t or ""))
    assert got == sorted((i, len((t or "").encode()), size(t), size(t) > 100) for i, t in rows)
    assert token_counts.count_tokens(empty).count() == 0
    vocabulary = token_counts.Vocabulary.of(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    texts = ["".join(rng.choice([" ", "\n", "a", "the", "▁", "é", "\t", ".", "<s>", "😀", "  "]) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    assert vocabulary.counts(texts) == [len(model.encode(t)) for t in texts]


# --- language model ----------------------------------------------------------------------------


def test_lm_scoring(docs, rows, empty):
    got = sorted(lm_scoring.score(docs, head=40).collect(), key=lambda r: (r.doc_id, r.score))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: [*words(t, lower=True), b"\n"]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        w = tokens(t)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held(i), len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9, abs_tol=1e-9)
        assert r.score < 0
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm_scoring.score(empty).count() == 0


def plain_scores(rows, head):
    """log10 probabilities of texts, one bit at a time: the definition of the model without hashing or arrays."""
    import heapq

    import numpy as np

    tokens = lambda t: [*words(t, lower=True), b"\n"]
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in t)
    top = sorted(c, key=lambda w: (-c[w], w))[:head]
    rest = sum(c.values()) - sum(c[w] for w in top)
    heap = [(c[w], i, w) for i, w in enumerate(top)] + [(max(1, rest), len(top), None)]
    heapq.heapify(heap)
    number, start_odds, paths = len(heap), {}, {w: [] for w in [*top, None]}
    below = {i: [w] for i, w in enumerate([*top, None])}
    while len(heap) > 1:
        (a, i, _), (b, j, _) = heapq.heappop(heap), heapq.heappop(heap)
        start_odds[number] = math.log((b + 0.4) / (a + 0.4))
        for bit, side in ((0, i), (1, j)):
            for w in below[side]:
                paths[w].insert(0, (number, bit))
        below[number] = below[i] + below[j]
        heapq.heappush(heap, (a + b, number, None))
        number += 1

    def bits(text):
        """(node, bit, depth, the two contexts) of each decision."""
        known = [w if w in paths else None for w in text]
        for k, w in enumerate(known):
            one = known[k - 1] if k > 0 else "start"
            two = known[k - 2] if k > 1 else "start"
            yield from ((node, bit, min(depth, 7), ((node, one), (node, one, two))) for depth, (node, bit) in enumerate(paths[w]))

    counts = {}
    for t in train:
        for _, bit, _, contexts in bits(t):
            for key in contexts:
                counts.setdefault(key, [0, 0])[bit] += 1

    level = lambda n: (n > 0) + (n > 2) + (n > 14)
    odds = lambda z, o: math.log(o + 0.4) - math.log(z + 0.4)

    def inputs(text, own):
        """Log-odds, gate, depth and bit of each decision; own: what a decision itself has added to the counters."""
        seen = {}
        for node, bit, depth, contexts in bits(text):
            x, gate = [start_odds[node]], 0
            for key in contexts:
                z, o = counts.get(key, (0, 0))
                z, o = (z - own * (bit == 0), o - own * bit)
                x.append(odds(z, o) if own else round(odds(z, o) * 8191 / 12) * 12 / 8191)
                gate = gate * 4 + level(z + o)
            z, o = seen.setdefault(node, [0, 0])
            x += [odds(z, o), 0.3]
            yield np.array(x), (gate * 2 + (z + o > 2)) * 8 + depth, depth, bit
            seen[node][bit] += 1

    squash = lambda s: 1 / (1 + math.exp(-s))
    start = np.array([0.3, 0.4, 0.2, 0.15, 0.0])
    flat = np.array([[squash(-8 + i / 2) for i in range(33)]] * 8)
    slope, bend = {}, {}
    hit, ones = np.zeros((8, 33)), np.zeros((8, 33))

    def place(s):
        at = (min(8, max(-8, s)) + 8) * 2
        low = min(int(at), 31)
        return low, at - low

    for t in train:
        for x, gate, depth, bit in inputs(t, 1):
            s = min(14, max(-14, float(x @ start)))
            p = squash(s)
            slope[gate] = slope.get(gate, 0) + x * (bit - p)
            bend[gate] = bend.get(gate, 0) + np.outer(x, x) * p * (1 - p)
            low, up = place(s)
            for cell, share in ((low, 1 - up), (low + 1, up)):
                hit[depth, cell] += share
                ones[depth, cell] += share * bit
    fitted = {g: start + np.clip(np.linalg.solve(bend[g] + 8 * np.eye(5), slope[g]), -0.5, 0.5) for g in slope}
    flat = (ones + 30 * flat) / (hit + 30)

    out = []
    for _, text in rows:
        weights, maps, total = dict(fitted), flat.copy(), 0.0
        each = list(inputs(tokens(text), 0))
        for at in range(0, len(each), 1024):
            change, often, hit, ones = {}, Counter(), np.zeros((8, 33)), np.zeros((8, 33))
            for x, gate, depth, bit in each[at : at + 1024]:
                s = min(14, max(-14, float(x @ weights.get(gate, start))))
                low, up = place(s)
                p = 0.5 * (squash(s) + maps[depth, low] * (1 - up) + maps[depth, low + 1] * up)
                p = min(1 - 1e-6, max(1e-6, p))
                total += math.log10(p if bit else 1 - p)
                change[gate] = change.get(gate, 0) + (bit - squash(s)) * x
                often[gate] += 1
                for cell, share in ((low, 1 - up), (low + 1, up)):
                    hit[depth, cell] += share
                    ones[depth, cell] += share * bit
            for g in change:
                weights[g] = weights.get(g, start) + 0.005 * change[g] / math.sqrt(often[g])
            maps += (ones - hit * maps) / (hit + 255)
        for w in tokens(text):
            if w not in paths:
                total += math.log10((c[w] + 0.5) / (rest + 0.5 * (len(c) - len(top) + 1)))
        out.append(total)
    return out


def test_scores_equal_a_plain_model(spark):
    rng = random.Random(5)
    parts = ["the cat sat on the mat .", "a dog saw the cat .", "The bird sang", "rain rain rain", "odd%d word%d", "on the mat a dog sat"]
    text = lambda n: " ".join(p % (rng.randrange(40), rng.randrange(40)) if "%" in p else p for p in rng.choices(parts, k=n))
    rows = [(i, text(rng.choice([1, 3, 20, 60]))) for i in range(30)] + [(30, ""), (31, None), (32, text(1_500)), (33, text(900))]
    rows += [(34, "never seen words never"), (1, rows[1][1]), (35, "the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.score) for r in lm_scoring.score(df.repartition(3), head=20, table_bits=22).collect())
    want = sorted(zip((i for i, _ in rows), plain_scores(rows, 20), strict=True))
    for (i, a), (j, b) in zip(got, want, strict=True):
        assert i == j and math.isclose(a, b, rel_tol=1e-3, abs_tol=1e-3), (i, a, b)


def test_code_probabilities_sum_to_one():
    import numpy as np

    rng = np.random.default_rng(0)
    code = lm_scoring.Code([b"a", b"b", b"c", b"\n"], np.array([5, 3, 2, 4, 1]))
    tables = [lm_scoring.compact(rng.integers(0, 9, (1 << 12, 2)).astype(np.uint16)) for _ in range(2)]
    mixer = lm_scoring.Mixer()
    before = np.array([0, 1, 0])
    total = 0.0
    for symbol in range(5):
        one = lm_scoring.log_probabilities(code, tables, mixer, np.append(before, symbol), np.zeros(4, np.int64), 12)[0]
        total += math.exp(one - lm_scoring.log_probabilities(code, tables, mixer, before, np.zeros(3, np.int64), 12)[0])
    assert abs(total - 1) < 1e-4


def test_mixer_is_fitted_on_all_training_texts(spark, monkeypatch):
    import numpy as np

    made, plain = [], lm_scoring.fit
    monkeypatch.setattr(lm_scoring, "fit", lambda *a: made.append(plain(*a)) or made[-1])
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd"]) for _ in range(12_000)) for _ in range(6)]  # all longer than 20,000 bytes
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 3):
        lm_scoring.score(df.repartition(parts)).collect()
    assert np.abs(made[0].weights - lm_scoring.Mixer().weights).max() > 0.01
    assert np.allclose(made[0].weights, made[1].weights, atol=1e-4) and np.allclose(made[0].maps, made[1].maps, atol=1e-4)


def test_documents_go_on_learning_by_themselves(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    code = lm_scoring.Code([b"a", b"b", b"c", b"\n"], np.array([5, 3, 2, 4, 1]))
    tables = [lm_scoring.compact(rng.integers(0, 900, (1 << 12, 2)).astype(np.uint16)) for _ in range(2)]
    docs = [rng.integers(0, 3, n) for n in (9_000, 40, 5_000, 0, 700)]
    run = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    scores = lambda *r: lm_scoring.log_probabilities(code, tables, lm_scoring.Mixer(), *r, 12)
    got = scores(*run)
    for d, one in zip(docs, got, strict=True):
        assert not len(d) or math.isclose(scores(d, np.zeros(len(d), np.int64))[0], one, rel_tol=1e-6)
    monkeypatch.setattr(lm_scoring, "RATE", 0.0, raising=False)
    monkeypatch.setattr(lm_scoring, "MAP_PRIOR", 1e18, raising=False)
    frozen = scores(*run)
    assert got[0] > frozen[0] + 10 and got[2] > frozen[2] + 10


def test_texts_are_cut_into_words_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(i, "a b a c " * i) for i in range(40)], "doc_id long, text string")
    assert lm_scoring.score(df.mapInArrow(watched, df.schema), head=20).count() == 40
    assert read.value <= 2 * 40


def test_symbols_are_those_of_words():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    texts = [bytes(rng.choice(b" \t\n\x0b\x0c\rABab\x1c\x85\xa0\xc3\xff\x00") for _ in range(rng.randint(0, 30))) for _ in range(500)] + [b"", b" ", b"x" * 90]
    want = [[*t.lower().split(), b"\n"] for t in texts]
    for head in ([b"a", b"b", b"ab", b"\n"], [b"a", b"\xc3"], []):  # with and without the end
        code = lm_scoring.Code(head, np.ones(len(head) + 1, np.int64))
        made = lm_scoring.encoded(pa.array(texts, pa.binary()), code)
        at = {w: i for i, w in enumerate(head)}
        symbols, sizes = lm_scoring.unpacked(pa.RecordBatch.from_pydict(made).slice(3))
        assert symbols.tolist() == [at.get(w, len(head)) for t in want[3:] for w in t] and sizes.tolist() == [len(t) for t in want[3:]]
        assert [{p["word"]: p["n"] for p in t} for t in made["tail"].to_pylist()] == [Counter(w for w in t if w not in at) for t in want]
        assert made["n_known"].to_pylist() == [sum(w in at for w in t) for t in want]
    symbols, sizes = np.array([65_536, 0, 65_535, 70_000]), np.array([1, 0, 3])
    low, high = lm_scoring.packed(symbols, sizes)
    back = lm_scoring.unpacked(pa.RecordBatch.from_arrays([low, high], names=["low", "high"]))
    assert back[0].tolist() == symbols.tolist() and back[1].tolist() == sizes.tolist()


# --- quality, licences, chat -------------------------------------------------------------------


def same_as_sql(spark, df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(f"{name}_arrow", t.toArrow())
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM {name}_arrow")
    want = con.sql(sql)
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    got = df.select(*names).toPandas().astype(object)
    rows = sorted(map(repr, got.itertuples(index=False, name=None)))
    return rows, sorted(map(repr, con.sql(f"SELECT {', '.join(names)} FROM ({sql})").df().astype(object).itertuples(index=False, name=None)))


def test_quality(spark, docs, empty):
    entries = quality.ledger(docs, "doc_id")
    got, want = same_as_sql(spark, quality.verdicts(entries), quality.ORACLE, documents=docs)
    assert got == want
    kept = quality.keep_clean(docs)
    assert kept.columns == docs.columns and kept.count() == quality.verdicts(entries).filter("kept").count()
    assert quality.keep_clean(empty).count() == quality.ledger(empty).count() == 0
    verdicts = quality.verdicts(entries).collect()
    for r in quality.ablation(entries).collect():
        bit = 1 << quality.RULES.index(r.rule)
        assert r.n_kept == sum(v.fail_bits == 0 for v in verdicts) and r.n_kept_without == sum(v.fail_bits & ~bit == 0 for v in verdicts)
        assert r.n_failed == sum(bool(v.fail_bits & bit) for v in verdicts) and r.n_only == sum(v.fail_bits == bit for v in verdicts)


def test_quality_repeats(spark):
    text = "a b c x a b c y a b c d a b"
    df = spark.createDataFrame([(1, text), (2, "a a a a a"), (3, "l one\nl one\n\nl two\nl one")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.ledger(df, "doc_id").collect()}
    assert got[1].n_repeat_words == 9 and got[2].n_repeat_words == 5 and (got[3].n_dup_lines, got[3].n_lines) == (2, 4)


def test_licenses(spark, empty):
    texts = [
        "x\nReleased under the MIT License.\n",
        "Foo. Licensed under CC BY-NC 4.0. Bar",
        'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed\nunder the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR\nCONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and limitations\nunder the License.',
        "We mention the MIT License here.",
        "Licensed under the MIT License. Licensed under the Apache License, Version 2.0.",
        "",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("rules", F.lit("clash"))
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[i].licenses for i in range(7)] == ["MIT", "CC-BY-NC-4.0", "Apache-2.0", "", "MIT OR Apache-2.0", "", ""]
    assert "apache-2.0.notice" in got[2].rules
    a, b = same_as_sql(spark, licenses.scan(df), licenses.oracle(), documents=df)
    assert a == b and licenses.scan(empty).count() == 0


def test_every_known_sentence_and_rule_is_found(spark):
    texts = [*licenses.SENTENCES.values(), *("Some words.\n" + ". ".join(licenses.SENTENCES[i] for i in ids) + ".\nMore" for _, _, ids in licenses.RULES)]
    texts += ["SPDX-License-Identifier:\n\nMIT", "SPDX-License-Identifier: MIT. Other", licenses.SENTENCES["gpl2.free"].replace(" ", "\n", 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.sentence_ids, r.rules.split(","), r.licenses) for r in licenses.scan(df).orderBy("doc_id").collect()]
    n = len(licenses.SENTENCES)
    assert [g[0] for g in got[:n]] == list(licenses.SENTENCES)
    assert [g[0] for g in got[n:-3]] == [",".join(ids) for _, _, ids in licenses.RULES]
    assert all(name in g[1] for g, (name, _, _) in zip(got[n:-3], licenses.RULES, strict=True))
    assert [g[2] for g in got[-3:]] == ["", "MIT", "GPL-2.0-or-later"]


def test_chat(spark):
    call = lambda **c: f"<tool_call>{json.dumps(c)}</tool_call>"
    rows = [
        (1, 0, "user", 'hi é "q"'),
        (1, 1, "assistant", "ok " + call(name="search", id="a", arguments={"query": "x", "limit": 3}) + call(name="search", id="b", arguments={"limit": "3"})),
        (1, 2, "tool", '{"tool_call_id":"b","content":"B"}'),
        (1, 3, "tool", '{"content":"A","tool_call_id":"a"}'),
        (1, 4, "tool", '{"tool_call_id":"zz","content":"?"}'),
        (2, 0, "tool", '{"tool_call_id":"c","content":"early"}'),
        (2, 1, "assistant", call(name="fetch", id="c", arguments={"url": "u", "headers": {"z": 1, "a": [1, 2]}})),
        (2, 2, None, None),
        (3, 0, "assistant", "<tool_call>not json</tool_call>"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    got = chat.format_chat(df).orderBy("conv_id", "order_turn", "order_step", "turn").collect()
    assert [(r.conv_id, r.turn, r.kind) for r in got] == [(1, 0, "message"), (1, 1, "call"), (1, 3, "result"), (1, 2, "result"), (1, 4, "orphan"), (2, 1, "call"), (2, 0, "result"), (2, 2, "message"), (3, 0, "message")]
    assert [r.n_valid for r in got] == [0, 1, 1, 0, 0, 1, 1, 0, 0]
    assert got[5].json == '{"content":"","role":"assistant","tool_calls":[{"arguments":{"headers":{"a":[1,2],"z":1},"url":"u"},"id":"c","name":"fetch"}]}'
    assert all(json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json for r in got)
    assert chat.format_chat(df.limit(0)).count() == 0


# --- pages -------------------------------------------------------------------------------------


def test_pages(spark):
    pages = spark.read.parquet(f"{D}/pages.parquet")

    def plain(source):
        article = source.split("<article>")[1].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article).replace("<br>", " "))
        blocks = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in parts]
        return "\n\n".join(b for b in blocks if b)

    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(plain(r.html)) and got[r.page_id].url == r.url
    odd = spark.createDataFrame([(1, None, None), (2, "x", ""), (3, "http://u@H:80/x", "<p>a"), (3, "http://u@H:80/x", "<p>a")], "page_id long, url string, html string").withColumn("path", F.lit("clash"))
    assert sorted((r.page_id, r.text) for r in html_extract.extract(odd).collect()) == [(1, ""), (2, ""), (3, "a"), (3, "a")]
    assert html_extract.extract(odd.limit(0)).count() == 0


def test_page_structure():
    source = """<html><body><div id="header">H</div><div class="wrap with-sidebar"><div class="nav-menu">m</div><div class="post-content"><h1>T &lt;x&gt;&nbsp;y</h1>
    <p>One<b>two</b> three<p>four<ul><li>a<li>b <i>c</i></ul><table><tr><td>1<td>2</table><div class="comments"><p>bad comment text that is long</div></div><aside>s</aside>
    <form>f<input></form></div><footer>z</body></html>"""
    page = html_extract.Page(source)
    assert page.text(None) == "T <x> y\n\nOnetwo three\n\nfour\n\na\n\nb c\n\n1\n\n2"
    assert page.path(page.best()).endswith("div.post-content")
    # the host's path decides over the page's own best container
    other = html_extract.Page("<body><div class='a'><p>short</div><div class='b'><p>much longer text than the other one</div></body>")
    assert other.text("body>div.a") == "short"
    for text in ("", "<", "<p", "a<b", "<script>", "&#65;", "<!-- x", "<a href='x>y'>t</a>"):
        html_extract.Page(text).text(None)


def test_attributes_are_read_by_name():
    text = lambda inner: html_extract.Page(f"<body><div>{inner}<p>{'Words of the article. ' * 9}</p></div></body>").text(None)
    for kept in ('<p title="The hidden valley">Kept</p>', '<p>See <a href="/hidden-valley">Kept</a></p>', '<p><a href="/p?id=nav">Kept</a></p>', "<div data-hidden=x data-id=nav>Kept</div>", '<p title="a" data-class="sidebar">Kept</p>', "<p alt='style=display:none'>Kept</p>"):
        assert "Kept" in text(kept), kept
    for left in ('<div id="sidebar" data-video="x">Gone</div>', '<div id=sidebar width="5">Gone</div>', "<p hidden>Gone</p>", "<p data-a=1 HIDDEN=''>Gone</p>", "<p style='display: none'>Gone</p>", '<p data-x="y" aria-hidden = "true">Gone</p>', '<div class="ads" class="x">Gone</div>'):
        assert "Gone" not in text(left), left


def test_forms_prose_and_many_open_elements():
    import time

    prose = " ".join(f"word{i}" for i in range(60))
    page = lambda x: html_extract.Page(x).text(None)
    assert page(f"<body><form><nav>Menu</nav><article><p>{prose}</p><p class='social'>And this.</p></article><label>Name</label></form></body>") == f"{prose}\n\nAnd this."
    assert page(f"<body><article><p>{prose}</p></article><form>Sign up <p>now</p></form></body>") == prose
    assert page(f"<body><article><p>{prose}</p><div class='social'>Share</div></article></body>") == prose
    start = time.process_time()
    assert page("<p>" + "<b>" * 40_000 + "x" + "<i>" * 40_000 + "y" + "</b>" * 40_000) == "xy"
    page("<div>" * 20_000 + "x" + "</p></span>" * 20_000)
    assert time.process_time() - start < 8


def test_votes_decide_between_containers(spark):
    """Most pages of a host have their text in one container; a page whose comments are longer follows them."""
    body = lambda text, other: f"<body><div class='story'><p>{text}</p></div><div class='extra'><p>{other}</p></div></body>"
    long = lambda i, n: " ".join(f"t{i}x{j}" for j in range(n))
    rows = [(i, "http://a.org/x", body(long(i, 80), "short")) for i in range(5)] + [(9, "http://a.org/y", body(long(9, 10), long(8, 90)))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == long(9, 10) and got[0] == long(0, 80)

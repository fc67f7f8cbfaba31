"""Filter audit, whitening and sentence pieces against brute force, exact numbers and the library."""

import hashlib
import itertools
import json
import random
import re
import time
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanforge.llm import chat, filter_audit, html_extract, near_duplicates, sentence_pieces, whitening
from tests.llm.test_operators import components_plain

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


# --- filter audit --------------------------------------------------------------------------


def audit_plain(rows, labels):
    """Applies every order of filters to the documents themselves."""
    texts = [t or "" for _, t, _ in rows]
    fails = []
    for (i, _, _), t in zip(rows, texts, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and u == t for (j, _, _), u in zip(rows, texts, strict=True))
        fails.append({x for x, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t), copy)) if bad})
    flagged = lambda k: {x[0] for x in labels if x[k] == 1 and x[0] is not None}
    good, toxic = flagged(1), flagged(2)
    out = {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(i, f) for (i, _, p), f in zip(rows, fails, strict=True) if (p or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(gone)
                failing = [f for _, f in mine if x in f]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(f == {x} for f in failing), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


@pytest.fixture(scope="module")
def audit_rows():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "é", "a#b", "GAMMA", "x" * 9]
    texts = [" ".join(rng.choice(words[: rng.choice([2, 4, 7])]) for _ in range(rng.choice([3, 199, 200, 260]))) for _ in range(30)]
    long = "".join(rng.choice("ab c") for _ in range(80_000))  # differs in its fourth block alone
    texts += [long, long[:-1] + "z", "y" + long[1:], long, "", None, "q" * 300, "q" * 299 + "r", "r" + "q" * 299]
    rows = [(i * 17 % 401, rng.choice(texts), rng.choice(["en", "de", None, "only"][:3])) for i in range(180)]
    rows += [(500 + i, t, "en") for i, t in enumerate(texts)] + [(3, texts[0], "en"), (3, texts[0], "en"), (None, texts[0], "fr"), (None, "lone", "fr"), (700, "lone", "")]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in rows[::2]] + [(9999, 1, 1), (None, 1, 1)]
    return rows, labels


def test_audit_equals_brute_force(spark, audit_rows):
    rows, labels = audit_rows
    docs = spark.createDataFrame([(i, t, p, "s", 1) for i, t, p in rows], SCHEMA).repartition(3)
    docs = docs.withColumns({c: F.lit(1) for c in ("part", "mask", "n", "least", "b0")})  # clashing names
    got = audited(filter_audit.audit(docs, spark.createDataFrame(labels, LABELS).withColumn("lang", F.lit("x"))))
    assert got == audit_plain(rows, labels)
    assert len(got) == 600 * 4


def test_audit_survives_collisions_and_shuffled_lookups(spark, audit_rows, monkeypatch):
    rows, labels = audit_rows
    docs = spark.createDataFrame([(i, t, p, "s", 1) for i, t, p in rows], SCHEMA)
    monkeypatch.setattr(filter_audit, "BROADCAST", 0)
    monkeypatch.setattr(filter_audit, "block_hash", lambda text, k: F.when(F.length(text) > filter_audit.BLOCKS[k][0], F.lit(7)))
    assert audited(filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))) == audit_plain(rows, labels)


def test_refinement_drops_what_is_alone(spark, audit_rows):
    rows, _ = audit_rows
    text = F.col("text")
    docs = spark.createDataFrame([(i, t or "") for i, t, _ in rows], "doc_id long, text string")
    measured = docs.select("*", F.length(text).alias("n_chars"), *[filter_audit.block_hash(text, k).alias(f"b{k}") for k in range(len(filter_audit.BLOCKS))])
    scratch = filter_audit.Scratch(spark, "test")
    left = sorted((r.text for r in filter_audit.repeated_parts(scratch, measured).collect()))
    texts = [t or "" for _, t, _ in rows]
    assert left == sorted(t for t in texts if texts.count(t) > 1)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    one = audited(filter_audit.audit(spark.createDataFrame([(1, None, None, None, None)], SCHEMA), labels))
    assert one == audit_plain([(1, None, None)], [])


def test_audit_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = filter_audit.audit(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")).toArrow()
    names = got.column_names
    want = con.sql(f"SELECT {', '.join(names)} FROM ({filter_audit.ORACLE})").to_arrow_table()
    rows = lambda t: sorted(zip(*[t.column(c).to_pylist() for c in names], strict=True))
    assert rows(got) == rows(want)


# --- whitening -----------------------------------------------------------------------------


def whitened_plain(vectors, most=8):
    """Exact sums by Python's whole numbers, eigenvectors of the exactly divided covariance."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    centred = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    deviation = [sum(c * c for c in r) for r in centred]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    z = (np.array(centred, float) / n) @ axes[:, :most] / np.sqrt(values[:most])
    return deviation, z, values / np.trace(cov)


def test_whitening_equals_exact_numbers(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12) - 40).astype(np.float32)
    odd = [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, [1.0] * 7), (905, []), (906, [1e30] * 12)]
    rows = [(i % 290, v.tolist()) for i, v in enumerate(vectors)] + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).withColumn("key", F.lit(2)).repartition(5)
    got = whitening.whiten(df).collect()
    deviation, z, explained = whitened_plain(vectors.tolist())
    assert len(got) == 300 * 8 and {r.n for r in got} == {300} and max(r.identity_error for r in got) < 1e-9
    by = {}
    for r in got:
        by.setdefault(r.component, []).append((r.vec_id, r.deviation, r.whitened, r.explained))
    for c, found in by.items():
        want = sorted((i % 290, deviation[i], z[i][c - 1]) for i in range(300))
        sign = np.sign(sum(a[2] * b[2] for a, b in zip(sorted(found), want)))
        want = sorted((i, d, sign * v) for i, d, v in want)
        assert [(i, d) for i, d, *_ in sorted(found)] == [(i, d) for i, d, _ in want]
        assert np.allclose([f[2] for f in sorted(found)], [w[2] for w in want], rtol=0, atol=1e-9)
        assert abs(found[0][3] / explained[c - 1] - 1) < 1e-9


def test_scatter_is_exact_for_large_entries(spark):
    rng = random.Random(2)
    x = [[rng.randrange(-(1 << 61), 1 << 61) for _ in range(3)] for _ in range(4_100)]
    df = spark.createDataFrame([(r,) for r in x], "x array<bigint>").repartition(3)
    n, sums, products = whitening.scatter(df, 3, whitening.primes(2 * len(x) << 122))
    assert n == len(x) and sums == [sum(r[j] for r in x) for j in range(3)]
    assert products == [[sum(r[i] * r[j] for r in x) for j in range(3)] for i in range(3)]


def test_whitening_without_variance(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (None, [2.0, 5.0])], kind)).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 3
    wide = whitening.whiten(spark.createDataFrame([(1, [1e14, 5.0]), (2, [-1e14, 5.0])], kind)).collect()
    assert [r.deviation for r in wide] == [None, None] and abs(wide[0].whitened) == pytest.approx(1)


def test_primes_and_remainders():
    moduli = whitening.primes(1 << 200)
    assert all(p < 1 << 21 and all(p % q for q in range(2, 1449)) for p in moduli) and len(set(moduli)) == len(moduli)
    for x in (0, 1, -1, 3**90, -(7**70)):
        assert whitening.reconstruct([x % p for p in moduli], moduli) == x


# --- sentence pieces -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.PrefixTable.of(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(pieces):
    rng = random.Random(11)
    letters = "aabbehinortsx  \n\t▁éñß1230.,'<>s/\0漢字ひ👍عن"
    for _ in range(20_000):
        s = "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 13, 40])))
        if rng.random() < 0.2:
            s = " " * rng.randrange(70) + s + " " * rng.randrange(70) + rng.choice(letters) + " " * rng.randrange(40)
        assert pieces.encode(s).tolist() == pieces.model.encode(s), s
    for _ in range(20_000):
        s = "".join(rng.choice(pieces.texts) for _ in range(rng.choice([2, 3, 6])))
        assert pieces.encode(s).tolist() == pieces.model.encode(s), s


def test_every_piece_that_can_be_built_encodes_as_itself(pieces):
    feed = pieces.model.encode("\n")
    for t, p in enumerate(pieces.texts):
        if not p.startswith(sentence_pieces.MARK):
            assert pieces.encode("\n" + p).tolist() == [*feed, pieces.ids[t]], p


def test_words_of_any_length(pieces):
    for s in ("ab" * 40_000, "é" * 9_000, " " * 5_003, "\n" * 500, "x" + " " * 31 + "the", "<s></s><unk>"):
        assert pieces.encode(s).tolist() == pieces.model.encode(s)


def test_memos_change_nothing(monkeypatch):
    monkeypatch.setattr(sentence_pieces.PrefixTable, "MEMO", 3)
    monkeypatch.setattr(sentence_pieces.Fits, "LIMIT", 3)
    table = sentence_pieces.PrefixTable(public_tokenizers.path("piece_bpe_32k.model"))
    text = "one two three one four five three six  seven one two " * 5
    assert table.encode(text).tolist() == table.model.encode(text)


def test_encode_decode(spark, pieces):
    texts = [(1, "Hello  wörld\n"), (2, None), (3, ""), (3, "  lead"), (None, "x▁y"), (4, "long " * 30_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))
    got = sentence_pieces.encode_decode(docs)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got.collect()) == sorted((str(i), pieces.model.encode(t or ""), pieces.model.decode(pieces.model.encode(t or "")) if t else "") for i, t in texts)
    assert sentence_pieces.encode_decode(docs.limit(0)).count() == 0


def test_digests_of_a_table(spark, pieces):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = pieces.model.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(pieces.model.decode(ids)) if ids else sha("")))
    assert sorted(map(tuple, sentence_pieces.digests(sentence_pieces.encode_decode(docs)).collect())) == sorted(want)


# --- pages ---------------------------------------------------------------------------------


def main_text(source, path=None):
    return html_extract.Page(source).text(path)


def test_an_empty_container_on_the_hosts_path(spark):
    article = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(i, f"http://h/{i}", f"<body><main class='a'><p>{article(i)}</p></main></body>") for i in range(5)]
    rows += [(9, "http://h/9", f"<body><main class='a'></main><div class='b'><p>{article(9)}</p></div></body>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: article(i) for i in (0, 1, 2, 3, 4, 9)}


def test_tags_left_open_take_no_longer():
    for piece in ('<a "', '<a x="1" ', "<a ", "<!x ", "<", '<a ">" ', "<b '\">' \" ", "<a<", "</a ", "<a x='>\" "):
        for tail in ("", ">", "'>", '">'):
            start = time.process_time()
            main_text(piece * (1_000_000 // len(piece)) + tail)
            assert time.process_time() - start < 4, (piece, tail)


def test_tags_end_where_they_did():
    """Against the plain rule: the first > outside quotation marks, else the first one."""
    rule = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^>]*)>")
    rng = random.Random(6)
    for _ in range(3_000):
        source = "".join(rng.choice("<a>\"' x=") for _ in range(rng.randrange(40)))
        tags = html_extract.Tags(source)
        for at in sorted(rng.sample(range(len(source) + 1), min(6, len(source) + 1))):
            m = rule.match(source, at)
            assert tags.end(at) == (m.end() - 1 if m else -1), (source, at)
    assert main_text("a <!-- b > c") == "a" and main_text("a > b <!-- c") == "a > b" and main_text("a <b") == "a <b" and main_text("x<![CDATA[ y") == "x"


def test_forms_are_judged_by_what_they_hold():
    short = "An article of few words, in a form that wraps the page."
    assert main_text(f"<body><form><div><p>{short}</p></div><input></form></body>") == short
    assert main_text(f"<body><form><article>{short}</article></form></body>") == short
    assert main_text("<body><form>User name <input> Pass word <input></form></body>") == ""
    assert main_text(f"<body><article><p>{short}</p></article><form>Your mail <p>Sign up</p></form></body>") == short


def test_one_word_of_a_class_drops_no_part_of_an_article():
    body = "Words of the article that stand here. " * 4
    page = lambda name: main_text(f"<body><article><p>{body.strip()}</p><section class='{name}'><p>Inner part.</p></section></article></body>")
    for name in ("social-policy", "comment-analysis", "banner-story", "related-work", "share-prices", "cookie-recipe", "widget-guide", "notice-of-meeting"):
        assert "Inner part." in page(name), name
    for name in ("social", "comments", "comment-list", "related-posts", "share-buttons", "newsletter-box", "sidebar-left", "promo", "ad-slot"):
        assert "Inner part." not in page(name), name


def test_several_templates_of_a_host(spark):
    """Pages of three templates and two hosts; what is not the article is known by how the pages are made."""
    rng = random.Random(9)
    say = lambda tag, n: f"{tag} " + " ".join(f"{tag}{rng.randrange(999)}" for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        parts = [say("story", rng.randrange(25, 60)) for _ in range(rng.randrange(1, 5))]
        prose = "".join(f"<p>{p}</p>" for p in parts)
        menu, side, note = say("menu", 5), say("side", 8), say("note", 6)
        kind = i % 3
        if kind == 0:
            source = f"<html><body><nav>{menu}</nav><main class='c{i}'><article>{prose}</article></main><footer>{note}</footer></body></html>"
        elif kind == 1:
            source = f"<div id='navbar'><a href=x>{menu}</a></div><div class='page{i}'><div class='story-text'>{prose}<div class='comments'><p>{side}</p></div></div><div class='sidebar'>{side}</div></div>"
        else:
            source = f"<table><tr><td class='menu'>{menu}<td class='text'>{prose}<form>{note}<input></form></table><script>{side}</script>"
        rows.append((i, f"https://h{i % 2}.org/{i}", source))
        want[i] = "\n\n".join(parts)
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == want


# --- near duplicates at high thresholds ------------------------------------------------------


def test_near_duplicates_at_99_of_100(spark):
    rng = random.Random(1)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (1200, 1200, 700, 30)]
    rows = []
    for i in range(80):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            text[rng.randrange(len(text))] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    for num in (95, 97, 99):
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs, 4, num, 100).collect()}
        assert got == {tuple(x) for x in components_plain(rows, 4, num, 100)}


# --- chat ----------------------------------------------------------------------------------


def test_odd_calls_and_results(spark):
    call = lambda x: f"<tool_call>{x}</tool_call>"
    good = '{"id":"a","name":"search","arguments":{"query":"q","limit":1}}'
    turns = [
        (1, 0, "assistant", f"Look {call('{broken')} and {call(good)} there {call('[1]')}{call('{}')}"),
        (1, 1, "tool", '{"tool_call_id":"a","content":{"b":[2,1],"a":null}}'),
        (1, 2, "tool", '{"tool_call_id":"a","content":"plain \\"text\\""}'),
        (1, 3, "tool", '{"tool_call_id":"a"}'),
        (None, 0, "assistant", call(good)),
        (None, 1, "tool", '{"tool_call_id":"a","content":7}'),
        (2, 0, "tool", '{"tool_call_id":"a","content":null}'),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.format_chat(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    first = json.loads(got[1, 0].json)
    assert got[1, 0].n_calls == got[1, 0].n_valid == 1 and first["tool_calls"] == [json.loads(good)]
    assert first["content"] == f"Look {call('{broken')} and  there {call('[1]')}{call('{}')}"
    assert got[1, 1].json == '{"content":{"a":null,"b":[2,1]},"role":"tool","tool_call_id":"a"}'
    assert got[1, 2].json == '{"content":"plain \\"text\\"","role":"tool","tool_call_id":"a"}'
    assert got[1, 3].json == got[2, 0].json == '{"role":"tool","tool_call_id":"a"}'
    assert (got[None, 1].kind, got[2, 0].kind) == ("result", "orphan") and got[None, 1].json == '{"content":7,"role":"tool","tool_call_id":"a"}'


def test_sets_go_straight_to_their_groups(spark, monkeypatch):
    """Sets are neither written nor joined as tables of their own, and keys are shuffled in turns."""
    names = []
    keep = near_duplicates.Scratch.keep
    monkeypatch.setattr(near_duplicates.Scratch, "keep", lambda self, df, name="t": names.append(name) or keep(self, df, name))
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text)] * 20 + [(7, text + " z"), (None, text), (9, "another text of its own"), (3, text + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.component_id) for r in near_duplicates.near_duplicates(docs, 4, 85, 100).collect())
    assert got == [(0, 3), (3, 3), *[(7, 3)] * 21, (9, 9)]
    assert "sets" not in names and names.count("keys") == near_duplicates.TURNS

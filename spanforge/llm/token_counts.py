"""Token counts by the whole-token shortcut.

The vocabulary is examined once, off the data path: which of its strings, when
encoded alone, come out as exactly one token.  Pre-tokens found among them
count as one token without any merging; all others go through the library's
merges, behind a bounded memo.

Why pre-tokens may be counted apart: text is cut before every space and around
every line feed.  ``Vocabulary.prove`` checks on the vocabulary itself that no
piece has a space mark after another character or holds a line feed, so no
merge can cross a cut, and the counts add up to the library's count.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import binary_text

MARK = "▁"


class Vocabulary:
    """A sentencepiece model with its whole-token table; one for each worker process and path."""

    MEMO = 400_000
    _made: dict[str, "Vocabulary"] = {}

    @classmethod
    def of(cls, path: str) -> "Vocabulary":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.separable, whole = self.prove()
        #: Pre-tokens behind a space mark, and those that follow a line feed, which have none.
        self.whole_marked = {w[1:] for w in whole if w.startswith(MARK)}
        self.whole_plain = {w for w in whole if not w.startswith(MARK)}
        self.marked: dict[str, int] = dict.fromkeys(self.whole_marked, 1)
        self.plain: dict[str, int] = dict.fromkeys(self.whole_plain, 1)
        self.marked_base, self.plain_base = len(self.marked), len(self.plain)

    def count(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))

    def plain_pieces(self, text: str) -> int:
        """Tokens of text without the dummy mark, of which the text before the line feed is independent."""
        ids = self.model.encode("\n" + text, num_threads=1)
        return len(ids) - len(self.model.encode("\n", num_threads=1))

    def prove(self) -> tuple[bool, set[str]]:
        """Whether cuts before spaces and at line feeds are safe, and which pieces encode alone as one token."""
        m = self.model
        usable = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        pieces = [m.id_to_piece(i) for i in usable]
        separable = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        # the usual normaliser adds one mark in front and only turns spaces into marks
        separable &= m.encode("a  b\nc d", out_type=str, num_threads=1)[0].startswith(MARK) and m.normalize("a  b Ä\n") == f"{MARK}a{MARK}{MARK}b{MARK}Ä\n"
        if not separable:
            return False, set()
        whole = set()
        marked = [p for p in pieces if p.startswith(MARK) and MARK not in p[1:] and len(p) > 1]
        for p, ids in zip(marked, m.encode([p[1:] for p in marked], num_threads=1), strict=True):
            if len(ids) == 1:
                whole.add(p)
        plain = [p for p in pieces if MARK not in p]
        base = len(m.encode("\n", num_threads=1))
        for p, ids in zip(plain, m.encode(["\n" + p for p in plain], num_threads=1), strict=True):
            if len(ids) == base + 1:
                whole.add(p)
        return True, whole

    def learn(self, memo: dict[str, int], base: int, limit: set[str], words: list[str], before: str) -> None:
        if len(memo) > base + self.MEMO:
            memo.clear()
            memo.update(dict.fromkeys(limit, 1))
        less = self.count(before) if before else 0
        for w, ids in zip(words, self.model.encode([before + w for w in words], num_threads=1), strict=True):
            memo[w] = len(ids) - less

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts, as the library gives them."""
        if not self.separable:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        cut, out = [], []
        new_marked: set[str] = set()
        new_plain: set[str] = set()
        marked, plain = self.marked, self.plain
        for text in texts:
            heads, tails, odd = [], [], []
            lines = text.split("\n")
            for i, line in enumerate(lines):
                parts = line.split(" ")
                if MARK in line or ("" in parts and len(parts) > 1):  # runs of marks, which merge among themselves
                    odd.append((i, line))
                elif i:
                    heads.append(parts[0])
                    tails += parts[1:]
                else:
                    tails += parts
            if not lines[0]:  # nothing before the first line feed: the dummy mark alone
                tails = tails[1:] if not (odd and odd[0][0] == 0) else tails
            heads = [x for x in heads if x]
            new_marked.update(w for w in tails if w not in marked)
            new_plain.update(w for w in heads if w not in plain)
            cut.append((text, lines, heads, tails, odd))
        if new_marked:
            self.learn(marked, self.marked_base, self.whole_marked, list(new_marked), "")
        if new_plain:
            self.learn(plain, self.plain_base, self.whole_plain, list(new_plain), "\n")
        for text, lines, heads, tails, odd in cut:
            if not text:
                out.append(self.count(""))
                continue
            n = (len(lines) - 1) * self.feed_tokens()
            if not lines[0]:
                n += self.count("\n") - self.feed_tokens()
            try:
                n += sum(map(marked.__getitem__, tails)) + sum(map(plain.__getitem__, heads))
            except KeyError:  # the memo was emptied meanwhile
                n += sum(marked[w] if w in marked else self.count(w) for w in tails)
                n += sum(plain[w] if w in plain else self.plain_pieces(w) for w in heads)
            n += sum(self.count(line) if i == 0 else self.plain_pieces(line) for i, line in odd)
            out.append(n)
        return out

    def feed_tokens(self) -> int:
        """Tokens of one line feed."""
        if not hasattr(self, "_feed"):
            self._feed = self.count("a\nb") - self.count("a") - self.plain_pieces("b")
        return self._feed


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = 4096) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit) for every row of docs.

    model: path of a sentencepiece file.  Null and empty texts have no bytes and
    no tokens; repeated rows are counted each; an empty table gives no rows; other
    columns of docs are not read.  A narrow map: no shuffle, no state between rows.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("text").cast(pa.string()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(vocabulary.counts(texts), pa.int64())], names=["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sizes = binary_text(docs, "doc_id")
    counted_rows = sizes.select("doc_id", "text").mapInArrow(with_bytes(counted), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted_rows.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def with_bytes(fn):
    """Adds the bytes of each text between doc_id and n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.cast(pc.binary_length(batch.column("text")), pa.int64())
            at = 0
            for got in fn(iter([batch])):
                yield pa.RecordBatch.from_arrays([got.column("doc_id"), sizes.slice(at, got.num_rows), got.column("n_tokens")], names=["doc_id", "n_bytes", "n_tokens"])
                at += got.num_rows

    return run

"""SentencePiece encoding by a table of last tokens, and decoding.

BPE gives every prefix of a text exactly one encoding, and the encoding of a text
ends in one token behind the encoding of the prefix before it.  So it is enough to
know the last token of each prefix.  A token found by an automaton at the end of a
prefix is that last token if it can stand behind the last token of the prefix in
front of it: if BPE, given the two tokens' text together, keeps them apart.  The
ids are then read from the table backwards.  The time grows with the text, however
long a word is.

The vocabulary is examined before any text is read: which pieces BPE can build at
all, from which two parts each comes, and whether the model is one that the table
holds for.  Pieces that share a score must be runs of the space mark; such runs
are merged from the left after everything else, by a table of their own.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import binaries, binary_text, slices

MARK = "▁"


def merged(symbols: list[str], rank: dict[str, tuple]) -> tuple[list[str], list[tuple[str, str]]]:
    """Plain BPE: the best adjacent pair, the leftmost of equals, again and again; and the pairs in their order."""
    symbols, done = list(symbols), []
    while True:
        found = [(rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank]
        if not found:
            return symbols, done
        i = min(found)[1]
        done.append((symbols[i], symbols[i + 1]))
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


class Fits(dict):
    """Which pairs of tokens BPE keeps apart, by number; a bounded memo."""

    LIMIT = 500_000

    def __init__(self, table: "PrefixTable"):
        super().__init__()
        self.table = table

    def __missing__(self, pair: int) -> bool:
        if len(self) >= self.LIMIT:
            self.clear()
        good = self[pair] = self.table.apart(*divmod(pair, len(self.table.texts)))
        return good


class PrefixTable:
    """A model's encoder; one for each worker process and path."""

    #: Pre-tokens remembered, in each of two generations, and the longest of them; longer ones are encoded each time.
    MEMO, LONGEST = 400_000, 64
    _made: dict[str, "PrefixTable"] = {}

    @classmethod
    def of(cls, path: str) -> "PrefixTable":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        m = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {m.id_to_piece(i): i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        self.bytes = {m.id_to_piece(i): i for i in range(m.get_piece_size()) if m.is_byte(i)}
        if len(self.bytes) != 256 or any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a model with byte pieces, and marks at the start of pieces only, is needed")
        if m.normalize("a  b Ä\t1 ") != f"{MARK}a{MARK}{MARK}b{MARK}Ä\t1{MARK}":
            raise ValueError("the model must add one mark in front and keep all else")
        self.byte_ids = [self.bytes[f"<0x{b:02X}>"] for b in range(256)]
        self.alphabet = {c for p in pieces for c in p}
        if self.alphabet - pieces.keys():
            raise ValueError("a character of a piece is no piece")
        self.runs = {len(p): i for p, i in pieces.items() if not p.strip(MARK)}
        self.mark = self.runs[1]
        score = {p: m.get_score(i) for p, i in pieces.items()}
        long = {p for p in pieces if len(p) > 1 and p.strip(MARK)}
        if len({score[p] for p in long}) < len(long) or any(score[MARK * n] >= score[p] for n in self.runs if n > 1 for p in long):
            raise ValueError("pieces share a score, or runs of marks come before other pieces")
        self._learn(pieces, long, score)
        self._learn_runs()
        self.automaton = ahocorasick.Automaton()
        for t, p in enumerate(self.texts):
            self.automaton.add_word(p, (t, len(p)))
        self.automaton.make_automaton()
        cut = "" if "\n" in self.alphabet else "\n"
        self.cut = re.compile(f" *[^ {cut}]+| +" + (f"|{cut}" if cut else ""))
        self.memo: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}
        self.fits = Fits(self)

    def _learn(self, pieces: dict[str, int], long: set[str], score: dict[str, float]) -> None:
        """Tokens in the order in which BPE prefers them, characters first, each with the two parts it is made of."""
        rank = {p: (-score[p],) for p in long}
        singles = sorted(p for p in pieces if len(p) == 1)
        self.texts, self.ids, self.parts, number = [], [], [], {}
        for p in [*singles, *sorted(long, key=rank.__getitem__)]:
            end, done = merged(list(p), rank)
            if end != [p]:
                continue  # never built, not even from its own text
            if any(rank[a + b] > rank[p] for a, b in done):
                raise ValueError(f"piece {p!r} comes before a part of it")
            t = number[p] = len(self.texts)
            self.texts.append(p)
            self.ids.append(pieces[p])
            self.parts.append(tuple(number[x] for x in done[-1]) if done else (t, t))
        self.sizes = [len(p) for p in self.texts]
        self.number = number

    def _learn_runs(self) -> None:
        """How runs of marks are encoded: blocks of the longest run, then what a shorter run gives."""
        rank = {MARK * n: (0,) for n in self.runs if n > 1}
        most = self.longest_run = max(self.runs)
        self.run_lengths = [[len(x) for x in merged([MARK] * n, rank)[0]] for n in range(4 * most)]
        for n, lengths in enumerate(self.run_lengths):
            if lengths != [most] * (n // most) + self.run_lengths[n % most]:
                raise ValueError("runs of marks don't repeat")

    def run(self, n: int) -> list[int]:
        """Ids of n marks that nothing else takes."""
        return [self.runs[self.longest_run]] * (n // self.longest_run) + [self.runs[k] for k in self.run_lengths[n % self.longest_run]]

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE keeps tokens a and b apart: no merge over their border comes before the one that makes its side.

        The two tokens are taken back one merge after another, the later one first;
        at each step the parts that meet at the border must not form a token earlier
        than the merge just taken back.
        """
        texts, parts, number = self.texts, self.parts, self.number
        before = len(texts)
        while True:
            over = number.get(texts[a] + texts[b])
            if over is not None and over < before:
                return False
            whole_a, whole_b = parts[a][0] == a, parts[b][0] == b
            if whole_a and whole_b:
                return True
            if whole_b or (not whole_a and a > b):
                before, a = a, parts[a][1]  # of equal merges the left one is first, so a later equal one loses
            else:
                before, b = b + 1, parts[b][0]

    def word(self, text: str) -> list[int]:
        """Ids of a text with at most one mark, in front."""
        n, fits, count = len(text), self.fits, len(self.texts)
        last = [-1] * (n + 1)  # at each character the token that ends there; -1: none, as in front of the text
        for end, (token, size) in self.automaton.iter(text):
            if last[end] < 0:
                before = last[end - size]
                if before < 0 or fits[before * count + token]:
                    last[end] = token
        out, at, ids, sizes = [], n - 1, self.ids, self.sizes
        while at >= 0:
            if (token := last[at]) < 0:
                out += [self.byte_ids[b] for b in reversed(text[at].encode())]
                at -= 1
            else:
                out.append(ids[token])
                at -= sizes[token]
        out.reverse()
        return out

    def pre_token(self, text: str) -> bytes:
        """Ids of spaces and what follows them, as 32-bit numbers."""
        rest = text.lstrip(" ")
        marks = len(text) - len(rest)
        ids = self.word(MARK + rest if marks else rest) if rest else []
        if marks and ids:
            if ids[0] == self.mark:  # the last mark joins the run before it
                ids = ids[1:]
            else:
                marks -= 1
        return array("i", self.run(marks) + ids if marks else ids).tobytes()

    def learn(self, text: str) -> bytes:
        """Ids of a pre-token that the younger memo does not have."""
        got = self.former.get(text) or self.pre_token(text)
        if len(text) <= self.LONGEST:
            if len(self.memo) >= self.MEMO:
                self.former = dict(self.memo)
                self.memo.clear()
            self.memo[text] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text: no piece holds a mark behind another character, so pre-tokens are encoded apart."""
        if not text:
            return np.empty(0, np.int32)
        known, learn = self.memo.get, self.learn
        return np.frombuffer(b"".join([known(x) or learn(x) for x in self.cut.findall(" " + text.replace(MARK, " "))]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist()) if len(ids) else ""


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Rows (doc_id, ids array<int>, decoded string) for every row of docs.

    model: path of a sentencepiece BPE file.  ids are those of the library's encode
    without begin or end, decoded is its decode of them.  Null and empty texts have
    no ids and decode to an empty text; special strings in a text are ordinary text;
    a text or word of any length is encoded whole; repeated rows are encoded each; an
    empty table gives no rows; other columns of docs are not read, whatever their
    names.  A narrow map: no shuffle, no state between rows but bounded memos.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PrefixTable.of(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [table.encode(x.decode("utf-8", "replace")) for x in binaries(part.column("text"))]
                at = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=at[1:])
                lists = pa.ListArray.from_arrays(at, np.concatenate(ids) if ids else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(map(table.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"])

    return binary_text(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Number and hash of ids and the hash of the decoded text, for rows of encode_decode()."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

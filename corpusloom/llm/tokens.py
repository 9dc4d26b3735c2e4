"""Encoding with a public byte-level BPE vocabulary, by prefix dynamic programming.

The text is cut into pieces by the vocabulary's pattern; inside a piece the
encoding of every byte prefix ends in exactly one token.  That token is the one
which, put after the last token of the prefix before it, is left alone by the
merges (``Vocabulary.stable``).  Keeping it for each prefix makes the encoding
linear in the length, lets text be appended without starting anew, and confines
the work after an edit to the pieces around it.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern of the vocabulary: contractions, words, numbers, signs, blanks.  A
#: fixed value; white space is what Unicode calls so.
_S = r"[\t-\r \x85\xa0  -     　]"
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+".replace(r"[^\s", "[^" + _S[1:-1]).replace(r"\S", "[^" + _S[1:]).replace(r"\s", _S)
#: Pieces kept in memory by a task, and the longest piece that is kept.
KEPT, LONGEST = 500_000, 64


def default_vocabulary() -> str:
    """Where the installed public vocabulary lies; a parameter everywhere."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Vocabulary:
    """Tokens by rank, and for each the two it is merged from."""

    def __init__(self, data: bytes, halves: np.ndarray | None = None):
        pairs = (line.split() for line in data.splitlines() if line.strip())
        self.ids = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.size = max(self.bytes) + 1
        self.longest = max(map(len, self.ids))
        self.lengths = sorted({len(t) for t in self.ids})
        self.halves = self._halves() if halves is None else halves
        self.left, self.right = self.halves[0].tolist(), self.halves[1].tolist()
        self.merged = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if a != i and a >= 0}
        self.known: dict[tuple[int, int], bool] = {}

    def _halves(self) -> np.ndarray:
        """The last merge of each token: its bytes merged by the tokens before it
        until two are left.  Single bytes are their own halves."""
        out = np.full((2, self.size), -1, np.int32)
        ids = self.ids
        for token, rank in ids.items():
            if len(token) == 1:
                out[:, rank] = rank
                continue
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best = min((ids.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
                if best[0] >= rank:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2:
                out[0, rank], out[1, rank] = ids[parts[0]], ids[parts[1]]
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` then ``b`` encode to just those two tokens.

        The merges are undone from the last one back, on the side of the later
        token; at each step no earlier merge across the border may exist.
        """
        key = (a, b)
        got = self.known.get(key)
        if got is not None:
            return got
        left, right, merged = self.left, self.right, self.merged
        bound, ok = self.size, True
        while True:
            across = merged.get((a, b))
            if across is not None and across < bound:
                ok = False
                break
            if a > b:
                bound, nxt = a, right[a]
                if nxt != a:
                    a = nxt
                    continue
                bound, nxt = b + 1, left[b]
                if nxt == b:
                    break
                b = nxt
            else:
                bound, nxt = b + 1, left[b]
                if nxt != b:
                    b = nxt
                    continue
                bound, nxt = a, right[a]
                if nxt == a:
                    break
                a = nxt
        if len(self.known) > KEPT:
            self.known.clear()
        self.known[key] = ok
        return ok


class PrefixTable:
    """The last token of each byte prefix of a piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        v, ids, last = self.v, self.v.ids, self.last
        at, data = len(self.data), self.data + more
        self.data = data
        for end in range(at + 1, len(data) + 1):
            found = -1
            for k in range(min(end, v.longest), 0, -1):
                t = ids.get(data[end - k : end])
                if t is not None and (k == end or v.stable(last[end - k], t)):
                    found = t
                    break
            last.append(found)

    def cut(self, length: int) -> None:
        """Keep the first ``length`` bytes; nothing is encoded again."""
        self.data, self.last = self.data[:length], self.last[: length + 1]

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            t = self.last[at]
            out.append(t)
            at -= len(self.v.bytes[t])
        return out[::-1]


class Encoder:
    """Encodes texts; pieces met before are remembered."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        self.v, self.split = vocabulary, regex.compile(pattern)
        self.memo: dict[str, tuple[int, ...]] = {}

    def piece(self, s: str) -> tuple[int, ...]:
        got = self.memo.get(s)
        if got is None:
            data = s.encode("utf-8", "surrogatepass")
            one = self.v.ids.get(data)
            got = (one,) if one is not None and one < 256 else tuple(PrefixTable(self.v, data).ids())
            if len(s) <= LONGEST:
                if len(self.memo) >= KEPT:
                    self.memo.clear()
                self.memo[s] = got
        return got

    def pieces(self, text: str) -> Iterator[tuple[int, ...]]:
        memo = self.memo
        for s in self.split.findall(text):
            got = memo.get(s)
            yield self.piece(s) if got is None else got

    def encode(self, text: str | None) -> list[int]:
        """Token ids; an empty list for an empty or null text."""
        return list(itertools.chain.from_iterable(self.pieces(text))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.pieces(text))) if text else 0

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.v.bytes[i] for i in ids).decode("utf-8", "replace")


class EncodedText:
    """A text that stays encoded while it is appended to or edited."""

    #: A piece may depend on so many characters behind its end.
    AHEAD = 3

    def __init__(self, encoder: Encoder, text: str = ""):
        self.e, self.text = encoder, text
        self.ends = [m.end() for m in encoder.split.finditer(text)]
        self.parts = [encoder.piece(s) for s in encoder.split.findall(text)]
        self.redone = len(self.parts)

    def ids(self) -> list[int]:
        return list(itertools.chain.from_iterable(self.parts))

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of ``text[start:end]``; ``redone`` pieces are encoded
        again, from the last one the edit can't have changed to the first border
        behind it that is one in the old text too."""
        keep = 0
        while keep < len(self.ends) and self.ends[keep] + self.AHEAD <= start:
            keep += 1
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        old = {x + shift: i for i, x in enumerate(self.ends) if x >= end}
        at = self.ends[keep - 1] if keep else 0
        ends, parts, tail = [], [], len(self.ends)
        for m in self.e.split.finditer(text, at):
            ends.append(m.end())
            parts.append(self.e.piece(m.group()))
            if m.end() in old and m.end() > start + len(new):
                tail = old[m.end()] + 1
                break
        self.redone = len(parts)
        self.ends = self.ends[:keep] + ends + [x + shift for x in self.ends[tail:]]
        self.parts = self.parts[:keep] + parts + self.parts[tail:]
        self.text = text


def _load(spark, path: str | None):
    """The vocabulary's bytes and halves, read and worked out on the driver; both
    have a fixed size."""
    data = Path(path or default_vocabulary()).read_bytes()
    return spark.sparkContext.broadcast((data, Vocabulary(data).halves))


def encoder_of(shared) -> Encoder:
    return Encoder(Vocabulary(*shared.value))


def token_ids(docs: DataFrame, doc_id: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row: the whole text encoded without special tokens,
    whose strings are ordinary text.  An empty and a null text give an empty
    list.  ``vocabulary``: path of a file of ranks."""
    shared = _load(docs.sparkSession, vocabulary)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(shared)
        for b in batches:
            col = b.column("t")
            for k in range(0, b.num_rows, 500):
                texts = col.slice(k, 500).to_pylist()
                rows = [e.encode(t) for t in texts]
                off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                flat = np.fromiter(itertools.chain.from_iterable(rows), np.int32, int(off[-1]))
                yield pa.RecordBatch.from_arrays([b.column("d").slice(k, 500), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, ids array<int>")

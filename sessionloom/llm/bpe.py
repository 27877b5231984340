"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes.

For every byte prefix of a piece exactly one token can end its encoding: the longest-to-shortest search takes the token t
ending there whose predecessor (the stored last token of the prefix before t) stays apart from it when both are merged
together by rank. Storing that token for each prefix gives exact appends (the table just grows) and cheap re-encoding
near an edit (prefixes before it keep their entries). Encodings follow the pointers back from the end.
"""

from __future__ import annotations

import base64
import hashlib
from functools import partial
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame


_NEVER = 1 << 60


class Vocabulary:
    """Ranks of a byte-level vocabulary, given as the text of a rank file: one base64 token and its rank a line."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.token = ranks, {v: k for k, v in ranks.items()}
        self.length = {v: len(k) for k, v in ranks.items()}
        self.longest = max(self.length.values())
        self.fits: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        found = ahocorasick.Automaton()
        for data, rank in ranks.items():
            found.add_word(data.decode("latin-1"), (rank, len(data)))
        found.make_automaton()
        self.ending = found.iter

    @classmethod
    def read(cls, data: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())})

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for a single byte or a token no merge makes."""
        if token not in self.halves:
            data, ranks = self.token[token], self.ranks
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                joined = [ranks.get(x + y, _NEVER) for x, y in zip(parts, parts[1:], strict=False)]
                best = min(joined)
                if best == _NEVER:
                    break
                at = joined.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens, one after the other, are the encoding of their bytes.

        Going back in time, the token with the higher rank at the seam comes undone first. The seam is crossed if the two
        that meet there merge before the merge that uses up either of them: strictly before on the left, where the
        leftmost of equal merges goes first, and no later on the right.
        """
        got = self.fits.get(left << 20 | right)
        if got is None:
            if len(self.fits) > 300_000:  # a cache only
                self.fits.clear()
            x, y, until, got = left, right, _NEVER, True
            while True:
                joined = self.ranks.get(self.token[x] + self.token[y], _NEVER)
                if joined < until:
                    got = False
                    break
                below = None
                if x > y and (below := self.split(x)):
                    until, x = x, below[1]
                elif below := self.split(y):
                    until, y = y + 1, below[0]
                elif below := self.split(x):
                    until, x = x, below[1]
                else:
                    break
            self.fits[left << 20 | right] = got
        return got


    def fill(self, data: bytes, last: list, start: int = 0) -> None:
        """The last tokens of the prefixes that end at ``start`` or later."""
        known, done = self.fits.get, start - 1
        for end, (token, length) in self.ending(data.decode("latin-1"), max(0, start - self.longest)):  # at each end the longest token comes first
            if end > done:
                if length > end:
                    last[end] = token
                    done = end
                elif (before := last[end - length]) is not None:
                    fit = known(before << 20 | token)
                    if fit or fit is None and self.apart(before, token):
                        last[end] = token
                        done = end

    def back(self, last: list) -> list[int]:
        """The encoding, from the last token of the whole back to the first."""
        out, end, length = [], len(last) - 1, self.length
        while end >= 0:
            token = last[end]
            if token is None:
                raise ValueError("the vocabulary lacks a byte of this text")
            out.append(token)
            end -= length[token]
        out.reverse()
        return out


class Prefixes:
    """The last token of each byte prefix of a growing piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.bytes, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> Prefixes:
        """Add bytes at the end; the entries so far stay as they are."""
        start = len(self.last)
        self.bytes += more
        self.last += [None] * len(more)
        self.vocabulary.fill(self.bytes, self.last, start)
        return self

    def edit(self, at: int, end: int, new: bytes) -> Prefixes:
        """Replace bytes at:end; only prefixes beyond ``at`` are worked out again."""
        rest = self.bytes[end:]
        self.bytes, self.last = self.bytes[:at], self.last[:at]
        return self.append(new + rest)

    def ids(self) -> list[int]:
        return self.vocabulary.back(self.last)


class Encoder(dict):
    """Ids of a piece, worked out once and kept in two generations: when the young one is full, it replaces the old one."""

    most = 200_000

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        super().__init__()
        self.vocabulary, self.split, self.old = vocabulary, regex.compile(pattern).findall, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            v, data = self.vocabulary, piece.encode()
            whole = v.ranks.get(data)
            if whole is not None:
                ids = (whole,)
            else:
                last = [None] * len(data)
                v.fill(data, last)
                ids = tuple(v.back(last))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, ids))


def _encoder(file: str, pattern: str) -> Encoder:
    with open(SparkFiles.get(file), "rb") as f:
        return Encoder(Vocabulary.read(f.read()), pattern)


def _encode(batches, file: str, pattern: str, with_ids: bool):
    encoder = _encoder(file, pattern)
    name = {i: str(i) for i in encoder.vocabulary.token}.__getitem__
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            ids = [encoder.encode(t or "") for t in part.column("text").to_pylist()]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            columns = {
                "n_tokens": pa.array(map(len, ids), pa.int64()),
                "ids_sha256": pa.array([sha(" ".join(map(name, x)).encode()) for x in ids], pa.string()),
                "decoded_sha256": pa.array([sha(encoder.decode(x)) for x in ids], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            keep = {c: part.column(c) for c in part.schema.names if c != "text"}
            yield pa.RecordBatch.from_arrays([*keep.values(), *columns.values()], [*keep, *columns])


def encode(documents: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode every whole text (null: empty), each match of ``pattern`` by itself, without special tokens, then decode the ids.

    vocabulary: path of a rank file on the driver; it is sent to the executors by Spark. Returns ``keep`` columns, n_tokens,
    ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the decoded bytes) and, on demand, the ids. Rows are
    independent: repeated and empty rows have rows of their own.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    kinds = dict(documents.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids array<int>"] * with_ids])
    return documents.select(*keep, "text").mapInArrow(partial(_encode, file=vocabulary.rpartition("/")[2], pattern=pattern, with_ids=with_ids), schema)

"""Language identification by word-first backoff.

A word that the model knows adds its log frequency in each language. A word it does not know is looked up as character
n-grams, the longest kind first: the first length at which any of its n-grams is known scores it, each known n-gram with an equal part of
one word's weight. A word no length knows adds nothing. Words are runs of letters and combining marks of any script, lower-cased; n-grams
count characters, not bytes.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, stage, text_slices
from .tokens import BASE, INVERSE, _powers, mix

LONGEST = 4
#: What is added to every count: little, so that a word seen once in one language still tells that language from larger ones.
SMOOTHING = 0.01


def alphabet() -> bytes:
    """Two bits for each code point: whether it is a letter, and whether it belongs to words (letters and marks)."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    return np.packbits(np.array([[k == "L" for k in kinds], [k in "LM" for k in kinds]], bool), axis=1).tobytes()


class Letters:
    """The words of each text of a slice, by characters: starts, ends, row, and whether a text has a letter."""

    def __init__(self, texts: pa.Array, table: np.ndarray):
        # a null or empty text is a line of its own: no word crosses a line feed
        whole = "\n".join(t or "" for t in texts.to_pylist())
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(texts)
        if not n:
            code = code[:0]
        size = pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) if n else np.zeros(0, np.int64)
        begin = np.cumsum(size + 1) - size - 1
        letter, inside = table[0][code], table[1][code]
        total = np.concatenate([[0], np.cumsum(letter)])
        self.lettered = total[begin + size] > total[begin]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.row = np.searchsorted(begin, self.starts, "right") - 1
        self.rows = n
        self.sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(mix(code.astype(np.uint64) + np.uint64(0x9E37)) * _powers(BASE, len(code)), out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _powers(INVERSE, len(self.sums))[starts] + (ends - starts).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def grams(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-character grams inside the words numbered ``at``, with the place in ``at`` of each one's word."""
        count = np.maximum(self.ends[at] - self.starts[at] - n + 1, 0)
        owner = np.repeat(np.arange(len(at)), count)
        start = self.starts[at][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        return self.hashes(start, start + n), owner


class Model:
    """Sorted hashes and log frequencies (entries x languages) for words (key 0) and n-grams (keys LONGEST to 1)."""

    def __init__(self, languages: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], letters: bytes):
        """counts: hashes, numbers of languages and counts, by kind; ``letters`` of :func:`alphabet`."""
        self.languages, self.letters, self.tables = languages, letters, {}
        for k in range(LONGEST + 1):
            h, language, n = counts.get(k, (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)))
            known, at = np.unique(h, return_inverse=True)
            table = np.zeros((len(known), len(languages)))
            np.add.at(table, (at, language), n)
            self.tables[k] = (known, np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * max(1, len(known)))).astype(np.float32))

    def table(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.letters, np.uint8).reshape(2, -1), axis=1)[:, : sys.maxunicode + 1].astype(bool)

    def known(self, k: int, h: np.ndarray) -> np.ndarray:
        """Place of each hash in table k, or -1."""
        keys = self.tables[k][0]
        if not len(keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)

    def scores(self, texts: Letters) -> np.ndarray:
        """Sum of log frequencies (rows x languages)."""
        out = np.zeros((texts.rows, len(self.languages)))
        at = self.known(0, texts.words())
        hit = at >= 0
        self._add(out, texts.row[hit], self.tables[0][1][at[hit]])
        left = np.flatnonzero(~hit)
        for k in range(LONGEST, 0, -1):
            if not len(left):
                break
            h, owner = texts.grams(left, k)
            at = self.known(k, h)
            owner, at = owner[at >= 0], at[at >= 0]
            n = np.bincount(owner, minlength=len(left))
            self._add(out, texts.row[left[owner]], self.tables[k][1][at] / n[owner][:, None])
            left = left[n == 0]
        return out

    def _add(self, out: np.ndarray, row: np.ndarray, what: np.ndarray) -> None:
        for j in range(out.shape[1]):
            out[:, j] += np.bincount(row, what[:, j], len(out))


def _count(batches, letters: bytes):
    table = Model([], {}, letters).table()
    for whole in batches:
        for part in text_slices(whole):
            language = np.array(part.column("lang").to_pylist(), object)
            for name in sorted(set(language)):
                own = Letters(part.column("text").filter(pa.array(language == name)), table)
                for k in range(LONGEST + 1):
                    h, n = np.unique(own.grams(np.arange(len(own.starts)), k)[0] if k else own.words(), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "k", "h", "n"])


def _predict(batches, model: Model, keep: tuple[str, ...], names: tuple[str, str]):
    table = model.table()
    for whole in batches:
        for part in text_slices(whole, "_text"):
            texts = Letters(part.column("_text"), table)
            s = model.scores(texts)
            name, score = ["und"] * len(s), np.zeros(len(s))
            if s.shape[1]:
                best = s.argmax(axis=1)
                p = 1.0 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                name = [model.languages[b] if ok else "und" for b, ok in zip(best, texts.lettered, strict=True)]
                score = np.where(texts.lettered, p, 0.0)
            yield pa.RecordBatch.from_arrays([*(part.column(f"_{i}") for i in range(len(keep))), pa.array(name, pa.string()), pa.array(score)], [*keep, *names])


def learn(examples: DataFrame, rows_a_language: int = 1_500) -> Model:
    """Fit a model to (text, lang) rows, on up to about ``rows_a_language`` distinct texts of each language: those with the smallest hashes,
    so the sample is bounded, repeatable, and rare languages are in it.

    Every language, word and n-gram of these rows is in the model; they are counted by an aggregation, and the counts alone come to the driver.
    Rows with a null text or lang teach nothing; of equal texts in one language one is taken, so copies do not fill the sample.
    No rows give a model without languages.
    """
    rows = examples.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("h"))
    size = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    # about twice as many as wanted by a threshold on the hash, then the smallest ones: no language is sorted as a whole
    low = rows.select("lang", "h").join(size, "lang").where(F.pmod("h", F.lit(1 << 32)) * F.col("rows") <= F.lit(2 * rows_a_language * float(1 << 32))).select("lang", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 32)), "h"))
    chosen = stage(low.withColumn("rank", rank).where(F.col("rank") <= rows_a_language).select("lang", "h"), "lang-chosen")
    sample = stage(rows.join(chosen, ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", F.lower("text").alias("text")).repartition(F.xxhash64("text")), "lang-sample")
    letters = alphabet()
    counts = sample.mapInArrow(partial(_count, letters=letters), "lang string, k int, h long, n long").groupBy("lang", "k", "h").agg(F.sum("n").alias("n")).toArrow()
    language = counts.column("lang").combine_chunks().dictionary_encode() if counts.num_rows else None
    if language is None:
        return Model([], {}, letters)
    if isinstance(language, pa.ChunkedArray):
        language = language.combine_chunks()
    found = language.dictionary.to_pylist()
    languages = sorted(found)
    number = np.array([languages.index(x) for x in found])[language.indices.to_numpy()]
    k, h, n = (counts.column(c).to_numpy() for c in ("k", "h", "n"))
    return Model(languages, {i: (h[k == i].view(np.uint64), number[k == i], n[k == i]) for i in range(LONGEST + 1)}, letters)


def predict(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns, lang_pred and score (the posterior of lang_pred under even priors) of every whole text; ``names`` are the two
    new columns' names, for tables that have such columns already.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if the model learned no language. A text of
    which nothing is known gets the first language with an even score; of equal scores the first language wins. Rows are independent:
    repeated rows get equal results, an empty table gives none, texts may be of any length.
    """
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{names[0]}` string, `{names[1]}` double"])
    inner = documents.select(*[c.alias(f"_{i}") for i, c in enumerate(columns(keep))], F.lower("text").alias("_text"))
    return inner.mapInArrow(partial(_predict, model=model, keep=keep, names=names), schema)

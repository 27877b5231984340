"""Suffix stripping after M. F. Porter (1980), as a table over distinct words."""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The suffixes of the published steps and what replaces them.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    w = word
    if len(w) < 3:
        return w
    if w.endswith("s") and not w.endswith("ss"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (end := _longest(w, ("ed", "ing"))) and "v" in _shape(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w).endswith("c") and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        if (end := _longest(w, table)) and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    if (end := _longest(w, STEP_4)) and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _stems(batches):
    for b in batches:
        words = b.column("word")
        yield pa.RecordBatch.from_arrays([words, pa.array([stem(w) for w in words.to_pylist()], pa.string())], ["word", "stem"])


def stem_table(words: DataFrame) -> DataFrame:
    """word, stem of the distinct words: Python sees each word once."""
    return words.select("word").where("word is not null").distinct().mapInArrow(_stems, "word string, stem string")


def equal_stems(pairs: DataFrame) -> DataFrame:
    """q_prev, q_curr, stems: whether the queries have as many words with equal stems, place by place (distinct pairs)."""
    t1, t2 = T.tokens(F.col("q_prev")), T.tokens(F.col("q_curr"))
    p = pairs.select("q_prev", "q_curr").distinct().where((F.size(t1) == F.size(t2)) & (F.size(t1) > 0))
    words = p.select("q_prev", "q_curr", F.explode(F.arrays_zip(t1.alias("a"), t2.alias("b"))).alias("z")).select("q_prev", "q_curr", "z.a", "z.b")
    table = stem_table(words.select(F.explode(F.array("a", "b")).alias("word")))
    j = words.join(table.select(F.col("word").alias("a"), F.col("stem").alias("sa")), "a").join(table.select(F.col("word").alias("b"), F.col("stem").alias("sb")), "b")
    return j.groupBy("q_prev", "q_curr").agg(F.bool_and(F.col("sa") == F.col("sb")).alias("stems"))

"""Licence scan by a positional rare-token index.

The words of a few licence templates are weighed by their inverse document frequency over all documents. A file is looked
up by its rarest template words: each posting (template, position) votes for the alignment that puts the template's start at
word - position. Alignments a few words apart go together, as a changed name or date shifts what follows. Their score is the share of the
template's weight that is found in place under one of them; a template is reported if its score reaches the threshold and all its
mandatory key phrases stand there word for word. Templates are short notices (below) and the whole texts in ``licence_texts``.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .tokens import ALNUM, Words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Alignments so many words apart or less go together.
DRIFT = 12
# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Label, key phrase, and words of common licence notices.
TEMPLATES = [
    ("gpl-3.0-notice", "general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("apache-2.0-notice", "apache license", "licensed under the apache license version 2 0"),
    ("cc-by-nc-4.0-notice", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-4.0-notice", "cc by 4 0", "licensed under cc by 4 0"),
    ("mit-notice", "mit license", "released under the mit license"),
    ("mit-text", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-notice", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("reserved-notice", "all rights reserved", "all rights reserved"),
]


def whole_texts() -> list[tuple[str, str, str]]:
    """label, key phrases (parted by bars) and words of the files of ``licence_texts``."""
    out = []
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        label, keys, _, text = path.read_text().split("\n", 3)
        out.append((label, keys, " ".join(WORD.findall(text.lower()))))
    return out


def _hash(words: list[str]) -> np.ndarray:
    return Words(pa.array(words), ALNUM).hashes() if words else np.zeros(0, np.uint64)


class Index:
    """Postings of the template words, rarest first."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str, str]], frequency: dict[int, int], documents: int, rare: int):
        self.phrases = [(_hash(p.split()), label) for p, label in sorted(phrases.items())]
        self.templates, self.postings = [], defaultdict(list)
        for t, (label, key, text) in enumerate(templates):
            h, k = _hash(text.split()), [_hash(part.split()) for part in key.split("|")]
            weight = np.array([math.log((1 + documents) / (1 + frequency.get(int(x), 0))) + 1e-3 for x in h])
            self.templates.append((label, k, h, weight, weight.sum()))
            for place in np.lexsort((np.arange(len(h)), -weight))[:rare]:
                self.postings[int(h[place])].append((t, int(place)))
        every = [h for h, _ in self.phrases] + [x[2] for x in self.templates] + [k for x in self.templates for k in x[1]]
        self.vocabulary = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)

    def scan(self, at: np.ndarray, h: np.ndarray, least: float) -> tuple[list[int], set[str], set[str], float]:
        """Starts and labels of the base phrases, labels of the templates, best score. at, h: places and hashes of the vocabulary's words."""
        here = dict(zip(at.tolist(), h.tolist(), strict=True))
        starts, base, found, best = [], set(), set(), 0.0
        for words, label in self.phrases:
            for i in at[h == words[0]].tolist():
                if all(here.get(i + j) == int(w) for j, w in enumerate(words)):
                    starts.append(i)
                    base.add(label)
        votes = defaultdict(set)
        for i, x in here.items():
            for t, place in self.postings.get(x, ()):
                votes[t].add(i - place)
        for t, begins in votes.items():
            label, keys, words, weight, total = self.templates[t]
            begins = sorted(begins)
            cuts = [0, *(i for i in range(1, len(begins)) if begins[i] - begins[i - 1] > DRIFT), len(begins)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                group = begins[low:high]
                score = float(sum(w for j, (x, w) in enumerate(zip(words.tolist(), weight.tolist(), strict=True)) if any(here.get(g + j) == x for g in group)) / total)
                around = range(group[0] - 2, group[-1] + len(words) + 3)
                if score >= least and all(any(all(here.get(i + j) == int(x) for j, x in enumerate(key)) for i in around) for key in keys):
                    best = max(best, score)
                    found.add(label)
        return starts, base, found, min(1.0, best)


def _frequencies(batches, vocabulary: np.ndarray):
    seen, rows = np.zeros(len(vocabulary), np.int64), 0
    for whole in batches:
        for part in text_slices(whole):
            words = Words(part.column("text"), ALNUM)
            h = words.hashes()
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            hit = vocabulary[at] == h
            pair = np.unique(words.row[hit] * len(vocabulary) + at[hit])
            seen += np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
            rows += part.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.append(vocabulary.view(np.int64), 0)), pa.array(np.append(seen, rows)), pa.array([True] * len(vocabulary) + [False])], ["word", "n", "is_word"])


def _scan(batches, index: Index, least: float):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for whole in batches:
        for part in text_slices(whole):
            words = Words(part.column("text"), ALNUM)
            h = words.hashes()
            at = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
            hit = np.flatnonzero(index.vocabulary[at] == h)
            cut = np.searchsorted(hit, words.first)
            out = []
            for i in range(part.num_rows):
                mine = hit[cut[i] : cut[i + 1]]
                starts, base, found, score = index.scan(mine - words.first[i], h[mine], least) if len(mine) else ([], set(), set(), 0.0)
                out.append((int(words.first[i + 1] - words.first[i]), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names)


def scan(documents: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str, str]] | None = None, rare: int = 6, least: float = 0.8) -> DataFrame:
    """Licences in every whole text of documents (doc_id, text).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased; a null text is empty. n_base counts all
    places of all phrases, overlapping ones too; first_word and last_word are null without any. labels adds the templates
    found with a score of ``least`` or more. The document frequencies cover all documents; ``rare`` words of each template are looked up
    (``templates``: label, key phrases, text; else TEMPLATES and the whole texts). Rows are independent: repeated rows and rows with a null doc_id have rows of
    their own, texts may be of any length, an empty table gives none; other columns are not read.
    """
    templates = [*TEMPLATES, *whole_texts()] if templates is None else templates
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blank = Index(phrases, templates, {}, 0, rare)
    counts = docs.mapInArrow(partial(_frequencies, vocabulary=blank.vocabulary), "word long, n long, is_word boolean").groupBy("word", "is_word").agg(F.sum("n").alias("n")).collect()  # a row for each template word
    frequency = {int(np.int64(r.word).astype(np.uint64)): r.n for r in counts if r.is_word}
    index = Index(phrases, templates, frequency, sum(r.n for r in counts if not r.is_word), rare)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.mapInArrow(partial(_scan, index=index, least=least), schema)

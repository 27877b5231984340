"""Context-triggered piecewise hashing of whole texts.

A rolling hash over the last seven bytes ends a chunk wherever it falls on a trigger value of the block size; every chunk
gives one of 64 signature letters. A fingerprint is ``size:letters:letters at twice the size``; two fingerprints are compared by edit
distance (insertions and deletions cost 1, replacements 2) where their block sizes are equal or differ by a factor of two.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .tokens import BASE, BYTE_CODE, INVERSE, _powers, mix

WINDOW, LEAST, MOST, COMMON = 7, 3, 64, 4
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTER = np.frombuffer(LETTERS.encode(), np.uint8)


def _signature(ends: np.ndarray, total: np.ndarray, most: int) -> str:
    """Letters of the chunks that end at ``ends`` (the last at the text's end); those past ``most`` join the last."""
    if len(ends) > most:
        ends = np.append(ends[: most - 1], ends[-1])
    starts = np.append(0, ends[:-1])
    h = mix((total[ends] - total[starts]) * _powers(INVERSE, len(total))[starts] + (ends - starts).astype(np.uint64))
    return _LETTER[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """Fingerprint of a text's UTF-8 bytes; the empty text's is ``3::``."""
    n = len(data)
    if not n:
        return f"{LEAST}::"
    raw = np.frombuffer(data, np.uint8)
    code = BYTE_CODE[raw]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(code * _powers(BASE, n), out=total[1:])
    short = raw.astype(np.uint32) + np.uint32(1)
    roll = short.copy()
    for j in range(1, min(WINDOW, n)):
        roll[j:] += short[:-j] * np.uint32(pow(0x01000193, j, 1 << 32))
    roll = (roll ^ (roll >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    roll ^= roll >> np.uint32(13)
    size = LEAST
    while size * MOST < n:
        size *= 2
    while True:
        at = np.flatnonzero(roll % np.uint32(size) == size - 1) + 1
        if size == LEAST or len(at) >= MOST // 2:
            break
        size //= 2
    twice = at[roll[at - 1] % np.uint32(2 * size) == 2 * size - 1]
    close = lambda x: x if len(x) and x[-1] == n else np.append(x, n)
    return f"{size}:{_signature(close(at), total, MOST)}:{_signature(close(twice), total, MOST // 2)}"


def _near(a: str, b: str) -> float:
    """1 - distance / total length, or 0 without a common run of letters (COMMON, or all of a shorter signature)."""
    if a == b:
        return 1.0
    run = min(COMMON, len(a), len(b))
    if not run or not ({a[i : i + run] for i in range(len(a) - run + 1)} & {b[i : i + run] for i in range(len(b) - run + 1)}):
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for c in b:  # bit-parallel longest common subsequence; the distance is len(a) + len(b) - 2 * its length
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 2.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: the best of the comparisons at compatible block sizes; 1 for equal fingerprints, 0 for incompatible ones."""
    if a == b:
        return 1.0
    (sa, a1, a2), (sb, b1, b2) = a.split(":"), b.split(":")
    sa, sb = int(sa), int(sb)
    pairs = [(a1, b1), (a2, b2)] if sa == sb else [(a2, b1)] if 2 * sa == sb else [(a1, b2)] if sa == 2 * sb else []
    return max((_near(x, y) for x, y in pairs if x and y), default=0.0)


def edited(text: str, following: str) -> str:
    """The last third of ``text`` (code points, rounded down) replaced by as many from the start of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _result(doc_id, text: str, own: str, following: str, next_own: str) -> tuple:
    new = edited(text, following)
    g = fingerprint(new.encode())
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own, g, likeness(own, g), likeness(own, next_own)


def _rows(batches):
    """Rows come in falling order: each is written when the next one is known. The last one's row holds what the next range needs:
    the first row's place and text, and the last one's text."""
    first = waiting = None
    for batch in batches:
        out = []
        for doc_id, text, order, tie in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "order", "tie")), strict=True):
            now = (doc_id, text, fingerprint(text.encode()))
            if waiting is None:
                first = (order, tie, text)
            else:
                out.append(_result(*waiting, *now[1:]))
            waiting = now
        if out:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)), *(pa.nulls(len(out), k) for k in (pa.int64(), pa.int64(), pa.string(), pa.string()))], [*NAMES, "order", "tie", "head", "tail"])
    if waiting is not None:
        yield pa.RecordBatch.from_arrays([pa.array([waiting[0]], pa.int64()), *(pa.nulls(1, k) for k in _KINDS[1:]), pa.array([first[0]]), pa.array([first[1]]), pa.array([first[2]]), pa.array([waiting[1]])], [*NAMES, "order", "tie", "head", "tail"])


def _ends(batches):
    for batch in batches:
        out = [_result(i, t, fingerprint(t.encode()), u, fingerprint(u.encode())) for i, t, u in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tail", "following")), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], NAMES)


def fingerprints(documents: DataFrame, rows_a_part: int | None = None) -> DataFrame:
    """Fingerprints of every text of documents (doc_id, text) and of its edited text, and how near they and the next text's are.

    The next document follows in descending doc_id, the first follows the last; a single document follows itself. A null
    text is empty; rows with a null doc_id come last, rows with equal ids (repeated rows too) follow each other by a hash of their texts, an empty
    table gives none; texts may be of any length; other columns are not read. Texts are dealt out once, in ranges of (id, hash) that Spark
    chooses (or of about ``rows_a_part`` rows), so equal and null ids fall into many of them; each range streams through its task, and only its two
    ends' texts meet those of its neighbours.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumns({"order": F.coalesce("doc_id", F.lit(-(1 << 63))), "tie": F.xxhash64("text")})
    falling = [F.desc("order"), F.col("tie")]
    parts = [max(1, docs.count() // rows_a_part)] if rows_a_part else []
    dealt = docs.repartitionByRange(*parts, *falling).sortWithinPartitions(*falling)
    done = stage(dealt.mapInArrow(_rows, f"{SCHEMA}, order long, tie long, head string, tail string"), "ctph-rows")
    ends = done.where("head is not null")  # one row for each range
    every = Window.orderBy(F.desc("order"), "tie", F.length("tail"))
    ends = ends.withColumn("following", F.coalesce(F.lead("head").over(every), F.first("head").over(every.rowsBetween(Window.unboundedPreceding, 0))))
    return done.where("head is null").select(*NAMES).unionByName(ends.select("doc_id", "tail", "following").mapInArrow(_ends, SCHEMA))

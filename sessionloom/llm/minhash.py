"""MinHash near-dedup with SetSketch registers.

Every document's set of k-word shingles becomes a SetSketch: ``m`` registers, each the truncated logarithm (base ``b``)
of the smallest of many exponentially spaced points. Equal sets have equal sketches, unions merge by maximum, and a
register agrees with probability at least the Jaccard similarity, so bands of register values find candidates. The joint
likelihood of the register orders then estimates each candidate's similarity; what stays within six standard errors of
the threshold is confirmed on the full sets.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, components, stage, text_slices
from .tokens import BASE, NOT_SPACE, Words, mix, shingles

M, B, A, Q = 200, 1.001, 20.0, (1 << 16) - 2
BAND = 5


def distinct_by_row(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes within each row, and the new offsets."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(off)))


def sketch(h: np.ndarray, off: np.ndarray, m: int = M) -> np.ndarray:
    """Registers (rows x m, uint16) of the sets h[off[i]:off[i+1]]; an empty set has zeros.

    The points of an element are a Poisson process of rate a*m whose marks choose registers evenly, so that each register
    sees independent points of rate a. An element stops when its next point lies beyond its row's largest minimum.
    """
    rows = len(off) - 1
    low = np.full((rows, m), np.inf)
    row = np.repeat(np.arange(rows), np.diff(off))
    state, x = h.copy(), np.zeros(len(h))
    while len(state):
        state = mix(state + np.uint64(BASE))
        x = x - np.log(((state >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / (A * m)
        mark = (mix(state ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(33)).astype(np.int64) % m
        np.minimum.at(low.reshape(-1), row * m + mark, x)
        go = x < low.max(axis=1)[row]
        state, x, row = state[go], x[go], row[go]
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(low) / np.log(B))
    return np.clip(k, 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of the sets of two sketches."""
    return np.maximum(a, b)


def bands(registers: np.ndarray, band: int = BAND) -> np.ndarray:
    """64-bit keys (rows x bands) of the register values in each band."""
    n, m = registers.shape
    k = m // band
    r = registers[:, : k * band].reshape(n, k, band).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, k + 1, dtype=np.uint64)), (n, k)).copy()
    for j in range(band):
        key = mix(key * np.uint64(BASE) + r[:, :, j])
    return key


def likely_jaccard(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes."""
    more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = ra.shape[1] - more - less
    u = na / (na + nb)
    v = 1.0 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def fit(j):
        p = lambda x: -np.log1p(-np.maximum(x, 0) * (B - 1) / B) / np.log(B)
        p1, p2 = p(u - v * j), p(v - u * j)
        log = lambda n, x: np.where(n > 0, n * np.log(np.maximum(x, 1e-300)), 0.0)
        return log(more, p1) + log(less, p2) + log(same, 1 - p1 - p2)

    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = fit(a) > fit(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def _sketches(batches, shingle: int, m: int):
    for whole in batches:
        for part in text_slices(whole):
            h, off = distinct_by_row(*shingles(Words(part.column("text"), NOT_SPACE), shingle))
            n = np.diff(off)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(s)))]) for s in (0x1234567, 0x89ABCDEF01)]
            k1, k2 = [(c[off[1:]] - c[off[:-1]] + n.astype(np.uint64)).view(np.int64) for c in sums]
            registers = sketch(h, off, m)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2), pa.array([r.tobytes() for r in registers], pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "registers"])


def _bands(batches, band: int):
    for b in batches:
        r = _registers(b.column("registers"))
        keys = bands(r, band).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), lists], ["id", "n", "keys"])


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1) if len(column) else np.zeros((0, BAND), np.uint16)


def _likely(batches, least: float):
    for b in batches:
        if not b.num_rows:
            continue
        na, nb = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
        keep = likely_jaccard(_registers(b.column("ra")), _registers(b.column("rb")), na, nb) >= least
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))


def _sets(batches, shingle: int):
    for whole in batches:
        for part in text_slices(whole):
            h, off = distinct_by_row(*shingles(Words(part.column("text"), NOT_SPACE), shingle))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([h[i:j].tobytes() for i, j in zip(off, off[1:], strict=False)], pa.binary())], ["id", "set"])


def _confirm(batches, percent: int):
    for b in batches:
        good = []
        for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _face(batches, percent: int, least: float, band: int):
    """Links between the strays and the members of a bucket's blocks, each pair in the first band that it shares."""
    for whole in batches:
        for i in range(whole.num_rows):
            key, strays, members = (whole.column(c)[i].as_py() for c in ("key", "strays", "members"))
            ra, rb = (np.stack([np.frombuffer(x["registers"], np.uint16) for x in side]) for side in (strays, members))
            ka, kb = bands(ra, band), bands(rb, band)
            at = int(np.flatnonzero(ka[0].view(np.int64) == key)[0])
            sets_a, sets_b = ([np.frombuffer(x["set"], np.uint64) for x in side] for side in (strays, members))
            na, nb = (np.array([len(x) for x in side]) for side in (sets_a, sets_b))
            ca, cb = (np.array([x["c"] for x in side]) for side in (strays, members))
            ask = (ca[:, None] != cb) & (100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb))
            ask &= ~(ka[:, None, :at] == kb[None, :, :at]).any(axis=2)
            p, q = np.nonzero(ask)
            if len(p):  # a register agrees with probability J at least, so few agreements rule a pair out
                near = (ra[p] == rb[q]).sum(axis=1) >= least * ra.shape[1]
                p, q = p[near], q[near]
            if len(p):
                near = likely_jaccard(ra[p], rb[q], na[p].astype(float), nb[q].astype(float)) >= least
                p, q = p[near], q[near]
            links = []
            for j in np.unique(p):
                asked = q[p == j]
                every, owner = np.concatenate([sets_b[k] for k in asked]), np.repeat(np.arange(len(asked)), nb[asked])
                place = np.minimum(np.searchsorted(sets_a[j], every), na[j] - 1)
                both = np.bincount(owner[sets_a[j][place] == every], minlength=len(asked))
                good = asked[100 * both >= percent * (na[j] + nb[asked] - both)]
                links += [(min(strays[j]["id"], members[k]["id"]), max(strays[j]["id"], members[k]["id"])) for k in good]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in links], pa.int64()), pa.array([p[1] for p in links], pa.int64())], ["a", "b"])


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80, m: int = M, band: int = BAND, block: int = 64) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set holds its distinct
    ``shingle``-word sequences, or all its words as one if there are fewer. Documents are linked when
    100 * intersection >= percent * union. Null or empty texts have empty sets and link with nothing; a null doc_id never
    links and its component_id is null; a repeated doc_id counts as one vertex. Documents with equal sets form a class
    that is compared once. In each band the documents that share a key are compared with the smallest and the largest id
    there; those that stay outside the smallest id's component (strays) are then compared with the members of other
    components there, so no chain is lost and no group is expanded into all its pairs. In buckets of more than ``block``
    documents that happens between blocks of rows inside a task, which returns the links alone. A row of two blocks holds up to
    2 * ``block`` sets, so Python gets them a few megabytes at a time.
    """
    with batches_of(documents.sparkSession, 1000, 4 << 20):  # every step that runs Python is staged here
        return _near_duplicates(documents, shingle, percent, m, band, block)


def _near_duplicates(documents: DataFrame, shingle: int, percent: int, m: int, band: int, block: int) -> DataFrame:
    docs = documents.select("doc_id", "text")
    all_ = stage(docs.mapInArrow(partial(_sketches, shingle=shingle, m=m), "doc_id long, n_shingles long, k1 long, k2 long, registers binary"), "mh-sketches")
    full = all_.where("n_shingles > 0 and doc_id is not null")
    classes = stage(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "mh-classes")
    reps = stage(full.join(classes, ["k1", "k2"]).where("doc_id = rep").dropDuplicates(["k1", "k2"]).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "registers"), "mh-reps")
    keyed = reps.mapInArrow(partial(_bands, band=band), "id long, n long, keys array<long>").select("id", "n", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("other"), F.count(F.lit(1)).alias("size")).where("size > 1")
    hubs = stage(hubs.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")), "mh-hubs")
    member = stage(keyed.join(hubs.hint("merge"), "key"), "mh-members")
    sized = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    close = F.least("n", "na") * 100 >= F.greatest("n", "na") * percent
    s = percent / 100
    likely_at = s - 6 * (s * (1 - s) / m) ** 0.5

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        return stage(docs.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(partial(_sets, shingle=shingle), "id long, set binary"), f"mh-sets-{name}")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a < b) whose sets are near enough."""
        right = reps.select(F.col("id").alias("b"), F.col("n").alias("n"), F.col("registers").alias("rb"))
        both = pairs.join(sized.hint("merge"), "a").join(right.hint("merge"), "b").where(close).withColumnRenamed("n", "nb")
        likely = stage(both.mapInArrow(partial(_likely, least=likely_at), "a long, b long"), f"mh-likely-{name}")
        sets = sets_of(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), name)
        with_sets = likely.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")).hint("merge"), "b")
        return stage(with_sets.mapInArrow(partial(_confirm, percent=percent), "a long, b long").distinct(), f"mh-links-{name}")

    tried = member.select(F.explode(F.array(F.struct(F.col("hub").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("other").alias("b")))).alias("p")).select("p.*").where("a < b")
    tried = stage(tried.distinct(), "mh-tried")
    links = confirmed(tried, "hub")
    label = components(links, "mh-first")
    named = member.join(label.select("id", F.col("component").alias("c1")).hint("merge"), "id", "left").join(label.select(F.col("id").alias("hub"), F.col("component").alias("c2")).hint("merge"), "hub", "left")
    named = stage(named.select("key", "id", "n", "blocks", F.coalesce("c1", "id").alias("c"), F.coalesce("c2", "hub").alias("hub_c")), "mh-named")
    stray = named.where("c <> hub_c")

    # small buckets: the strays' pairs as rows, at most ``block`` for each
    few = stray.where("blocks = 1").select("key", F.col("id").alias("sid"), F.col("n").alias("na"), F.col("c").alias("sc"))
    cross = few.join(named.where("blocks = 1").hint("merge"), "key").where((F.col("c") != F.col("sc")) & close & ((F.col("c") == F.col("hub_c")) | (F.col("sid") < F.col("id"))))
    cross = cross.select(F.least("sid", "id").alias("a"), F.greatest("sid", "id").alias("b")).distinct().join(tried.hint("merge"), ["a", "b"], "left_anti")
    links = links.unionByName(confirmed(stage(cross, "mh-cross"), "cross"))

    # large buckets: blocks of strays against blocks of members, compared inside the task
    many = stage(stray.where("blocks > 1").select("key").distinct().join(named.where("blocks > 1").hint("merge"), "key"), "mh-many")
    if not many.isEmpty():
        sets = sets_of(many.select(F.col("id").alias("doc_id")).distinct(), "many")
        row = F.struct("id", "c", "registers", "set").alias("x")
        with_sets = many.join(reps.select("id", "registers").hint("merge"), "id").join(sets.hint("merge"), "id")
        part = F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")
        members = with_sets.groupBy("key", "blocks", part.alias("part")).agg(F.collect_list(row).alias("members"))
        strays = with_sets.where("c <> hub_c").groupBy("key", "blocks", part.alias("stray_part")).agg(F.collect_list(row).alias("strays"))
        strays = strays.select("key", "strays", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))  # a bucket's blocks go to as many tasks
        facing = strays.join(members.hint("merge"), ["key", "part"]).select("key", "strays", "members")
        links = links.unionByName(facing.mapInArrow(partial(_face, percent=percent, least=likely_at, band=band), "a long, b long").distinct())
    label = components(links, "mh")
    out = all_.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))

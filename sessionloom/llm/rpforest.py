"""Near-duplicate vectors by a forest of random projection trees with spill.

Each tree splits along random directions at the emptiest place near the middle, as a bounded sample of the label's vectors shows it; a vector
near a split goes down both sides. A branch ends when the table's vectors there, estimated by the sample's share, fit one leaf, or
when a split would send most of them both ways (a dense group stays together). Vectors that share a leaf, a label and a length are
compared in tiles of bounded size; a pair counts in the first leaf it shares, so every link is counted once and no pair
is ever written: a tile returns the number of links of its vectors and a spanning forest of its links.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stage
from .tokens import mix

DEEPEST = 40


class Directions:
    """The random unit vectors of every tree and level, made on first use from the seed alone."""

    def __init__(self, trees: int, seed: int = 11):
        self.trees, self.seed, self.made = trees, seed, {}

    def __call__(self, tree: int, level: int, dims: int) -> np.ndarray:
        key = (tree, level, dims)
        if key not in self.made:
            d = np.random.default_rng((self.seed, *key)).standard_normal(dims)
            self.made[key] = d / np.linalg.norm(d)
        return self.made[key]

    def __getstate__(self):
        return {"trees": self.trees, "seed": self.seed, "made": {}}


def cut_of(p: np.ndarray, margin: float) -> float:
    """The place in the middle half of the projections with the fewest of them within ``margin`` (a place far from the middle has to be
    emptier by as much as it is off); nan if the split would not pay."""
    p = np.sort(p)
    n = len(p)
    between = (p[max(1, n // 4) : n - n // 4] + p[max(0, n // 4 - 1) : n - n // 4 - 1]) / 2
    if not len(between):
        return np.nan
    both = np.searchsorted(p, between + margin, "right") - np.searchsorted(p, between - margin)
    best = int(np.argmin(both + np.abs(np.arange(len(between)) - len(between) / 2)))
    low, high = np.searchsorted(p, between[best] + margin, "right"), n - np.searchsorted(p, between[best] - margin)
    return between[best] if max(low, high) <= 0.85 * n and low + high <= 1.5 * n else np.nan


class Tree:
    """Cuts of the nodes that the sample reaches (by path), and for the ends among them the cuts of all lower levels."""

    def __init__(self, sample: np.ndarray, project, margin: float, least: int = 100):
        self.share, self.cut, self.deep = {1: 1.0}, {}, {}
        todo = [(1, 0, np.arange(len(sample)))]
        while todo:
            node, level, rows = todo.pop()
            if len(rows) < 2 * least or level >= DEEPEST:
                self.deep[node] = self._below(sample[rows], [project(j) for j in range(level, min(DEEPEST, level + 24))], margin)
                continue
            p = sample[rows] @ project(level)
            cut = self.cut[node] = cut_of(p, margin)
            for child, own in ((2 * node, p <= cut + margin), (2 * node + 1, p > cut - margin)) if cut == cut else ((2 * node, np.ones(len(rows), bool)),):
                self.share[child] = self.share[node] * own.mean()
                todo.append((child, level + 1, rows[own]))

    @staticmethod
    def _below(own: np.ndarray, directions: list[np.ndarray], margin: float) -> list[float]:
        """Medians along the directions; nan where half of the vectors or more would go both ways, 0 without vectors to tell."""
        if len(own) < 8 or not directions:
            return [0.0] * len(directions)
        p = own @ np.stack(directions, axis=1)
        cut = np.median(p, axis=0)
        return np.where((np.abs(p - cut) <= margin).mean(axis=0) < 0.5, cut, np.nan).tolist()

    def route(self, x: np.ndarray, n: float, leaf: int, project, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and paths of the leaves of unit vectors, where ``n`` vectors are to be dealt out."""
        rows, paths = [], []
        todo = [(1, 0, np.arange(len(x)), n, None)]
        while todo:
            node, level, own, size, end = todo.pop()
            if not len(own):
                continue
            if end is None:
                size = n * self.share[node]
                if node in self.deep:
                    end = (self.deep[node], level)
            at = self.cut.get(node, np.nan) if end is None else end[0][level - end[1]] if level - end[1] < len(end[0]) else None
            if size <= leaf or at is None:
                rows.append(own)
                paths.append(np.full(len(own), node))
            elif at != at:
                todo.append((2 * node, level + 1, own, size, end))
            else:
                p = x[own] @ project(level)
                left, right = p <= at + margin, p > at - margin
                todo += [(2 * node, level + 1, own[left], size / 2, end), (2 * node + 1, level + 1, own[right], size / 2, end)]
        return (np.concatenate(rows), np.concatenate(paths)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Forest:
    """Trees for each label and length of the sample, and for each length over all labels (4096 vectors); other lengths are cut at 0."""

    def __init__(self, labels: list, vectors: list[np.ndarray], trees: int, leaf: int, least: float, spill: float):
        self.leaf, self.least, self.spill, self.directions = leaf, least, spill, Directions(trees)
        groups: dict = {}
        for label, v in zip(labels, vectors, strict=True):
            groups.setdefault((label, len(v)), []).append(v)
            if len(groups.setdefault((None, len(v)), [])) < 4096:
                groups[None, len(v)].append(v)
        self.trees = {key: self._fit(np.array(v), key[1]) for key, v in groups.items() if len(v) >= 64}

    def margin(self, dims: int) -> float:
        """``spill`` times the deviation of a projected difference of two vectors whose cosine is ``least``."""
        return self.spill * (2 * (1 - self.least) / max(dims, 1)) ** 0.5

    def _fit(self, sample: np.ndarray, dims: int) -> list[Tree]:
        return [Tree(sample, partial(self.directions, t, dims=dims), self.margin(dims)) for t in range(self.directions.trees)]

    def leaves(self, label, x: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaf numbers (tree and path in one) of unit vectors of a label that has ``n``; a row has one leaf or more in each tree."""
        dims = x.shape[1]
        if (label, dims) not in self.trees and (None, dims) not in self.trees:
            self.trees[None, dims] = self._fit(np.zeros((0, dims)), dims)
        trees = self.trees.get((label, dims)) or self.trees[None, dims]
        rows, leaves = [], []
        for t, tree in enumerate(trees):
            row, path = tree.route(x, n, self.leaf, partial(self.directions, t, dims=dims), self.margin(dims))
            rows.append(row)
            leaves.append(mix(path.astype(np.uint64) * np.uint64(64) + np.uint64(t)).view(np.int64))
        return np.concatenate(rows), np.concatenate(leaves)


def unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths in double precision, over their norms; parts are scaled first, so that no norm overflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _route(batches, forest: Forest):
    names = ["node", "g", "v", "copies", "leaves"]
    for whole in batches:
        for start in range(0, whole.num_rows, 4096):
            b = whole.slice(start, 4096)
            labels, g = b.column("label").to_pylist(), b.column("g").to_numpy(zero_copy_only=False)
            order = np.argsort(g, kind="stable")
            ends = np.flatnonzero(np.append(g[order][1:] != g[order][:-1], True)) + 1 if len(g) else []
            for low, high in zip([0, *ends], ends, strict=False):
                part = b.take(pa.array(order[low:high]))
                rows, leaves = forest.leaves(labels[order[low]], unit(part.column("v")), float(part.column("n")[0].as_py()))
                by = np.lexsort((leaves, rows))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[by], np.arange(part.num_rows + 1)).astype(np.int32)), pa.array(leaves[by]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-1]), lists], names)


def compare(node: np.ndarray, copies: np.ndarray, x: np.ndarray, leaves: pa.ListArray, side: np.ndarray, leaf: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one tile: rows of side 0 among themselves if the tile has one side, else side 0 against side 1.

    Returns node, its links that no earlier leaf shares, and the smallest node that links here reach, for rows with any.
    """
    one = not (side == 1).any()
    left = np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    links = np.zeros((len(left), len(right)), bool)
    for s in range(0, len(left), 512):
        links[s : s + 512] = x[left[s : s + 512]] @ x[right].T >= least
    if one:
        np.fill_diagonal(links, False)
    n = np.zeros(len(node), np.int64)
    if not links.any():
        return node[:0], n[:0], node[:0]
    offsets = leaves.offsets.to_numpy() - leaves.offsets[0].as_py()
    every, owner = leaves.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(node)), np.diff(offsets))
    earlier = every < leaf
    kinds, place = np.unique(every[earlier], return_inverse=True)
    fresh = links.copy()
    for k in range(0, len(kinds), 1024):  # pairs that share an earlier leaf were counted there
        own = (place >= k) & (place < k + 1024)
        held = np.zeros((len(node), min(1024, len(kinds) - k)), np.float32)
        held[owner[earlier][own], place[own] - k] = 1
        for s in range(0, len(left), 512):
            fresh[s : s + 512] &= held[left[s : s + 512]] @ held[right].T == 0
    np.add.at(n, left, fresh @ copies[right])
    if not one:
        np.add.at(n, right, fresh.T @ copies[left])
    root = node.copy()
    while True:  # the smallest node reachable: over the links, then over the nodes reached
        old = root.copy()
        for s in range(0, len(left), 512):
            part = links[s : s + 512]
            far = np.where(part, root[right], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            root[left[s : s + 512]] = np.minimum(root[left[s : s + 512]], far)
            if not one:
                back = np.where(part, root[left[s : s + 512]][:, None], np.iinfo(np.int64).max).min(axis=0, initial=np.iinfo(np.int64).max)
                root[right] = np.minimum(root[right], back)
        if (root == old).all():
            break
    keep = (n > 0) | (root != node)
    return node[keep], n[keep], root[keep]


def _compare(batches, least: float):
    """Rows come sorted by tile."""

    def done(table: pa.Table):
        b = table.combine_chunks().to_batches()[0]
        tile, node, copies, side, leaf = (b.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "node", "copies", "side", "leaf"))
        ends = np.flatnonzero(np.append(tile[1:] != tile[:-1], True)) + 1
        out = []
        for low, high in zip([0, *ends], ends, strict=False):
            s = slice(low, high)
            out.append(compare(node[s], copies[s], unit(b.column("v").slice(low, high - low)), b.column("leaves").slice(low, high - low), side[s], leaf[low], least))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "n", "root"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        tile = table.column("tile").to_numpy()
        if table.num_rows >= 8192 and tile[0] != tile[-1]:  # all but the last tile are whole
            cut = int(np.flatnonzero(tile[1:] != tile[:-1])[-1]) + 1
            yield from done(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held:
        yield from done(pa.Table.from_batches(held))


def near_vectors(embeddings: DataFrame, least: float = 0.98, trees: int = 6, leaf: int = 256, spill: float = 0.6, most_values: int = 1_500_000, block: int = 2048) -> DataFrame:
    """One row for each row of embeddings (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors with equal, non-null labels and equal lengths are linked if their cosine, in double precision, is at least ``least``. Vectors that
    are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows with a null vec_id (its component is null,
    it is kept). Equal vectors of one label are one class that is compared once and counts as often as it occurs (repeated rows are
    linked copies); rows of one vec_id with different labels or vectors count apart, and a component's id is the smallest vec_id in it. An
    empty table gives none; other columns are not read. The trees are fitted on the vectors with the smallest hashes, as many as have
    ``most_values`` components in all; every vector is indexed. ``spill`` is in deviations of a just linked pair's projected difference. A leaf
    larger than ``block`` is compared in tiles of two blocks, so the work grows with the square of a group of vectors that are all linked, as do its links.
    """
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0)
    e = e.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("k", F.when(F.col("good"), F.sha2(F.concat_ws(",", F.transform("v", lambda c: (c + F.lit(0.0)).cast("string"))), 256)))
    named = e.where("good").groupBy("label", "k").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = stage(named.withColumns({"node": F.xxhash64("label", "k"), "dims": F.size("v"), "g": F.xxhash64("label", F.size("v"))}), "rp-classes")
    widest = classes.agg(F.max("dims")).first()[0] or 1
    fit = classes.orderBy(F.xxhash64("k"), "node").limit(max(1, most_values // widest)).select("label", "v").toArrow()
    vectors: list = [None] * fit.num_rows
    lengths = pa.compute.list_value_length(fit.column("v")).to_numpy()
    for size in np.unique(lengths):
        own = np.flatnonzero(lengths == size)
        for i, v in zip(own.tolist(), unit(pa.concat_arrays(fit.column("v").take(pa.array(own)).chunks)), strict=True):
            vectors[i] = v
    forest = Forest(fit.column("label").to_pylist(), vectors, trees, leaf, least, spill)
    block = min(block, max(128, (1 << 21) // widest))
    sizes = classes.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    routed = classes.join(sizes, "g").select("node", "g", "label", "v", "copies", "n").mapInArrow(partial(_route, forest=forest), "node long, g long, v array<double>, copies long, leaves array<long>")
    placed = stage(routed, "rp-routed").select("*", F.explode("leaves").alias("leaf"))
    full = placed.groupBy("g", "leaf").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("g", "leaf", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    placed = placed.join(full, ["g", "leaf"]).withColumn("mine", (F.pmod(F.xxhash64("node", "leaf"), F.col("blocks"))).cast("int"))
    # the row goes to its own block, and to the pair of its block with every other one
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("node", "v", "copies", "leaves", "leaf", F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), F.xxhash64("g", "leaf", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"))
    found = stage(dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(partial(_compare, least=least), "node long, n long, root long"), "rp-found")
    label = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "rp")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    each = classes.select("label", "k", "id", "copies", "node").join(counts, "node", "left").join(label.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    each = stage(each.select("label", "k", "id", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "rp-each")
    smallest = each.groupBy("component").agg(F.min("id").alias("component_id"))
    out = e.select("vec_id", "label", "k").join(each.join(smallest, "component").select("label", "k", "n_links", "component_id"), ["label", "k"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

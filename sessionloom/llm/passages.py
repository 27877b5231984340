"""Repeated passages by compact windows.

Tokens are the five-word shingles of a text. For each of several hash functions the Cartesian tree over the token hashes gives
the compact windows: all subsequences whose smallest hash lies at one token, written as (left, centre, right). Texts with
equal signatures (the centre's hash) may share a passage around their centres.

1. Signatures that stand in one text only are found by an aggregation and dropped by a join, so a frequent one is split like any skewed join.
2. Windows of a signature with equal surroundings (every passage of the least length through the centre lies in them) are one
   variant; all its texts hold that stretch word for word. Only variants are compared.
3. Variants of a signature are compared in blocks of bounded size, each with all those it is not yet linked to. If a signature has more
   than one block, the blocks' components are held against the largest one, and only what stays apart from it is
   compared with all other rows.

Every comparison is a verification on the shingles: a stretch through both centres, long and alike enough.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, components, release, stage, text_slices
from .tokens import BASE, INVERSE, NOT_SPACE, Words, _powers, mix, shingles

#: Tokens left and right of a centre at which its text and another one are still compared for words in other places (insertions).
SHIFT = 8
CELLS = 1024


def compact_windows(h: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, left, centre, right of the compact windows of ``least`` tokens or more, level by level of the Cartesian trees.

    Of equal smallest hashes the leftmost is the centre; all of them are taken in one level, so repeated words do not make it deep.
    """
    low, high, row = off[:-1], off[1:], np.arange(len(off) - 1)
    out = []
    while True:
        size = high - low
        wide = np.flatnonzero(size >= least)
        if not len(wide):
            break
        low, high, row, size = low[wide], high[wide], row[wide], size[wide]
        begin = np.cumsum(size) - size
        node = np.repeat(np.arange(len(low)), size)
        place = np.arange(len(node)) + np.repeat(low - begin, size)
        value = h[place]
        hit = np.flatnonzero(value == np.minimum.reduceat(value, begin)[node])
        centre, node = place[hit], node[hit]
        again = np.append(False, node[1:] == node[:-1])
        left = np.where(again, np.append(0, centre[:-1] + 1), low[node])
        right = high[node]
        keep = right - left >= least
        out.append((row[node[keep]], left[keep], centre[keep], right[keep]))
        end = np.append(~again[1:], True)  # the last centre of its node
        low, high, row = np.concatenate([left, centre[end] + 1]), np.concatenate([centre, right[end]]), np.concatenate([row[node], row[node[end]]])
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    row, low, centre, high = (np.concatenate(x) for x in zip(*out, strict=True))
    base = off[row]
    return row, low - base, centre - base, high - base


def windows_of(h: np.ndarray, off: np.ndarray, functions: int, least: int):
    """signature, variant, row, at, lo, hi of all windows, one array of each for every hash function.

    at + lo to at + hi is the stretch within least - 1 tokens of the centre, inside the window; the variant is its hash. Of a run of
    equal tokens only the first is a centre: its window holds those of the others.
    """
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(BASE, len(h)), out=total[1:])
    back = _powers(INVERSE, len(h) + 1)
    for f in range(functions):
        g = mix(h ^ mix(np.array([f + 1], np.uint64)))
        row, low, at, high = compact_windows(g, off, least)
        new = (low < at) | (at == 0) | (h[off[row] + at - 1] != h[off[row] + at])
        row, low, at, high = row[new], low[new], at[new], high[new]
        base = off[row]
        lo, hi = np.maximum(low - at, 1 - least), np.minimum(high - at, least)
        first, last = base + at + lo, base + at + hi
        variant = mix((total[last] - total[first]) * back[first] + ((hi - lo) * 256 - lo).astype(np.uint64))
        yield g[base + at].view(np.int64), variant.view(np.int64), row, at, lo, hi


def _windows(batches, functions: int, least: int, k: int, places: bool):
    """Windows of every text that this task has not met before."""
    met: set[int] = set()
    for whole in batches:
        new = [not (t in met or met.add(t)) for t in whole.column("t").to_pylist()]
        for part in text_slices(whole.filter(pa.array(new, pa.bool_())), most_bytes=1 << 19):
            h, off = shingles(Words(part.column("text"), NOT_SPACE), k)
            t = part.column("t").to_numpy(zero_copy_only=False)
            for signature, variant, row, at, lo, hi in windows_of(h, off, functions, least):
                if places:  # a variant that overlaps itself in a text is one row, from its first place to its last
                    by = np.lexsort((at, variant, row))
                    signature, variant, row, at, lo, hi = (x[by] for x in (signature, variant, row, at, lo, hi))
                    same = (row[1:] == row[:-1]) & (variant[1:] == variant[:-1]) & (signature[1:] == signature[:-1]) & (at[1:] - at[:-1] <= hi[1:] - lo[1:])
                    first = np.flatnonzero(np.append(True, ~same)) if len(row) else np.zeros(0, np.int64)
                    upto = at[np.append(first[1:], len(row)) - 1] if len(row) else at
                    columns = [signature[first], variant[first], t[row[first]], at[first].astype(np.int32), upto.astype(np.int32), lo[first].astype(np.int8), hi[first].astype(np.int8)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["signature", "variant", "t", "at", "upto", "lo", "hi"])
                else:
                    columns = [signature, (variant >> 32).astype(np.int32), (t[row] >> 32).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["signature", "v", "t"])


def _counted(batches):
    for whole in batches:
        for part in text_slices(whole):
            n = np.diff(Words(part.column("text"), NOT_SPACE, lower=False).first)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array(n, pa.int64())], ["doc_id", "t", "n"])


def _contents(batches, k: int):
    """The tokens around each asked centre of a text."""
    for whole in batches:
        for batch in text_slices(whole):
            h, off = shingles(Words(batch.column("text"), NOT_SPACE), k)
            short = (h >> np.uint64(32)).astype("<u4").tobytes()
            asked = batch.column("asked")
            count = np.diff(asked.offsets.to_numpy())
            flat = asked.flatten()
            fields = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
            begin = np.repeat(off[:-1], count) + fields["at"].to_numpy(zero_copy_only=False)
            first, last = ((begin + fields[c].to_numpy(zero_copy_only=False)) * 4 for c in ("lo", "hi"))
            fields |= {"t": pa.array(np.repeat(batch.column("t").to_numpy(zero_copy_only=False), count)), "tokens": pa.array([short[x:y] for x, y in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())}
            rows = pa.RecordBatch.from_arrays([fields[c] for c in CONTENT_NAMES], CONTENT_NAMES)
            for start in range(0, rows.num_rows, 8192):
                yield rows.slice(start, 8192)


CONTENT_NAMES = ["signature", "block", "blocks", "variant", "t", "lo", "tokens"]
CONTENTS = "signature long, block int, blocks int, variant long, t long, lo byte, tokens binary"


class Rows:
    """Variants as rows of 2 * least - 1 tokens with the centre in the middle; which places are there; and a table of CELLS by tokens' low bits."""

    def __init__(self, lo: np.ndarray, tokens: list[bytes], least: int):
        n, width = len(tokens), 2 * least - 1
        flat = np.frombuffer(b"".join(tokens), np.uint32)
        size = np.array([len(x) // 4 for x in tokens], np.int64)
        row = np.repeat(np.arange(n), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo.astype(np.int64) + least - 1, size)
        self.least, self.tokens, self.there = least, np.zeros((n, width), np.uint32), np.zeros((n, width), bool)
        self.tokens[row, place], self.there[row, place] = flat, True
        self.count = np.zeros((n, CELLS), np.float32)
        np.add.at(self.count.reshape(-1), row * CELLS + (flat % np.uint32(CELLS)), 1)

    def may_meet(self, own: slice, other: Rows, theirs: slice, percent: int) -> np.ndarray:
        """Pairs (rows by rows) that can have a passage: the most places of one whose tokens can stand in the other are enough."""
        need = percent * 2 * self.least / (100 + percent) - 1e-3
        a, b = self.count[own], other.count[theirs]
        return (a @ (b > 0).T.astype(np.float32) >= need) & ((a > 0).astype(np.float32) @ b.T >= need)


def _stretch(a: np.ndarray, b: np.ndarray, least: int, loss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of values per place (1: shared, -loss: not, very low: not there) of two texts: whether a stretch of ``least`` places or
    more through the centre has sums of at least 0 in both, and the longest one's first and last place."""
    c, n = least - 1, len(a)
    best, first, last = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = [np.cumsum(x[:, c::-1], axis=1) for x in (a, b)]  # sums of places c - i to c
    right = [np.cumsum(x[:, c:], axis=1) - x[:, c : c + 1] for x in (a, b)]
    for i in range(c + 1):
        ok = (left[0][:, i : i + 1] + right[0] >= -1e-6) & (left[1][:, i : i + 1] + right[1] >= -1e-6)
        far = np.where(ok.any(axis=1), c - np.argmax(ok[:, ::-1], axis=1), -least)
        better = (i + far > best) & (i + far + 1 >= least)
        best[better], first[better], last[better] = (i + far)[better], c - i, c + far[better]
    return best >= 0, first, last


def meet(left: Rows, i: np.ndarray, right: Rows, j: np.ndarray, percent: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of rows i of left and j of right: similarity (0: no passage), the stretch's first and last place, which are the same in both rows.

    A run of ``least`` equal tokens through the centre is a passage of similarity 1. Else the longest stretch through the centre is
    taken in which the tokens that stand in the other text (up to SHIFT places away) are enough for ``percent``, and its
    similarity is counted on the two sets. ``exact``: only the first.
    """
    least = left.least
    c, n = least - 1, len(i)
    similarity, first, last = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return similarity, first, last
    same = (left.tokens[i] == right.tokens[j]) & left.there[i] & right.there[j]
    ends = lambda s: np.where(s.all(axis=1), s.shape[1], np.argmin(s, axis=1))
    before, after = ends(same[:, c::-1]), ends(same[:, c:])
    run = before + after - 1 >= least
    similarity[run], first[run], last[run] = 1.0, c - before[run] + 1, c + after[run] - 1
    need = percent * 2 * least / (100 + percent) - 1e-6
    left_over = np.flatnonzero(~run)
    if exact or not len(left_over):
        return similarity, first, last
    in_x, in_y = left.there[i[left_over]], right.there[j[left_over]]
    x, y = left.tokens[i[left_over]], right.tokens[j[left_over]]
    hit_x, hit_y = same[left_over], same[left_over].copy()
    for d in range(1, SHIFT + 1):
        e = (x[:, d:] == y[:, :-d]) & in_x[:, d:] & in_y[:, :-d]
        hit_x[:, d:] |= e
        hit_y[:, :-d] |= e
        e = (x[:, :-d] == y[:, d:]) & in_x[:, :-d] & in_y[:, d:]
        hit_x[:, :-d] |= e
        hit_y[:, d:] |= e
    some = np.flatnonzero((hit_x.sum(axis=1) >= need) & (hit_y.sum(axis=1) >= need))
    loss = (2 * percent) / (100 - percent) if percent < 100 else 1e6
    values = lambda hit, there: np.where(there, np.where(hit, 1.0, -loss), -1e9)
    ok, p, q = _stretch(values(hit_x[some], in_x[some]), values(hit_y[some], in_y[some]), least, loss)
    for r, a, b in zip(some[ok], p[ok], q[ok], strict=True):
        core = np.flatnonzero(hit_x[r, a : b + 1] & hit_y[r, a : b + 1]) + a  # ends that the other text lacks go, as far as the length allows
        b = max(min(b, core[-1]), a + least - 1)
        a = min(max(a, core[0]), b - least + 1)
        one, two = set(x[r, a : b + 1].tolist()), set(y[r, a : b + 1].tolist())
        both = len(one & two)
        if 100 * both >= percent * (len(one) + len(two) - both):
            similarity[left_over[r]], first[left_over[r]], last[left_over[r]] = both / (len(one) + len(two) - both), a, b
    return similarity, first, last


def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0 to n - 1 that each one reaches over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def spanning(group: np.ndarray, rows: Rows, percent: int, most: int = 2_000):
    """Links between the rows of each group (rows sorted by group): all pairs that can meet are compared, first those of each group's
    first row, then those of the next one, two, four, ..., unless links found before join them.

    Returns the first row that each one reaches, and (i, j, similarity, first place, last place) of the links.
    """
    n = len(group)
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, n))
    pairs = []
    for two in np.split(begin[size == 2], range(most, int((size == 2).sum()), most)):
        pairs.append((two, two + 1))
    for low, m in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        i, j = np.nonzero(rows.may_meet(slice(low, low + m), rows, slice(low, low + m), percent))
        pairs.append((low + i[i < j], low + j[i < j]))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    place = np.arange(n) - np.repeat(begin, size)
    root, links = np.arange(n), []
    for exact in (True, False):  # stretches that are shared word for word first, so that a nearly equal one does not stand for them
        done, step = 0, 1
        left, right = i, j
        while len(left):
            now = place[left] < done + step
            a, b = left[now], right[now]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            for s in range(0, len(a), most):
                p, q = a[s : s + most], b[s : s + most]
                similarity, first, last = meet(rows, p, rows, q, percent, exact)
                yes = similarity > 0
                links.append((p[yes], q[yes], similarity[yes], first[yes], last[yes]))
            left, right = left[~now], right[~now]
            done, step = done + step, step * 2
            if links and len(a):
                root = smallest(n, np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links]))
    empty = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] + [np.zeros(0, np.int64)] * 2
    return root, [np.concatenate(c) for c in zip(*links, strict=True)] if links else empty


MARK_NAMES = ["signature", "variant", "own", "other", "block", "lo", "hi", "similarity"]
#: A variant, its component and the one that it was linked to (the same: inside a block), and the stretch around its centre that it shares; no similarity: none.
MARKS = "signature long, variant long, own long, other long, block int, lo int, hi int, similarity double"


def _marks(signature, variant, own, other, block, first, last, similarity, least: int) -> pa.RecordBatch:
    columns = [signature, variant, own, other, block.astype(np.int32), (first - least + 1).astype(np.int32), (last - least + 2).astype(np.int32)]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(similarity, mask=np.asarray(similarity) == 0)], MARK_NAMES)


def _numbers(batch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def _link(batches, least: int, percent: int, rows: int = 4096):
    """Rows come sorted by signature and block: the mark of each linked variant, and of every one where a signature has more blocks."""

    def done(table: pa.Table):
        b = table.combine_chunks()
        signature, block, blocks, variant, lo = _numbers(b, "signature", "block", "blocks", "variant", "lo")
        group = np.cumsum(np.append(False, (signature[1:] != signature[:-1]) | (block[1:] != block[:-1])))
        root, (i, j, similarity, first, last) = spanning(group, Rows(lo, b.column("tokens").to_pylist(), least), percent)
        for whole in (True, False):  # what is shared word for word, and what nearly
            of = (similarity == 1) == whole
            low, high, worst = np.full(len(signature), 2 * least), np.full(len(signature), -1), np.full(len(signature), 2.0)
            for side in (i[of], j[of]):
                np.minimum.at(low, side, first[of])
                np.maximum.at(high, side, last[of])
                np.minimum.at(worst, side, similarity[of])
            worst[high < 0] = 0
            keep = np.flatnonzero((high >= 0) | (blocks > 1) & whole)
            own = variant[root][keep]
            yield _marks(signature[keep], variant[keep], own, own, block[keep], low[keep], high[keep], worst[keep], least)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        signature, block = _numbers(table, "signature", "block")
        new = np.flatnonzero((signature[1:] != signature[:-1]) | (block[1:] != block[:-1]))
        if len(new):  # all but the last block are whole
            yield from done(table.slice(0, new[-1] + 1))
            held = table.slice(new[-1] + 1).to_batches()
    if held:
        yield from done(pa.Table.from_batches(held))


def _both(signature, v, w, own, other, first, last, similarity, least: int):
    """The marks of both ends of links."""
    none = np.zeros(len(v), np.int64)
    yield _marks(signature, v, own, other, none, first, last, similarity, least)
    yield _marks(signature, w, other, own, none, first, last, similarity, least)


def _pairs(batches, least: int, percent: int):
    """Links between components' first variants and their hubs'."""
    for whole in batches:
        for start in range(0, whole.num_rows, 4096):
            b = whole.slice(start, 4096)
            signature, v, w, lo, other_lo = _numbers(b, "signature", "root", "hub", "lo", "other_lo")
            each = np.arange(b.num_rows)
            similarity, first, last = meet(Rows(lo, b.column("tokens").to_pylist(), least), each, Rows(other_lo, b.column("other_tokens").to_pylist(), least), each, percent)
            yes = np.flatnonzero(similarity > 0)
            yield from _both(signature[yes], v[yes], w[yes], v[yes], w[yes], first[yes], last[yes], similarity[yes], least)


def _tiles(batches, least: int, percent: int):
    """Links between the strays and the members of a tile that have different components."""
    for batch in batches:
        for i in range(batch.num_rows):
            sides = []
            for name in ("strays", "members"):
                rows = batch.column(name).slice(i, 1).flatten()
                f = dict(zip((x.name for x in rows.type), rows.flatten(), strict=True))
                sides.append([f[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("component", "variant")] + [Rows(f["lo"].to_numpy(zero_copy_only=False), f["tokens"].to_pylist(), least)])
            (c, v, left), (d, w, right) = sides
            hub, signature = batch.column("hub")[i].as_py(), batch.column("signature")[i].as_py()
            p, q = np.nonzero((c[:, None] != d) & ((d == hub) | (v[:, None] < w)) & left.may_meet(slice(None), right, slice(None), percent))
            kinds, number = np.unique(np.concatenate([c, d]), return_inverse=True)
            own, other = number[: len(c)], number[len(c) :]
            root, links, step = np.arange(len(kinds)), [], 64
            while len(p):
                a, b, p, q = p[:step], q[:step], p[step:], q[step:]
                similarity, first, last = meet(left, a, right, b, percent)
                yes = similarity > 0
                if yes.any():
                    links.append((a[yes], b[yes], similarity[yes], first[yes], last[yes]))
                    root = smallest(len(kinds), *(np.concatenate(x) for x in zip(*[(own[x[0]], other[x[1]]) for x in links], strict=True)))
                    apart = root[own[p]] != root[other[q]]
                    p, q = p[apart], q[apart]
                step = min(2_000, 2 * step)
            if links:
                a, b, similarity, first, last = (np.concatenate(x) for x in zip(*links, strict=True))
                yield from _both(np.full(len(a), signature), v[a], w[b], c[a], d[b], first, last, similarity, least)


def _passages(batches, k: int, slack: int):
    """The passages of each text: its stretches that overlap, joined. Word-for-word ones come first; another one that reaches up to ``slack``
    tokens beyond them (its unshared ends, as a rule) does not move their ends."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            t = batch.column("t")[i].as_py()
            spans = batch.column("spans").slice(i, 1).flatten()
            rows = sorted(zip(*(c.to_pylist() for c in spans.flatten()), strict=True), key=lambda r: (r[2] < 1, r))
            open_: list[list] = []
            for start, end, similarity, kind in rows:
                near = [p for p in open_ if start <= p[1] and end >= p[0]]
                if not near:
                    open_.append([start, end, similarity, {kind}])
                    continue
                p, more = near[0], 0 if similarity == 1 else slack
                p[0] = start if p[0] - start > more else p[0]
                p[1] = end if end - p[1] > more else p[1]
                p[2] = min(p[2], similarity)
                p[3].add(kind)
                for q in near[1:]:  # joined by this stretch
                    p[0], p[1], p[2] = min(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2])
                    p[3] |= q[3]
                    open_.remove(q)
            out += [(t, p[0], p[1] + k - 1, p[2], sorted(p[3])) for p in open_]
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["t", "start_word", "end_word", "similarity", "kinds"])


def repeated_passages(documents: DataFrame, words: int = 50, k: int = 5, percent: int = 80, functions: int = 3, block: int = 512) -> DataFrame:
    """Passages of ``words`` words or more that stand in more than one document of documents (doc_id, text): one row for each
    passage of a document and the document with the smallest id that has it too, with word ranges (end exclusive) and the least Jaccard
    similarity of the ``k``-word shingles over the stretches that make the passage up.

    Documents with equal texts form a class: the smallest id is compared with other texts, the other copies point to it with
    their whole text. Stretches that overlap in a text are one passage, and passages of texts that share a stretch, directly or through others,
    are one class; its first document is in other_doc_id of all others. A pair at exactly ``percent`` is missed if no function has its smallest
    hash in the shared shingles: 0.2 ** functions at 80 %. Null and shorter texts and rows with a null doc_id have no rows, an empty
    table gives none, repeated rows are copies; of a repeated doc_id with different texts each text counts, and a passage that only these
    share is not listed; other columns are not read. Words are runs of bytes other than ASCII white space, A-Z
    lower-cased. Texts may be of any length. ``block`` bounds the rows compared at once.
    """
    with batches_of(documents.sparkSession, 1000):  # every step that runs Python is staged here
        return _repeated(documents, words, k, percent, functions, block)


def _repeated(documents: DataFrame, words: int, k: int, percent: int, functions: int, block: int) -> DataFrame:
    spark = documents.sparkSession
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    keyed = stage(docs.mapInArrow(_counted, "doc_id long, t long, n long").where(F.col("n") >= words), "cw-keyed")
    classes = stage(keyed.groupBy("t").agg(F.min("doc_id").alias("id")), "cw-classes")
    least = words - k + 1
    windows = docs.select("t", "text")
    make = partial(_windows, functions=functions, least=least, k=k)
    seen = windows.mapInArrow(partial(make, places=False), "signature long, v int, t int").groupBy("signature")
    seen = seen.agg(F.min("t").alias("t1"), F.max("t").alias("t2"), F.min("v").alias("v1"), F.max("v").alias("v2")).where("t1 <> t2")
    shared = stage(seen.select("signature", (F.col("v1") != F.col("v2")).alias("many")), "cw-shared")
    release(spark)
    placed = windows.mapInArrow(partial(make, places=True), "signature long, variant long, t long, at int, upto int, lo byte, hi byte")
    held = stage(placed.join(shared.hint("merge"), "signature"), "cw-held")
    release(spark)
    first = F.min(F.struct("t", "at"))
    variants = held.groupBy("signature", "variant", "lo", "hi", "many").agg(first.alias("first"), (F.min("t") != F.max("t")).alias("same"))
    variants = stage(variants.select("*", "first.*").drop("first"), "cw-variants")

    # different variants of a signature
    blocks = variants.where("many").groupBy("signature").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    asked = variants.join(blocks.hint("merge"), "signature").groupBy("t").agg(F.collect_list(F.struct("signature", F.pmod("variant", F.col("blocks")).cast("int").alias("block"), "blocks", "variant", "at", "lo", "hi")).alias("asked"))
    asked = asked.join(classes.hint("merge"), "t").select("id", "t", "asked")
    texts = docs.select(F.col("doc_id").alias("id"), "t", "text").join(asked.hint("merge"), ["id", "t"]).dropDuplicates(["id", "t"])
    contents = stage(texts.select("t", "text", "asked").mapInArrow(partial(_contents, k=k), CONTENTS), "cw-contents")
    release(spark)
    compare = {"least": least, "percent": percent}
    found = stage(contents.repartition("signature", "block").sortWithinPartitions("signature", "block", "t", "variant").mapInArrow(partial(_link, **compare), MARKS), "cw-links")

    # signatures of more blocks: components against the largest one, then what stays apart against all
    large = contents.where("blocks > 1")
    label = found.join(large.select("signature").distinct(), "signature", "left_semi").select("signature", "variant", F.col("own").alias("root"), "block").distinct()
    label = stage(label, "cw-label")  # read several times below
    roots = label.groupBy("signature", "root").agg(F.count(F.lit(1)).alias("n"))
    hubs = roots.groupBy("signature").agg(F.max(F.struct("n", "root")).alias("hub")).select("signature", F.col("hub.root").alias("hub"))
    row = large.select("signature", "variant", "lo", "tokens")
    other = row.select("signature", F.col("variant").alias("hub"), *[F.col(c).alias(f"other_{c}") for c in ("lo", "tokens")])
    against = roots.join(hubs, "signature").where("root <> hub").join(row.withColumnRenamed("variant", "root"), ["signature", "root"]).join(other, ["signature", "hub"])
    met = stage(against.mapInArrow(partial(_pairs, **compare), MARKS), "cw-hub")
    joined = met.join(hubs, "signature").where("other = hub").select("signature", F.col("own").alias("root"), F.lit(True).alias("joined")).distinct()
    named = label.join(hubs, "signature").join(joined, ["signature", "root"], "left")
    named = named.select("signature", "variant", "hub", F.when(F.col("joined"), F.col("hub")).otherwise(F.col("root")).alias("component"))
    rows = large.join(named, ["signature", "variant"]).withColumn("x", F.struct("lo", "component", "variant", "tokens"))
    rows = stage(rows.select("signature", "hub", "block", "blocks", "component", "x"), "cw-apart")
    strays = rows.where("component <> hub").groupBy("signature", "hub", "blocks", F.col("block").alias("stray_block")).agg(F.collect_list("x").alias("strays"))
    strays = strays.select("signature", "hub", "strays", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    tiles = strays.join(rows.groupBy("signature", "block").agg(F.collect_list("x").alias("members")), ["signature", "block"])
    marks = found.where("similarity is not null").unionByName(met).unionByName(stage(tiles.mapInArrow(partial(_tiles, **compare), MARKS), "cw-tiles"))

    # every window with what its variant shares, the passages of each text, and their classes by way of the signatures' components
    alike = marks.groupBy("signature", "variant").agg(F.min("own").alias("own"), *[f(F.when((F.col("similarity") == 1) == whole, F.col(c))).alias(name) for f, c, name, whole in (
        (F.min, "lo", "run_lo", True), (F.max, "hi", "run_hi", True), (F.min, "lo", "near_lo", False), (F.max, "hi", "near_hi", False), (F.min, "similarity", "similarity", False),
    )])
    told = variants.select("signature", "variant", "lo", "hi", "same").join(alike, ["signature", "variant"], "left")
    marked = held.select("signature", "variant", "t", "at", "upto").join(told.hint("merge"), ["signature", "variant"])
    marked = stage(marked.select("t", "at", "upto", "lo", "hi", "same", "run_lo", "run_hi", "near_lo", "near_hi", "similarity", F.xxhash64("signature", F.coalesce("own", "variant")).alias("kind")), "cw-marked")
    span = lambda lo, hi, similarity: F.struct((F.col("at") + F.col(lo)).cast("int").alias("start"), (F.col("upto") + F.col(hi)).cast("int").alias("end"), similarity.alias("similarity"), "kind")
    spans = F.filter(F.array(F.when(F.col("same"), span("lo", "hi", F.lit(1.0))), F.when(F.col("run_lo").isNotNull(), span("run_lo", "run_hi", F.lit(1.0))), F.when(F.col("similarity").isNotNull(), span("near_lo", "near_hi", F.col("similarity")))), lambda x: x.isNotNull())
    each = marked.where("same or run_lo is not null or similarity is not null").groupBy("t").agg(F.flatten(F.collect_set(spans)).alias("spans"))
    found_in = stage(each.mapInArrow(partial(_passages, k=k, slack=int(least * (100 - percent) / (100 + percent))), "t long, start_word long, end_word long, similarity double, kinds array<long>"), "cw-passages")
    edges = found_in.select(F.col("kinds")[0].alias("a"), F.explode("kinds").alias("b")).distinct()
    edges = edges.unionByName(marks.where("own <> other").select(F.xxhash64("signature", "own").alias("a"), F.xxhash64("signature", "other").alias("b")))
    label = components(edges, "cw").withColumnRenamed("id", "kind")
    listed = found_in.join(classes.select("t", F.col("id").alias("doc_id")), "t").withColumn("kind", F.col("kinds")[0]).join(label, "kind", "left")
    listed = stage(listed.select("doc_id", "start_word", "end_word", "similarity", F.coalesce("component", "kind").alias("component")), "cw-listed")
    heads = listed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").alias("other_doc_id"), F.col("start_word").alias("other_start_word"), F.col("end_word").alias("other_end_word"))).alias("head"))
    near = listed.join(heads, "component").select("doc_id", "start_word", "end_word", "head.*", "similarity").where("doc_id <> other_doc_id").distinct()
    copies = keyed.join(classes.hint("merge"), "t").where("doc_id <> id").select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"), F.col("id").alias("other_doc_id"), F.lit(0).cast("long").alias("other_start_word"), F.col("n").alias("other_end_word"), F.lit(1.0).alias("similarity"))
    return near.unionByName(copies.distinct())

import random

import numpy as np
import pyarrow as pa

from sessionloom.llm import passages, rpforest
from sessionloom.llm.tokens import NOT_SPACE, Words, shingles


def brute_windows(h, least):
    out = []

    def go(low, high):
        if high - low >= least:
            at = low + int(np.argmin(h[low:high]))
            out.append((low, at, high))
            go(low, at)
            go(at + 1, high)

    go(0, len(h))
    return sorted(out)


def test_compact_windows_equal_recursion():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 50, n).astype(np.uint64) << np.uint64(40) for n in (0, 3, 40, 200, 1)]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    row, left, centre, right = passages.compact_windows(np.concatenate(parts), off, 5)
    for i, p in enumerate(parts):
        mine = row == i
        assert sorted(zip(left[mine], centre[mine], right[mine])) == brute_windows(p, 5)


def test_repeated_passages(spark):
    rng = random.Random(1)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = fresh(60)
    near = passage.split()
    near[30] = "changed"
    rows = [(i, f"{fresh(80)} {passage} {fresh(40)}") for i in range(1, 9)]
    rows += [(20, f"{' '.join(near)} {fresh(90)}"), (21, fresh(200)), (22, fresh(30)), (23, None), (24, ""), (None, passage), (25, fresh(5000)), (26, rows[0][1]), (26, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as place")
    got = passages.repeated_passages(df).collect()
    met = {x for r in got for x in (r.doc_id, r.other_doc_id)}
    assert met == {*range(1, 9), 20, 26}
    text = dict(r for r in rows if r[0] is not None)
    for r in got:
        assert r.end_word - r.start_word >= 50 and r.similarity >= 0.8
        if r.doc_id < 20:
            assert text[r.doc_id].split()[r.start_word : r.end_word] == passage.split() == text[r.other_doc_id].split()[r.other_start_word : r.other_end_word]
    assert passages.repeated_passages(df.limit(0)).count() == 0


def test_labels_of_large_signatures_are_worked_out_once(spark, monkeypatch):
    rng = random.Random(2)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line, passage = fresh(20), fresh(60)
    rows = [(i, f"{fresh(70)} {line} {fresh(70)}") for i in range(40)] + [(100 + i, f"{fresh(60)} {passage} {fresh(60)}") for i in range(3)]
    plans, real = {}, passages.stage

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(passages, "stage", kept)
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), block=8).collect()
    assert {x for r in got for x in (r.doc_id, r.other_doc_id)} == {100, 101, 102}
    assert sum(plan.count("LeftSemi") for plan in plans.values()) == 1


def holders_met(got, holders):
    """Whether the rows join all holders."""
    of = {x: x for x in holders}
    for r in got:
        a, b = of.get(r.doc_id), of.get(r.other_doc_id)
        if a is not None and b is not None and a != b:
            of = {x: b if v == a else v for x, v in of.items()}
    return len(set(of.values())) == 1


def test_partial_quotes_do_not_hide_a_passage(spark):
    rng = random.Random(4)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, want = [], []
    for case in range(12):
        base, passage = case * 1000, fresh(60)
        want.append({base, base + 999})
        rows += [(base, f"{fresh(60)} {passage} {fresh(60)}"), (base + 999, f"{fresh(60)} {passage} {fresh(60)}")]
        for j in range(40 if case % 2 else 8):  # quotes of 20 words from all over the passage
            start = rng.randrange(41)
            rows.append((base + 1 + j, f"{fresh(60)} {' '.join(passage.split()[start : start + 20])} {fresh(60)}"))
    line = fresh(20)
    rows += [(50_000 + i, f"{fresh(60)} {line} {fresh(60)}") for i in range(60)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(holders_met(got, w) for w in want), [holders_met(got, w) for w in want]
    assert {x for r in got for x in (r.doc_id, r.other_doc_id)} == set().union(*want)


def test_blocks_do_not_change_who_is_joined(spark):
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, two, line = fresh(60), fresh(64), fresh(18)
    two = " ".join([*two.split()[:20], *one.split()[20:38], *two.split()[38:]])  # two passages with a stretch in common
    rows = [(i, f"{fresh(50)} {(one, two, line)[i % 3]} {fresh(50)}") for i in range(150)]
    rows += [(200 + i, f"{fresh(50)} {' '.join('x' if j == 12 + i else w for j, w in enumerate(one.split()))} {fresh(50)}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (8, 512):
        got = passages.repeated_passages(df, block=block).collect()
        assert holders_met(got, [*range(0, 150, 3), *range(200, 212)]) and holders_met(got, range(1, 150, 3))
        assert not {x for r in got for x in (r.doc_id, r.other_doc_id)} & {*range(2, 150, 3)}
        assert {r.other_doc_id for r in got} == {0, 1}


def test_repeated_words_beside_a_common_line(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    cycle = "one two three four five six "
    rows = [(i, f"{fresh(60)} {cycle * (12 if i in (0, 39) else 2)} {fresh(60)}") for i in range(40)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert holders_met(got, {0, 39})


def test_texts_of_any_length(spark):
    rng = np.random.default_rng(7)
    passage = " ".join(f"p{x}" for x in rng.integers(0, 10**6, 60))
    long = " ".join(map(str, rng.integers(0, 10**5, (1 << 21) + 10).tolist()))
    got = passages.repeated_passages(spark.createDataFrame([(1, f"{long} {passage}"), (2, f"a b {passage} c")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.other_doc_id, r.other_start_word, r.other_end_word) for r in got] == [(2, 2, 62, 1, (1 << 21) + 10, (1 << 21) + 70)]
    h = rng.integers(0, 1 << 63, (1 << 22) + 5).astype(np.uint64)
    _, left, centre, right = passages.compact_windows(h, np.array([0, len(h)]), 1 << 20)
    assert sorted(zip(left, centre, right)) == brute_windows(h, 1 << 20)


def test_shingles_of_short_rows():
    h, off = shingles(Words(pa.array(["a b c d", "a b", None, "", "A B", "b a"]), NOT_SPACE), 3)
    assert list(np.diff(off)) == [2, 1, 0, 0, 1, 1] and h[2] == h[3] != h[4]


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    rows = []
    for i in range(700):
        v = centres[i % 12] + rng.standard_normal(16) * (0.01 + 0.2 * (i % 3))
        rows.append((i, [float(x) for x in v], i % 2 if i % 50 else None))
    rows += [(1000 + i, rows[5][1], 1) for i in range(30)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1), (None, rows[5][1], 1), (2004, [], 1), (2005, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as copies", "3 as k")
    got = {r.vec_id: r for r in rpforest.near_vectors(df, leaf=32, block=64, trees=8).collect()}
    assert len(got) == len(rows)
    fine = [r for r in rows if r[0] is not None and r[0] < 2000 and r[2] is not None]
    x = np.array([r[1] for r in fine])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in fine])
    links = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(links, False)
    root = np.arange(len(fine))
    for _ in range(len(fine)):
        new = np.minimum(root, np.where(links, root, len(fine)).min(axis=1))
        if (new == root).all():
            break
        root = new
    for r, n, c in zip(fine, links.sum(axis=1), root):
        assert (got[r[0]].n_links, got[r[0]].component_id) == (n, fine[c][0])
    odd = [got[r[0]] for r in rows if r[0] is not None and (r[0] >= 2000 or r[2] is None)]
    assert all(r.n_links == 0 and r.kept and r.component_id == r.vec_id for r in odd)
    assert rpforest.near_vectors(df.limit(0)).count() == 0

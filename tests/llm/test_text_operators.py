import hashlib
import re

import public_tokenizers
import pytest

from sessionloom.llm import bpe, ctph, minhash

ODD = [
    (9, "the quick brown fox jumps over the lazy dog again and again until night"),
    (8, "The quick brown fox jumps over the lazy dog again and again until night"),
    (7, None),
    (6, ""),
    (5, "one"),
    (4, " \t one\n"),
    (3, "é中文😀 'll x" * 50),
    (2, "word " * 30_000),
    (None, "the quick brown fox"),
    (1, "the quick brown fox jumps over the lazy dog again and again until dawn"),
]


def frame(spark, rows, extra=True):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.selectExpr("*", "1 as n_shingles", "'x' as ids", "2 as part") if extra else docs


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if w]


def brute_components(rows, k, percent):
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w := words(t)) >= k else {tuple(w)} if w else set() for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    chain = "a b c d e f g h i j k l m n o p q r s t".split()
    rows = ODD + [(100 + i, " ".join(chain[i:] + [f"z{j}" for j in range(i)])) for i in range(6)] + [(200 + i, "same text for all of us here") for i in range(40)]
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, rows), shingle=k).collect()}
    want = brute_components(rows, k, 80)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items() if i is not None} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items() if i is not None)
    assert got[None].component_id is None and got[None].kept


def test_large_buckets_are_compared_in_blocks(spark):
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # copies whose similarities lie around the threshold
        text = list(base)
        for at in rng.sample(range(120), rng.choice([2, 5, 8, 12])):
            text[at] = f"x{i}-{at}"
        rows.append((i, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows), shingle=2, block=8).collect()}
    assert got == brute_components(rows, 2, 80)


def test_python_gets_a_few_megabytes_at_a_time(spark, monkeypatch, tmp_path):
    import uuid

    confirm = minhash._confirm

    def seen(batches, percent):
        def each():
            for b in batches:
                (tmp_path / uuid.uuid4().hex).write_text(str(b.nbytes))
                yield b

        yield from confirm(each(), percent)

    monkeypatch.setattr(minhash, "_confirm", seen)
    limits = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    was = [spark.conf.get(x) for x in limits]
    words = [f"w{i}" for i in range(20_000)]
    got = minhash.near_duplicates(frame(spark, [(i, " ".join([f"x{i}", *words])) for i in range(80)])).collect()
    assert {r.component_id for r in got} == {0}
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert sum(sizes) > 20e6 and max(sizes) < 6e6
    assert was == [spark.conf.get(x) for x in limits]


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def test_sketches_merge_and_estimate():
    import numpy as np

    h = np.arange(1, 3001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one, two, both = (minhash.sketch(x, np.array([0, len(x)])) for x in (h[:2000], h[500:], h))
    assert (minhash.merge(one, two) == both).all()
    got = minhash.likely_jaccard(one, two, np.array([2000.0]), np.array([2500.0]))[0]
    assert abs(got - 1500 / 3000) < 0.2


def test_fingerprints_follow_descending_ids(spark):
    rows = [r for r in ODD if r[0] is not None] + [(i, f"text number {i} " * 5) for i in range(20, 60)]
    for size in (3, 1000):
        got = {r.doc_id: r for r in ctph.fingerprints(frame(spark, rows), rows_a_part=size).collect()}
        ordered = sorted(rows, reverse=True)
        for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1]):
            t, u = t or "", u or ""
            new = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
            r = got[i]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
            assert r.fingerprint == ctph.fingerprint(t.encode()) and r.edited_fingerprint == ctph.fingerprint(new.encode())
            assert r.near_edited == ctph.likeness(r.fingerprint, r.edited_fingerprint) and 0 <= r.near_next <= 1
        assert len(got) == len(rows)
    assert ctph.fingerprints(frame(spark, [])).collect() == []


def test_one_document_and_null_ids_follow_themselves(spark):
    assert [r.near_next for r in ctph.fingerprints(frame(spark, [(1, "alone " * 30)])).collect()] == [1.0]
    assert len(ctph.fingerprints(frame(spark, [(None, "a"), (None, None), (3, "b"), (3, "b")]), rows_a_part=1).collect()) == 4


def test_encoding_equals_the_library(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = bpe.Vocabulary.read(open(path, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rows = ODD + [(50, "<|endoftext|> \x00\x1c\x85 don't"), (51, "antidisestablishmentarianism" * 20)]
    out = bpe.encode(frame(spark, rows), path, public_tokenizers.PATTERN, with_ids=True, keep=("doc_id", "part")).collect()
    text = dict(rows)
    for r in out:
        ids = library.encode_ordinary(text[r.doc_id] or "")
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest()
    assert len(out) == len(rows)


def test_prefix_tables_append_and_edit():
    vocabulary = bpe.Vocabulary.read(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    grown = bpe.Prefixes(vocabulary, b"unbeliev").append(b"ably rewor").append(b"ded")
    assert grown.ids() == bpe.Prefixes(vocabulary, b"unbelievably reworded").ids()
    assert grown.edit(2, 4, b"help").ids() == bpe.Prefixes(vocabulary, b"unhelplievably reworded").ids()

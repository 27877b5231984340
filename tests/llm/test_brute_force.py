"""Operators against plain versions written for these tests alone."""

import hashlib
import math
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionloom.llm import ctph, langid, mixing, pii, queries, quality, rpforest
from sessionloom.llm.tokens import BASE, BYTE_CODE, mix

SF = "/root/testdata/sf0.001"


def linked(rows, least=0.98):
    """n_links and component of each row index by all pairs."""
    n, links = len(rows), defaultdict(set)
    for label in {r[2] for r in rows}:
        for size in {len(r[1]) for r in rows if r[2] == label}:
            own = [i for i in range(n) if rows[i][2] == label and len(rows[i][1]) == size]
            x = np.array([rows[i][1] for i in own])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for a, b in zip(*np.nonzero(x @ x.T >= least)):
                if a != b:
                    links[own[a]].add(own[b])
    root = {}
    for i in range(n):
        if i not in root:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            low = min(rows[j][0] for j in seen)
            root |= dict.fromkeys(seen, low)
    return {rows[i][0]: (len(links[i]), root[i]) for i in range(n)}


def test_registered_settings_find_every_pair_near_the_threshold(spark):
    rng, rows = np.random.default_rng(8), []
    for label, dims in ((0, 64), (1, 64), (0, 16), (2, 200)):
        base = rng.standard_normal((1500, dims))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        side = rng.standard_normal((1500, dims))
        side -= (side * base).sum(axis=1, keepdims=True) * base
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        c = np.where(np.arange(1500) % 2, 0.9801, 0.9799)[:, None]
        for v in np.concatenate([base, c * base + np.sqrt(1 - c * c) * side]):
            rows.append((len(rows), [float(z) for z in v], label))
    centre = rng.standard_normal(64)
    rows += [(len(rows) + i, [float(z) for z in centre + 0.06 * rng.standard_normal(64)], 1) for i in range(700)]  # a dense group
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in rpforest.near_vectors(df).collect()}
    want = linked(rows)
    pairs = sum(n for n, _ in want.values())
    assert pairs > 100_000 and sum(n for n, _ in got.values()) >= 0.9999 * pairs
    assert all(got[i][0] <= n for i, (n, _) in want.items())
    assert sum(got[i] == x for i, x in want.items()) >= 0.999 * len(want)


def test_mixed_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(z) for z in rng.standard_normal(3)], 1) for i in range(600)] + [(600, [1.0, 0.0, 0.0, 0.0], 1), (601, [2.0, 0.0, 0.0, 0.0], 1), (602, [1e200, 1e200], 1), (603, [1e-200, 1e-200], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in rpforest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), leaf=32).collect()}
    want = linked([(i, [x / max(map(abs, v)) for x in v], y) for i, v, y in rows])
    assert got == want and got[600] == (1, 600) and got[603] == (1, 602)
    again = spark.createDataFrame([(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 2), (6, [1.0, 0.01], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in rpforest.near_vectors(again).collect()) == [(5, 0, 5), (5, 1, 5), (6, 1, 5)]


def words_of(text):
    out, word = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        else:
            out += [word] if word else []
            word = ""
    return out


def test_language_scores_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").limit(60).collect()
    known, asked = docs[:40], docs[40:]
    odd = ["Ärger über Öl", "日本語のテキスト", "это пример", "naïve—“quoted” text…", "x", "12", "हिन्दी भाषा"]
    model = langid.learn(spark.createDataFrame([(r.text, r.lang) for r in known] + [("日本語です", "ja"), ("русский текст", "ru")], "text string, lang string"))
    ask = spark.createDataFrame(list(enumerate([*(r.text for r in asked), *odd])), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(ask, model).collect()}
    counts = [defaultdict(Counter) for _ in range(5)]
    for text, lang in {(r.text, r.lang) for r in known} | {("日本語です", "ja"), ("русский текст", "ru")}:
        for w in words_of(text):
            counts[0][lang][w] += 1
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts[k][lang][w[i : i + k]] += 1
    langs = sorted(counts[0])
    assert langs == model.languages
    kinds = [{x for c in counts[k].values() for x in c} for k in range(5)]
    log = lambda k, x, y: math.log((counts[k][y][x] + 0.01) / (sum(counts[k][y].values()) + 0.01 * len(kinds[k])))
    for i, text in enumerate([*(r.text for r in asked), *odd]):
        total = dict.fromkeys(langs, 0.0)
        for w in words_of(text):
            for k in (0, 4, 3, 2, 1):
                found = [g for g in ([w] if k == 0 else [w[j : j + k] for j in range(len(w) - k + 1)]) if g in kinds[k]]
                for g in found:
                    for y in langs:
                        total[y] += log(k, g, y) / len(found)
                if found:
                    break
        best = max(langs, key=lambda y: total[y])
        p = 1 / sum(math.exp(v - total[best]) for v in total.values())
        if any(c.isalpha() for c in text):
            assert abs(got[i].score - p) < 1e-3 and (got[i].lang_pred == best or sorted(total.values())[-1] - sorted(total.values())[-2] < 1e-3), text
        else:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)


def plain_fingerprint(data):
    """The same definition, byte by byte."""
    n, m32, m64 = len(data), (1 << 32) - 1, (1 << 64) - 1
    if not n:
        return "3::"

    def rolled(i):
        x = 0
        for j in range(max(0, i - 6), i + 1):
            x = (x + (data[j] + 1) * pow(0x01000193, i - j, 1 << 32)) & m32
        x = ((x ^ (x >> 15)) * 0x2C1B3C6D) & m32
        return x ^ (x >> 13)

    roll = [rolled(i) for i in range(n)]

    def letters(size, most):
        ends = [i + 1 for i in range(n) if roll[i] % size == size - 1]
        if not ends or ends[-1] != n:
            ends.append(n)
        if len(ends) > most:
            ends = [*ends[: most - 1], ends[-1]]
        out, start = "", 0
        for end in ends:
            h = sum(int(BYTE_CODE[data[start + j]]) * pow(int(BASE), j, 1 << 64) for j in range(end - start))
            out += ctph.LETTERS[int(mix(np.array([(h + end - start) & m64], np.uint64))[0]) >> 58]
            start = end
        return out

    size = 3
    while size * 64 < n:
        size *= 2
    while size > 3 and sum(x % size == size - 1 for x in roll) < 32:
        size //= 2
    return f"{size}:{letters(size, 64)}:{letters(2 * size, 32)}"


def test_fingerprints_equal_a_plain_version(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 2500").limit(40).collect()]
    for text in [*texts, "", "a", "é" * 9, "aaaa" * 300]:
        assert ctph.fingerprint(text.encode()) == plain_fingerprint(text.encode())


def test_weights_minimise_the_loss():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, len(quality.FEATURES)))
    y = (x[:, 0] + 0.5 * x[:, 3] + rng.standard_normal(300) > 0).astype(int)
    model = quality.Model(x, y, 0.3, 4)
    good, poor, again = np.flatnonzero(y == 1), np.flatnonzero(y == 0), np.random.default_rng(7)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    count = 4 * max(len(good), len(poor))
    d = z[again.choice(good, count)] - z[again.choice(poor, count)]

    def loss(w):
        return np.log1p(np.exp(-d @ w)).mean() + 0.5e-3 * w @ w

    best = loss(model.weights)
    for _ in range(200):
        assert loss(model.weights + 0.02 * rng.standard_normal(len(model.weights))) >= best
    s = model.score(x)
    right = ((s >= 0.3) == (y == 1)).mean()
    assert all(right >= ((z @ model.weights >= t) == (y == 1)).mean() - 1e-9 for t in np.quantile(z @ model.weights, np.linspace(0, 1, 1001)))


def test_mixture_equals_plain_raking(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    got = {r.doc_id: r for r in queries.op9_raked_mixture(spark, SF).collect()}
    rows = docs.withColumn("topic", mixing.topic_of(F.col("text"))).collect()
    cell, tokens = {}, Counter()
    for r in rows:
        cell[r.doc_id] = (r.source or "(none)", r.lang or "(none)", r.topic)
        tokens[cell[r.doc_id]] += len([w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in r.text or "").split(" ") if w])
    names = sorted(tokens)
    t = np.array([tokens[c] for c in names], float)
    sides = [np.array([sorted({c[k] for c in names}).index(c[k]) for c in names]) for k in range(3)]
    total = [np.bincount(s, t)[s] for s in sides]
    target = [n**0.5 / np.sum(np.unique(s, return_index=True)[1] * 0 + np.bincount(s, t) ** 0.5) for n, s in zip(total, sides)]
    w = t.copy()
    for _ in range(12):
        for s, goal in zip(sides, target):
            w = w * goal / np.bincount(s, w)[s]
    most = min(0.5 * t.sum(), *[(n / goal).min() for n, goal in zip(total, target)])
    w = np.minimum(t, w * most / w.sum())
    for _ in range(32):
        for s, goal in zip(sides, target):
            w = np.minimum(t, w * goal * most / np.bincount(s, w)[s])
    p = dict(zip(names, np.minimum(1, w / t)))
    kept = {d for d, c in cell.items() if int(hashlib.md5(str(d).encode()).hexdigest()[:12], 16) / 2**48 < p[c]}
    assert kept == set(got)
    assert all(abs(got[d].probability - p[cell[d]]) < 1e-6 for d in kept)


def test_surrogates_of_all_documents_are_one_to_one(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").collect()}
    there, back, touched = {}, {}, 0
    replacer = pii.Replacer(queries.KEY.encode())
    for r in queries.op6_pii_surrogates(spark, SF.replace("0.001", "0.01")).collect():
        new, found = replacer(texts[r.doc_id] or "")
        assert (r.text or "") == new and r.n_entities == len(found)
        touched += bool(found)
        for kind, old, now in found:
            assert there.setdefault((kind, old), now) == now and back.setdefault((kind, now), old) == old and (old != now or len(old) < 4)
    assert touched > 20


@pytest.mark.parametrize("text, kind", [("4111 1111 1111 1111", "card"), ("4111111111111112", "card"), ("GB82 WEST 1234 5698 7654 32", "iban"), ("DE12 ABCD EFGH IJKL", "iban")])
def test_check_digits_stay_right_or_wrong(text, kind):
    right = {"card": lambda x: pii._luhn("".join(c for c in x if c.isdigit())), "iban": lambda x: pii._iban_rest(x) == 1}[kind]
    for i in range(50):
        now = pii.surrogate(kind, text, "", b"k%d" % i)
        assert right(now) == right(text) and len(now) == len(text) and now != text


def test_names_keep_script_gender_and_person():
    new, found = pii.Replacer(b"k")("Mr. Иван Петров and Mrs. Zelda Meyer. Then Zelda met Петров, Meyer's friend.")
    assert [k for k, *_ in found] == ["name", "name", "given", "surname", "surname"]
    first, second = new.split()[1:3]
    assert first in pii.NAMES["m cyrillic"] and all("Ѐ" <= c <= "ӿ" for c in second)
    zelda, meyer = new.split()[5], new.split()[6].rstrip(".")
    assert zelda.endswith("a") and zelda != "Zelda" and f"Then {zelda} met {second}, {meyer}'s friend." in new


CLASHES = {"score": 1.5, "lang_pred": "x", "kinds": "k", "n_entities": 3, "entities": "e", "_topic": "t", "_source": "s", "_lang": "l", "_p": 0.1, "_tokens": 2, "id": 7, "t": 8, "h": 9, "component_id": 1, "kept": True, "registers": 2, "rank": 4, "n": 5, "rows": 6}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_clashing_columns_and_odd_rows(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(900_000, None, None, None, 0), (900_001, "", "en", "src1", 0), (900_002, "the and of " * 40_000, "en", "src1", 440_000), (900_003, "1 2 3", None, None, 5), (None, "the house and the garden", "en", "src1", 24), (900_004, "the house and the garden", "en", "src1", 24), (900_004, "the house and the garden", "en", "src1", 24)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    plain = sorted(str(r.asDict()) for r in dict(corpus_pipeline.STAGES)[name](spark, docs, SF).collect())
    wide = docs.select("*", *[F.lit(v).alias(c) for c, v in CLASHES.items()])
    out = dict(corpus_pipeline.STAGES)[name](spark, wide, SF)
    rows = out.collect()
    if name == corpus_pipeline.STAGES[-1][0]:
        assert sorted(str(r.asDict()) for r in rows) == plain
    else:
        assert out.columns == wide.columns and all(r[c] == v for r in rows for c, v in CLASHES.items())
        assert sorted(str({c: r[c] for c in docs.columns}) for r in rows) == plain
    assert dict(corpus_pipeline.STAGES)[name](spark, wide.limit(0), SF).count() == 0

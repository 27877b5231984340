import pathlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionloom.llm import langid, licences, quality

SF = "/root/testdata/sf0.001"
ODD = [(901, None), (902, ""), (903, "12 34 !!"), (904, "word " * 20_000), (905, "\x00\t"), (None, "the the")]


def test_language_backs_off_to_shorter_grams(spark):
    rng = random.Random(1)
    make = lambda parts, n: " ".join(rng.choice(parts) + rng.choice(parts) for _ in range(n))
    en, de = ["the", "ing", "th", "ow"], ["sch", "ung", "ei", "ück"]
    rows = [(make(en, 30), "en") for _ in range(30)] + [(make(de, 30), "de") for _ in range(30)] + [(None, "de"), ("schei", None)]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    ask = [(1, "thingowth ingowing"), (2, "schungeiück eiungsch"), (3, "THINGOW"), *ODD]
    df = spark.createDataFrame(ask, "doc_id long, text string").selectExpr("*", "'x' as lang_pred_", "1 as score_")
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["en", "de", "en"]
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (901, 902, 903, 905))
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(ask)
    assert langid.predict(df.limit(0), model).count() == 0
    nothing = langid.learn(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    out = langid.predict(docs.where(held), langid.learn(docs.where(~held)), keep=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in out)


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score(docs, quality.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    good, poor = ([r.score for r in out if r.quality == q] for q in (1, 0))
    assert sum(a > b for a in good for b in poor) >= 0.95 * len(good) * len(poor)
    assert all((r.score >= 0.3) == (r.predicted == 1) and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in out)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD + [(1, "good text of words"), (2, "bad bad bad bad"), (2, "bad bad bad bad")], "doc_id long, text string").selectExpr("*", "1 as quality", "2.0 as score")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    for given in (labels, labels.limit(0), labels.where("quality = 0")):
        got = quality.score(docs, quality.learn(docs, given, folds=1000)).collect()
        assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
    assert quality.score(docs.limit(0), quality.learn(docs, labels)).count() == 0


def brute_licences(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[1] for h in hits}))


def test_licences_equal_brute_force(spark):
    notice = "This work is licensed under the GNU General Public License, version 3."
    rows = [*ODD, (1, notice), (2, f"é {notice} x {notice}"), (3, "Apache--License cc-by mit license MIT LICENSE ccby"), (4, "gnu general public"), (5, "CC BY-NC 4.0 " * 3000), (6, "Licensed under CC BY-NC 4.0."), (1, notice)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'' as labels", "1 as n_words")
    got = licences.scan(df).collect()
    text = dict(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licences(text[r.doc_id]), r
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in got}
    assert labels[1] == "gpl,gpl-3.0-notice" and labels[6] == "cc-by,cc-by-nc-4.0-notice" and labels[4] == ""
    assert len(got) == len(rows) and licences.scan(df.limit(0)).count() == 0


def test_whole_licence_texts(spark):
    texts = {p.read_text().split("\n", 1)[0]: p.read_text().split("\n", 3)[3] for p in (pathlib.Path(licences.__file__).parent / "licence_texts").glob("*.txt")}
    named = texts["bsd-3-clause-text"].replace("the copyright holder nor", "Example Widgets and Sons Incorporated nor")
    broken = texts["mit-licence-text"].replace("IS PROVIDED", "IS NOT PROVIDED")
    half = " ".join(texts["isc-text"].split()[:40])
    rows = [(i, f"x {t} y") for i, t in enumerate(texts.values())] + [(100, f"Copyright 2001\n{named}"), (101, broken), (102, half), (103, " ".join(reversed(texts["mit-licence-text"].split())))]
    got = {r.doc_id: set(r.labels.split(",")) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(texts):
        assert label in got[i], label
    assert "bsd-3-clause-text" in got[100] and "mit-licence-text" not in got[101] | got[103] and "isc-text" not in got[102]
    assert "bsd-2-clause-text" not in got[102] and "gpl-header" not in got[list(texts).index("lgpl-header")]


def test_pipeline_stages_keep_their_contracts(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900_000, None, "en", "src1", 0), (900_001, "1234", None, "src1", 4)], docs.schema)
    rows, kept = docs.unionByName(extra), None
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, rows, SF)
        out.write.parquet(str(tmp_path / name.split()[0]))
        out = spark.read.parquet(str(tmp_path / name.split()[0]))
        now = {r.doc_id for r in out.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        if kept is None:
            assert now == {r.doc_id for r in docs.collect()}
        else:
            assert now <= kept and now
        kept, rows = now, out
    last = rows.collect()
    assert all(len(r.ids) == r.n_tokens for r in last)
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", ["language ID", "PII surrogates", "mixing to target weights", "byte-level BPE"])
def test_stages_take_empty_tables(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).count() == 0


def test_every_language_is_learned(spark):
    rows = [(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}q " * 3, f"l{i:03d}") for i in range(230)]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == sorted(x for _, x in rows)
    got = langid.predict(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string"), model).collect()
    assert all(r.lang_pred == rows[r.doc_id][1] for r in got)

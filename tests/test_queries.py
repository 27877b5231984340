"""Every registered query of the log library against its SQL in DuckDB on the smallest tables."""

import math
import os
import subprocess
import sys

import pytest

from sessionloom.plans import catalog

SF = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    out = duck.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_library_stands_without_the_corpus_package(tmp_path):
    import shutil

    for what in ("sessionloom", "__spark_entry__.py"):
        source, target = os.path.join(HERE, what), tmp_path / what
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, target)
    shutil.rmtree(tmp_path / "sessionloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert e.corpus is None; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) == len(catalog.queries())


def _unit(v):
    size = math.sqrt(sum(x * x for x in v.values()))
    return {t: x / size for t, x in v.items()} if size else {}


def _dot(a, b):
    return sum(x * b[t] for t, x in a.items() if t in b)


def _concepts(queries, docs, topn):
    """BM25 vectors of whole documents, by loops."""
    bags = {i: t.split() for i, t in docs}
    mean = sum(map(len, bags.values())) / len(bags)
    out = {}
    for q in queries:
        score = {}
        for w in q.split():
            df = sum(w in b for b in bags.values())
            for i, b in bags.items():
                if w in b:
                    score[i] = score.get(i, 0) + math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / mean))
        best = sorted(score, key=lambda i: (-round(score[i], 9), str(i)))[:topn]
        out[q] = _unit({i: score[i] for i in best})
    return out


def _char_vectors(rows):
    """Smooth tf-idf of 2- to 4-grams inside padded words, by loops."""
    bags = [[f" {w} "[i : i + n] for w in q.split() for n in (2, 3, 4) for i in range(max(1, len(w) + 3 - n)) if n == 2 or len(w) + 2 > n - 1] for q in rows]
    idf = {g: math.log((1 + len(rows)) / (1 + sum(g in b for b in bags))) + 1 for b in bags for g in b}
    return {q: _unit({g: b.count(g) * idf[g] for g in b}) for q, b in zip(rows, bags)}


def test_cascade_with_concepts_equals_brute_force(spark, tmp_path):
    import random

    rng = random.Random(8)
    words = ["amber", "brick", "cloud", "dunes", "ember", "fjord", "glyph", "hazel"]
    parts = [(i, f"{words[i % 8]} {words[(i * 3 + 1 + i // 8) % 8]}") for i in range(16)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 7)) + ["filler"] * rng.randrange(4))) for i in range(600)]
    events = [(i, i // 40, 1_704_067_200 + i // 40 * 7 + (i % 40) * 900 + (i % 7 == 0) * 3000, i * 37 % 1000) for i in range(240)]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    log = spark.createDataFrame(events, "event_id long, user_id long, t long, k long")
    log.selectExpr("event_id", "cast(timestamp_seconds(t) as timestamp_ntz) as ts", "user_id", "'view' as event_type", "concat('{\"k\": ', k, '}') as props").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.search_id: r for r in catalog.queries()["r4_cascade_with_concepts"](spark, str(tmp_path)).collect()}

    name = dict(parts)
    rows = [(str(i), f"public{u}", t, name[i * 7919 % len(parts)], set(range(k, k + 10))) for i, u, t, k in events]
    concepts, chars = _concepts({r[3] for r in rows}, docs, 1000), _char_vectors([r[3] for r in rows])
    assert max(len(v) for v in concepts.values()) > 100
    last, number = {}, {}
    assert len(got) == len(rows)
    for i, uid, t, q, serp in sorted(rows, key=lambda r: (r[1], r[2], int(r[0]))):
        group, esa = f"{uid}|{t // 86400}", None
        before = last.get(group)
        if before is None:
            stage = "grp"
        else:
            pt, pq, ps = before
            a, b = set(pq.split()), set(q.split())
            if t - pt > 5400:
                stage = "gap"
            elif a <= b or b <= a or len(a & b) / len(a | b) >= 0.5:
                stage = "s1"
            elif _dot(chars[pq], chars[q]) >= 0.3:
                stage = "s2"
            else:
                esa = _dot(concepts[pq], concepts[q])
                stage = "s3" if esa >= 0.3 else "s4" if len(ps & serp) / len(ps | serp) >= 0.1 else "boundary"
        number[group] = number.get(group, 0) + (stage in ("grp", "gap", "boundary"))
        last[group] = (t, q, serp)
        assert got[i].stage == stage and got[i].session_id.endswith(f"|{number[group]}"), (i, stage, got[i])
        assert (got[i].esa_cos is None) == (esa is None) and (esa is None or abs(got[i].esa_cos - esa) < 1e-6), (i, esa, got[i])
    assert any(r.esa_cos is not None for r in got.values())

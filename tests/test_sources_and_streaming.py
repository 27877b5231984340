import bz2
import json

from pyspark.sql import functions as F

from sessionloom.operators import cleaning, sessions
from sessionloom.sources import readers
from sessionloom.streaming import online


def test_json_log_with_quarantine(spark, tmp_path):
    lines = [json.dumps({"date": "1", "query": "a\tb", "serp": [1, 2], "uid": "u"}), "", "not json", "[1]", json.dumps({"date": 2, "extra": {"x": 1}})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    rows, bad = readers.read_json_log(spark, [str(tmp_path)])
    got = sorted((r.date, r.query, r.serp) for r in rows.collect())
    assert got == [("1", "a b", "[1,2]"), ("2", None, None)] or [g[:2] for g in got] == [("1", "a b"), ("2", None)]
    assert sorted(r.raw for r in bad.collect()) == ["[1]", "not json"]
    assert readers.discover_fields(spark, [str(tmp_path)]) == ["date", "extra", "query", "serp", "uid"]


def test_tsv_round_trip_and_slices(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x"', 5), ("b", None, 15)], "id string, q string, ts long")
    readers.write_tsv(df, str(tmp_path / "t"))
    back = readers.read_tsv(spark, str(tmp_path / "t"))
    assert sorted((r.id, r.q) for r in back.collect()) == [("a", 'say "x"'), ("b", None)]
    readers.write_slices(cleaning.time_slices(df, "ts", [("one", 0, 10), ("two", 10, 20)]), str(tmp_path / "s"))
    assert {(r.slice, r.id) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {("one", "a"), ("two", "b")}


def test_corpus_and_dump(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"records": [{"id": 1, "title": "T"}, {"id": 2, "title": "U"}]}))
    assert readers.read_corpus(spark, str(tmp_path / "c.json")).count() == 2
    page = lambda i, ns, text, more="": f"<page><title>T{i}</title><ns>{ns}</ns><id>{i}</id>{more}<revision><text>{text}</text></revision></page>"
    body = "'''Bold''' [[Link|shown]] {{drop {{this}}}} " + "word " * 20
    xml = "<mediawiki>" + page(1, 0, body) + page(2, 1, body) + page(3, 0, body, '<redirect title="x"/>') + page(4, 0, "short") + "</mediawiki>"
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    got = readers.read_wiki_dump(spark, str(tmp_path / "d.xml.bz2")).collect()
    assert [r.docno for r in got] == ["1"] and got[0].text.startswith("Bold shown")


def test_bad_lines_have_their_numbers(spark, tmp_path):
    for name, bad in (("a", {3, 700}), ("b", {1, 2})):
        (tmp_path / f"{name}.jsonl").write_text("\n".join("" if i % 50 == 0 else "no" if i in bad else json.dumps({"uid": "x" * 20}) for i in range(1, 1001)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (was, "4k"):  # many blocks
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows, bad = readers.read_json_log(spark, [str(tmp_path)])
        assert sorted((r.file[-7:], r.line, r.raw) for r in bad.collect()) == [("a.jsonl", 3, "no"), ("b.jsonl", 1, "no"), ("b.jsonl", 2, "no")] and rows.count() == 1957
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_corpora_of_all_shapes(spark, tmp_path):
    records = [{"id": i, "authors": [{"n": 1}]} for i in range(5)]
    wide = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "records": records}
    for name, text in (("array", json.dumps(records)), ("lines", "\n".join(map(json.dumps, records))), ("object", json.dumps(wide)), ("pretty", json.dumps(wide, indent=1))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(text)
        assert sorted(r.id for r in readers.read_corpus(spark, str(tmp_path / name)).collect()) == list(range(5)), name


def test_nul_short_rows_and_unquoted(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('a\tb\n"x\ty\0z\nonly\n')
    got = readers.read_tsv(spark, str(tmp_path / "t.tsv"), quoted=False).collect()
    assert [(r.a, r.b) for r in got] == [('"x', "yz"), ("only", None)]
    readers.write_ndjson(spark.createDataFrame([("1", "t", "x y")], "docno string, title string, text string"), str(tmp_path / "n"))
    assert [tuple(r) for r in readers.read_articles(spark, str(tmp_path / "n")).collect()] == [("1", "t", "x y")]
    assert readers.alias_columns(spark.createDataFrame([(1,)], "docid int"), {"id": ("doc", "docid")}).columns == ["id"]


def test_report_blocks(spark):
    rows = [(str(i), i, "u", 60 * i, f"q{i}", [1]) for i in range(3)]
    s = sessions.gap_sessions(spark.createDataFrame(rows, "search_id string, ord long, uid string, ts long, query string, serp array<long>"))
    got = readers.session_blocks(s, sessions.global_numbers(s)).orderBy("line").collect()
    assert [(r.file, r.line, r.minutes, r["query"]) for r in got] == [(0, 1, None, "q0"), (0, 2, 1, "q1"), (0, 3, 1, "q2")]


def test_streams(spark, tmp_path):
    rows = [("a", "u", "2024-01-01 00:00:00"), ("a", "u", "2024-01-01 00:00:05"), ("b", "u", "2024-01-01 00:30:00"), ("c", "u", "2024-01-01 09:00:00"), ("z", "w", "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "search_id string, uid string, time string").select("search_id", "uid", F.to_timestamp("time").alias("time"), F.lit("q").alias("type"))
    df.write.parquet(str(tmp_path / "in"))

    def run(f, name):
        stream = f(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert len(run(online.unique_searches, "unique_searches")) == 4
    assert sorted(r.n for r in run(online.gap_sessions, "gap_sessions")) == [1, 3]
    assert sum(r.n for r in run(online.event_counts, "event_counts")) == 4

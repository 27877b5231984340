import pytest
from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.operators import cleaning, evaluation, interactions, known_item, quality, reformulation, sessions, vectors

LABELS = [
    ("machine learning", "Machine Learning", "Identical"),
    ("machine learning", "learning machine", "Word Reorder"),
    ("e-mail server", "email server", "Whitespace/Punctuation"),
    ("new york city", "new york", "Remove Words"),
    ("new york", "new york city", "Add Words"),
    ("www.arxiv.org", "arxiv.org", "URL Stripping"),
    ("neural networks", "neural network", "Substring"),
    ("world health organization", "who", "Form Acronym"),
    ("who", "world health organization", "Expand Acronym"),
    ("climate change", "climate cha", "Substring"),
    ("climate cha", "climate change", "Superstring"),
    ("int conf", "international conference", "Abbreviation"),
    ("big car", "big automobile", "New"),
    ("recieve", "receive", "Spelling Correction"),
    ("a a", "a", "Remove Words"),
    ("a a b", "a b b", "Spelling Correction"),
    ("banana bread", "quantum physics", "New"),
    (" ", "anything", "New"),
    (None, "anything", "New"),
]


def test_labels(spark):
    df = spark.createDataFrame(LABELS, "a string, b string, want string")
    got = df.select("want", "a", "b", reformulation.classify(F.col("a"), F.col("b")).alias("label")).collect()
    assert [(r.a, r.b, r.label) for r in got] == [(r.a, r.b, r.want) for r in got]


def test_labels_with_stemmer_and_related_words(spark):
    df = spark.createDataFrame([("neural networks", "neural network"), ("big car", "big automobile")], "a string, b string")
    got = df.select(reformulation.classify(F.col("a"), F.col("b"), stems=F.col("a") == "neural networks", substituted=F.col("a") == "big car").alias("l")).collect()
    assert [r.l for r in got] == ["Stemming", "Word Substitution"]


def log(spark, rows):
    """Rows (ts, query, serp) of one user on one day from noon on, unless a uid is given."""
    full = [(str(i), i, r[3] if len(r) > 3 else "u", 1_700_049_600 + r[0], r[1], r[2]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "search_id string, ord long, uid string, ts long, query string, serp array<long>")


CASES = [
    (299, "deep learning", "deep learning", [1, 2], [2, 3], True, "s1"),
    (300, "deep learning", "deep learning", [1, 2], [2, 3], False, "s1"),
    (5400, "deep learning", "deep learning", [1], [1], False, "s1"),
    (5401, "deep learning", "deep learning", [1], [1], False, "gap"),
    (10, "deep learning", "deep learning", [], [], False, "s1"),
    (10, "the of", "the of", [1], [1], False, "s1"),
    (10, "alpha beta", "alpha beta gamma", [], [], False, "s1"),
    (10, "quartz", "willow", list(range(10)), list(range(9, 10)), False, "s4"),
    (10, "quartz", "willow", [1], [2], False, "boundary"),
    (10, "neural networks", "neuralnetworks", [1], [2], False, "s2"),
]


@pytest.mark.parametrize("gap, q1, q2, s1, s2, together, stage", CASES)
def test_session_boundaries(spark, gap, q1, q2, s1, s2, together, stage):
    df = log(spark, [(0, q1, s1), (gap, q2, s2)])
    got = sessions.multi_criteria(df, stop=["the", "of"]).orderBy("ord").collect()
    assert (got[0].session_id == got[1].session_id) == together
    assert sessions.cascade(df).orderBy("ord").collect()[1].stage == stage


def test_midnight_splits_and_start(spark):
    df = log(spark, [(12 * 3600 - 5, "a b", [1]), (12 * 3600 + 5, "a b", [1])])
    out = sessions.with_start(sessions.cascade(df)).orderBy("ord").collect()
    assert [r.stage for r in out] == ["start", "grp"] and out[0].session_id != out[1].session_id


def test_concepts_join_what_words_do_not(spark):
    df = log(spark, [(0, "quartz", [1]), (10, "willow", [2])])
    v = spark.createDataFrame([("quartz", "d1", 1.0), ("willow", "d1", 0.6), ("willow", "d2", 0.8)], "query string, term string, weight double")
    got = sessions.cascade(df, v).orderBy("ord").collect()[1]
    assert got.stage == "s3" and abs(got.esa_cos - 0.6) < 1e-9
    assert evaluation.concept_distribution(sessions.cascade(df, v)).first().n == 1


def test_bursts_filters_and_timing(spark):
    df = log(spark, [(0, "a", [1]), (0, "b", [1]), (5, "c", [1])])
    assert [r.query for r in sessions.drop_bursts(df).collect()] == ["c"]
    s = sessions.gap_sessions(log(spark, [(0, "year>=1999 AND (x)", [1], "u1"), (0, "same", [1], "u2"), (9, "same", [1], "u2"), *[(10 * i, "yearPublished x" if i < 3 else f"q{i}", [1], "u3") for i in range(5)], *[(10 * i, "yearPublished x" if i < 4 else f"q{i}", [1], "u4") for i in range(5)]]))
    gone = {r.session_id[:2] for r in sessions.sweep_sessions(s).collect()}
    assert gone == {"u1", "u2"}
    assert {r.session_id[:2] for r in sessions.structured_sessions(s).collect()} == {"u1", "u2", "u4"}
    timed = sessions.timing(s)
    assert {r.uid: r.std_gap_s for r in sessions.regular_bots(timed).collect()} == {"u3": 0.0, "u4": 0.0}
    assert quality.recurrence(sessions.regular_bots(timed)).first().users == 2
    n = [r.number for r in sessions.global_numbers(s).orderBy("session_id").collect()]
    assert n == ["session1", "session2", "session3", "session4"]


def test_dwell(spark):
    events = spark.createDataFrame([("u", 0), ("u", 29), ("u", 29), ("u", 59), ("v", 5)], "uid string, ts long")
    acts = spark.createDataFrame([("u", 0, "works", "k"), ("u", 29, "works", "k"), ("u", 59, "works", "k"), ("v", 5, "author", "k")], "uid string, ts long, type string, merge_key string")
    got = {(r.uid, r.ts): (r.dwell, r.plausible) for r in interactions.dwell(acts, events).collect()}
    assert got == {("u", 0): (29, 0), ("u", 29): (30, 1), ("u", 59): (-1, 1), ("v", 5): (-1, 1)}


def test_known_items(spark):
    rows = [(0, "The Title!", [1], "a"), (0, "other", [1], "b"), (0, "x y", [1], "c"), (5, "quantum", [1], "c"), (0, "x", [1], "d"), (5, "x y", [1], "d"), *[(5 * i, f"topic {'abcd'[i] * 9}", [1], "e") for i in range(4)]]
    s = sessions.gap_sessions(log(spark, rows))
    records = spark.createDataFrame([("1", ["the title"])], "`Doc ID` string, Title array<string>")
    t = known_item.normalised_titles(known_item.title_index(records))
    got = {r.session_id[0]: (r.klass, r.sub) for r in known_item.classes(s, t).collect()}
    assert got == {"a": ("Known-Item", "title"), "b": ("Einzelquery (ohne Titel)", None), "c": ("Known-Item", "short"), "d": ("Unscharf", None), "e": ("Exploratory", "plain")}


def test_pairs_are_events_less_sessions(spark):
    s = sessions.lexical_sessions(log(spark, [(10 * i, f"w{i // 3} x", [i]) for i in range(12)]))
    p = quality.pair_identity(s).first()
    assert p.pairs == reformulation.pairs(s).count() == p.events - p.sessions


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(T.serp_ids(lit("[1, 22,x3]"))) == [1, 22, 3] and one(T.serp_ids_strict(lit("[1, 22,3]"))) == [22]
    assert one(T.serp_set(lit(" [1, 22, 1,] "))) == ["1", "22"]
    assert one(T.to_epoch(lit("1700000000123"))) == 1_700_000_000 and one(T.to_epoch(lit("1700000000"))) == 1_700_000_000
    assert one(T.to_epoch(lit("2023-11-14 22:13:20"))) == 1_700_000_000 and one(T.to_epoch(lit("2023-11-14T22:13:20.500000+00:00"))) == 1_700_000_000 and one(T.to_epoch(lit("soon"))) is None
    assert one(T.from_german(lit("14.11.2023 22:13:20"))) == 1_700_000_000
    assert one(T.title_norm(lit("Ä_b--C "))) == "ä b c" and one(T.title_norm_keep_underscore(lit("Ä_b--C "))) == "ä_b c"
    assert one(T.char_grams(lit("ab c"))) == [" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "]
    assert one(T.boolean_words(lit("a AND b or NOT c"))) == 2 and one(T.merge_key(lit("12-3-4"))) == "12"
    assert one(T.jaccard(F.array(lit(1), lit(2)), F.array(lit(2), lit(3)))) == pytest.approx(1 / 3) and one(T.jaccard(F.array().cast("array<int>"), F.array(lit(2)))) == 0


def test_pipelines_on_odd_rows(spark):
    rows = [("1", "a", "[1,2]", "good one", None, None, "public1"), ("1", "a", "[9]", "good one", None, None, "public1"), ("2", "b", "[3]", "", None, None, "public1"), ("3", "c", "[3]", "null user", None, None, "null"), ("4", "d", "[3]", "undefined track", "undefined-1", None, "public2"), ("5", "e", "[3]", "a OR b", None, None, "public2"), (None, "f", "[3]", "no date", None, None, "public2")]
    df = spark.createDataFrame(rows, "date string, search_id string, serp string, query string, trackId string, type string, uid string")
    assert sorted(r.search_id for r in cleaning.clean_streaming(df, ["serp"]).collect()) == ["a", "c", "d", "e"]
    assert [(r.search_id, r.serp) for r in cleaning.clean_filtered(cleaning.blank_to_null(df), ["serp"]).collect()] == [("a", [1, 2])]
    assert cleaning.clean_streaming(df.limit(0), ["serp"]).count() == 0


def test_retrieval_orders_by_relevance(spark):
    docs = spark.createDataFrame([("d1", "spark joins tables"), ("d2", "spark streams events from many tables"), ("d3", "cooking bread")], "id string, text string")
    index = vectors.inverted_index(docs, "id", "text")
    q = spark.createDataFrame([("spark joins",), ("bread",)], "query string")
    got = vectors.retrieve(q, index).orderBy("query", "rank").collect()
    assert [(r.query, r.docno, r["rank"]) for r in got] == [("bread", "d3", 1), ("spark joins", "d1", 1), ("spark joins", "d2", 2)]


def test_stems():
    from sessionloom.functions.stemming import stem

    # Examples of the published steps.
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "networks": "network", "triplicate": "triplic", "electrical": "electr", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "cease": "ceas", "controll": "control", "recieve": "reciev", "receive": "receiv"}
    assert {w: stem(w) for w in want} == want


def test_labels_with_stems_and_related_words(spark):
    s = sessions.gap_sessions(log(spark, [(0, "neural networks", [1]), (5, "neural network", [1]), (0, "big car", [1], "v"), (5, "big automobile", [1], "v")]))
    related = spark.createDataFrame([("automobile", "car")], "w1 string, w2 string")
    got = {r.strategy for r in reformulation.labelled(s, stemming=True, related=related).collect()}
    assert got == {"Stemming", "Word Substitution"}
    assert {r.strategy for r in reformulation.labelled(s).collect()} == {"Substring", "New"}


def test_a_resumed_job_gives_the_same_sessions(spark):
    rows = [(str(i), i, f"u{i % 3}", 86_000 + 300 * i, f"q{i // 4}", [1, 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "search_id string, ord long, uid string, ts long, query string, serp array<long>")
    whole = {(r.search_id, r.session_id) for r in sessions.gap_sessions(df).collect()}
    done = sessions.gap_sessions(df.where("uid = 'u1'"))
    rest = sessions.gap_sessions(sessions.remaining(df, done))
    assert whole == {(r.search_id, r.session_id) for r in done.unionByName(rest).collect()} and rest.count() == 40


def test_sorted_files(spark, tmp_path):
    from sessionloom.sources import readers

    df = spark.range(1000).selectExpr("(id * 7919) % 1009 as ts", "id")
    readers.write_sorted(df.repartition(4), str(tmp_path / "s"), "ts")
    parts = [[r.ts for r in spark.read.parquet(str(f)).collect()] for f in sorted((tmp_path / "s").glob("part-*"))]
    assert [x for p in parts for x in p] == sorted(r.ts for r in df.collect())

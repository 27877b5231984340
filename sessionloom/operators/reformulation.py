"""Reformulation classes of neighbouring queries, their distribution and transitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stemming import equal_stems
from . import cleaning

REFINING = ("Add Words", "Remove Words", "Word Substitution", "Substring", "Superstring")


def classify(q1: Column, q2: Column, stems: Column | None = None, substituted: Column | None = None) -> Column:
    """Label of the step from q1 to q2, one CASE WHEN of built-in functions.

    stems and substituted are optional conditions for the rules that need a stemmer or a table of related words; without
    them these rules never fire. A null query counts as blank.
    """
    q1, q2 = F.coalesce(q1, F.lit("")), F.coalesce(q2, F.lit(""))
    n1, n2, t1, t2 = T.norm(q1), T.norm(q2), T.tokens(q1), T.tokens(q2)
    same_length = F.size(t1) == F.size(t2)
    either = F.exists(F.array(F.struct(t1.alias("a"), t2.alias("b"))), lambda x: F.lit(False))
    acronym = lambda short, long: (F.size(short) == 1) & (F.size(long) >= 2) & (F.element_at(short, 1) == T.initials(long))
    affix = lambda whole, piece: F.startswith(whole, piece) | F.endswith(whole, piece)
    abbreviated = same_length & F.forall(F.zip_with(t1, t2, lambda a, b: F.startswith(a, b) | F.startswith(b, a)), lambda x: x)
    rules = [
        ("Word Reorder", (t1 != t2) & (F.array_sort(t1) == F.array_sort(t2))),
        ("Whitespace/Punctuation", T.squeeze(q1) == T.squeeze(q2)),
        ("Remove Words", (F.size(t2) < F.size(t1)) & T.within(t2, t1)),
        ("Add Words", (F.size(t2) > F.size(t1)) & T.within(t1, t2)),
        ("URL Stripping", T.strip_url(q1) == T.strip_url(q2)),
        ("Stemming", stems if stems is not None else either),
        ("Form Acronym", acronym(t2, t1)),
        ("Expand Acronym", acronym(t1, t2)),
        ("Substring", affix(n1, n2)),
        ("Superstring", affix(n2, n1)),
        ("Abbreviation", abbreviated),
        ("Word Substitution", substituted if substituted is not None else either),
        ("Spelling Correction", F.levenshtein(n1, n2) <= 2),
    ]
    rules = [r for r in rules if r[1] is not either]
    first = F.when(n1 == n2, "Identical").when((F.size(t1) == 0) | (F.size(t2) == 0), "New")
    return reduce(lambda c, r: c.when(r[1], r[0]), rules, first).otherwise("New")


def pairs(sessions: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """session_id, ts, ord, search_id, q_prev, q_curr of neighbouring queries of a session."""
    mine = Window.partitionBy("session_id").orderBy("ts", "ord")
    p = sessions.where("session_id is not null").select("session_id", "ts", "ord", "search_id", *extra, F.lag("query").over(mine).alias("q_prev"), F.col("query").alias("q_curr"), F.row_number().over(mine).alias("k"))
    return p.where("k > 1").drop("k")


def labelled(sessions: DataFrame, drop_structured: bool = False, stemming: bool = False, related: DataFrame | None = None) -> DataFrame:
    """:func:`pairs` with strategy; a pair with a structured query has a null strategy on demand.

    stemming: with the rule on equal stems. related: (w1, w2) words that may stand for each other, in both directions.
    """
    p = pairs(sessions)
    stems = substituted = None
    if stemming:
        p = p.join(equal_stems(p), ["q_prev", "q_curr"], "left")
        stems = F.coalesce("stems", F.lit(False))
    if related is not None:
        p = p.join(all_related(p, related), ["q_prev", "q_curr"], "left")
        substituted = F.coalesce("related", F.lit(False))
    label = classify(F.col("q_prev"), F.col("q_curr"), stems, substituted)
    if drop_structured:
        label = F.when(~F.coalesce(cleaning.is_structured_pair(F.col("q_prev"), F.col("q_curr")), F.lit(False)), label)
    return p.withColumn("strategy", label).drop("stems", "related")


def all_related(p: DataFrame, related: DataFrame) -> DataFrame:
    """q_prev, q_curr, related: whether the queries have as many words, equal or related place by place (distinct pairs)."""
    t1, t2 = T.tokens(F.col("q_prev")), T.tokens(F.col("q_curr"))
    same = p.select("q_prev", "q_curr").distinct().where((F.size(t1) == F.size(t2)) & (F.size(t1) > 0))
    words = same.select("q_prev", "q_curr", F.explode(F.arrays_zip(t1.alias("w1"), t2.alias("w2"))).alias("z")).select("q_prev", "q_curr", "z.w1", "z.w2")
    both = related.select("w1", "w2").unionByName(related.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"))).distinct().withColumn("hit", F.lit(True))
    return words.join(both, ["w1", "w2"], "left").groupBy("q_prev", "q_curr").agg(F.bool_and((F.col("w1") == F.col("w2")) | F.coalesce("hit", F.lit(False))).alias("related"))


def distribution(labels: DataFrame) -> DataFrame:
    n = labels.where("strategy is not null").groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # at most 15 rows


def transitions(labels: DataFrame) -> DataFrame:
    """label_from, label_to, n, p (share of label_from); a null label breaks the chain."""
    mine = Window.partitionBy("session_id").orderBy("ts", "ord")
    steps = labels.withColumn("label_from", F.lag("strategy").over(mine)).where("label_from is not null and strategy is not null")
    n = steps.groupBy("label_from", F.col("strategy").alias("label_to")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("label_from")))


def top_transitions(matrix: DataFrame, least: int = 50, top: int = 3) -> DataFrame:
    """The ``top`` targets of each label with ``least`` outgoing steps or more."""
    k = F.row_number().over(Window.partitionBy("label_from").orderBy(F.desc("n"), "label_to"))
    return matrix.withColumn("total", F.sum("n").over(Window.partitionBy("label_from"))).withColumn("k", k).where((F.col("total") >= least) & (F.col("k") <= top)).drop("total")


def examples(labels: DataFrame, each: int = 3) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("strategy").orderBy("ts", "ord"))
    return labels.where("strategy is not null").withColumn("k", k).where(F.col("k") <= each).select("strategy", "k", "q_prev", "q_curr")


def stratified_sample(labels: DataFrame, by: str = "strategy", each: int = 25, seed: str = "42", key: str = "search_id") -> DataFrame:
    """``each`` rows of every stratum in the order of a seeded hash of the key."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    k = F.row_number().over(Window.partitionBy(by).orderBy(order, key))
    return labels.where(F.col(by).isNotNull()).withColumn("idx", k).where(F.col("idx") <= each)


def sample_rows(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows in the order of a seeded hash of the key: repeatable, without a shuffle of all rows."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(n)


def precision(sheet: DataFrame) -> DataFrame:
    """strategie, n, correct, precision and the total (null strategie) of an annotated sample; blank marks are not counted."""
    mark = F.trim(F.col("korrekt").cast("string"))
    marked = sheet.where(mark.isin("0", "1"))
    return marked.rollup("strategie").agg(F.count(F.lit(1)).alias("n"), F.count_if(mark == "1").alias("correct")).withColumn("precision", F.col("correct") / F.col("n"))


def confusions(sheet: DataFrame, top: int = 15) -> DataFrame:
    wrong = sheet.where((F.trim(F.col("korrekt").cast("string")) == "0") & (F.trim("richtige_klasse_falls_falsch") != ""))
    n = wrong.groupBy("strategie", F.trim("richtige_klasse_falls_falsch").alias("richtig")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "strategie", "richtig").limit(top)

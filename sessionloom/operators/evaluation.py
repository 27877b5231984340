"""Comparison of session methods and reports on the cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CONTINUED = ("s1", "s2", "s3", "s4")


def lengths(sessions: DataFrame) -> DataFrame:
    return sessions.where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


def length_stats(sessions: DataFrame) -> DataFrame:
    """sessions, events, mean, lower median, longest, percent of single-query sessions and of those with four or more."""
    histogram = lengths(sessions).groupBy("n").agg(F.count(F.lit(1)).alias("times"))
    order = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # one row for each length
    h = histogram.withColumn("upto", F.sum("times").over(order)).withColumn("all", F.sum("times").over(Window.partitionBy()))
    return h.agg(
        F.sum("times").alias("sessions"), F.sum(F.col("n") * F.col("times")).alias("events"), (F.sum(F.col("n") * F.col("times")) / F.sum("times")).alias("mean"),
        F.min(F.when(F.col("upto") >= F.col("all") / 2, F.col("n"))).alias("median"), F.max("n").alias("longest"),
        (100 * F.sum(F.when(F.col("n") == 1, F.col("times")).otherwise(0)) / F.sum("times")).alias("pct_single"), (100 * F.sum(F.when(F.col("n") >= 4, F.col("times")).otherwise(0)) / F.sum("times")).alias("pct_four"),
    )


def split_factor(sessions: DataFrame) -> DataFrame:
    return lengths(sessions.select("session_id")).agg(F.count(F.lit(1)).alias("sessions")).crossJoin(F.broadcast(lengths(sessions.select(F.concat_ws("|", "uid", "day").alias("session_id"))).agg(F.count(F.lit(1)).alias("uid_days")))).withColumn("factor", F.col("sessions") / F.col("uid_days"))  # one row each


def aligned(methods: dict[str, DataFrame]) -> DataFrame:
    """search_id, uid, day, ts, ord and the session id of each method, for the events that all of them have."""
    out = None
    for name, df in methods.items():
        cols = [F.col("session_id").alias(name)] if out is not None else ["uid", "day", "ts", "ord", F.col("session_id").alias(name)]
        one = df.select("search_id", *cols)
        out = one if out is None else out.join(one, "search_id")
    return out


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """in_a, in_both, only_a, only_b: events of two methods that have a partner and those skipped by a comparison."""
    one, two = (x.select("search_id").distinct().withColumn(c, F.lit(1)) for x, c in ((a, "a"), (b, "b")))
    return one.join(two, "search_id", "full").agg(F.count("a").alias("in_a"), F.count(F.col("a") + F.col("b")).alias("in_both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


def agreement(methods: DataFrame, a: str, b: str) -> DataFrame:
    """pairs of neighbours within a user's day, agreeing ones, and how often each method splits."""
    mine = Window.partitionBy("uid", "day").orderBy("ts", "ord")
    p = methods.withColumn("pa", F.lag(a).over(mine)).withColumn("pb", F.lag(b).over(mine)).where("pa is not null")
    sa, sb = F.col("pa") == F.col(a), F.col("pb") == F.col(b)
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(sa == sb).alias("agree"), F.count_if(~sa).alias("split_a"), F.count_if(~sb).alias("split_b"))


def breakup(old: DataFrame, new: DataFrame, least: int = 4) -> DataFrame:
    """Old sessions of ``least`` events or more: session_id, size, uids, new sessions, dropped events."""
    to = new.select("search_id", F.col("session_id").alias("new_id")).dropDuplicates(["search_id"])
    g = old.join(to, "search_id", "left").groupBy("session_id").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("uid").alias("uids"), F.countDistinct("new_id").alias("parts"), F.count_if(F.col("new_id").isNull()).alias("dropped"))
    return g.where(F.col("size") >= least)


def breakup_histogram(broken: DataFrame) -> DataFrame:
    return broken.groupBy(F.when(F.col("parts") >= 10, "10+").otherwise(F.col("parts").cast("string")).alias("parts")).agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean_size"))


def breakup_example(broken: DataFrame, low: int = 5, high: int = 20) -> DataFrame:
    return broken.where(F.col("size").between(low, high)).orderBy(F.desc("parts"), F.desc("uids"), "size", "session_id").limit(1)


def best_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """session_a, session_b, shared: the session of b that shares most searches with each of a, ties to the smaller id."""
    n = a.select("search_id", F.col("session_id").alias("session_a")).join(b.select("search_id", F.col("session_id").alias("session_b")), "search_id").groupBy("session_a", "session_b").agg(F.count(F.lit(1)).alias("shared"))
    return n.groupBy("session_a").agg(F.min_by("session_b", F.struct(-F.col("shared"), F.col("session_b"))).alias("session_b"), F.max("shared").alias("shared"))


def stage_counts(cascade: DataFrame) -> DataFrame:
    n = cascade.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("kind", F.when(F.col("stage").isin(*CONTINUED), "continued").when(F.col("stage") == "grp", "grp").otherwise("boundary")).withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each stage


def durations(cascade: DataFrame) -> DataFrame:
    g = cascade.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), ((F.max("ts") - F.min("ts")) / 60).alias("minutes"))
    return g.groupBy(T.length_bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("sessions"), F.avg("minutes").alias("mean_min"), F.expr("percentile(minutes, 0.5)").alias("median_min"), F.max("minutes").alias("max_min"))


def concept_distribution(cascade: DataFrame) -> DataFrame:
    at = [0.02, 0.05, 0.10, 0.20]
    return cascade.where("esa_cos is not null").agg(F.count(F.lit(1)).alias("n"), F.avg("esa_cos").alias("mean"), *[F.expr(f"percentile(esa_cos, {q / 100})").alias(f"p{q}") for q in (50, 75, 90, 95, 99)], F.max("esa_cos").alias("longest"), *[F.count_if(F.col("esa_cos") >= a).alias(f"from_{round(a * 100)}") for a in at])


def concept_band(cos: Column) -> Column:
    edges = [0.005, 0.02, 0.05, 0.10, 0.20, 0.50, 1.01]
    out = F.lit(None).cast("string")
    for a, b in zip(edges, edges[1:], strict=False):
        out = F.when((cos >= a) & (cos < b), f"{a:g}-{b:g}").otherwise(out)
    return out


def gap_bucket(gap: Column) -> Column:
    g = F.greatest(gap, F.lit(0))
    return F.when(g < 300, "<5").when(g < 600, "5-10").when(g < 1800, "10-30").when(g <= 5400, "30-90").otherwise(">90")


def stage_against(cascade: DataFrame, other: DataFrame) -> DataFrame:
    """stage, gap bucket, kept, split, unknown: what the other method does with the pairs that each stage decided."""
    mine = Window.partitionBy("uid", "day").orderBy("ts", "ord")
    j = cascade.select("uid", "day", "ts", "ord", "stage", "search_id", F.lag("search_id").over(mine).alias("prev_id"), (F.col("ts") - F.lag("ts").over(mine)).alias("g")).where("prev_id is not null")
    o = other.select("search_id", F.col("session_id").alias("o1")).dropDuplicates(["search_id"])
    j = j.join(o, "search_id", "left").join(o.withColumnsRenamed({"search_id": "prev_id", "o1": "o0"}), "prev_id", "left")
    known = F.col("o1").isNotNull() & F.col("o0").isNotNull()
    return j.groupBy("stage", gap_bucket(F.col("g")).alias("bucket")).agg(F.count_if(known & (F.col("o1") == F.col("o0"))).alias("kept"), F.count_if(known & (F.col("o1") != F.col("o0"))).alias("split"), F.count_if(~known).alias("unknown"))

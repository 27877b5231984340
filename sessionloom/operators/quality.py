"""Data-quality profiles of raw logs and diagnostics of automated traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _filled(c: str):
    return F.coalesce(F.col(c) != "", F.lit(False))


def profile(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(_filled(c)).alias(f"nn_{c}") for c in ("trackId", "type", "uid")], F.count_if(_filled("query") & _filled("uid")).alias("query_and_uid"))


def event_kinds(log: DataFrame) -> DataFrame:
    kind = F.when(_filled("type"), "interaction").when(_filled("query"), "query").otherwise("neither")
    return log.groupBy(kind.alias("kind"), F.when(_filled("type"), F.col("type")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def completeness(log: DataFrame) -> DataFrame:
    q = log.where(_filled("query") & ~_filled("type"))
    full = _filled("date") & _filled("search_id")
    return q.agg(F.count(F.lit(1)).alias("queries"), F.count_if(full).alias("complete"), F.count_if(~full).alias("incomplete"))


def date_range(log: DataFrame, column: str = "date") -> DataFrame:
    """first, last as seconds (milliseconds scaled), and as text for columns that are no numbers."""
    n = F.col(column).cast("string").try_cast("double")
    n = F.when(n > 1e12, n / 1000).otherwise(n)
    return log.agg(F.min(n).alias("first"), F.max(n).alias("last"), F.min(F.col(column).cast("string")).alias("first_text"), F.max(F.col(column).cast("string")).alias("last_text"))


def days_per_uid(events: DataFrame) -> DataFrame:
    return events.groupBy("uid").agg(F.countDistinct("day").alias("days"), F.count(F.lit(1)).alias("n"))


def pair_identity(sessions: DataFrame) -> DataFrame:
    """events, sessions, pairs (events - sessions), rows with a blank query."""
    g = sessions.where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim(F.coalesce("query", F.lit(""))) == "").alias("blank"))
    return g.agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("sessions"), (F.sum("n") - F.count(F.lit(1))).alias("pairs"), F.sum("blank").alias("blank"), F.count_if(F.expr("n = 1")).alias("single"))


def std_buckets(bots: DataFrame) -> DataFrame:
    s = F.col("std_gap_s")
    return bots.groupBy(F.when(s == 0, "0").when(s <= 0.5, "<=0.5").when(s <= 1, "<=1").otherwise("<=2").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def frequent_gaps(bots: DataFrame, top: int = 8) -> DataFrame:
    return bots.groupBy(F.bround("mean_gap_s").cast("bigint").alias("gap")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gap").limit(top)


def uid_overlap(timed: DataFrame, bots: DataFrame) -> DataFrame:
    """Users with regular sessions only, with other sessions only, with both."""
    flag = timed.join(bots.select("session_id", F.lit(1).alias("bot")), "session_id", "left").groupBy("uid").agg(F.count("bot").alias("b"), F.count(F.lit(1)).alias("n"))
    return flag.agg(F.count_if(F.expr("b > 0 and b = n")).alias("only_bot"), F.count_if(F.expr("b = 0")).alias("only_other"), F.count_if(F.expr("b > 0 and b < n")).alias("both"))


def recurrence(bots: DataFrame, top: int = 10) -> DataFrame:
    """Regular sessions per user: users, mean, median, p90, p99 (by place in the falling list), most, share with two or more, share of the ``top``."""
    per = bots.groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    times = per.groupBy("n").agg(F.count(F.lit(1)).alias("users"))  # one row for each number of sessions
    upto = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    t = times.withColumn("upto", F.sum("users").over(upto)).withColumn("all", F.sum("users").over(Window.partitionBy()))
    at = lambda q: F.max(F.when(F.col("upto") > F.least(F.col("all") - 1, F.floor(F.col("all") * q)), F.col("n")))
    best = F.sum(F.col("n") * F.greatest(F.lit(0), F.least(F.col("users"), top - (F.col("upto") - F.col("users")))))
    median = per.agg(F.median("n").alias("median"))
    out = t.agg(F.sum("users").alias("users"), (F.sum(F.col("n") * F.col("users")) / F.sum("users")).alias("mean"), at(0.10).alias("p90"), at(0.01).alias("p99"), F.max("n").alias("most"), (F.sum(F.when(F.col("n") >= 2, F.col("users")).otherwise(0)) / F.sum("users")).alias("share_two"), (best / F.sum(F.col("n") * F.col("users"))).alias("share_top"))
    return out.crossJoin(F.broadcast(median))  # one row each


def summary_totals(summaries: DataFrame) -> DataFrame:
    """uids, queries, mean, median and most queries and minutes of users' summaries (n_queries, dauer_min)."""
    n, m = F.col("n_queries"), F.col("dauer_min")
    return summaries.agg(
        F.count(F.lit(1)).alias("uids"), F.sum(n).alias("queries"), F.avg(n).alias("mean_queries"), F.expr("percentile(n_queries, 0.5)").alias("median_queries"), F.max(n).alias("most_queries"),
        F.avg(m).alias("mean_min"), F.expr("percentile(dauer_min, 0.5)").alias("median_min"), F.max(m).alias("most_min"),
    )


def top_regular(timed: DataFrame, bots: DataFrame, top: int = 10) -> DataFrame:
    """kind (pure: regular sessions only; shared), uid, bot_sessions, k: the ``top`` users of each kind."""
    of = timed.join(bots.select("session_id", F.lit(1).alias("bot")), "session_id", "left").groupBy("uid").agg(F.count("bot").alias("bot_sessions"), F.count(F.lit(1)).alias("n")).where("bot_sessions > 0")
    kind = F.when(F.col("bot_sessions") == F.col("n"), "pure").otherwise("shared")
    k = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("bot_sessions"), "uid"))
    return of.withColumn("kind", kind).withColumn("k", k).where(F.col("k") <= top).select("kind", "uid", "bot_sessions", "k")

"""Interactions with results: extraction, dwell times, attribution to reformulations, key tracing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

KINDS = ("get-pdf", "data-provider", "author", "works")
ATTRIBUTED = ("author", "works", "data-provider")


def extract(raw: DataFrame) -> DataFrame:
    """ts, uid, type, trackId, merge_key of the interactions with a readable time."""
    out = raw.where(F.col("type").isin(*KINDS)).withColumn("ts", T.to_epoch(F.col("date").cast("string"))).where("ts is not null")
    return out.select("ts", "uid", "type", "trackId", T.merge_key(F.col("trackId")).alias("merge_key"))


def latest_query_key(events: DataFrame) -> DataFrame:
    """merge_key of each interaction: the latest query of the same uid at or before it.

    Windows run over one user's day; the last key of earlier days comes from a table of one row for each user and day, so a user
    with very many events fills no task. Null uids are one user.
    """
    day = F.floor(F.col("ts") / 86_400)
    keyed = events.withColumns({"_day": day, "_key": F.when(F.col("type").isNull(), F.col("search_id"))})
    order = Window.partitionBy("uid", "_day").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, 0)
    within = keyed.withColumn("_within", F.last("_key", ignorenulls=True).over(order)).where("type is not null")
    days = keyed.groupBy(F.col("uid").alias("_uid"), F.col("_day").alias("_on")).agg(F.max(F.when(F.col("_key").isNotNull(), F.struct("ts", "ord", "_key"))).alias("_last"))
    earlier = Window.partitionBy("_uid").orderBy("_on").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier)["_key"]).drop("_last").where("_before is not null")
    joined = within.join(days, F.col("uid").eqNullSafe(F.col("_uid")) & (F.col("_day") == F.col("_on")), "left")
    return joined.withColumn("merge_key", F.coalesce("_within", "_before")).select(*events.columns, "merge_key")


def dwell(interactions: DataFrame, timeline: DataFrame, plausible_from: int = 30, exclude_blank_uid: bool = False) -> DataFrame:
    """Adds dwell, the seconds to the next, strictly later event of the same uid (-1: none), and plausible (1/0).

    timeline: (uid, ts) of all events. Only users with interactions are read into the windows, which run over one user's day; the next
    day's first time comes from a table of one row for each user and day.
    """
    if exclude_blank_uid:
        interactions = interactions.where("uid is not null and trim(uid) <> ''")
    users = interactions.select("uid").distinct()
    times = timeline.select("uid", "ts").join(users, "uid", "left_semi").distinct().withColumn("_day", F.floor(F.col("ts") / 86_400))
    days = times.groupBy("uid", "_day").agg(F.min("ts").alias("_first"))
    days = days.withColumn("_following", F.lead("_first").over(Window.partitionBy("uid").orderBy("_day"))).drop("_first")
    after = times.withColumn("_next", F.lead("ts").over(Window.partitionBy("uid", "_day").orderBy("ts"))).join(days, ["uid", "_day"], "left")  # distinct times, so the next one is later
    j = interactions.join(after.select("uid", "ts", F.coalesce("_next", "_following").alias("next_ts")), ["uid", "ts"], "left")
    gap = F.coalesce(F.col("next_ts") - F.col("ts"), F.lit(-1)).cast("bigint")
    return j.withColumn("dwell", gap).withColumn("plausible", F.when((gap < 0) | (gap >= plausible_from), 1).otherwise(0)).drop("next_ts")


def of_sessions(interactions: DataFrame, sessions: DataFrame) -> DataFrame:
    keys = sessions.select(F.col("search_id").alias("merge_key")).distinct()
    return interactions.join(keys, "merge_key", "left_semi")


def attribution(labels: DataFrame, dwelled: DataFrame) -> DataFrame:
    """strategy, pairs, and percent of pairs with each interaction type, with any, and with too short ones only counted apart."""
    flags = [F.coalesce(F.bool_or((F.col("type") == k) & (F.col("plausible") == p)), F.lit(False)).alias(f"{k.replace('-', '_')}_{'long' if p else 'short'}") for p in (1, 0) for k in ATTRIBUTED]
    per = dwelled.where(F.col("type").isin(*ATTRIBUTED)).groupBy(F.col("merge_key").alias("search_id")).agg(*flags)
    names = [c for c in per.columns if c != "search_id"]
    j = labels.where("strategy is not null").join(per, "search_id", "left").fillna(False, names)
    share = lambda c: 100 * F.count_if(c) / F.count(F.lit(1))
    any_of = lambda end: F.greatest(*[F.col(c) for c in names if c.endswith(end)])
    return j.groupBy("strategy").agg(F.count(F.lit(1)).alias("pairs"), *[share(F.col(c)).alias(f"pct_{c}") for c in names], share(any_of("_long")).alias("pct_any_long"), share(any_of("_short")).alias("pct_any_short"))


def matched(interactions: DataFrame, sessions: DataFrame) -> DataFrame:
    """type, total, matched, pct, example key: interactions whose key is a session's search."""
    keys = sessions.select(F.col("search_id").alias("merge_key")).distinct().withColumn("hit", F.lit(1))
    return interactions.join(keys, "merge_key", "left").groupBy("type").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("matched"), (100 * F.count("hit") / F.count(F.lit(1))).alias("pct"), F.min("merge_key").alias("example"))


def key_status(interactions: DataFrame) -> DataFrame:
    """type (null: all), total, undefined, real, empty."""
    key = F.trim("merge_key")
    return interactions.rollup("type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(key == "undefined").alias("undefined"), F.count_if((key != "") & (key != "undefined")).alias("real"), F.count_if(F.col("merge_key").isNull() | (key == "")).alias("empty")
    )


def key_coverage(interactions: DataFrame, log: DataFrame, kind: str = "get-pdf") -> DataFrame:
    """keys, found in the log, found with an empty and with a filled uid: distinct keys of one interaction type."""
    keys = interactions.where((F.col("type") == kind) & (F.trim("merge_key") != "")).select("merge_key").distinct()
    there = log.groupBy(F.col("search_id").alias("merge_key")).agg(F.bool_or(F.coalesce(F.trim("uid") != "", F.lit(False))).alias("filled"))
    return keys.join(there, "merge_key", "left").agg(F.count(F.lit(1)).alias("keys"), F.count("filled").alias("found"), F.count_if(~F.col("filled")).alias("uid_empty"), F.count_if("filled").alias("uid_filled"))


def stage_coverage(interactions: DataFrame, stages: dict[str, DataFrame], kind: str = "get-pdf") -> DataFrame:
    """stage, found: distinct keys still present after each processing stage."""
    keys = interactions.where((F.col("type") == kind) & (F.trim("merge_key") != "")).select(F.col("merge_key").alias("search_id")).distinct()
    out = None
    for name, df in stages.items():
        one = df.select("search_id").join(keys, "search_id", "left_semi").agg(F.countDistinct("search_id").alias("found")).select(F.lit(name).alias("stage"), "found")
        out = one if out is None else out.unionByName(one)
    return out

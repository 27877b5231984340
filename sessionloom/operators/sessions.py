"""Session reconstruction: user-day groups, time gaps, the multi-criteria method and the staged cascade.

A row is compared with the one before it in (uid, UTC day) order of (ts, ord); a session number is the running count of
boundaries. Rows: uid, ts, ord, query, serp, search_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.staging import staged
from . import cleaning, vectors


def _by_day():
    return Window.partitionBy("uid", "day").orderBy("ts", "ord")


def drop_bursts(df: DataFrame, least: int = 2) -> DataFrame:
    """Without the events of a user that share their second with ``least`` - 1 others or more."""
    n = F.count(F.lit(1)).over(Window.partitionBy("uid", "ts"))
    return df.withColumn("_n", n).where(F.col("_n") < least).drop("_n")


def uid_day(df: DataFrame) -> DataFrame:
    return cleaning.uid_present(df).withColumn("day", T.utc_day(F.col("ts"))).withColumn("grp", F.concat_ws("|", "uid", "day"))


def remaining(df: DataFrame, done: DataFrame) -> DataFrame:
    """Events of the user-days that ``done`` (session_id) has not yet, to resume a job: no session crosses a user's day, so no other state is needed."""
    finished = done.where("session_id is not null").select(F.regexp_replace("session_id", r"\|\d+$", "").alias("grp")).distinct()
    return uid_day(df).join(finished, "grp", "left_anti").select(df.columns)


def neighbours(df: DataFrame) -> DataFrame:
    """Adds prev_ts, prev_query, prev_serp and gap; null at the start of a user's day."""
    return df.withColumns({f"prev_{c}": F.lag(c).over(_by_day()) for c in ("ts", "query", "serp")}).withColumn("gap", F.col("ts") - F.col("prev_ts"))


def numbered(df: DataFrame, boundary: Column) -> DataFrame:
    """Adds session_id: uid|day|running count of boundaries."""
    k = F.sum(F.when(boundary, 1).otherwise(0)).over(_by_day().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("session_id", F.concat_ws("|", "grp", k.cast("string")))


def lexically_same(q1: Column, q2: Column, least: float = 0.5) -> Column:
    """Equal, or one's token set within the other's (neither empty), or token Jaccard of ``least`` or more."""
    a, b = F.array_distinct(T.tokens(q1)), F.array_distinct(T.tokens(q2))
    inside = (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))
    return (F.lower(F.trim(q1)) == F.lower(F.trim(q2))) | inside | (T.jaccard(a, b) >= least)


def gap_sessions(df: DataFrame, most_gap: int = 5400) -> DataFrame:
    n = neighbours(uid_day(df))
    return numbered(n, F.col("prev_ts").isNull() | (F.col("gap") > most_gap))


def lexical_sessions(df: DataFrame, most_gap: int = 5400) -> DataFrame:
    """Time gap, then the lexical stage alone."""
    n = neighbours(uid_day(df))
    return numbered(n, ~F.coalesce((F.col("gap") <= most_gap) & lexically_same(F.col("prev_query"), F.col("query")), F.lit(False)))


def multi_criteria(df: DataFrame, most_gap: int = 300, least_jaccard: float = 0.01, least_cosine: float = 0.10, stop: list[str] | None = None) -> DataFrame:
    """Same session if the gap is below ``most_gap`` and results and words overlap. Cosines are worked out only for the pairs that pass the two cheap tests."""
    n = staged(neighbours(uid_day(df)), "neighbours")
    near = F.coalesce((F.col("gap") < most_gap) & (T.jaccard(F.col("prev_serp"), F.col("serp")) >= least_jaccard), F.lit(False))
    pairs = n.where(near).select(F.col("prev_query").alias("q1"), F.col("query").alias("q2")).distinct()
    cos = vectors.pair_cosines(pairs, vectors.word_tfidf(n.select("query"), stop)).select(F.col("q1").alias("prev_query"), F.col("q2").alias("query"), "cosine")
    joined = n.join(cos, ["prev_query", "query"], "left")
    return numbered(joined, ~(near & F.coalesce(F.col("cosine") >= least_cosine, F.lit(False))))


def cascade(df: DataFrame, concepts: DataFrame | None = None, most_gap: int = 5400, least_char: float = 0.30, least_concept: float = 0.30, least_serp: float = 0.10) -> DataFrame:
    """Staged decisions, first match wins: start, grp, gap (boundaries), s1 lexical, s2 character cosine, s3 concept cosine, s4 results, boundary.

    concepts: vectors (query, term, weight), without which s3 never fires. Each stage's join holds only the pairs that the cheaper stages
    left open; esa_cos is filled for those that reach s3.
    """
    n = staged(neighbours(uid_day(df)), "neighbours")
    inside = F.coalesce(F.col("gap") <= most_gap, F.lit(False))
    same = F.coalesce(lexically_same(F.col("prev_query"), F.col("query")), F.lit(False))
    names = {"q1": "prev_query", "q2": "query"}
    open2 = n.where(inside & ~same).select(F.col("prev_query").alias("q1"), F.col("query").alias("q2")).distinct()
    char = vectors.pair_cosines(open2, vectors.char_tfidf(n.select("query"))).withColumnsRenamed(names).withColumnRenamed("cosine", "char_cos")
    j = n.join(char, ["prev_query", "query"], "left")
    if concepts is not None:
        open3 = char.where(F.col("char_cos") < least_char).select(F.col("prev_query").alias("q1"), F.col("query").alias("q2"))
        esa = vectors.pair_cosines(open3, concepts).withColumnsRenamed(names).withColumnRenamed("cosine", "esa")
        j = j.join(esa, ["prev_query", "query"], "left")
    else:
        j = j.withColumn("esa", F.lit(None).cast("double"))
    start = ~F.exists(F.array("prev_ts"), lambda x: x.isNotNull())
    stage = (
        F.when(start, "grp")
        .when(~inside, "gap")
        .when(same, "s1")
        .when(F.col("char_cos") >= least_char, "s2")
        .when(F.col("esa") >= least_concept, "s3")
        .when(T.jaccard(F.col("prev_serp"), F.col("serp")) >= least_serp, "s4")
        .otherwise("boundary")
    )
    j = j.withColumn("stage", stage).withColumn("esa_cos", F.when(F.col("stage").isin("s3", "s4", "boundary"), F.col("esa")))
    return numbered(j, F.col("stage").isin("grp", "gap", "boundary")).drop("char_cos", "esa")


def with_start(sessions: DataFrame) -> DataFrame:
    """The globally first row's stage becomes start."""
    first = sessions.agg(F.min(F.struct("uid", "ts", "ord")).alias("first"))
    return sessions.crossJoin(F.broadcast(first)).withColumn("stage", F.when(F.struct("uid", "ts", "ord") == F.col("first"), "start").otherwise(F.col("stage"))).drop("first")  # one row


def uid_summary(df: DataFrame) -> DataFrame:
    out = cleaning.uid_present(df).groupBy("uid").agg(F.count(F.lit(1)).alias("n_queries"), F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end"))
    return out.withColumn("dauer_min", (F.col("ts_end") - F.col("ts_start")) / 60)


def session_flags(sessions: DataFrame) -> DataFrame:
    return sessions.where("session_id is not null").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(cleaning.is_structured(F.col("query"))).alias("structured"),
        (F.max("ts") - F.min("ts")).alias("span"),
        (F.min("query") == F.max("query")).alias("same"),
    )


def sweep_sessions(sessions: DataFrame, most_span: int = 120) -> DataFrame:
    """Ids of sessions whose queries are all structured within ``most_span`` seconds, or repeat one query."""
    return session_flags(sessions).where(((F.col("structured") == F.col("n")) & (F.col("span") <= most_span)) | ((F.col("n") >= 2) & F.col("same"))).select("session_id")


def structured_sessions(sessions: DataFrame, most: float = 0.6) -> DataFrame:
    """Ids of sessions with a larger share of structured queries than ``most``, or that repeat one query."""
    return session_flags(sessions).where(((F.col("structured") > 0) & (F.col("structured") / F.col("n") > most)) | ((F.col("n") >= 2) & F.col("same"))).select("session_id")


def without_sessions(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows without a session id stay."""
    return sessions.join(ids, "session_id", "left_anti")


def timing(sessions: DataFrame) -> DataFrame:
    """session_id, uid (of the first row), n_queries, mean_gap_s, std_gap_s (population)."""
    mine = Window.partitionBy("session_id").orderBy("ts", "ord")
    g = sessions.withColumn("g", F.col("ts") - F.lag("ts").over(mine))
    return g.groupBy("session_id").agg(F.min_by("uid", F.struct("ts", "ord")).alias("uid"), F.count(F.lit(1)).alias("n_queries"), F.avg("g").alias("mean_gap_s"), F.stddev_pop("g").alias("std_gap_s"))


def regular_bots(timed: DataFrame, least: int = 3, most_mean: float = 12.0, most_std: float = 2.0) -> DataFrame:
    return timed.where((F.col("n_queries") >= least) & (F.col("mean_gap_s") <= most_mean) & (F.col("std_gap_s") <= most_std))


def global_numbers(sessions: DataFrame) -> DataFrame:
    """session_id, number: place of each session in (uid, first ts) order, as text session1, session2, ...

    Users are counted first; the running sum over users works on one row for each user and day.
    """
    per = sessions.groupBy("uid", "day", "session_id").agg(F.min(F.struct("ts", "ord")).alias("first"))
    groups = per.groupBy("uid", "day").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("uid", "day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    k = F.row_number().over(Window.partitionBy("uid", "day").orderBy("first"))
    return per.withColumn("k", k).join(groups.withColumn("before", before).drop("n"), ["uid", "day"]).select("session_id", F.concat(F.lit("session"), (F.col("before") + F.col("k")).cast("string")).alias("number"))

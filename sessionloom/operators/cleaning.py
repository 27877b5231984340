"""Row filters, deduplication and frequency limits of raw query logs, and the three cleaning pipelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

RAW = ("date", "search_id", "serp", "query", "trackId", "type", "uid")


def blank_to_null(df: DataFrame, columns=RAW) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns if c in df.columns})


def require(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns or ("date", "search_id", "query")))


def drop_type_keep_two(df: DataFrame) -> DataFrame:
    """Without the type column; rows with two non-null values or more among the rest."""
    rest = df.drop("type")
    return rest.dropna(thresh=2)


def keep_types(df: DataFrame, types=("author", "works", "get-pdf")) -> DataFrame:
    return df.where(F.col("type").isin(*types)) if "type" in df.columns else df.limit(0)


def drop_matching(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that do not meet the condition; a null query stays."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def is_doi(q: Column) -> Column:
    return q.rlike(r"10\.\d{4,}/")


def is_internal_id(q: Column) -> Column:
    return q.rlike(r"id:\d{9}")


def other_script(q: Column) -> Column:
    return q.rlike("[\\u3040-\\u30FF\\u4E00-\\u9FFF\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF\\u0400-\\u04FF\\u00C0-\\u024F\\u00A1\\u00BF]")


def is_title_query(q: Column) -> Column:
    return q.contains('title:"')


def is_update_window(q: Column) -> Column:
    stamp = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{6}\+\d{2}:\d{2}|Z)"
    return q.rlike(rf"^updatedDate\s*>=\s*{stamp}\s+AND\s+updatedDate\s*<\s*{stamp}\z")


def is_ten_digits(q: Column) -> Column:
    return q.rlike(r"^\d{10}\z")


def is_cell_capture(q: Column) -> Column:
    return q.rlike('^"?cell capture AND')


def has_special_field(q: Column) -> Column:
    return q.rlike("(^|[^a-zA-Z0-9])(" + "|".join(T.SPECIAL_FIELDS) + "):")


def has_boolean(q: Column) -> Column:
    return q.rlike(r"(?U)\b(AND|OR|NOT)\b")


def is_structured(q: Column) -> Column:
    return q.rlike(T.STRUCTURED)


def is_structured_pair(a: Column, b: Column) -> Column:
    return a.rlike(T.STRUCTURED_PAIR) | b.rlike(T.STRUCTURED_PAIR)


def drop_undefined_track(df: DataFrame, keep_null: bool = True) -> DataFrame:
    if "trackId" not in df.columns:
        return df
    return df.where(F.coalesce(~F.startswith("trackId", F.lit("undefined")), F.lit(keep_null)))


def uid_present(df: DataFrame) -> DataFrame:
    return df.where("uid is not null and trim(uid) <> ''")


def uid_not_null_text(df: DataFrame) -> DataFrame:
    return df.where(~F.col("uid").isin("null", "NaN"))


def uid_public(df: DataFrame) -> DataFrame:
    return df.where(F.startswith("uid", F.lit("public")))


def limit_uid_rows(df: DataFrame, limit: int = 100) -> DataFrame:
    """Users with more than ``limit`` rows go. Counts are pre-aggregated, so one heavy user does not fill a task."""
    heavy = df.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("uid")
    return df.join(heavy, "uid", "left_anti")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order: a grouped minimum, so copies meet before the shuffle.

    Rows that tie in ``order`` are told apart by the remaining columns; null keys form groups.
    """
    rest = [c for c in df.columns if c not in keys]
    front = [c for c in order if c in rest]
    packed = F.struct(*front, *[c for c in rest if c not in front])
    return df.groupBy(*keys).agg(F.min(packed).alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def unique_search_ids(df: DataFrame, order: list[str]) -> DataFrame:
    return first_by(df, ["search_id"], order)


def unique_but_serp(df: DataFrame, order: list[str]) -> DataFrame:
    return first_by(df, [c for c in ("date", "search_id", "query", "trackId", "type", "uid") if c in df.columns], order)


def drop_frequent_queries(df: DataFrame, limit: int = 500) -> DataFrame:
    """Queries that occur ``limit`` times or more go (anti-join with the few that do)."""
    high = df.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit).select("query")
    return df.join(high, "query", "left_anti").select(df.columns)


def cap_query_rows(df: DataFrame, order: list[str], limit: int = 50) -> DataFrame:
    """The first ``limit`` rows of each query; Spark keeps only the leading rows of each task before the shuffle."""
    mine = Window.partitionBy("query").orderBy(*order)
    return df.withColumn("_k", F.row_number().over(mine)).where(F.col("_k") <= limit).drop("_k")


def _without(df: DataFrame, *tests) -> DataFrame:
    return reduce(lambda d, t: drop_matching(d, t(F.col("query"))), tests, df)


def clean_streaming(df: DataFrame, order: list[str], limit: int = 500) -> DataFrame:
    """Pipeline 1: required columns, eight pattern filters, one row a search, no frequent queries."""
    df = _without(require(blank_to_null(df)), is_doi, is_internal_id, other_script, is_title_query, is_update_window, is_ten_digits, is_cell_capture, has_special_field)
    return drop_frequent_queries(unique_search_ids(df, order), limit)


def clean_filtered(df: DataFrame, order: list[str], limit: int = 100, cap: int = 50, keep_null_track: bool = True) -> DataFrame:
    """Pipelines 2 and 3: unique rows, pattern filters, frequency limit and cap, user filters, parsed result lists."""
    df = drop_type_keep_two(unique_but_serp(df.where("query is not null"), order))
    df = _without(df, has_boolean, has_special_field, is_doi, is_title_query)
    df = cap_query_rows(drop_frequent_queries(df, limit), order, cap)
    df = uid_public(uid_not_null_text(uid_present(drop_undefined_track(df, keep_null_track))))
    return require(df.select("date", "search_id", T.serp_ids(F.col("serp")).alias("serp"), "query", "uid"))


def time_slices(df: DataFrame, ts: str, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """Adds slice, the name of the first half-open range [start, end) that holds ts; rows outside all go."""
    name = F.lit(None).cast("string")
    for label, start, end in reversed(ranges):
        name = F.when((F.col(ts) >= start) & (F.col(ts) < end), label).otherwise(name)
    return df.withColumn("slice", name).where("slice is not null")

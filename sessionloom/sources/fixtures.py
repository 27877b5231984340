"""The derived search log over the driver's tables, on which the registered queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import known_item


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_id, ord, uid, ts, query, serp (array), type (null: a query), date, trackId."""
    events, part = table(spark, sf_dir, "events"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n = part.agg(F.count(F.lit(1)).alias("n_part"))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    e = events.crossJoin(F.broadcast(n)).withColumn("p_partkey", F.col("event_id") * 7919 % F.col("n_part"))  # one row: the number of parts
    j = e.join(part, "p_partkey")
    ts = F.unix_seconds(F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type") == "click", "works").when(F.col("event_type") == "purchase", "author")
    return j.select(
        F.col("event_id").cast("string").alias("search_id"), F.col("event_id").alias("ord"), F.concat(F.lit("public"), F.col("user_id").cast("string")).alias("uid"), ts.alias("ts"), F.col("p_name").alias("query"),
        F.sequence(k, k + 9).alias("serp"), kind.alias("type"), ts.cast("string").alias("date"), F.concat(F.col("event_id").cast("string"), F.lit("-"), k.cast("string")).alias("trackId"),
    )


def queries_of(log: DataFrame) -> DataFrame:
    return log.where("type is null")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of all parts stand in for titles of known documents."""
    part = table(spark, sf_dir, "part")
    return known_item.normalised_titles(known_item.title_index(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))))


#: DuckDB's form of :func:`search_log`.
LOG = """log as (select cast(event_id as varchar) search_id, event_id ord, concat('public', user_id) uid, cast(floor(epoch_us(ts)/1000000) as bigint) ts, p.p_name query,
 range(cast(regexp_extract(props,'([0-9]+)',1) as bigint), cast(regexp_extract(props,'([0-9]+)',1) as bigint)+10) serp,
 case event_type when 'click' then 'works' when 'purchase' then 'author' end as type, cast(cast(floor(epoch_us(ts)/1000000) as bigint) as varchar) date,
 concat(event_id, '-', regexp_extract(props,'([0-9]+)',1)) trackId
 from events e join part p on p.p_partkey = (e.event_id*7919) % (select count(*) from part)),
 q0 as (select *, strftime(to_timestamp(ts) at time zone 'UTC', '%Y-%m-%d') as day from log where type is null)"""

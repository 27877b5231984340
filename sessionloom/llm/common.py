"""Shared plumbing: staged tables, connected components, bounded Arrow slices."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder of our own only where that is unset and the session runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.conf.get("spark.master", None) or "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "sessionloom-stages")
    return folder


@contextmanager
def batches_of(spark: SparkSession, rows: int, most_bytes: int | None = None):
    """What is staged meanwhile goes to Python in Arrow batches of ``rows`` rows and about ``most_bytes`` at most, so that whole texts do not pile up
    beside the heap."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": most_bytes}
    limits = {key: value for key, value in limits.items() if value is not None}
    was = {key: spark.conf.get(key) for key in limits}
    try:
        for key, value in limits.items():
            spark.conf.set(key, str(value))
        yield
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there, and no executor holds the only copy."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(taken: list[str], *names: str) -> tuple[str, ...]:
    """``names``, each with as many underscores after it as it takes to differ from all ``taken`` ones (in any case)."""
    taken = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def columns(names: list[str]) -> list[Column]:
    """The columns of these names, whatever characters are in them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def release(spark: SparkSession) -> None:
    """Lets the driver collect its garbage, upon which Spark removes the shuffle files of steps that are finished and no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stage_observed(df: DataFrame, name: str, **what) -> tuple[DataFrame, dict]:
    """:func:`stage`, with aggregates taken while the rows are written."""
    seen = Observation()
    out = stage(df.observe(seen, *[c.alias(k) for k, c in what.items()]), name)
    return out, seen.get


def text_slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch with about ``most_bytes`` of text each (a longer text stands alone), so temporary arrays stay small."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def components(edges: DataFrame, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every vertex of ``edges`` (a, b: long): columns id, component.

    Alternates large-star and small-star contractions, each a grouped minimum and a join over the edge table, written to the
    shared folder, until every edge leads from a leaf to the hub of its star. Minima are pre-aggregated before the shuffle
    and staged, so that a hub with very many edges meets them in a join that Spark can split. No vertices are gathered on
    the driver.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    for _ in range(most_rounds):
        e, edge_count = stage_observed(e, f"{name}-edges", n=F.count(F.lit(1)))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("first"), F.max("v").alias("last"))
        low, seen = stage_observed(low, f"{name}-low", leaves=F.count_if(F.expr("first < u")), between=F.count_if(F.expr("first < u and last > u")))
        if not edge_count["n"] or seen["leaves"] == edge_count["n"] and not seen["between"]:
            break
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "first").alias("v")).distinct()
        large = stage(large, f"{name}-large")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small")
        e = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    return low.select(F.col("u").alias("id"), F.least("u", "first").alias("component"))

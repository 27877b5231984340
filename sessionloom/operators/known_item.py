"""Known-item searches: title index, classes of sessions, position of title hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import reformulation

CANDIDATES = {"id": ("id", "doc_id", "docid", "core_id", "identifier", "doi"), "title": ("title", "document_title", "titel", "name")}


def pick(df: DataFrame, wanted: tuple[str, ...]) -> str | None:
    """The first column, or field one level down, whose name without case, blanks, hyphens and underscores is wanted."""
    plain = lambda s: s.lower().replace(" ", "").replace("-", "").replace("_", "")
    names = {plain(f.name): f"`{f.name}`" for f in reversed(df.schema.fields)}
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            names = {plain(g.name): f"`{f.name}`.`{g.name}`" for g in f.dataType.fields} | names
    return next((names[plain(w)] for w in wanted if plain(w) in names), None)


def as_text(df: DataFrame, column: str):
    c = F.element_at(F.col(column), 1) if df.select(column).dtypes[0][1].startswith("array") else F.col(column)
    return F.trim(F.regexp_replace(c.cast("string"), r"[\t\r\n]+", " "))


def title_index(records: DataFrame) -> DataFrame:
    """doc_id, title from records of any shape that :func:`pick` understands."""
    i, t = pick(records, CANDIDATES["id"]), pick(records, CANDIDATES["title"])
    if t is None:
        raise ValueError("no title field")
    key = as_text(records, i) if i else F.lit(None).cast("string")
    return records.select(key.alias("doc_id"), as_text(records, t).alias("title")).where("title <> ''")


def normalised_titles(index: DataFrame) -> DataFrame:
    return index.select(T.title_norm(F.col("title")).alias("t")).where("t <> ''").distinct()


def with_title_hit(sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """Adds hit: whether the normalised query is a title. Spark broadcasts the titles only if they are small."""
    j = sessions.withColumn("t", T.title_norm(F.col("query"))).join(titles.withColumn("hit", F.lit(True)), "t", "left")
    return j.withColumn("hit", F.coalesce("hit", F.lit(False))).drop("t")


def classes(sessions: DataFrame, titles: DataFrame, exploratory_from: int = 4, short_to: int = 3) -> DataFrame:
    """session_id, n, refine, hit, klass, sub for every session."""
    mine = Window.partitionBy("session_id").orderBy("ts", "ord")
    s = with_title_hit(sessions.where("session_id is not null"), titles).withColumn("prev", F.lag("query").over(mine)).withColumn("k", F.row_number().over(mine))
    refining = (F.col("k") > 1) & reformulation.classify(F.col("prev"), F.col("query")).isin(*reformulation.REFINING)
    g = s.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(refining).alias("refine"), F.bool_or("hit").alias("hit"))
    klass = (
        F.when(F.col("hit"), "Known-Item")
        .when(F.col("n") == 1, "Einzelquery (ohne Titel)")
        .when(F.col("n") >= exploratory_from, "Exploratory")
        .when((F.col("n") <= short_to) & (F.col("refine") == 0), "Known-Item")
        .otherwise("Unscharf")
    )
    return g.withColumn("klass", klass).withColumn("sub", F.when((F.col("klass") == "Exploratory") & (F.col("refine") >= 1), "refining").when(F.col("klass") == "Exploratory", "plain").when(F.col("klass") == "Known-Item", F.when(F.col("hit"), "title").otherwise("short")))


def class_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("klass", "sub").agg(F.count(F.lit(1)).alias("n"))


def priority_classes(sessions: DataFrame, titles: DataFrame, exploratory_from: int = 4) -> DataFrame:
    g = with_title_hit(sessions, titles).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("hit").alias("hit"))
    return g.withColumn("klass", F.when(F.col("hit"), "known-item").when(F.col("n") >= exploratory_from, "exploratory").otherwise("unclear")).groupBy("klass").agg(F.count(F.lit(1)).alias("n"))


def title_positions(sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """bucket, sessions, title_sessions, queries, title_queries, first, middle, last (positions in sessions of two queries or more)."""
    mine = Window.partitionBy("session_id")
    s = with_title_hit(sessions, titles).withColumn("k", F.row_number().over(mine.orderBy("ts", "ord"))).withColumn("n", F.count(F.lit(1)).over(mine))
    many = F.col("hit") & (F.col("n") >= 2)
    g = s.groupBy("session_id").agg(
        F.max("n").alias("n"), F.count_if("hit").alias("hits"), F.count_if(many & (F.col("k") == 1)).alias("first"), F.count_if(many & (F.col("k") > 1) & (F.col("k") < F.col("n"))).alias("middle"), F.count_if(many & (F.col("k") == F.col("n"))).alias("last")
    )
    return g.groupBy(T.position_bucket(F.col("n")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.expr("hits > 0")).alias("title_sessions"), F.sum("n").alias("queries"), F.sum("hits").alias("title_queries"), F.sum("first").alias("first"), F.sum("middle").alias("middle"), F.sum("last").alias("last")
    )

"""Readers and writers of logs, corpora and dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

RAW_SCHEMA = S.StructType([S.StructField(c, S.StringType()) for c in ("date", "search_id", "serp", "query", "trackId", "type", "uid")])


def flatten_value(c):
    """Tabs and line ends become spaces, NUL goes."""
    return F.translate(F.regexp_replace(c, r"[\t\r\n]", " "), "\u0000", "")


def discover_fields(spark: SparkSession, paths: list[str]) -> list[str]:
    """Keys of all JSON objects of the files, sorted; other lines count for nothing."""
    lines = spark.read.text(paths).select(F.try_parse_json("value").alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    keys = lines.select(F.explode(F.json_object_keys(F.to_json("v"))).alias("k")).distinct()
    return sorted(r.k for r in keys.collect())  # one row for each field name


def read_json_log(spark: SparkSession, paths: list[str], schema: S.StructType = RAW_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON-lines files with every field as text, and the lines that are no objects: (file, line, raw), raw cut to 300 characters.

    Blank lines are skipped but counted: ``line`` is the number in the file, from 1. It is the line's place in its block of the file plus the
    lines of the blocks before, of which a table with one row for each block tells.
    """
    meta = F.col("_metadata")
    every = spark.read.text(paths).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))
    checked = every.where("trim(value) <> ''").withColumn("v", F.try_parse_json("value")).withColumn("fine", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    text = lambda f: F.coalesce(F.try_variant_get("v", f"$.{f}", "string"), F.to_json(F.try_variant_get("v", f"$.{f}", "variant")))
    rows = checked.where("fine").select(*[flatten_value(F.nullif(text(f.name), F.lit(""))).alias(f.name) for f in schema.fields])
    blocks = every.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))  # numbers run on within a task, so within a block
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bad = checked.where("not fine").join(blocks.withColumn("before", before), ["file", "block"])
    return rows, bad.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), F.substring("value", 1, 300).alias("raw"))


def read_tsv(spark: SparkSession, path: str, quoted: bool = True, schema: S.StructType | None = None, header: bool = True) -> DataFrame:
    """Tab-separated text, all columns as text unless a schema is given; short rows get nulls, NUL bytes go."""
    reader = spark.read.option("sep", "\t").option("header", header).option("quote", '"' if quoted else "").option("escape", '"').option("maxCharsPerColumn", -1)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.withColumns({f.name: F.translate(f.name, "\u0000", "") for f in df.schema.fields if f.dataType == S.StringType()})


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", True).option("escape", "\"").csv(path)


def write_sorted(df: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> None:
    """Parquet files in the order of ``by`` across all of them: ranges, each sorted in its task."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode(mode).parquet(path)


def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_slices(sliced: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder for each value of slice."""
    sliced.write.mode(mode).partitionBy("slice").parquet(path)


def write_lines(df: DataFrame, line, path: str, mode: str = "errorifexists") -> None:
    df.select(line.alias("value")).write.mode(mode).text(path)


def session_blocks(events: DataFrame, numbers: DataFrame, each: int = 5000) -> DataFrame:
    """Report lines of sessions with the file number they belong to: ``each`` sessions a file, minutes since the query before."""
    mine = Window.partitionBy("session_id").orderBy("ts", "ord")
    n = numbers.withColumn("k", F.regexp_extract("number", r"(\d+)", 1).cast("bigint"))
    minutes = F.bround((F.col("ts") - F.lag("ts").over(mine)) / 60).cast("bigint")
    return events.join(n, "session_id").select(F.floor((F.col("k") - 1) / each).cast("int").alias("file"), "number", F.row_number().over(mine).alias("line"), minutes.alias("minutes"), "query")


def read_corpus(spark: SparkSession, path: str, suffix: str = "*.{json,jsonl}") -> DataFrame:
    """Records of JSON arrays, JSON lines, or of files that are one object each, whose first list of objects (by name) holds them, whatever other fields it has."""
    reader = lambda: spark.read.option("pathGlobFilter", suffix)
    plain = reader().json(path)
    pretty = "_corrupt_record" in plain.columns  # documents of several lines
    records = reader().option("multiLine", True).json(path) if pretty else plain
    lines = reader().text(path).select(F.trim("value").alias("value"), F.col("_metadata")["file_path"].alias("file"), F.monotonically_increasing_id().alias("at")).where("value <> ''")
    files = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.substring("value", 1, 1), "at").alias("begin"))
    one_each = files.where((F.col("begin") == "[") | ((F.col("n") > 1) & F.lit(not pretty))).isEmpty()
    lists = [f.name for f in records.schema.fields if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct"]
    return records.select(F.explode(lists[0]).alias("r")).select("r.*") if lists and one_each else records


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("docno string, title string, text string").json(path).select("docno", "title", "text")


def strip_markup(text):
    """Wiki text without comments, templates, tables, references, tags, link targets and emphasis (regular expressions, innermost first)."""
    for pattern, put in ((r"(?s)<!--.*?-->", ""), (r"(?s)<ref[^>]*/>|<ref[^>]*>.*?</ref>", ""), *[(r"(?s)\{\{[^{}]*\}\}", "")] * 4, (r"(?s)\{\|.*?\|\}", ""), (r"\[\[(?:[Ff]ile|[Ii]mage|[Cc]ategory):[^\[\]]*\]\]", ""), (r"\[\[(?:[^|\[\]]*\|)?([^\[\]]*)\]\]", "$1"), (r"\[https?://\S+ ?([^\]]*)\]", "$1"), (r"<[^>]+>", ""), (r"'{2,}", ""), (r"(?m)^=+\s*(.*?)\s*=+\s*\z", "$1")):
        text = F.regexp_replace(text, pattern, put)
    return F.trim(text)


def read_wiki_dump(spark: SparkSession, path: str, least: int = 50) -> DataFrame:
    """docno, title, text of the articles of a (compressed) XML dump: namespace 0, no redirects, texts of ``least`` characters or more."""
    schema = "id long, ns int, title string, redirect struct<_title:string>, revision array<struct<text:string>>"
    pages = spark.read.format("xml").option("rowTag", "page").option("valueTag", "_v").schema(schema).load(path).where("ns = 0 and redirect is null")
    text = strip_markup(F.element_at("revision", 1)["text"])
    return pages.select(F.col("id").cast("string").alias("docno"), "title", text.alias("text")).where(F.length("text") >= least)


def alias_columns(df: DataFrame, candidates: dict[str, tuple[str, ...]]) -> DataFrame:
    """Renames the first present candidate of each wanted column."""
    found = {w: next((c for c in cs if c in df.columns), None) for w, cs in candidates.items()}
    return df.withColumnsRenamed({c: w for w, c in found.items() if c and c != w})

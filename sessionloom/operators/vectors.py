"""TF-IDF cosines of neighbouring queries, BM25 retrieval and concept (ESA) cosines, as joins over long tables."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def english_stop_words() -> list[str]:
    """Spark's own English list; pass another one where parity with another library's list is wanted."""
    return StopWordsRemover.loadDefaultStopWords("english")


def tfidf(queries: DataFrame, grams, most_features: int | None = None) -> DataFrame:
    """query, term, weight (L2-normalised, smooth idf) of the queries, which may repeat: idf counts every row.

    queries: (query). Terms are counted once for each distinct query, weighted by how often it occurs.
    """
    distinct = queries.groupBy("query").agg(F.count(F.lit(1)).alias("times"))
    terms = distinct.select("query", "times", F.explode(grams(F.col("query"))).alias("term")).groupBy("query", "times", "term").agg(F.count(F.lit(1)).alias("tf"))
    total = queries.agg(F.count(F.lit(1)).alias("rows"))
    df = terms.groupBy("term").agg(F.sum("times").alias("df"), F.sum(F.col("tf") * F.col("times")).alias("all_tf"))
    if most_features:
        df = df.orderBy(F.desc("all_tf"), "term").limit(most_features)
    weighted = terms.join(df, "term").crossJoin(F.broadcast(total)).withColumn("w", F.col("tf") * (F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1))  # one row: the total
    size = weighted.groupBy("query").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return weighted.join(size, "query").select("query", "term", (F.col("w") / F.col("size")).alias("weight"))


def pair_cosines(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """q1, q2, cosine of distinct pairs (q1, q2); 0 where no term is shared."""
    pairs = pairs.select("q1", "q2").distinct()
    one = weights.select(F.col("query").alias("q1"), "term", F.col("weight").alias("w1"))
    two = weights.select(F.col("query").alias("q2"), "term", F.col("weight").alias("w2"))
    dots = pairs.join(one, "q1").join(two, ["q2", "term"]).groupBy("q1", "q2").agg(F.sum(F.col("w1") * F.col("w2")).alias("cosine"))
    return pairs.join(dots, ["q1", "q2"], "left").select("q1", "q2", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def char_tfidf(queries: DataFrame, most_features: int | None = None) -> DataFrame:
    return tfidf(queries, T.char_grams, most_features)


def word_tfidf(queries: DataFrame, stop: list[str] | None = None, most_features: int | None = None) -> DataFrame:
    stop = english_stop_words() if stop is None else stop
    return tfidf(queries, lambda q: T.word_grams(q, stop), most_features)


def index_terms(text):
    return F.filter(F.split(F.lower(T.sanitize(text)), " "), lambda w: w != "")


def inverted_index(documents: DataFrame, docno: str, text: str, stop: list[str] | None = None, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings (term, docno, tf), doc_stats (docno, len) and term_stats (term, df).

    asked: queries (query) to answer; postings then hold their terms alone, as lengths need no postings.
    """
    terms = index_terms(F.col(text))
    if stop:
        terms = F.filter(terms, lambda w: ~w.isin(stop))
    listed = documents.select(F.col(docno).cast("string").alias("docno"), terms.alias("terms")).where(F.size("terms") > 0)
    words = listed.select("docno", F.explode("terms").alias("term"))
    if asked is not None:
        words = words.join(asked.select(F.explode(index_terms(F.col("query"))).alias("term")).distinct(), "term", "left_semi")
    postings = words.groupBy("term", "docno").agg(F.count(F.lit(1)).alias("tf"))
    return postings, listed.groupBy("docno").agg(F.sum(F.size("terms")).alias("len")), postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def retrieve(queries: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], topn: int = 1000, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query, docno, score, rank: BM25 (non-negative idf) of distinct queries; the best ``topn`` of each, ties by docno.

    Postings meet the lengths first, so they lie by document when the queries' terms join them and each document's sums need no
    further shuffle where those are few; queries go by number, their texts come back with the results.
    """
    postings, docs, terms = index
    totals = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    named = queries.select("query").where("query is not null").distinct().withColumn("qid", F.xxhash64("query"))
    asked = named.select("qid", F.explode(index_terms(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighted = terms.crossJoin(F.broadcast(totals)).select("term", "avg_len", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # totals: one row
    hits = postings.join(docs, "docno").join(asked.join(weighted, "term"), "term")
    score = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = hits.groupBy("qid", "docno").agg(F.sum(score).alias("score"))
    mine = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "docno")  # sums of floats in any order tie alike
    best = scored.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= topn)
    return best.join(named, "qid").select("query", "docno", "score", "rank")


def concept_vectors(retrieved: DataFrame, topn: int | None = None) -> DataFrame:
    """query, term (docno), weight: retrieval scores, L2-normalised over the best ``topn``."""
    r = retrieved.where(F.col("rank") <= topn) if topn else retrieved
    size = r.groupBy("query").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("size")).where("size > 0")
    return r.join(size, "query").select("query", F.col("docno").alias("term"), (F.col("score") / F.col("size")).alias("weight"))

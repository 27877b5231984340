"""Queries of the corpus operators over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctph, langid, licences, minhash, mixing, passages, pii, quality, rpforest


#: A test key, not a secret: published surrogates need one that stays with their owner.
KEY = "sessionloom tests"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rp_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_context_triggered_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.fingerprints(table(spark, sf_dir, "documents"))


def op3_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.learn(documents, table(spark, sf_dir, "labels")))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.checked(pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY))
    return out.select("doc_id", "n_entities", "kinds", "text")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", F.coalesce("source", F.lit(mixing.NONE)).alias("source"), F.coalesce("lang", F.lit(mixing.NONE)).alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").cast("long").alias("tokens"), F.round("_p", 9).alias("probability"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = langid.learn(documents.where(~held_out))
    return langid.predict(documents.select("doc_id", "text", held_out.alias("held_out")), model, keep=("doc_id", "held_out"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"pipeline": corpus_pipeline.run}


_REACH = """reach as (select x, y from links union select y, x from links union select r.x, l.y from reach r join (select x, y from links union all select y, x from links) l on r.y = l.x),
 low as (select x, min(y) y from reach group by 1)"""

_OP1 = f"""with recursive good as (select vec_id, label, list_transform(embedding, lambda c: c::double) v from embeddings where label is not null and len(embedding) > 0
 and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
 links as (select a.vec_id x, b.vec_id y from good a join good b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id < b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.98), {_REACH},
 n as (select x, count(*) n from (select x from links union all select y from links) group by 1)
 select vec_id, cast(coalesce(n, 0) as bigint) n_links, least(vec_id, coalesce(y, vec_id)) component_id, vec_id <= coalesce(y, vec_id) kept from embeddings left join n on n.x = vec_id left join low on low.x = vec_id"""

_OP4 = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
 d as (select doc_id, case when len(w) = 1 then [w[1]] else list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i+1]))) end s from w),
 e as (select doc_id, len(s) n, unnest(s) g from d),
 p as (select a.doc_id x, b.doc_id y, a.n an, b.n bn, count(*) c from e a join e b on a.g = b.g and a.doc_id < b.doc_id and 100*least(a.n, b.n) >= 80*greatest(a.n, b.n) group by all),
 links as (select x, y from p where 100*c >= 80*(an + bn - c)), {_REACH}
 select doc_id, cast(len(s) as bigint) n_shingles, least(doc_id, coalesce(y, doc_id)) component_id, doc_id <= coalesce(y, doc_id) kept from d left join low on low.x = doc_id"""


def _op9() -> str:
    """Raking as a chain of subqueries: 12 sweeps without bounds, 32 with them."""
    topic = " ".join(f"when regexp_matches(text, '{pattern}') then '{name}'" for name, pattern in mixing.TOPICS)
    steps = [
        f"d as (select doc_id, coalesce(source, '{mixing.NONE}') source, coalesce(lang, '{mixing.NONE}') lang, coalesce(case {topic} end, 'prose') topic, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::double tokens from documents)",
        "c0 as (select source, lang, topic, sum(tokens) tokens from d group by all)",
        "c1 as (select *, " + ", ".join(f"sum(tokens) over (partition by {x}) n_{x}" for x in mixing.SIDES) + " from c0)",
        "c2 as (select *, " + ", ".join(f"sqrt(n_{x}) / sum(case when n_{x} > 0 then sqrt(n_{x}) * tokens / n_{x} else 0 end) over () g_{x}" for x in mixing.SIDES) + ", tokens w from c1)",
    ]
    last = "c2"
    for k in range(12):
        for x in mixing.SIDES:
            steps.append(f"r{k}{x} as materialized (select * replace (case when sum(w) over (partition by {x}) > 0 then w * g_{x} / sum(w) over (partition by {x}) else 0 end as w) from {last})")
            last = f"r{k}{x}"
    steps.append(f"m as (select *, least(0.5 * sum(tokens) over (), " + ", ".join(f"min(case when g_{x} > 0 and n_{x} > 0 then n_{x} / g_{x} end) over ()" for x in mixing.SIDES) + f") most from {last})")
    steps.append("b as (select * replace (coalesce(least(tokens, case when sum(w) over () <> 0 then w * most / sum(w) over () end), 0) as w) from m)")
    last = "b"
    for k in range(32):
        for x in mixing.SIDES:
            steps.append(f"b{k}{x} as materialized (select * replace (case when sum(w) over (partition by {x}) > 0 then least(tokens, w * g_{x} * most / sum(w) over (partition by {x})) else 0 end as w) from {last})")
            last = f"b{k}{x}"
    steps.append(f"p as (select source, lang, topic, case when tokens <= 0 then 1 else least(1.0, w / tokens) end p from {last})")
    chance = "cast(concat('0x', substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 12)) as bigint)::double / 281474976710656"
    return f"with {', '.join(steps)} select doc_id, source, lang, topic, cast(d.tokens as bigint) tokens, round(p, 9) probability from d join p using (source, lang, topic) where {chance} < p"


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are tested against plain versions in tests/llm."""
    return {"op1_rp_forest_dedup": _OP1, "op4_minhash_dedup": _OP4, "op9_raked_mixture": _op9()}

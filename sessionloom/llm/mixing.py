"""Mixing to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed for each cell (source, language, topic); sweeps rake the cell weights to the three marginals in turn. The
cells are then raked on with no cell's expected tokens above its tokens; their ratio is the probability with which its documents
are kept. The budget is lowered where a value has fewer tokens than its target share of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, stage, unused

SIDES = ("source", "lang", "topic")
# Topics by the first pattern found in a text.
TOPICS = (
    ("legal", "(?i)licen[sc]e|all rights reserved|copyright"),
    ("contact", "@|555-|https?://"),
    ("tabular", " \\| "),
)
NONE = "(none)"


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return F.coalesce(out, F.lit("prose"))


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("double")


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone, so that a rerun draws the same documents; null ids share the one of the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def cells(documents: DataFrame) -> DataFrame:
    """source, lang, topic, tokens: sums, aggregated before the shuffle; nulls form a group of their own."""
    keyed = documents.select(F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"), topic_of(F.col("text")).alias("topic"), tokens_of(F.col("text")).alias("tokens"))
    return keyed.groupBy(*SIDES).agg(F.sum("tokens").alias("tokens"))


def with_targets(table: DataFrame, power: float = 0.5, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Adds _source, _lang and _topic, the target shares of a cell's values: the given weights (a value without one gets 0), or
    for sides not given the token shares to ``power``; they sum to 1 over the values that have tokens."""
    targets = targets or {}
    if set(targets) - set(SIDES) or any(min(x.values(), default=0) < 0 or not sum(x.values()) > 0 for x in targets.values()):
        raise ValueError(f"targets are weights of at least 0, not all 0, by {SIDES}")
    t = table
    for side in SIDES:
        t = t.withColumn(f"_n{side}", F.sum("tokens").over(Window.partitionBy(side)))
        if side in targets:
            given = F.create_map(*[F.lit(x) for value, weight in targets[side].items() for x in (value, float(weight))])
            t = t.withColumn(f"_{side}", F.coalesce(F.try_element_at(given, F.col(side)), F.lit(0.0)))
        else:
            t = t.withColumn(f"_{side}", F.pow(f"_n{side}", F.lit(power)))
    every = Window.partitionBy()
    return t.withColumns({f"_{s}": F.try_divide(F.col(f"_{s}"), F.sum(F.when(F.col(f"_n{s}") > 0, F.col(f"_{s}") * F.col("tokens") / F.col(f"_n{s}")).otherwise(0.0)).over(every)) for s in SIDES})


def rake(table: DataFrame, power: float = 0.5, sweeps: int = 12, sweeps_a_stage: int = 4, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Cells with their raked weight w; without ``targets`` a value's target is its token share to ``power``, so large sources give way to small ones.

    Cells without tokens keep weight 0. One row a cell: the windows run over these sums, never over documents.
    """
    t = stage(with_targets(table, power, targets).withColumn("w", F.col("tokens")), "mix-targets")
    for k in range(sweeps):
        for side in SIDES:
            total = F.sum("w").over(Window.partitionBy(side))
            t = t.withColumn("w", F.when(total > 0, F.col("w") * F.col(f"_{side}") / total).otherwise(0.0))
        if k % sweeps_a_stage == sweeps_a_stage - 1:
            t = stage(t, "mix-sweep")
    return t.select(*SIDES, "tokens", "w")


def calibrate(raked: DataFrame, fraction: float) -> DataFrame:
    """Adds p, the cells' sampling probability: expected tokens are ``fraction`` of all, as far as whole cells allow."""
    t = raked.withColumn("r", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0))
    order = Window.orderBy(F.desc("r"), *SIDES)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("full", F.coalesce(F.sum("tokens").over(before), F.lit(0.0)))
    t = t.withColumn("rest", F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("factor", (F.lit(fraction) * F.sum("tokens").over(Window.partitionBy()) - F.col("full")) / F.when(F.col("rest") > 1e-12, F.col("rest")))
    # the first cell in falling order whose probability stays within one fixes the factor; those before it are kept whole
    fits = F.min(F.when(F.col("factor") * F.col("r") <= 1.0, F.struct("full", "factor"))).over(Window.partitionBy())
    return t.withColumn("p", F.when(F.col("tokens") <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(fits["factor"], F.lit(1e300)) * F.col("r"))))).select(*SIDES, "tokens", "w", "p")


def bounded(raked: DataFrame, fraction: float = 0.5, power: float = 0.5, targets: dict[str, dict[str, float]] | None = None, sweeps: int = 32, sweeps_a_stage: int = 8) -> DataFrame:
    """Cells raked on with the expected tokens w of no cell above its tokens: source, lang, topic, tokens, w, p = w / tokens and the
    target shares _source, _lang, _topic.

    The budget is ``fraction`` of all tokens, or less where a value has fewer tokens than its target would take: then it is the
    largest budget whose targets every value can give. What a full cell cannot take goes to the others of its values in the next sweeps.
    """
    every = Window.partitionBy()
    t = with_targets(raked, power, targets)
    most = F.least(F.lit(fraction) * F.sum("tokens").over(every), *[F.min(F.when((F.col(f"_{s}") > 0) & (F.col(f"_n{s}") > 0), F.col(f"_n{s}") / F.col(f"_{s}"))).over(every) for s in SIDES])
    t = t.withColumn("_most", most)
    t = stage(t.withColumn("w", F.coalesce(F.least("tokens", F.try_divide(F.col("w") * F.col("_most"), F.sum("w").over(every))), F.lit(0.0))), "mix-bounds")
    for k in range(sweeps):
        for side in SIDES:
            total = F.sum("w").over(Window.partitionBy(side))
            t = t.withColumn("w", F.when(total > 0, F.least("tokens", F.col("w") * F.col(f"_{side}") * F.col("_most") / total)).otherwise(0.0))
        if k % sweeps_a_stage == sweeps_a_stage - 1:
            t = stage(t, "mix-bounded")
    p = F.when(F.col("tokens") <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("w") / F.col("tokens")))
    return t.withColumn("p", p).select(*SIDES, "tokens", "w", "p", *[f"_{s}" for s in SIDES])


def gaps(cells_p: DataFrame) -> DataFrame:
    """side, value, target and expected share of the sample's tokens, of :func:`bounded`: where they differ, no sample of whole cells was found that meets the target."""
    every = F.sum(F.col("tokens") * F.col("p")).over(Window.partitionBy())
    each = cells_p.withColumn("share", F.try_divide(F.col("tokens") * F.col("p"), every))
    long = each.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("value"), F.when(F.col("tokens") > 0, F.col(f"_{s}")).otherwise(0.0).alias("target"), "share") for s in SIDES])).alias("x")).select("x.*")
    return long.groupBy("side", "value").agg(F.max("target").alias("target"), F.sum("share").alias("expected"))


def mix(documents: DataFrame, fraction: float = 0.5, power: float = 0.5, sweeps: int = 12, targets: dict[str, dict[str, float]] | None = None, names: tuple[str, ...] = ("_topic", "_tokens", "_weight", "_p")) -> DataFrame:
    """The sampled documents (all their columns) with topic, tokens, weight and probability as _topic, _tokens, _weight, _p; ``names`` are
    the four new columns' names, for tables that have such columns already.

    A document is kept if its id's uniform number is below its cell's probability: repeated rows share their fate, documents
    without words (null and empty texts) are kept, texts may be of any length, nulls in source or lang are a value of their own, an empty
    table stays empty. ``targets`` are weights by side and value (see :func:`with_targets`);
    ``fraction`` is the most that is kept (see :func:`bounded`). The cell table has one row for each source, language and topic.
    """
    topic, tokens, weight, probability = names
    source, lang = unused([*documents.columns, *names], "_source", "_lang")
    named = documents.withColumns({source: F.coalesce("source", F.lit(NONE)), lang: F.coalesce("lang", F.lit(NONE)), topic: topic_of(F.col("text")), tokens: tokens_of(F.col("text"))})
    p = bounded(rake(stage(cells(documents), "mix-cells"), power, sweeps, targets=targets), fraction, power, targets)
    p = stage(p, "mix-cells-p").select(F.col("source").alias(source), F.col("lang").alias(lang), F.col("topic").alias(topic), F.col("w").alias(weight), F.col("p").alias(probability))
    kept = named.join(p, [source, lang, topic]).where(uniform(F.col("doc_id")) < F.col(probability))
    return kept.select(*columns([*documents.columns, *names]))

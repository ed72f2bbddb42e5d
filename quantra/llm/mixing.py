"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sizes are words. Targets: the sources share `share` times all sizes by weight; a target stops at `cap` times its
source's size and the excess is shared anew by weight (the water level is found from the sources in order of cap/weight).
Certain copies: the whole part of target/source size is given to every document of the source.
Order sampling of the rest: a document's inclusion probability is p = min(1, rate * measure), its measure being its size (in steps of a
sixteenth of an octave) and the rate such that the expected words are those the source still needs; documents of p = 1 are certain. Documents
are ranked by (U/(1-U)) / (p/(1-p)), U a hash of the row, and taken in that order until the words needed are there, to the nearer side of the
last document: a sample of fixed size (in words) with unequal inclusion probabilities. As no document over 1/rate words is left to chance, the
last one moves the total by half of that at most.

No source meets in one task: sizes are summed by band (at most some hundred a source) for the rate, and by 4,096 rank cells for the cell of
the cut, and only that cell's documents are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantra.llm.common import small, stored, wrapped

CELLS, BANDS = 4096, 16
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"


def _uniform(seed: int) -> Column:
    """In (0, 1), from the row's id and text."""
    h = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("__key"), F.lit(seed)), 11)
    return (h.cast("double") + 0.5) / F.lit(float(1 << 53))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, __key, size in words, and more."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return wrapped(docs, F.col("source"), size.alias("size"), *more).withColumnRenamed("row_key", "__key")


def _band() -> Column:
    return F.when(F.col("size") > 0, F.floor(F.log2("size") * BANDS)).otherwise(F.lit(-1)).cast("int")


def _measure(band: Column) -> Column:
    return F.pow(F.lit(2.0), band / BANDS)


def _ranked(sized: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """Adds inclusion, __rank in [0, 1) (the uniform's odds over those of inclusion, as a share) and __cell: -1 for certain documents. rates: __source, certain_band, rate."""
    p = F.when(F.col("size") == 0, F.lit(0.0)).when(_band() > F.col("certain_band"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("rate") * _measure(_band())))
    u, p1 = _uniform(seed), F.col("inclusion")
    joined = sized.join(small(rates, 100_000), F.col("source").eqNullSafe(F.col("__source"))).withColumn("inclusion", p)
    ranked = joined.withColumn("__rank", u * (1 - p1) / (u * (1 - p1) + (1 - u) * p1))
    return ranked.withColumn("__cell", F.when(p1 == 1, F.lit(-1)).otherwise(F.least((F.col("__rank") * CELLS).cast("int"), F.lit(CELLS - 1))))


def _place() -> Column:
    return F.struct("__rank", F.coalesce("doc_id", F.lit(-(1 << 63))), "__key")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> with weight and target. One row a source; weights go round by code point, a null source last."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((turn - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    limit = F.lit(float(cap)) * F.col("source_size")
    levels = weighted.withColumn("level", limit / F.col("weight")).withColumn("all", share * F.sum("source_size").over(everything))
    levels = levels.withColumn("spent", F.sum(limit).over(by_level.rowsBetween(Window.unboundedPreceding, -1)))
    levels = levels.withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    levels = levels.withColumn("water", (F.col("all") - F.coalesce("spent", F.lit(0.0))) / F.col("open"))
    levels = levels.withColumn("under", F.col("level") > F.col("water"))
    water = F.first(F.when(F.col("under"), F.col("water")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.select("source", "source_size", "weight", F.when(water.isNull(), limit).otherwise(F.least(limit, F.col("weight") * water)).alias("target"))


def needs(sized: DataFrame, share: float, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """One row a source: source_size, target, copies (certain ones of every document) and need (words of the sample)."""
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights)
    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    goal = goal.withColumn("copies", F.floor(ratio + 1e-12).cast("long"))
    return goal.withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size")))


def inclusion_rates(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """(__source, certain_band, rate): bands over certain_band are certain, for the others p = rate * measure.

    With the bands over k certain, the rate is (need - their words) / (the words of the others, each times its measure); the right k is the greatest where no
    other p is over 1.
    """
    bands = sized.where("size > 0").groupBy("source", _band().alias("band")).agg(F.sum("size").alias("words"))
    up = Window.partitionBy("source").orderBy("band")
    bands = bands.withColumn("weighed", F.sum(F.col("words") * _measure(F.col("band"))).over(up)).withColumn("over", F.sum("words").over(Window.partitionBy("source")) - F.sum("words").over(up))
    named = goal.select(F.col("source").alias("__source"), "need")
    tried = bands.join(named, F.col("source").eqNullSafe(F.col("__source"))).withColumn("rate", (F.col("need") - F.col("over")) / F.col("weighed"))
    fits = tried.where(F.col("rate") * _measure(F.col("band")) <= 1)
    return fits.groupBy("__source").agg(F.max_by(F.struct(F.col("band").alias("certain_band"), "rate"), "band").alias("at")).select("__source", "at.certain_band", F.greatest("at.rate", F.lit(0.0)).alias("rate"))


def cuts(ranked: DataFrame, goal: DataFrame) -> DataFrame:
    """(__source, cut_cell, cut): the cell where the words needed are reached and the last place taken in it (null: none), for sources that need a sample."""
    by_cell = Window.partitionBy("source").orderBy("__cell")
    cells = ranked.where("size > 0").groupBy("source", "__cell").agg(F.sum("size").alias("n")).withColumn("to", F.sum("n").over(by_cell))
    crossing = cells.join(goal.where("need > 0").select(F.col("source").alias("__source"), "need"), F.col("source").eqNullSafe(F.col("__source"))).where("to > need")
    at = F.min_by(F.struct(F.col("__cell").alias("cut_cell"), (F.col("need") - F.col("to") + F.col("n")).alias("left")), "__cell")
    crossing = stored(crossing.groupBy("__source").agg(at.alias("at")).select("__source", "at.cut_cell", "at.left"), "mix-cells")
    inside = ranked.where("size > 0").drop("__source").join(small(crossing, 100_000), F.col("source").eqNullSafe(F.col("__source")) & (F.col("__cell") == F.col("cut_cell")))
    before = F.sum("size").over(Window.partitionBy("__source").orderBy("__rank", "doc_id", "__key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    taken = inside.withColumn("before", before).where("before + size / 2 <= left")
    last = taken.groupBy("__source").agg(F.max(_place()).alias("cut")).withColumnRenamed("__source", "__of")
    return crossing.join(last, F.col("__source").eqNullSafe(F.col("__of")), "left").select("__source", "cut_cell", "cut")


def _copies() -> Column:
    """The certain copies, and one more for documents before the cut, if the source needs any."""
    cut = F.when(F.col("need") > 0, F.coalesce("cut_cell", F.lit(CELLS))).otherwise(F.lit(-2))
    chosen = (F.col("__cell") < cut) | (F.col("__cell").eqNullSafe(F.col("cut_cell")) & F.coalesce(_place() <= F.col("cut"), F.lit(False)))
    return F.coalesce("copies", F.lit(0).cast("long")) + (chosen & (F.col("size") > 0)).cast("long")


def _planned(docs: DataFrame, share: float, cap: float, weights: tuple[float, ...], seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes, and one row a source: what `needs`, `inclusion_rates` and `cuts` give."""
    sized = stored(_sized(docs).drop("row"), "sizes")
    goal = stored(needs(sized, share, cap, weights), "mix-needs")
    rates = stored(inclusion_rates(sized, goal), "mix-rates")
    cut = cuts(_ranked(sized, rates, seed), goal).withColumnRenamed("__source", "__of")
    plan = goal.join(rates, goal.source.eqNullSafe(F.col("__source")), "left").drop("__source").join(cut, goal.source.eqNullSafe(F.col("__of")), "left").drop("__of")
    return sized, stored(plan.withColumnRenamed("source", "__source"), "mix-plan")


def mix_sources(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """One row for each of docs: doc_id, source, size, source_size, target, inclusion (the probability of one copy over the certain ones), copies and taken (size times copies).

    docs: doc_id long, source string, text string. A null or empty text has size 0 and takes nothing; a very long one counts whole and may be certain; a null
    source is a source of its own; rows with a null doc_id and repeated rows take part like any other (equal rows rank side by side, ties go by id and text).
    An empty table gives an empty result. Other columns are ignored, whatever their names. Reruns agree.
    """
    sized, plan = _planned(docs, share, cap, weights, seed)
    return _ranked(sized, plan, seed).withColumn("n", _copies()).select("doc_id", "source", "size", "source_size", "target", "inclusion", F.col("n").alias("copies"), (F.col("size") * F.col("n")).alias("taken"))


def mixed(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """docs as the mix has them: each row as often as its copies, so not at all where it has none. Columns as given.

    Nulls, empty and very long texts, ties, repeated rows, empty tables and columns of any names as in mix_sources; a row without words comes as often as
    its source's certain copies.
    """
    _, plan = _planned(docs, share, cap, weights, seed)
    rows = _ranked(_sized(docs), plan, seed).withColumn("__n", _copies())
    return rows.where("__n > 0").withColumn("__i", F.explode(F.expr("array_repeat(1, cast(__n as int))"))).select("row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies", "inclusion")

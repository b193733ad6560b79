"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 10).

Each document draws the exponential key -ln(u)/w, u from its id and w from its
quality weight; ascending keys are a weighted sample without replacement.
Whole epochs of a source come first, the fraction that is left goes to the
documents with the least keys until their words fill the budget. The prefix
sum is distributed: words are summed by (source, key bin), the bins' running
sums find the one bin that the budget cuts, and only that bin is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

SYMBOLS = "#*$%&|<>!"
#: Bins of a source's keys; one bin of a source of N documents holds about N/BINS.
BINS = 16384
#: Up to so many rows of cut bins go to where the texts are; beyond, texts are shuffled.
BROADCAST_ROWS = 500_000


def quality_weight(text: Column) -> Column:
    """(0, 1]: the share of a text's characters that are no symbols."""
    text = F.coalesce(text, F.lit(""))
    kept = F.length(F.translate(text, SYMBOLS, ""))
    return (kept + 1) / (F.length(text) + 1)


def uniform(doc_id: Column, seed: int) -> Column:
    """(0, 1], the same for an id in every run."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 1) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): source shares by weight, none above
    `most` times its size. Sharing an excess again and again by weight ends at
    target = min(cap, level * weight); the level is where the targets' sum
    meets the total, found from sums over sources ordered by cap / weight.
    One row per source, so these windows hold a table of sources only."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    named = sizes.withColumn("weight", pick).withColumn("cap", F.col("source_size") * float(most))
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    held = named.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") < F.col("cap"))
    # the first source that stays below its cap sets the level of all after it
    met = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything)
    return held.withColumn("met", met["level"]).select("source", "source_size", F.when(F.col("met").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("met") * F.col("weight"))).alias("target"))


def _drawn(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    text = F.col(text_col).cast("string")
    draw = -F.log(uniform(F.col(id_col), seed)) / quality_weight(text)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), draw.alias("draw"), *more)
    return own.withColumn("bin", F.floor((1 - F.exp(-F.coalesce("draw", F.lit(0.0)))) * BINS).cast("int"))


def plan_mix(drawn: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """What every source does (one row each), and the rows of the bins that
    budgets cut, with more = 1 for those taken once more than the epochs."""
    bins = materialize(drawn.groupBy("source", "bin").agg(F.sum("size").alias("words")), "bins")
    aims = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    aims = aims.withColumn("epochs", epochs).withColumn("left", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    filling = bins.withColumn("upto", F.sum("words").over(running)).join(aims.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
    cut = filling.where("upto > left").groupBy("s").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
    named = aims.alias("aims").join(cut.alias("cut"), F.col("aims.source").eqNullSafe(F.col("cut.s")), "left")
    plan = materialize(named.select(F.col("source").alias("s"), "source_size", "target", "epochs", "left", F.col("cut.bin").alias("cut"), F.col("cut.before").alias("before")), "plan")
    ordered = Window.partitionBy("s").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    # the document that the budget cuts is taken if that comes nearer to it
    there = F.col("before") + F.coalesce(F.sum("size").over(ordered), F.lit(0)) + F.col("size") / 2
    tight = drawn.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("cut")))
    return plan, tight.withColumn("more", (there <= F.col("left")).cast("int"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) per row of docs.

    size is the text's words (null text: 0), taken the words the mix takes of
    this row, repeats counted. Null sources are one source, ordered last. Rows
    that share an id draw one key and are then ordered by size. Texts without
    words are taken 0 times. An empty table gives no rows; other columns are
    ignored.
    """
    base = materialize(_drawn(docs, seed, id_col, text_col, source_col), "draws")
    plan, tight = plan_mix(base, weights, share, most)
    clear = base.join(plan, F.col("source").eqNullSafe(F.col("s"))).where("cut is null or bin <> cut").withColumn("more", F.coalesce((F.col("bin") < F.col("cut")).cast("int"), F.lit(0)))
    taken = (F.col("size") * (F.col("epochs") + F.col("more"))).cast("long")
    columns = ["doc_id", "size", "source", "source_size", "target", taken.alias("taken")]
    return clear.select(*columns).unionByName(tight.select(*columns))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken, with its
    own columns. Texts stay in their partitions: only sources' plans and the
    rows of the cut bins, about rows / BINS a source, meet them."""
    names = docs.columns
    base = materialize(_drawn(docs, seed, id_col, text_col, source_col), "draws")
    plan, tight = plan_mix(base, weights, share, most)
    cut_rows = materialize(tight.groupBy("s", "doc_id", "size").agg(F.max("more").alias("more")), "cut")
    if cut_rows.count() <= BROADCAST_ROWS:
        cut_rows = F.broadcast(cut_rows)
    kept = _drawn(docs, seed, id_col, text_col, source_col, F.struct(*names).alias("row"))
    rows = kept.join(plan, F.col("source").eqNullSafe(F.col("s"))).alias("r").join(cut_rows.withColumnsRenamed({"s": "s2", "doc_id": "id2", "size": "size2"}), F.col("s").eqNullSafe(F.col("s2")) & F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("size") == F.col("size2")), "left")
    times = F.col("epochs") + F.when(F.col("bin") < F.col("cut"), 1).when(F.col("bin") == F.col("cut"), F.coalesce("more", F.lit(0))).otherwise(0)
    return rows.where((F.col("size") > 0) & (times > 0)).select("row", F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("copy")).select(*[F.col("row")[c].alias(c) for c in names])

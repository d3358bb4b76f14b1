"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Native: DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpointed, text_or_empty

#: Sources up to which their plan is sent to every task.
MOST_BROADCAST = 100_000


def word_count(column: str = "text") -> Column:
    """Number of words of a text; null has none."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """Water-filling over (source, source_size): adds `target`.

    Sources by code point, null last, take `weights` in turn. The budget is
    `share` of all sizes. A source takes at most `max_epochs` times its size;
    what it can't take goes to the others by weight, until none is above.
    Sources in order of cap / weight are full first, so the full ones are a
    prefix and one running sum finds the level; no iteration is needed. The
    windows without partition run over one row per source, in one task: they
    are meant for up to some millions of sources.
    An empty table gives an empty table, a source of size 0 the target 0.
    """
    by_name, by_level = W.orderBy(F.asc_nulls_last("source")), W.orderBy("fill", F.asc_nulls_last("source"))
    whole = W.partitionBy()
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    s = (
        sources.select("source", "source_size")
        .withColumn("weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), turn.cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(int(max_epochs)))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
    )
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    onward = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    s = s.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weight_left", F.sum("weight").over(onward))
    s = s.withColumn("full", F.col("cap").cast("double") * F.col("weight_left") <= F.col("left") * F.col("weight"))
    full_cap = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("budget") - full_cap) * F.col("weight") / open_weight)
    return s.select("source", "source_size", target.cast("double").alias("target"))


def _row_id(id_col: str, text_col: str) -> Column:
    """The id as text; without one the text's digest, so that rows without id are drawn apart."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(text_or_empty(text_col).cast("binary"))))


def _draw(seed: int, row_id: Column) -> Column:
    """60 seeded bits from the id; the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), row_id)), 1, 15), 16, 10).cast("long")


def mix_sources(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, share: float = 1.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All rows of `docs` with size, source_size, target, repeats and taken.

    A source with target = r * size gets floor(r) whole repetitions of each
    document, and of the rest the documents with the smallest seeded draws,
    up to the size that comes nearest the target. The cut is found without
    sorting a source: sizes are summed in 4,096 bands of the draw, and only
    the band where the target is crossed is ordered. After that each row
    decides for itself by comparing its draw with its source's cut.

    Null text: size 0. Null source: a source of its own. Null id: drawn by
    its text. Equal ids share one draw and are taken together. Columns of
    `docs` that are named like an added one are replaced; other columns may
    have any name.
    """
    added = ["size", "source_size", "target", "repeats", "taken"]
    keep = [F.col(c) for c in docs.columns if c not in added]
    row_id = _row_id(id_col, text_col)
    sized = checkpointed(docs.select(F.col(source_col).alias("source"), row_id.alias("id"), word_count(text_col).alias("size"), _draw(seed, row_id).alias("draw")).withColumn("band", F.shiftright("draw", 48)))

    bands = sized.groupBy("source", "band").agg(F.sum("size").alias("band_size"))
    targets = source_targets(bands.groupBy("source").agg(F.sum("band_size").alias("source_size")), weights, max_epochs, share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = checkpointed(targets.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))

    t = targets.select(F.col("source").alias("t_source"), "need")
    run = F.sum("band_size").over(W.partitionBy("source").orderBy("band"))
    crossed = (
        bands.withColumn("upto", run)
        .join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .where((F.col("need") > 0) & (F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("band_size") < F.col("need")))
        .select("t_source", F.col("band").alias("cut_band"), (F.col("need") - (F.col("upto") - F.col("band_size"))).alias("band_need"))
    )
    inside = sized.join(crossed, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("band") == F.col("cut_band")))
    upto = F.sum("size").over(W.partitionBy("t_source").orderBy("draw", "id", "size").rowsBetween(W.unboundedPreceding, 0))
    cuts = (
        inside.withColumn("upto", upto)
        .withColumn("in", 2 * F.col("upto") - F.col("size") <= 2 * F.col("band_need"))
        .groupBy("t_source", "cut_band")
        .agg(F.max(F.when(F.col("in"), F.struct("draw", "id"))).alias("cut"))
    )
    own = "plan"
    while own in docs.columns:
        own += "_"
    plan = checkpointed(targets.join(cuts, F.col("source").eqNullSafe(F.col("t_source")), "left").select(
        F.struct("source", "source_size", "target", "whole", "cut_band", "cut").alias(own)
    ))

    if plan.count() <= MOST_BROADCAST:  # a few numbers a source; beyond, the join is shuffled, and adaptive execution splits hot sources
        plan = F.broadcast(plan)
    p = F.col(own)
    size, draw = word_count(text_col), _draw(seed, row_id)
    band = F.shiftright(draw, 48)
    extra = F.coalesce((band < p["cut_band"]) | ((band == p["cut_band"]) & (F.struct(draw.alias("draw"), row_id.alias("id")) <= p["cut"])), F.lit(False))
    rows = docs.join(plan, F.col(source_col).eqNullSafe(p["source"]), "left")
    rows = rows.select(*keep, p["source_size"].alias("source_size"), p["target"].alias("target"), size.alias("size"), (p["whole"] + extra.cast("long")).alias("repeats"))
    return rows.select(*keep, "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))

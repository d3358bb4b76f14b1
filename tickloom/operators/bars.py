"""Tape, bars and archive units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.ticks import bucket
from tickloom.sources.market import SEQ

NS = 1_000_000_000


def tape(fills: DataFrame) -> DataFrame:
    """One print per fill."""
    seq = F.concat(F.col("seq_ms").cast("string"), F.lit("-"), F.col("seq_ord").cast("string"))
    return fills.select("symbol_id", "price_ticks", "qty", "aggressor_side", "timestamp_ns", seq.alias("seq"), *SEQ)


def bars(prints: DataFrame, widths: list[int]) -> DataFrame:
    """OHLCV by symbol, width and bucket; first and last by sequence. All widths in one pass."""
    at = F.struct(*SEQ)
    rows = prints.withColumn("bucket_seconds", F.explode(F.array(*[F.lit(w).cast("long") for w in widths])))
    return rows.groupBy("symbol_id", "bucket_seconds", bucket("timestamp_ns", F.col("bucket_seconds") * NS).alias("open_ns")).agg(
        F.min_by("price_ticks", at).alias("open_ticks"), F.max("price_ticks").alias("high_ticks"), F.min("price_ticks").alias("low_ticks"),
        F.max_by("price_ticks", at).alias("close_ticks"), F.sum("qty").alias("volume"), F.count("*").alias("trades"),
    )


def split_open(b: DataFrame) -> DataFrame:
    """Adds `closed`: a later bucket of the symbol and width has a trade."""
    later = F.lead("open_ns").over(W.partitionBy("symbol_id", "bucket_seconds").orderBy("open_ns"))
    return b.withColumn("closed", later.isNotNull())


def force_closed(b: DataFrame, cutoff_ns: int) -> DataFrame:
    """Bars that a later trade or the cutoff has closed."""
    return split_open(b).where(F.col("closed") | (F.col("open_ns") + F.col("bucket_seconds") * NS <= cutoff_ns)).drop("closed")


def over_units(units: DataFrame, value: str, name: str, backward: bool, inclusive: bool, units_a_part: int, unit_ns: int) -> DataFrame:
    """Adds `name`: the least `value` of the units from a row's on (backward), or the greatest of those up to it, in two levels.

    Units are windowed within parts of some thousand, and parts, one row
    each, among each other, so no task sees all units of a long log.
    """
    part = bucket("unit_ns", units_a_part * unit_ns)
    best = F.min if backward else F.max
    u = units.withColumn("_part", part)
    order = F.desc("unit_ns") if backward else F.asc("unit_ns")
    own = best(value).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))
    parts = u.groupBy("_part").agg(best(value).alias("_v"))
    beyond = best("_v").over(W.orderBy(F.desc("_part") if backward else F.asc("_part")).rowsBetween(W.unboundedPreceding, -1))
    u = u.withColumn("_own", own).join(parts.select("_part", beyond.alias("_beyond")), "_part")
    both = (F.least if backward else F.greatest)("_own", "_beyond")
    return u.withColumn(name, both).drop("_part", "_own", "_beyond")


def flush_units(log: DataFrame, unit_seconds: int) -> DataFrame:
    """Per unit its first and last id, its rows and the id before its first record, from which a reader resumes."""
    at = F.struct(*SEQ)
    units = log.groupBy(bucket("timestamp_ns", unit_seconds * NS).alias("unit_ns")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    units = over_units(units, "last", "before", backward=False, inclusive=False, units_a_part=1440, unit_ns=unit_seconds * NS)
    return units.select(
        "unit_ns", F.col("first.seq_ms").alias("first_ms"), F.col("first.seq_ord").alias("first_ord"), F.col("last.seq_ms").alias("last_ms"),
        F.col("last.seq_ord").alias("last_ord"), "n", F.coalesce("before.seq_ms", F.lit(0)).alias("resume_ms"), F.coalesce("before.seq_ord", F.lit(0)).alias("resume_ord"),
    )


def seals_of(first: DataFrame, unit_seconds: int) -> DataFrame:
    """(unit_ns, seal) of units with their first record: the record from which on rows of the unit are late; only units that are sealed."""
    over = {"backward": True, "units_a_part": 1440, "unit_ns": unit_seconds * NS}
    # the first record of any later unit seals a unit that had begun by then
    later = over_units(first, "first", "later", inclusive=False, **over)
    sealed = later.withColumn("own", F.when(F.col("first") < F.col("later"), F.col("later")))
    # and no unit before one that is sealed opens any more
    return over_units(sealed, "own", "seal", inclusive=True, **over).where("seal is not null").select("unit_ns", "seal")


def late_rows(log: DataFrame, unit_seconds: int) -> DataFrame:
    """Rows of units that were sealed before they came: a record of a later unit lies between.

    A unit opens with its first record unless it, or a later one, is sealed
    already; the record that opens a later unit seals the ones before it.
    Units that ever open have the running maximum as their start, so a row
    is late if a later unit has begun before it and its own unit was open,
    or had no chance to open, by then.
    """
    rows = log.withColumn("unit_ns", bucket("timestamp_ns", unit_seconds * NS))
    first = rows.groupBy("unit_ns").agg(F.min(F.struct(*SEQ)).alias("first"))
    return rows.join(seals_of(first, unit_seconds), "unit_ns").where(F.struct(*SEQ) > F.col("seal"))


def reconcile(prints: DataFrame, archived: DataFrame, widths: list[int]) -> DataFrame:
    """Bars rebuilt from trades that differ from the archived ones, with the side that has them."""
    made = bars(prints, widths)
    cols = made.columns
    return made.select(cols).exceptAll(archived.select(cols)).withColumn("side", F.lit("rebuilt")).unionByName(archived.select(cols).exceptAll(made.select(cols)).withColumn("side", F.lit("archived")))


def misfiled(b: DataFrame) -> DataFrame:
    """Archived bars whose date partition is not the UTC day they open on."""
    from tickloom.functions.ticks import utc_date

    return b.where(utc_date("open_ns") != F.col("date").cast("string"))


def research_bars(history: DataFrame, minutes: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """Bars of consecutive minutes in [first, last); a short bar at the end is dropped."""
    h = history
    if first is not None:
        h = h.where(F.col("minute_index") >= first)
    if last is not None:
        h = h.where(F.col("minute_index") < last)
    start = h.groupBy("symbol_id").agg(F.min("minute_index").alias("start"))
    h = h.join(start, "symbol_id").withColumn("bar_index", F.call_function("div", F.col("minute_index") - F.col("start"), F.lit(minutes)))
    return (
        h.groupBy("symbol_id", "bar_index")
        .agg(
            F.min("minute_index").alias("first_minute"), F.min_by("close_ticks", "minute_index").alias("open_ticks"), F.max("close_ticks").alias("high_ticks"),
            F.min("close_ticks").alias("low_ticks"), F.max_by("close_ticks", "minute_index").alias("close_ticks"), F.count("*").alias("n"),
        )
        .where(F.col("n") == minutes).drop("n")
    )


def last_trade(prints: DataFrame) -> DataFrame:
    at = F.struct(*SEQ)
    return prints.groupBy("symbol_id").agg(F.max_by("price_ticks", at).alias("price_ticks"), F.max_by("qty", at).alias("qty"), F.max_by("seq", at).alias("seq"))


def recent_trades(prints: DataFrame, n: int) -> DataFrame:
    newest = F.row_number().over(W.partitionBy("symbol_id").orderBy(*[F.desc(c) for c in SEQ]))
    return prints.withColumn("rank", newest).where(F.col("rank") <= n)


def bar_series(delivered: DataFrame, n: int) -> DataFrame:
    """Per symbol and width the newest n bars; of a bar delivered again the last delivery counts. `arrival` orders deliveries."""
    twin = F.row_number().over(W.partitionBy("symbol_id", "bucket_seconds", "open_ns").orderBy(F.desc("arrival")))
    newest = F.row_number().over(W.partitionBy("symbol_id", "bucket_seconds").orderBy(F.desc("open_ns")))
    return delivered.withColumn("twin", twin).where("twin = 1").drop("twin").withColumn("rank", newest).where(F.col("rank") <= n)


def direction_volume(b: DataFrame) -> DataFrame:
    up = F.col("close_ticks") >= F.col("open_ticks")
    return b.groupBy("symbol_id", "bucket_seconds").agg(F.sum(F.when(up, F.col("volume")).otherwise(0)).alias("up_volume"), F.sum(F.when(up, 0).otherwise(F.col("volume"))).alias("down_volume"))


def replay_price(events: DataFrame, history: DataFrame, ratio_ns: int) -> DataFrame:
    """Each event with the price at its simulated minute: (offset + elapsed // ratio) mod the length of the symbol's history. `events` has symbol_id, seq_ord, elapsed_ns, offset."""
    n = history.groupBy("symbol_id").agg(F.count("*").alias("n"))
    minute = F.pmod(F.col("offset") + F.call_function("div", F.col("elapsed_ns"), F.lit(ratio_ns)), F.col("n"))
    return events.join(n, "symbol_id").withColumn("minute_index", minute).join(history, ["symbol_id", "minute_index"])

"""The book of each second, as intervals in which the best levels stay the same.

A month has 2.6 million seconds and a symbol's book changes in a few of
them, so samples are not laid out: a sorted fold per symbol and archive unit
keeps the levels of both sides and hands on the best n whenever a second ends
with another top of the book. Reports weigh an interval by its seconds. All
times of an interval are starts of sampling steps, `to_ns` is the step after
its last one.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.ticks import bucket, ceil_div
from tickloom.sources.market import SEQ

LEVELS = "array<struct<price_ticks: long, qty: long>>"


def covered_units(log: DataFrame, step_ns: int, unit_ns: int) -> DataFrame:
    """(unit_ns, first_active_ns, covered): units that have a record, the step of the first one, and the number of covered steps before the unit. One row a unit."""
    at = bucket("timestamp_ns", unit_ns)
    units = log.groupBy(at.alias("unit_ns")).agg(F.min(bucket("timestamp_ns", step_ns)).alias("first_active_ns"))
    return units.withColumn("covered", (F.row_number().over(W.orderBy("unit_ns")) - 1) * (unit_ns // step_ns))


class SideOfBook:
    """Quantity by price of one side; `best` are its n best levels."""

    def __init__(self, sign: int):
        self.sign, self.qty, self.keys = sign, {}, []

    def put(self, price: int, qty: int) -> None:
        key = self.sign * price
        if qty > 0:
            if price not in self.qty:
                insort(self.keys, key)
            self.qty[price] = qty
        elif self.qty.pop(price, None) is not None:
            del self.keys[bisect_left(self.keys, key)]

    def best(self, n: int) -> tuple:
        return tuple((self.sign * k, self.qty[self.sign * k]) for k in self.keys[:n])


def book_intervals(changes: DataFrame, units: DataFrame, step_ns: int, unit_ns: int, depth: int, by: tuple[str, ...] = ("symbol_id",), parity: bool = False) -> DataFrame:
    """(*by, unit_ns, from_ns, to_ns, steps, bids, asks): the best `depth` levels of each covered step, neighbours that agree in one row.

    `changes` are level changes with the columns `by`. A step has the book
    after its last record; steps of a book without levels give no row. An
    interval ends with its unit at the latest. With `parity` the steps of a
    unit before its first record have the book after the step of that record,
    as the archive had them.
    """
    own = [*by, "side", "price_ticks"]
    moved = changes.groupBy(*own, bucket("timestamp_ns", step_ns).alias("step_ns")).agg(F.max_by("qty", F.struct(*SEQ)).alias("qty"))
    moved = moved.withColumn("next_ns", F.lead("step_ns").over(W.partitionBy(*own).orderBy("step_ns"))).withColumn("unit_ns", bucket("step_ns", unit_ns))
    last = units.agg(F.max("unit_ns").alias("last_unit"))  # one row
    # what a level holds at the start of each later unit, up to the one in which it changes next
    until = F.coalesce(bucket("next_ns", unit_ns), F.col("last_unit"))
    carried = moved.where("qty > 0").join(F.broadcast(last)).where(F.col("unit_ns") < until)
    carried = carried.withColumn("unit_ns", F.explode(F.sequence(F.col("unit_ns") + unit_ns, until, F.lit(unit_ns)))).withColumn("step_ns", F.col("unit_ns") - step_ns)
    cols = [*by, "unit_ns", "step_ns", "side", "price_ticks", "qty"]
    rows = moved.select(cols).unionByName(carried.select(cols)).join(units.select("unit_ns", "first_active_ns"), "unit_ns").withColumn("own_ns", F.col("step_ns"))
    if parity:
        rows = rows.withColumn("step_ns", F.when(F.col("step_ns") <= F.col("first_active_ns"), F.col("unit_ns") - step_ns).otherwise(F.col("step_ns")))
    types = ", ".join(f"{c} {changes.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{types}, unit_ns long, from_ns long, to_ns long, steps long, bids {LEVELS}, asks {LEVELS}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out, width = to_arrow_schema(_parse_datatype_string(schema)), len(by)

    def run(batches):
        import pyarrow as pa

        group = step = shown = None
        sides, since, done = (), 0, []

        def close(upto: int) -> None:
            """The interval that has been open until the step `upto`."""
            if shown is not None and any(shown) and since < upto:
                done.append((*group, since, upto, (upto - since) // step_ns, *shown))

        def settle() -> None:
            """The step that has ended; the book before a unit's first change holds from its start."""
            nonlocal shown, since
            if group is None:
                return
            now = tuple(s.best(depth) for s in sides)
            if now != shown:
                start = max(step, group[width])
                close(start)
                shown, since = now, start

        def flush():
            part = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(part, out, strict=True)], schema=out)

        for b in batches:
            for *key, at, side, price, qty, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != group:
                    settle()
                    if group is not None:
                        close(group[width] + unit_ns)
                    group, step, shown, sides = key, at, None, (SideOfBook(-1), SideOfBook(1))
                elif at != step:
                    settle()
                    step = at
                sides[side - 1].put(price, qty)
            if len(done) > 2_000:
                yield flush()
        settle()
        if group is not None:
            close(group[width] + unit_ns)
        if done:
            yield flush()

    dealt = rows.select(*cols, "own_ns").repartition(*by, "unit_ns").sortWithinPartitions(*by, "unit_ns", "step_ns", "own_ns")
    return dealt.mapInArrow(run, schema)


def laid_out(intervals: DataFrame, *by: str) -> DataFrame:
    """Long table: one row per level of each interval; level 0 is the best."""
    side = lambda n, c: F.transform(c, lambda x, i: F.struct(F.lit(n).alias("side"), i.alias("level"), x["price_ticks"].alias("price_ticks"), x["qty"].alias("qty")))
    both = intervals.select(*by, "from_ns", "to_ns", "steps", F.explode(F.concat(side(1, "bids"), side(2, "asks"))).alias("x"))
    return both.select(*by, "from_ns", "to_ns", "steps", "x.*")


def with_best(intervals: DataFrame) -> DataFrame:
    """Adds bid and ask, null where a side is empty."""
    first = lambda c: F.get(F.col(c), F.lit(0))["price_ticks"]
    return intervals.withColumn("bid", first("bids")).withColumn("ask", first("asks"))


def crossed(best: DataFrame) -> DataFrame:
    """Per symbol: sampled steps, crossed ones (bid >= ask) and the longest run of them; a run goes on over steps without a sample."""
    c = best.withColumn("crossed", F.coalesce(F.col("bid") >= F.col("ask"), F.lit(False)))
    c = c.withColumn("island", F.sum((~F.col("crossed")).cast("int")).over(W.partitionBy("symbol_id").orderBy("from_ns")))
    runs = c.groupBy("symbol_id", "island").agg(F.sum("steps").alias("n"), F.sum(F.when(F.col("crossed"), F.col("steps")).otherwise(0)).alias("run"))
    return runs.groupBy("symbol_id").agg(F.sum("n").alias("snapshots"), F.sum("run").alias("crossed"), F.max("run").alias("longest_run"))


def depth_share(intervals: DataFrame) -> DataFrame:
    """Each level's quantity against the largest one shown at the time."""
    most = F.array_max(F.transform(F.concat("bids", "asks"), lambda x: x["qty"]))
    return laid_out(intervals.withColumn("most", most), "symbol_id", "most").withColumn("share", F.col("qty") / F.col("most")).drop("most")


def spread_samples(intervals: DataFrame, probe_price: int, depth: int) -> DataFrame:
    """Per interval, without own probe levels (price <= probe_price): spread in basis points and the thinner side's quantity in `depth` levels; null and one_sided where a side is empty, no row where both are."""
    own = lambda c: F.filter(c, lambda x: x["price_ticks"] > probe_price)
    s = with_best(intervals.withColumn("bids", own("bids")).withColumn("asks", own("asks"))).where("bid is not null or ask is not null")
    total = lambda c: F.aggregate(F.slice(c, 1, depth), F.lit(0).cast("long"), lambda t, x: t + x["qty"])
    two = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    spread = (F.col("ask") - F.col("bid")) / ((F.col("bid") + F.col("ask")) / 2) * 10_000
    return s.select("symbol_id", "from_ns", "to_ns", "steps", "bid", "ask", (~two).alias("one_sided"), F.when(two, spread).alias("spread_bps"), F.when(two, F.least(total("bids"), total("asks"))).alias("thin_qty"))


def best_quotes(intervals: DataFrame) -> DataFrame:
    """The best level of each side as columns bid, bid_qty, ask, ask_qty instead of arrays."""
    first = lambda c, f: F.get(F.col(c), F.lit(0))[f]
    cols = (("bids", "price_ticks", "bid"), ("bids", "qty", "bid_qty"), ("asks", "price_ticks", "ask"), ("asks", "qty", "ask_qty"))
    return intervals.select("*", *[first(c, f).alias(n) for c, f, n in cols]).drop("bids", "asks")


def cut_by_unit(intervals: DataFrame, step_ns: int, unit_ns: int) -> DataFrame:
    """Intervals cut at the ends of units, with unit_ns and steps; units without a record are still among them."""
    x = intervals.withColumn("unit_ns", F.explode(F.sequence(bucket("from_ns", unit_ns), bucket(F.col("to_ns") - 1, unit_ns), F.lit(unit_ns))))
    x = x.withColumn("from_ns", F.greatest("from_ns", "unit_ns")).withColumn("to_ns", F.least(F.col("to_ns"), F.col("unit_ns") + unit_ns))
    return x.withColumn("steps", F.call_function("div", F.col("to_ns") - F.col("from_ns"), F.lit(step_ns)))


def obligation_intervals(quotes: DataFrame, pairs: DataFrame, units: DataFrame, step_ns: int, unit_ns: int, max_spread_bps: int, min_size: int) -> DataFrame:
    """(user_id, symbol_id, from_ns, to_ns, at, steps, two_sided, spread_bps, breaches) over all covered steps of each maker and symbol.

    `quotes`: (user_id, symbol_id, unit_ns, from_ns, to_ns, steps, bid,
    bid_qty, ask, ask_qty), cut by unit. Steps without a quote of both sides
    are the gaps between two-sided intervals, one row each: they follow from
    the number of covered steps before either end, so no row is made for a
    step or a unit without a quote. `pairs` are all (user_id, symbol_id) that
    owe quotes.
    """
    from tickloom.operators.quality import with_breaches

    q = placed(quotes.where("bid is not null and ask is not null"), units, step_ns)
    q = q.select("user_id", "symbol_id", "from_ns", "to_ns", "at", "steps", "bid", "bid_qty", "ask", "ask_qty")
    per_unit = unit_ns // step_ns
    ends = units.agg(F.min("unit_ns").alias("begin_ns"), (F.max("unit_ns") + unit_ns).alias("end_ns"), F.count("*").alias("n")).select("begin_ns", "end_ns", (F.col("n") * per_unit).alias("all_steps"))  # one row
    # one row at the start and one at the end of each pair's time, so that every gap lies between two rows
    w = W.partitionBy("user_id", "symbol_id").orderBy("at", "steps")
    edge = lambda at, ns: pairs.join(F.broadcast(ends)).select("user_id", "symbol_id", F.expr(ns).alias("from_ns"), F.expr(ns).alias("to_ns"), F.lit(0).cast("long").alias("steps"), F.expr(at).cast("long").alias("at"))
    held = q.unionByName(edge("0", "begin_ns"), allowMissingColumns=True).unionByName(edge("all_steps", "end_ns"), allowMissingColumns=True)
    nxt = held.withColumn("next_at", F.lead("at").over(w)).withColumn("next_ns", F.lead("from_ns").over(w))
    gap = nxt.where(F.col("next_at") > F.col("at") + F.col("steps"))
    gaps = gap.select("user_id", "symbol_id", F.col("to_ns").alias("from_ns"), F.col("next_ns").alias("to_ns"), (F.col("at") + F.col("steps")).alias("at"), (F.col("next_at") - F.col("at") - F.col("steps")).alias("steps"))
    rows = q.unionByName(gaps, allowMissingColumns=True)
    return with_breaches(rows, max_spread_bps, min_size).select("user_id", "symbol_id", "from_ns", "to_ns", "at", "steps", "two_sided", "spread_bps", "breaches")


def placed(intervals: DataFrame, units: DataFrame, step_ns: int) -> DataFrame:
    """Adds `at`: how many covered steps lie before the interval."""
    at = F.col("covered") + F.call_function("div", F.col("from_ns") - F.col("unit_ns"), F.lit(step_ns))
    return intervals.join(units.select("unit_ns", "covered"), "unit_ns").withColumn("at", at).drop("covered")


def within(intervals: DataFrame, load_steps: DataFrame, units: DataFrame, step_ns: int, unit_ns: int) -> DataFrame:
    """`intervals` (with `at`) cut to load steps [began, ended], both ends in: adds `step`, and `steps` are those inside.

    `load_steps` is a small table by contract, some thousands of rows; its
    ends become numbers of covered steps first, so that time without a record
    doesn't count.
    """
    low, high = ceil_div("began", step_ns) * step_ns, bucket("ended", step_ns) + step_ns
    ends = load_steps.select("step", F.explode(F.array(F.struct(F.lit(0).alias("which"), low.alias("t")), F.struct(F.lit(1).alias("which"), high.alias("t")))).alias("e")).select("step", "e.*")
    # steps before t: those of the last unit that begins before t, as far as t goes into it
    inside = F.least(F.call_function("div", F.col("t") - F.col("unit_ns"), F.lit(step_ns)), F.lit(unit_ns // step_ns))
    upto = ends.join(F.broadcast(units.select("unit_ns", "covered")), F.col("unit_ns") <= F.col("t"), "left").groupBy("step", "which").agg(F.coalesce(F.max(F.col("covered") + inside), F.lit(0)).alias("n"))
    bounds = upto.groupBy("step").agg(F.max(F.when(F.col("which") == 0, F.col("n"))).alias("low"), F.max(F.when(F.col("which") == 1, F.col("n"))).alias("high"))
    part = F.least(F.col("at") + F.col("steps"), F.col("high")) - F.greatest("at", "low")
    cut = intervals.join(F.broadcast(bounds), (F.col("at") < F.col("high")) & (F.col("at") + F.col("steps") > F.col("low")))
    return cut.withColumn("steps", part).drop("low", "high")

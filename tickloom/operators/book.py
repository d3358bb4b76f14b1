"""The order book from the log, without a state machine per event.

What rests of an order after an event has a closed form: nothing after a
cancel, else its quantity less the fills since its acceptance, never below
zero. So the book is a window per order, then sums per price level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.ticks import bucket, ceil_div, floor_div
from tickloom.sources.market import SEQ

def order_events(accepts: DataFrame, fills: DataFrame, cancels: DataFrame) -> DataFrame:
    """Acceptance, fill legs and cancels of every accepted order, later ones only; records of unknown orders are left out.

    (order_id, symbol_id, side, price_ticks, qty, user_id, a_ms, a_ord,
    seq_ms, seq_ord, timestamp_ns, kind, filled): kind accept, maker, taker or cancel.
    """
    a = accepts.select("order_id", "symbol_id", "side", "price_ticks", "qty", "user_id", F.col("seq_ms").alias("a_ms"), F.col("seq_ord").alias("a_ord"), F.col("timestamp_ns").alias("a_ns"))
    legs = fills.select(
        *SEQ, "timestamp_ns", F.col("qty").alias("filled"),
        F.explode(F.array(F.struct(F.col("maker_order_id").alias("order_id"), F.lit("maker").alias("kind")), F.struct(F.col("taker_order_id").alias("order_id"), F.lit("taker").alias("kind")))).alias("leg"),
    ).select(*SEQ, "timestamp_ns", "leg.order_id", "leg.kind", "filled")
    gone = cancels.select(*SEQ, "timestamp_ns", "order_id", F.lit("cancel").alias("kind"), F.lit(0).cast("long").alias("filled"))
    later = a.join(legs.unionByName(gone), "order_id").where(F.struct(*SEQ) > F.struct("a_ms", "a_ord"))
    cols = ["order_id", "symbol_id", "side", "price_ticks", "qty", "user_id", "a_ms", "a_ord", *SEQ, "timestamp_ns", "kind", "filled"]
    own = a.select("*", F.col("a_ms").alias("seq_ms"), F.col("a_ord").alias("seq_ord"), F.col("a_ns").alias("timestamp_ns"), F.lit("accept").alias("kind"), F.lit(0).cast("long").alias("filled"))
    return own.select(cols).unionByName(later.select(cols))


def order_states(events: DataFrame) -> DataFrame:
    """One row per order and record: `rem` after it and `delta` against before."""
    e = events.groupBy("order_id", "symbol_id", "side", "price_ticks", "qty", "user_id", "a_ms", "a_ord", *SEQ, "timestamp_ns").agg(F.sum("filled").alias("filled"), F.max(F.col("kind") == "cancel").alias("cancelled"))
    upto = W.partitionBy("order_id").orderBy(*SEQ)
    rem = F.when(F.max("cancelled").over(upto), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("qty") - F.sum("filled").over(upto))).cast("long")
    e = e.withColumn("rem", rem)
    return e.withColumn("delta", F.col("rem") - F.coalesce(F.lag("rem").over(upto), F.lit(0)))


def order_lifecycle(events: DataFrame, fills: DataFrame) -> DataFrame:
    """Per order: filled quantity and notional, whether cancelled, what rests, its status, first and last time."""
    price = fills.select(*SEQ, F.col("price_ticks").alias("fill_price"))
    e = events.join(price, list(SEQ), "left")
    leg = F.col("kind").isin("maker", "taker")
    g = e.groupBy("order_id", "symbol_id", "side", "price_ticks", "qty", "user_id").agg(
        F.sum("filled").alias("filled_qty"), F.sum(F.when(leg, F.col("filled") * F.col("fill_price")).otherwise(0)).alias("filled_notional"),
        F.max(F.col("kind") == "cancel").alias("cancelled"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"),
    )
    rem = F.when(F.col("cancelled"), 0).otherwise(F.greatest(F.lit(0), F.col("qty") - F.col("filled_qty"))).cast("long")
    status = F.when(F.col("cancelled"), "CANCELLED").when(F.col("filled_qty") >= F.col("qty"), "FILLED").when(F.col("filled_qty") > 0, "PARTIAL").otherwise("OPEN")
    avg = F.when(F.col("filled_qty") > 0, floor_div("filled_notional", "filled_qty"))
    return g.withColumn("avg_price_ticks", avg).withColumn("remaining", rem).withColumn("status", status)


def resting_orders(events: DataFrame, upto: tuple[int, int] | None = None) -> DataFrame:
    """Orders with something left after the record `upto` (all records if None)."""
    if upto is not None:
        events = events.where(F.struct(*SEQ) <= F.struct(F.lit(upto[0]).cast("long"), F.lit(upto[1]).cast("long")))
    g = events.groupBy("order_id", "symbol_id", "side", "price_ticks", "qty", "user_id", "a_ms", "a_ord").agg(F.sum("filled").alias("filled"), F.max(F.col("kind") == "cancel").alias("cancelled"))
    return g.where(~F.col("cancelled") & (F.col("filled") < F.col("qty"))).select("order_id", "symbol_id", "side", "price_ticks", "user_id", "a_ms", "a_ord", (F.col("qty") - F.col("filled")).alias("rem"))


def ranked(levels: DataFrame, *by: str) -> DataFrame:
    """Adds `level`: 0 is the best price of a side."""
    best_first = F.when(F.col("side") == 1, -F.col("price_ticks")).otherwise(F.col("price_ticks"))
    return levels.withColumn("level", F.row_number().over(W.partitionBy(*by, "side").orderBy(best_first)) - 1)


def book_levels(resting: DataFrame, depth: int | None = None) -> DataFrame:
    levels = ranked(resting.groupBy("symbol_id", "side", "price_ticks").agg(F.sum("rem").alias("qty"), F.count("*").alias("orders")), "symbol_id")
    return levels if depth is None else levels.where(F.col("level") < depth)


def bbo(levels: DataFrame, *by: str) -> DataFrame:
    """Best bid and ask, spread and middle (floored); null where a side is empty."""
    side = lambda s: F.when(F.col("side") == s, F.col("price_ticks"))
    b = levels.groupBy(*by).agg(F.max(side(1)).alias("bid"), F.min(side(2)).alias("ask"))
    two = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    return b.withColumn("two_sided", two).withColumn("spread", F.col("ask") - F.col("bid")).withColumn("mid", floor_div(F.col("ask") + F.col("bid"), 2))


def level_changes(states: DataFrame, *by: str) -> DataFrame:
    """Quantity of a price level after each record that changes it; 0 is gone. Levels of a symbol, or of what `by` names."""
    own = [*(by or ["symbol_id"]), "side", "price_ticks"]
    d = states.where("delta <> 0").groupBy(*own, *SEQ, "timestamp_ns").agg(F.sum("delta").alias("delta")).where("delta <> 0")
    return d.withColumn("qty", F.sum("delta").over(W.partitionBy(*own).orderBy(*SEQ)))


def level_intervals(changes: DataFrame) -> DataFrame:
    """(symbol_id, side, price_ticks, qty, from_ns, to_ns): a level holds qty after the last record of from_ns and before to_ns (null: to the end)."""
    last = changes.groupBy("symbol_id", "side", "price_ticks", F.col("timestamp_ns").alias("from_ns")).agg(F.max_by("qty", F.struct(*SEQ)).alias("qty"))
    to = F.lead("from_ns").over(W.partitionBy("symbol_id", "side", "price_ticks").orderBy("from_ns"))
    return last.withColumn("to_ns", to)


def book_at(changes: DataFrame, symbol_id: int, second: int) -> DataFrame:
    """One symbol's levels after the last record of a second (since the epoch): filters that reach the scan, then ranks."""
    end = (second + 1) * 1_000_000_000
    iv = level_intervals(changes.where((F.col("symbol_id") == symbol_id) & (F.col("timestamp_ns") < end))).where("qty > 0 and to_ns is null")
    return ranked(iv.select("symbol_id", F.lit(second * 1_000_000_000).alias("step_ns"), "side", "price_ticks", "qty"), "symbol_id", "step_ns")


def conflated(changes: DataFrame, window_ns: int) -> DataFrame:
    """Last quantity of each level that moved in each window."""
    return changes.groupBy("symbol_id", "side", "price_ticks", bucket("timestamp_ns", window_ns).alias("window_ns")).agg(F.max_by("qty", F.struct(*SEQ)).alias("qty"), F.max(F.struct(*SEQ)).alias("at")).select("symbol_id", "side", "price_ticks", "window_ns", "qty", F.col("at.seq_ord").alias("seq_ord"))


def bbo_timeline(changes: DataFrame) -> DataFrame:
    """Best bid and ask after each record that changes a level of the symbol.

    A symbol's half day is folded on its own: it begins with the levels that
    were there before, then come its changes in order. Rows come sorted and
    are folded as a stream with a heap per side, so work grows with the
    changes and not with changes times levels.
    """
    import pyarrow as pa

    part = 43_200 * 1_000_000_000
    iv = changes.select("symbol_id", "side", "price_ticks", *SEQ, "timestamp_ns", "qty")
    nxt = W.partitionBy("symbol_id", "side", "price_ticks").orderBy(*SEQ)
    iv = iv.withColumn("to_ns", F.lead("timestamp_ns").over(nxt)).withColumn("part", bucket("timestamp_ns", part))
    last = changes.agg(F.max(bucket("timestamp_ns", part)).alias("last_part"))  # one row
    end = F.coalesce(bucket("to_ns", part), F.col("last_part"))
    later = iv.where("qty > 0").join(F.broadcast(last)).where(F.col("part") < end).withColumn("part", F.explode(F.sequence(F.col("part") + part, end, F.lit(part))))
    before = F.lit(-1).cast("long")
    cols = ["symbol_id", "part", *SEQ, "side", "price_ticks", "qty"]
    rows = iv.select(cols).unionByName(later.select("symbol_id", "part", before.alias(SEQ[0]), before.alias(SEQ[1]), "side", "price_ticks", "qty"))
    schema = f"symbol_id {changes.schema['symbol_id'].dataType.simpleString()}, seq_ms long, seq_ord long, bid long, ask long"

    def run(batches):
        from heapq import heappop, heappush

        book, heaps, at, done = ({}, {}), ([], []), None, []

        def best(k: int):
            while heaps[k] and abs(heaps[k][0]) not in book[k]:
                heappop(heaps[k])
            return abs(heaps[k][0]) if heaps[k] else None

        def emit():
            if at is not None and at[2] >= 0:
                done.append((at[0], at[2], at[3], best(0), best(1)))

        def batch():
            names, kinds = ["symbol_id", "seq_ms", "seq_ord", "bid", "ask"], [symbol, *[pa.int64()] * 4]
            cols = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            symbol = b.schema.field(0).type
            for sym, slot, ms, order, side, price, qty in zip(*(c.to_pylist() for c in b.columns), strict=True):
                now = (sym, slot, ms, order)
                if now != at:
                    emit()
                    if at is None or now[:2] != at[:2]:
                        book, heaps = ({}, {}), ([], [])
                    at = now
                k = side - 1
                if qty > 0:
                    if price not in book[k]:
                        heappush(heaps[k], -price if k == 0 else price)
                    book[k][price] = qty
                else:
                    book[k].pop(price, None)
            if done:
                yield batch()
        emit()
        if done:
            yield batch()

    return rows.repartition("symbol_id", "part").sortWithinPartitions("symbol_id", "part", *SEQ).mapInArrow(run, schema)


def as_of(left: DataFrame, right: DataFrame, by: str, values: list[str], strict: bool = True, width_ms: int = 43_200_000) -> DataFrame:
    """Rows of `left` with the last `values` of `right` before them (or at the same record, if not strict).

    Both are sorted together in ranges of time, so that one key is not one
    task; a row with nothing before it in its range takes the last values of
    the ranges before, of which each gives one row.
    """
    first, second = (0, 1) if strict else (1, 0)
    part = bucket("seq_ms", width_ms).alias("_part")
    seen = right.select(by, *SEQ, F.struct(*values).alias("_v")).withColumn("_kind", F.lit(second))
    u = left.withColumn("_kind", F.lit(first)).unionByName(seen, allowMissingColumns=True).select("*", part)
    lasts = seen.select(by, part, "_v", F.struct(*SEQ).alias("_at")).groupBy(by, "_part").agg(F.max_by("_v", "_at").alias("_own"))
    parts = u.select(by, "_part").distinct().join(lasts, [by, "_part"], "left")
    carried = parts.select(by, "_part", F.last("_own", ignorenulls=True).over(W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    w = W.partitionBy(by, "_part").orderBy(*SEQ, "_kind").rowsBetween(W.unboundedPreceding, 0)
    u = u.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where(F.col("_kind") == first).join(carried, [by, "_part"])
    u = u.withColumn("_v", F.coalesce("_v", "_before"))
    return u.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def banded_price(orders: DataFrame, band_bps: int = 500) -> DataFrame:
    """Adds `limit_ticks`: what a market order becomes at the best opposite price; null without one."""
    buy = ceil_div(F.col("ask") * (10_000 + band_bps), 10_000)
    sell = F.greatest(F.lit(1).cast("long"), floor_div(F.col("bid") * (10_000 - band_bps), 10_000))
    return orders.withColumn("limit_ticks", F.when(F.col("side") == 1, buy).otherwise(F.when(F.col("bid").isNotNull(), sell)))


def audit_event_log(accepts: DataFrame, fills: DataFrame, cancels: DataFrame) -> DataFrame:
    """(seq_ms, seq_ord, rule): one row per rule that a fill or cancel violates, against each order's state just before it."""
    events = order_events(accepts, fills, cancels)
    st = order_states(events).select("order_id", *SEQ, "rem", "delta")
    before = st.select(F.col("order_id").alias("o"), *SEQ, (F.col("rem") - F.col("delta")).alias("before"))
    a = accepts.select(F.col("order_id").alias("o"), F.col("symbol_id").alias("o_symbol"), F.col("side").alias("o_side"), F.col("price_ticks").alias("o_price"), F.struct(*SEQ).alias("o_at"))
    known = a.join(before, "o").where(F.struct(*SEQ) > F.col("o_at"))

    def leg(name: str):
        return known.select(F.col("o").alias(f"{name}_order_id"), *SEQ, F.col("o_symbol").alias(f"{name}_symbol"), F.col("o_side").alias(f"{name}_side"), F.col("o_price").alias(f"{name}_price"), F.col("before").alias(f"{name}_rem"))

    f = fills.join(leg("maker"), ["maker_order_id", *SEQ], "left").join(leg("taker"), ["taker_order_id", *SEQ], "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "maker_unknown": F.col("maker_rem").isNull(), "taker_unknown": F.col("taker_rem").isNull(),
        "maker_gone": no(F.col("maker_rem") == 0), "taker_gone": no(F.col("taker_rem") == 0),
        "same_side": no(F.col("maker_side") == F.col("taker_side")), "aggressor_side": no(F.col("aggressor_side") != F.col("taker_side")),
        "symbol": no(F.col("maker_symbol") != F.col("symbol_id")) | no(F.col("taker_symbol") != F.col("symbol_id")),
        "price": no(F.col("maker_price") != F.col("price_ticks")), "qty": F.col("qty") <= 0,
        "maker_overfill": no((F.col("qty") > F.col("maker_rem")) & (F.col("maker_rem") > 0)), "taker_overfill": no((F.col("qty") > F.col("taker_rem")) & (F.col("taker_rem") > 0)),
    }
    broken = lambda rules: F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))).alias("rule")
    c = cancels.select(*SEQ, F.col("order_id").alias("o"), "remaining_qty").join(known.select("o", *SEQ, "before"), ["o", *SEQ], "left")
    c_rules = {"cancel_unknown": F.col("before").isNull(), "cancel_gone": no(F.col("before") == 0), "cancel_qty": no((F.col("before") > 0) & (F.col("before") != F.col("remaining_qty")))}
    return f.select(*SEQ, broken(rules)).unionByName(c.select(*SEQ, broken(c_rules)))


def audit_price_time(accepts: DataFrame, fills: DataFrame, cancels: DataFrame, slice_ns: int = 86_400 * 1_000_000_000) -> DataFrame:
    """(seq_ms, seq_ord, maker_order_id, better_order_id): fills whose maker was not the best live opposite order of the taker.

    A symbol's time slice is folded on its own: it begins with the orders
    that were live before it, then come acceptances, ends of orders and fills
    in order. A heap per side has the best live order, by price, then age, on
    top; ended orders leave it when they come up. So a slice of n records
    costs n log n, however many orders are live.
    """
    import pyarrow as pa

    states = order_states(order_events(accepts, fills, cancels))
    own = ["order_id", "symbol_id", "side", "price_ticks", "a_ms", "a_ord"]
    lives = states.groupBy(*own).agg(F.min("timestamp_ns").alias("from_ns"), F.min(F.when(F.col("rem") == 0, F.struct(*SEQ, "timestamp_ns"))).alias("to"))
    at_slice = lambda c: bucket(c, slice_ns)
    last = fills.agg(F.max(at_slice("timestamp_ns")).alias("last_slice"))  # one row
    lives = lives.join(F.broadcast(last)).withColumn("slice", at_slice("from_ns")).withColumn("end_slice", F.coalesce(at_slice("to.timestamp_ns"), F.greatest("last_slice", "slice")))
    key, none = ["symbol_id", "slice"], F.lit(None).cast("long")
    order = ["side", "price_ticks", F.col("a_ms").alias("age_ms"), F.col("a_ord").alias("age_ord"), "order_id", none.alias("maker_order_id")]
    begun = lives.select(*key, F.col("a_ms").alias("seq_ms"), F.col("a_ord").alias("seq_ord"), F.lit(2).alias("kind"), *order)
    carried = lives.where("slice < end_slice").withColumn("slice", F.explode(F.sequence(F.col("slice") + slice_ns, F.col("end_slice"), F.lit(slice_ns))))
    before = F.lit(-1).cast("long")
    opening = carried.select(*key, before.alias("seq_ms"), before.alias("seq_ord"), F.lit(2).alias("kind"), *order)
    ended = lives.where("to is not null").select("symbol_id", at_slice("to.timestamp_ns").alias("slice"), "to.seq_ms", "to.seq_ord", F.lit(1).alias("kind"), *order)
    taker = accepts.select(F.col("order_id").alias("taker_order_id"), "symbol_id", "side", "price_ticks", F.col("seq_ms").alias("t_ms"), F.col("seq_ord").alias("t_ord"))
    f = fills.drop("symbol_id", "price_ticks").join(taker, "taker_order_id").where(F.struct("t_ms", "t_ord") < F.struct(*SEQ))
    asked = f.select("symbol_id", at_slice("timestamp_ns").alias("slice"), *SEQ, F.lit(0).alias("kind"), "side", "price_ticks", none.alias("age_ms"), none.alias("age_ord"), none.alias("order_id"), "maker_order_id")
    rows = begun.unionByName(opening).unionByName(ended).unionByName(asked)
    schema = "seq_ms long, seq_ord long, maker_order_id long, better_order_id long"

    def run(batches):
        from heapq import heappop, heappush

        group, live, heaps = None, set(), ([], [])
        for b in batches:
            found = []
            for sym, slot, ms, seq, kind, side, price, age_ms, age_ord, oid, maker in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (sym, slot) != group:
                    group, live, heaps = (sym, slot), set(), ([], [])
                if kind == 2:
                    live.add(oid)
                    heappush(heaps[side - 1], (-price if side == 1 else price, age_ms, age_ord, oid))
                elif kind == 1:
                    live.discard(oid)
                else:  # a buy meets the sells, and the other way round
                    other = heaps[2 - side]
                    while other and other[0][3] not in live:
                        heappop(other)
                    if other and (other[0][0] <= price if side == 1 else -other[0][0] >= price) and other[0][3] != maker:
                        found.append((ms, seq, maker, other[0][3]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["seq_ms", "seq_ord", "maker_order_id", "better_order_id"])

    return rows.repartition(*key).sortWithinPartitions(*key, *SEQ, "kind").mapInArrow(run, schema)


def conservation(events: DataFrame) -> DataFrame:
    """Per symbol: accepted quantity, what was filled (up to the order's size), what cancels took, what rests; the difference is 0."""
    last = order_states(events).groupBy("order_id", "symbol_id", "qty").agg(F.max_by("rem", F.struct(*SEQ)).alias("rem"), F.sum(F.when(F.col("cancelled"), -F.col("delta")).otherwise(0)).alias("off"), F.sum(F.when(~F.col("cancelled") & (F.col("delta") < 0), -F.col("delta")).otherwise(0)).alias("filled"))
    s = last.groupBy("symbol_id").agg(F.sum("qty").alias("accepted"), F.sum("filled").alias("filled"), F.sum("off").alias("cancelled"), F.sum("rem").alias("resting"))
    return s.withColumn("difference", F.col("accepted") - F.col("filled") - F.col("cancelled") - F.col("resting"))


def is_crossed(best: DataFrame) -> Column:
    return F.coalesce(F.col("bid") >= F.col("ask"), F.lit(False))

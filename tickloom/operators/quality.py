"""Market quality, obligations, latency and traces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.ticks import BPS, floor_div
from tickloom.sources.sinks import written


def nearest_rank(rows: DataFrame, value: str, by: list[str], quantiles: dict[str, float], weight: str | None = None, rounds: int = 2, bins: int = 1024) -> DataFrame:
    """Count, least, greatest and quantiles by the rule index = floor(q * n), at most n - 1; a row counts `weight` times.

    Distributed selection: equal values are counted first; then each round
    cuts a group's range of values in equal bins, of which only those that
    hold a wanted rank are kept, with the count before them. A group's values
    so never meet in one task, only its bins and what the last round leaves.
    Nulls are left out.
    """
    key = by or ["_all"]
    c = (rows if by else rows.withColumn("_all", F.lit(0))).where(F.col(value).isNotNull())
    c = written(c.groupBy(*key, F.col(value).alias("v")).agg(F.sum(F.col(weight) if weight else F.lit(1)).cast("long").alias("c")), "ranks")
    ends = c.groupBy(*key).agg(F.sum("c").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"))
    at = lambda q: F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1)
    kept = c.withColumn("before", F.lit(0).cast("long"))
    path = list(key)
    for k in range(rounds):
        size = kept.groupBy(*path).agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
        share = (F.col("v").cast("double") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300))  # never falls as v grows
        own = f"bin{k}"
        binned = kept.join(size, path).withColumn(own, F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")).drop("lo", "hi")
        m = binned.groupBy(*path, own).agg(F.sum("c").alias("m"), F.min("before").alias("base")).join(ends.select(*key, "n"), key)
        before = F.col("base") + F.sum("m").over(W.partitionBy(*path).orderBy(own)) - F.col("m")
        m = m.withColumn("before", before)
        holds = [(at(q) >= F.col("before")) & (at(q) < F.col("before") + F.col("m")) for q in quantiles.values()]
        m = m.where(reduce(lambda x, y: x | y, holds)).select(*path, own, "before")
        kept = binned.drop("before").join(m, [*path, own])
        path = [*path, own]
    upto = F.col("before") + F.sum("c").over(W.partitionBy(*path).orderBy("v"))
    pick = [F.min(F.when(F.col("upto") > at(q), F.col("v"))).alias(name) for name, q in quantiles.items()]
    found = kept.withColumn("upto", upto).join(ends.select(*key, "n"), key).groupBy(*key).agg(*pick)
    return ends.join(found, key).select(*by, "n", "least", *quantiles, "greatest")


def by_step(samples: DataFrame, breaches: DataFrame, steps: DataFrame) -> DataFrame:
    """Per load step: spread quantiles and breaches by kind, each weighed by its sampled steps. `samples` and `breaches` are cut to load steps already (`intervals.within`)."""
    q = nearest_rank(samples, "spread_bps", ["step"], {"p50": 0.5, "p95": 0.95}, "steps")
    kinds = ["not_two_sided", "spread_too_wide", "size_too_small"]
    b = breaches.groupBy("step").pivot("kind", kinds).agg(F.sum("steps"))
    return steps.select("step").join(q, "step", "left").join(b, "step", "left").fillna(0, kinds)


def with_breaches(quotes: DataFrame, max_spread_bps: int, min_size: int) -> DataFrame:
    """Adds two_sided, spread_bps and the array of breaches to quotes of (bid, ask, bid_qty, ask_qty); without both sides there is one breach."""
    two = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    mid = floor_div(F.col("ask") + F.col("bid"), 2)
    spread = F.when(two & (mid > 0), floor_div((F.col("ask") - F.col("bid")) * BPS, F.greatest(mid, F.lit(1))))
    small = lambda c: F.when(two & (F.col(c) < min_size), "size_too_small")
    found = F.array_compact(F.array(F.when(~two, "not_two_sided"), F.when(spread > max_spread_bps, "spread_too_wide"), small("bid_qty"), small("ask_qty")))
    return quotes.withColumn("two_sided", two).withColumn("spread_bps", spread).withColumn("breaches", found)


def breach_rows(intervals: DataFrame, *more: str) -> DataFrame:
    """One row per breach of each interval, with its sampled steps."""
    return intervals.select("user_id", "symbol_id", "from_ns", "to_ns", "steps", *more, F.explode("breaches").alias("kind"))


def obligation_summary(intervals: DataFrame, min_uptime: float) -> DataFrame:
    """Per maker and symbol: sampled steps, share of two-sided ones (4 digits), whether it meets the minimum, breaches by kind."""
    kind = lambda k: F.sum(F.col("steps") * F.size(F.filter("breaches", lambda x: x == k))).alias(k)
    up = F.sum(F.when(F.col("two_sided"), F.col("steps")).otherwise(0)) / F.sum("steps")
    return intervals.groupBy("user_id", "symbol_id").agg(
        F.sum("steps").alias("samples"), F.round(up, 4).alias("two_sided_uptime"), (up >= min_uptime).alias("meets"), kind("not_two_sided"), kind("spread_too_wide"), kind("size_too_small"),
        F.sum(F.col("steps") * F.size("breaches")).alias("total"),
    )


def maker_activity(accepts: DataFrame, cancels: DataFrame, held: DataFrame, makers_below: int) -> DataFrame:
    own = F.col("user_id") < makers_below
    a = accepts.where(own).groupBy("user_id", "symbol_id").agg(F.count("*").alias("placed"))
    c = cancels.where(own).groupBy("user_id", "symbol_id").agg(F.count("*").alias("cancelled"))
    m = a.join(c, ["user_id", "symbol_id"], "full").join(held.where(own), ["user_id", "symbol_id"], "full")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return m.select("user_id", "symbol_id", zero("placed"), zero("cancelled"), zero("position"))


def quote_panel(rows: DataFrame, half_spread_bps: int, skew_bps: int, size: int) -> DataFrame:
    """Adds the desired bid and ask for (fair, inventory): spread off the fair value, middle moved against the inventory, sign and floored magnitude apart."""
    half = F.greatest(F.lit(1).cast("long"), floor_div(F.col("fair") * half_spread_bps, BPS))
    size_of_skew = floor_div(F.col("fair") * skew_bps * F.abs("inventory"), max(1, size) * BPS)
    mid = F.col("fair") - F.when(F.col("inventory") < 0, -size_of_skew).otherwise(size_of_skew)
    bid = F.greatest(F.lit(1).cast("long"), mid - half)
    return rows.withColumn("bid", bid).withColumn("ask", F.greatest(bid + 1, mid + half))


def order_trace(inbound: DataFrame, accepts: DataFrame, fills: DataFrame) -> DataFrame:
    """Per submission: when it was sent and accepted, its fills, and the hops between in milliseconds."""
    s = inbound.where("record_type = 'submit'").select("user_id", "client_order_id", F.col("seq_ms").alias("submit_ms"))
    a = accepts.select("user_id", "client_order_id", "order_id", F.col("seq_ms").alias("accept_ms"), F.col("seq_ord").alias("a_ord"))
    legs = fills.select("seq_ms", "seq_ord", "qty", F.explode(F.array("maker_order_id", "taker_order_id")).alias("order_id"))
    f = legs.join(a.select("order_id", "a_ord"), "order_id").where("seq_ord > a_ord").groupBy("order_id").agg(F.count("*").alias("fills"), F.min("seq_ms").alias("first_fill_ms"))
    t = s.join(a, ["user_id", "client_order_id"], "left").join(f, "order_id", "left")
    return t.select("user_id", "client_order_id", (F.col("accept_ms") - F.col("submit_ms")).alias("accept_hop_ms"), F.coalesce("fills", F.lit(0)).cast("long").alias("fills"), (F.col("first_fill_ms") - F.col("accept_ms")).alias("fill_hop_ms"))


def ambiguous_ids(orders: DataFrame) -> DataFrame:
    return orders.groupBy("client_order_id").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("orders")).where("users > 1")


def load_result(samples: DataFrame, receipts: DataFrame, steps: DataFrame, warm_up_ns: int) -> DataFrame:
    """Per rate step, warm-up left out: outcomes, latency quantiles from the intended time, receipts (last of each id) and the achieved rate."""
    r = receipts.groupBy("client_order_id").agg(F.max("received_ns").alias("received_ns"))
    s = samples.join(F.broadcast(steps), (F.col("intended_ns") >= F.col("began") + warm_up_ns) & (F.col("intended_ns") <= F.col("ended"))).join(r, "client_order_id", "left")
    s = s.withColumn("latency_ns", F.when(F.col("status") == 202, F.col("acked_ns") - F.col("intended_ns")))
    n = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    st = F.col("status")
    g = s.groupBy("step", "began", "ended").agg(F.count("*").alias("attempted"), n(st == 202, "accepted"), n(st == 429, "limited"), n(st >= 500, "errors"), n(~st.isin(202, 429) & (st < 500), "other"), F.count("received_ns").alias("received"))
    q = nearest_rank(s, "latency_ns", ["step"], {"p50": 0.5, "p99": 0.99, "p999": 0.999}).withColumnRenamed("n", "timed").withColumnRenamed("least", "fastest").withColumnRenamed("greatest", "slowest")
    rate = F.col("accepted") / ((F.col("ended") - F.col("began") - warm_up_ns) / 1e9)
    return g.join(q, "step", "left").withColumn("achieved_per_s", F.round(rate, 6)).drop("began", "ended")


def next_frame(orders: DataFrame, frames: DataFrame, width: int = 500_000) -> DataFrame:
    """Forward as-of join: for each order of (symbol_id, seq_ord, stamped_ns) the first frame of its symbol with frame_seq >= seq_ord.

    Both are sorted together in ranges of `width` numbers of the log, so that
    a symbol is not one task; an order with no frame left in its range takes
    the first one of the ranges after it, of which each gives one row.
    """
    part = F.call_function("div", F.col("seq_ord"), F.lit(width)).alias("part")
    seen = frames.select("symbol_id", F.col("frame_seq").alias("seq_ord"), F.lit(None).cast("long").alias("stamped_ns"), F.lit(1).alias("kind"), F.struct("frame_seq", "arrival_ns").alias("f"))
    u = orders.select("symbol_id", "seq_ord", "stamped_ns", F.lit(0).alias("kind"), F.lit(None).cast("struct<frame_seq:bigint,arrival_ns:bigint>").alias("f")).unionByName(seen).select("*", part)
    firsts = seen.select("symbol_id", part, "f").groupBy("symbol_id", "part").agg(F.min("f").alias("own"))
    parts = u.select("symbol_id", "part").distinct().join(firsts, ["symbol_id", "part"], "left")
    later = F.first("own", ignorenulls=True).over(W.partitionBy("symbol_id").orderBy("part").rowsBetween(1, W.unboundedFollowing))
    carried = parts.select("symbol_id", "part", later.alias("later"))
    w = W.partitionBy("symbol_id", "part").orderBy(F.desc("seq_ord"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)
    u = u.withColumn("f", F.last("f", ignorenulls=True).over(w)).where("kind = 0").join(carried, ["symbol_id", "part"])
    u = u.withColumn("f", F.coalesce("f", "later"))
    return u.select("symbol_id", "seq_ord", "f.frame_seq", (F.col("f.arrival_ns") - F.col("stamped_ns")).alias("delay_ns"))


def delay_summary(matched: DataFrame, by: list[str]) -> DataFrame:
    """Quantiles of delays, how many are negative and how many found no frame."""
    key = by or ["all"]
    m = matched if by else matched.withColumn("all", F.lit(0))
    q = nearest_rank(m, "delay_ns", key, {"p50": 0.5, "p99": 0.99})
    n = m.groupBy(*key).agg(F.sum(F.when(F.col("delay_ns") < 0, 1).otherwise(0)).alias("negative"), F.sum(F.when(F.col("delay_ns").isNull(), 1).otherwise(0)).alias("unmatched"))
    out = n.join(q, key, "left")
    return out if by else out.drop("all")


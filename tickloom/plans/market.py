"""The registered queries over the market log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import ticks as X
from tickloom.operators import bars as B
from tickloom.operators import book as K
from tickloom.operators import intervals as V
from tickloom.operators import ledger as L
from tickloom.operators import risk as R
from tickloom.operators import backtest as G
from tickloom.operators import quality as Q
from tickloom.sources.sinks import archive_scan as read_archive
from tickloom.sources.sinks import archive_stats as stats_of_archive
from tickloom.sources.sinks import archive_write, shared_folder
from tickloom.sources.sinks import result_json as result_documents
from tickloom.streaming import queries as S
from tickloom.streaming import readmodel as RM
from tickloom.sources import ingest as I
from tickloom.sources import market as M

QUERIES: dict = {}
DAY, HOUR = 86_400, 3_600
ALL_FILES = 1_000_000  # more than a batch of a stream finds


def query(f):
    QUERIES[f.__name__] = f
    return f


def prints(spark, sf_dir) -> DataFrame:
    return B.tape(M.fills(M.base(spark, sf_dir)))


def both_bars(spark, sf_dir) -> DataFrame:
    return B.bars(prints(spark, sf_dir), [HOUR, DAY])


@query
def outbound_log(spark, d):
    start = F.struct(F.lit(1704326400000).alias("seq_ms"), F.lit(5).cast("long").alias("seq_ord"))  # exclusive
    return M.base(spark, d).where(F.struct("seq_ms", "seq_ord") > start).select("seq_ms", "seq_ord", "timestamp_ns", "symbol_id", "user_id", "event_type")


@query
def stream_id_order(spark, d):
    ids = M.base(spark, d).select("symbol_id", F.when(F.col("k") % 5 == 0, F.col("seq_ms").cast("string")).otherwise(F.concat_ws("-", "seq_ms", "seq_ord")).alias("id"))
    at = F.struct(X.stream_ms("id").alias("ms"), X.stream_ord("id").alias("ord"))
    r = ids.groupBy("symbol_id").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    return r.select("symbol_id", F.col("a.ms").alias("first_ms"), F.col("a.ord").alias("first_ord"), F.col("b.ms").alias("last_ms"), F.col("b.ord").alias("last_ord"))


@query
def price_history(spark, d):
    return M.price_history(M.base(spark, d))


@query
def build_price_history(spark, d):
    """Decimal closes to ticks: halves go to the even tick, never below one."""
    b = M.base(spark, d)
    text = (F.col("price_ticks") * 5 + F.col("k")).cast("decimal(20,3)") / 1000  # a decimal price with three digits
    h = b.withColumn("close", text.cast("decimal(20,3)").cast("string"))
    ticks = F.greatest(F.lit(1).cast("long"), X.half_even(F.col("close").cast("decimal(20,3)") * F.call_function("div", F.col("tick_size_ticks"), F.lit(100))))
    name = F.concat(F.lit("SERIES_"), F.lpad(F.col("symbol_id").cast("string"), 2, "0"))
    h = M.numbered(h.select("symbol_id", "seq_ord", "close"), "symbol_id", "minute_index")
    return h.join(F.broadcast(M.symbol_dim(spark)), "symbol_id").select(name.alias("symbol"), "minute_index", ticks.alias("close_ticks"))


@query
def history_quality(spark, d):
    """Twins are symbols of the same path; paths are compared by 128 bits of hash of their points."""
    h = M.price_history(M.base(spark, d))
    point = lambda seed: F.sum(F.xxhash64("minute_index", "close_ticks", F.lit(seed)).cast("decimal(38,0)"))
    stats = h.groupBy("symbol_id").agg(F.count("*").alias("n"), F.min("close_ticks").alias("min_close"), F.countDistinct("close_ticks").alias("n_closes"))
    paths = h.groupBy("symbol_id").agg(F.struct(F.count("*"), point(1), point(2)).alias("path"))
    alike = paths.groupBy("path").agg(F.count("*").alias("alike"))
    twins = paths.join(alike, "path").select("symbol_id", (F.col("alike") - 1).alias("twins"))
    s = M.symbol_dim(spark).join(stats, "symbol_id", "left").join(twins, "symbol_id", "left")
    return s.select("name", "n", "min_close", "n_closes", (F.col("min_close") > 0).alias("all_positive"), (F.col("n_closes") > 1).alias("moves"), F.coalesce("twins", F.lit(0)).cast("long").alias("twins"))


@query
def symbol_dim(spark, d):
    traded = M.fills(M.base(spark, d)).groupBy("symbol_id").agg(F.count("*").alias("trades"), F.sum("qty").alias("volume"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return M.symbol_dim(spark).join(traded, "symbol_id", "left").select("name", "tick_size_ticks", "lot_size", zero("trades"), zero("volume"))


@query
def order_validation(spark, d):
    from tickloom.operators.risk import reject_reason

    k = F.col("k")
    rows = M.inbound(M.base(spark, d)).where("record_type = 'submit'").withColumn("k", F.col("qty") - 1)
    rows = rows.select(
        "client_order_id", F.when(k % 11 == 0, 3).otherwise(F.col("side")).alias("side"), F.when(k % 13 == 0, 9).otherwise(1).alias("tif"),
        F.when(k % 17 == 0, -F.col("price_ticks")).otherwise(F.col("price_ticks")).alias("price_ticks"), F.when(k % 7 == 0, 0).otherwise(F.col("qty")).alias("qty"),
        F.when(k % 19 == 0, F.col("symbol_id") + 10).otherwise(F.col("symbol_id")).alias("symbol_id"),
    )
    return reject_reason(rows, M.symbol_dim(spark)).select("client_order_id", "reason")


@query
def tape(spark, d):
    return prints(spark, d).drop("seq_ms", "seq_ord")


@query
def bars_ohlcv(spark, d):
    return B.bars(prints(spark, d), [HOUR])


@query
def bars_multi_width(spark, d):
    return both_bars(spark, d)


@query
def bars_closed(spark, d):
    return B.split_open(both_bars(spark, d)).where("closed")


@query
def bars_open(spark, d):
    return B.split_open(both_bars(spark, d)).where("not closed")


@query
def bars_force_closed(spark, d):
    return B.force_closed(both_bars(spark, d), 1706486400 * B.NS)


@query
def flush_units(spark, d):
    return B.flush_units(M.base(spark, d), DAY)


def with_steps_back(log: DataFrame) -> DataFrame:
    return log.withColumn("timestamp_ns", F.when(F.col("k") % 9 == 0, F.col("timestamp_ns") - 93600 * B.NS).otherwise(F.col("timestamp_ns")))


@query
def late_rows(spark, d):
    """On a log whose time goes back by 26 hours in every ninth record."""
    return B.late_rows(with_steps_back(M.base(spark, d)), DAY).select("seq_ms", "seq_ord", "unit_ns")


@query
def bars_reconcile(spark, d):
    """Against an archive in which some bars have a wrong volume."""
    p = prints(spark, d)
    archived = B.bars(p, [HOUR, DAY]).withColumn("volume", F.when(F.col("open_ns") % 7 == 3, F.col("volume") + 1).otherwise(F.col("volume")))
    return B.reconcile(p, archived, [HOUR, DAY])


@query
def research_bars(spark, d):
    return B.research_bars(M.price_history(M.base(spark, d)), 15, 100, 877)


@query
def last_trade(spark, d):
    return B.last_trade(prints(spark, d))


@query
def recent_trades(spark, d):
    return B.recent_trades(prints(spark, d), 200).select("symbol_id", "price_ticks", "qty", "seq", "rank")


@query
def bar_series(spark, d):
    """Some bars come a second time with one more unit of volume."""
    b = both_bars(spark, d).withColumn("arrival", F.lit(1))
    again = b.where("open_ns % 3 = 0").withColumn("volume", F.col("volume") + 1).withColumn("arrival", F.lit(2))
    return B.bar_series(b.unionByName(again), 600).select("symbol_id", "bucket_seconds", "open_ns", "close_ticks", "volume", "rank")


@query
def bar_direction(spark, d):
    return B.direction_volume(both_bars(spark, d))


@query
def width_label(spark, d):
    w = B.bars(prints(spark, d), [1, 60, 300, 1440]).select("bucket_seconds").distinct()
    return w.select("bucket_seconds", X.width_label("bucket_seconds").alias("label"))


@query
def replay_price_join(spark, d):
    b = M.base(spark, d)
    events = b.select("seq_ord", "symbol_id", (F.col("timestamp_ns") - 1704067200 * B.NS).alias("elapsed_ns"), (F.col("symbol_id") * 37).alias("offset"))
    return B.replay_price(events, M.price_history(b), 60 * B.NS).select("seq_ord", "symbol_id", "minute_index", "close_ticks")


def logs(spark, d):
    b = M.base(spark, d)
    return M.accepts(b), M.fills(b), M.cancels(b)


def events_of(spark, d) -> DataFrame:
    return K.order_events(*logs(spark, d))


def changes_of(spark, d) -> DataFrame:
    return K.level_changes(K.order_states(events_of(spark, d)))


def units_of(spark, d) -> DataFrame:
    return V.covered_units(M.base(spark, d), B.NS, DAY * B.NS)


def intervals_of(spark, d, depth: int, parity: bool = False) -> DataFrame:
    """The best levels of each second, as intervals; archive units are days."""
    return V.book_intervals(changes_of(spark, d), units_of(spark, d), B.NS, DAY * B.NS, depth, parity=parity)


@query
def order_events(spark, d):
    return events_of(spark, d).select("order_id", "seq_ord", "kind", "filled")


@query
def order_lifecycle(spark, d):
    return K.order_lifecycle(events_of(spark, d), logs(spark, d)[1])


@query
def resting_orders(spark, d):
    return K.resting_orders(events_of(spark, d), (1705276800000, 1 << 60)).drop("a_ms", "a_ord")


@query
def book_levels(spark, d):
    return K.book_levels(K.resting_orders(events_of(spark, d)), 20)


@query
def bbo(spark, d):
    return K.bbo(K.book_levels(K.resting_orders(events_of(spark, d))), "symbol_id")


@query
def level_changes(spark, d):
    return changes_of(spark, d).select("symbol_id", "side", "price_ticks", "seq_ord", "qty")


@query
def book_snapshots_1hz(spark, d):
    """The best ten levels of each second of the month; seconds that agree are one interval."""
    return V.laid_out(intervals_of(spark, d, 10), "symbol_id")


@query
def book_snapshots_parity(spark, d):
    """The same with the archive's own seconds before a unit's first record."""
    return V.laid_out(intervals_of(spark, d, 3, parity=True), "symbol_id")


@query
def book_at(spark, d):
    return K.book_at(changes_of(spark, d), 3, 1705305600)


@query
def conflated_book(spark, d):
    return K.conflated(changes_of(spark, d), 50_000_000)


@query
def crossed_books(spark, d):
    return V.crossed(V.with_best(intervals_of(spark, d, 1)))


@query
def depth_share(spark, d):
    return V.depth_share(intervals_of(spark, d, 5)).select("symbol_id", "from_ns", "steps", "side", "level", "qty", "share")


@query
def banded_price(spark, d):
    a = logs(spark, d)[0].select("order_id", "side", "symbol_id", "seq_ms", "seq_ord")
    seen = K.as_of(a, K.bbo_timeline(changes_of(spark, d)), "symbol_id", ["bid", "ask"])
    return K.banded_price(seen).select("order_id", "side", "bid", "ask", "limit_ticks")


@query
def audit_event_log(spark, d):
    return K.audit_event_log(*logs(spark, d))


@query
def audit_price_time(spark, d):
    return K.audit_price_time(*logs(spark, d))


@query
def audit_crossed_final(spark, d):
    best = K.bbo(K.book_levels(K.resting_orders(events_of(spark, d))), "symbol_id")
    return best.select("symbol_id", "bid", "ask", K.is_crossed(best).alias("crossed"))


@query
def conservation(spark, d):
    return K.conservation(events_of(spark, d))


def legs_of(spark, d) -> DataFrame:
    return L.fill_legs(M.fills(M.base(spark, d)))


def cash_of(spark, d) -> DataFrame:
    return L.cash_events(M.account_records(M.base(spark, d)), legs_of(spark, d))


@query
def fees(spark, d):
    return L.fees(M.fills(M.base(spark, d)))


@query
def fill_legs(spark, d):
    return legs_of(spark, d).select("seq_ord", "symbol_id", "role", "user_id", "order_id", "side", "fee", "signed_qty", "cash_delta")


@query
def cash_balances(spark, d):
    return L.cash_balances(cash_of(spark, d))


@query
def cash_history(spark, d):
    return L.cash_history(cash_of(spark, d)).select("user_id", "seq_ord", "leg", "delta", "balance")


@query
def positions(spark, d):
    return L.positions(legs_of(spark, d))


@query
def open_orders(spark, d):
    a, _, c = logs(spark, d)
    return L.open_orders(a, legs_of(spark, d), c)


@query
def house_fees(spark, d):
    return L.house_fees(M.fills(M.base(spark, d)))


@query
def cash_conservation(spark, d):
    b = M.base(spark, d)
    return L.conservation(M.account_records(b), M.fills(b))


@query
def portfolio(spark, d):
    return L.portfolio(L.cash_balances(cash_of(spark, d)), L.positions(legs_of(spark, d)), M.symbol_dim(spark), M.base(spark, d).select("user_id").distinct())


@query
def private_timeline(spark, d):
    a, _, c = logs(spark, d)
    t = L.private_timeline(a, legs_of(spark, d), c, M.account_records(M.base(spark, d)), M.symbol_dim(spark))
    return t.select("user_id", "user_seq", "seq_ord", "kind", "role", "symbol", "order_id", "qty")


@query
def changed_keys(spark, d):
    """Of every 500 records of the log."""
    a, _, c = logs(spark, d)
    return L.changed_keys(a, legs_of(spark, d), c, M.account_records(M.base(spark, d)), F.call_function("div", F.col("seq_ord"), F.lit(500)))


@query
def mark_to_market(spark, d):
    return L.mark_to_market(L.cash_balances(cash_of(spark, d)), L.positions(legs_of(spark, d)), B.last_trade(prints(spark, d)))


@query
def state_snapshot(spark, d):
    """A digest of each state table that doesn't depend on the order of its rows: the sum of its lines' 48-bit hashes, modulo 2^64 as a signed long."""
    line = lambda df, name, *c: df.select(F.lit(name).alias("tbl"), F.concat_ws(":", *c).alias("line"))
    rows = line(L.cash_balances(cash_of(spark, d)), "cash", "user_id", "cash_ticks").union(line(L.positions(legs_of(spark, d)), "position", "user_id", "symbol_id", "position"))
    rows = rows.union(line(K.resting_orders(events_of(spark, d)), "resting", "order_id", "rem"))
    part = F.conv(F.substring(F.sha2("line", 256), 1, 12), 16, 10).cast("decimal(38,0)")  # 65,536 lines and more sum up to 2^63
    return rows.groupBy("tbl").agg(F.count("*").alias("n"), X.wrapped(F.sum(part)).alias("digest"))


@query
def buy_cost(spark, d):
    return logs(spark, d)[0].where("side = 1").select("order_id", X.buy_cost("price_ticks", "qty").alias("cost"))


@query
def reservations(spark, d):
    return R.reservations(K.resting_orders(events_of(spark, d)))


@query
def available(spark, d):
    return R.available(L.cash_balances(cash_of(spark, d)), L.positions(legs_of(spark, d)), R.reservations(K.resting_orders(events_of(spark, d))))


def free_cash(spark, d) -> DataFrame:
    return R.running_available(R.cash_moves(cash_of(spark, d), K.order_states(events_of(spark, d))))


@query
def admission_audit(spark, d):
    units = R.running_units(legs_of(spark, d), K.order_states(events_of(spark, d)))
    return R.admission_audit(logs(spark, d)[0], free_cash(spark, d), units, M.MARKET_MAKERS)


@query
def retail_short_violations(spark, d):
    return R.retail_shorts(legs_of(spark, d), M.MARKET_MAKERS).drop("seq_ms")


@query
def insolvency_violations(spark, d):
    low = free_cash(spark, d).groupBy("user_id", "seq_ord").agg(F.min("free").alias("lowest"))
    return low.where("lowest < 0")


@query
def first_outcome_dedupe(spark, d):
    """Client ids that are used again; a TTL of a day."""
    s = M.inbound(M.base(spark, d)).where("record_type = 'submit'")
    s = s.select("user_id", ((F.col("qty") - 1) % 10).alias("client_order_id"), "seq_ord", "timestamp_ns")
    return R.first_outcomes(s, DAY * B.NS).select("user_id", "client_order_id", "seq_ord", "duplicate")


@query
def rate_limit_audit(spark, d):
    """Two orders a day."""
    s = M.inbound(M.base(spark, d)).where("record_type = 'submit'").select("user_id", "client_order_id", "seq_ord", "timestamp_ns")
    return R.rate_limited(s.withColumn("timestamp_ns", F.call_function("div", F.col("timestamp_ns"), F.lit(DAY // 2))), 1.0).select("user_id", "client_order_id", "allowed")


@query
def reject_summary(spark, d):
    k = F.col("k") % 4
    reason = F.when(k == 0, "INSUFFICIENT_CASH").when(k == 1, "INVALID_PRICE").when(k == 2, "UNKNOWN_SYMBOL").otherwise("INSUFFICIENT_POSITION")
    return R.reject_summary(M.base(spark, d).where("event_type = 'error'").select("symbol_id", "user_id", reason.alias("reason")), M.symbol_dim(spark))


@query
def recovery_check(spark, d):
    """Expected: every third view and, wrongly, every third error."""
    b = M.base(spark, d)
    expected = b.where("event_type in ('view', 'error') and k % 3 = 0").select(F.col("seq_ord").alias("client_order_id"))
    return R.recovery_check(expected, M.accepts(b), M.fills(b))


def frames_of(b: DataFrame) -> DataFrame:
    """Frames of private channels, numbered densely with gaps, and of tapes, with steps back."""
    private = F.col("k") % 2 == 0
    return b.select(
        F.when(private, F.concat(F.lit("private:"), F.col("user_id"))).otherwise(F.concat(F.lit("tape:"), F.col("symbol_id"))).alias("channel"), private.alias("private"), F.col("seq_ord").alias("arrival"),
        F.when(private, 0).otherwise(F.col("seq_ms")).alias("seq_a"), F.when(private, F.call_function("div", F.col("seq_ord"), F.lit(700))).otherwise(F.col("seq_ord") - (F.col("k") % 5) * 30).alias("seq_b"),
    )


@query
def sequence_verdicts(spark, d):
    return R.sequence_verdicts(frames_of(M.base(spark, d))).select("channel", "arrival", "verdict")


# Fixed values: (run_id, minutes of a bar, fast and slow windows, quantity).
RUNS = [(1, 15, 3, 8, 5), (2, 15, 5, 20, 5), (3, 60, 2, 5, 3)]


def swept(spark, d, runs=RUNS[:1]) -> DataFrame:
    params = spark.createDataFrame(runs, "run_id long, minutes int, fast int, slow int, qty long")
    return G.sweep(M.price_history(M.base(spark, d)), params, sorted({r[1] for r in runs}), sorted({n for r in runs for n in r[2:4]}))


def curve_of(spark, d) -> DataFrame:
    return G.run_backtests(swept(spark, d)).where("kind = 'bar'")


@query
def sma_signal(spark, d):
    return swept(spark, d).select("run_id", "symbol_id", "bar_index", "long")


@query
def backtest_trades(spark, d):
    t = G.run_backtests(swept(spark, d)).where("kind = 'trade'")
    return t.select("run_id", "symbol_id", "bar_index", "side", "qty", "price_ticks", "fee_ticks", "realised_ticks")


@query
def strategy_udf(spark, d):
    """Trades of a strategy class that a user hands in."""
    t = G.run_backtests(swept(spark, d), G.BuySellCycle).where("kind = 'trade'")
    return t.select("run_id", "symbol_id", "bar_index", "side", "qty", "price_ticks", "fee_ticks", "realised_ticks")


@query
def result_json(spark, d):
    """Realised profit per run as documents with sorted keys."""
    return result_documents(realised_pnl(spark, d), "no slippage").select("run_id", "symbol_id", "document")


@query
def dataset_checksum(spark, d):
    """Closes written in files of 10,000 per symbol and held against recorded digests, of which those of symbol 4 are wrong; one file is recorded that there is not."""
    h = M.price_history(M.base(spark, d)).join(F.broadcast(M.symbol_dim(spark)), "symbol_id")
    part = F.call_function("div", F.col("minute_index"), F.lit(10_000)).cast("string")
    h = h.select(F.concat_ws("-", "name", part).alias("name"), "symbol_id", "minute_index", F.concat("close_ticks", F.lit("\n")).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("minute_index", "line"))), lambda x: x["line"]), "")
    right = F.sha2(text, 256)
    recorded = h.groupBy("name", "symbol_id").agg(F.when(F.col("symbol_id") == 4, F.sha2(F.lit("x"), 256)).otherwise(right).alias("expected")).select("name", "expected")
    recorded = recorded.unionByName(spark.createDataFrame([("none-0", "0")], "name string, expected string"))
    folder = shared_folder(spark, "files")
    h.repartition("name").sortWithinPartitions("name", "minute_index").select(F.rtrim("line", F.lit("\n")).alias("value"), "name").write.partitionBy("name").text(folder)
    return I.verify_files(spark, folder, recorded, r"name=([^/]*)/").select("name", "found", "ok")


@query
def equity_curve(spark, d):
    return curve_of(spark, d).select("run_id", "symbol_id", "bar_index", "cash_ticks", "position", "equity_ticks", "refused")


@query
def realised_pnl(spark, d):
    t = G.run_backtests(swept(spark, d)).where("kind = 'trade'")
    return t.groupBy("run_id", "symbol_id").agg(F.sum("realised_ticks").alias("realised_ticks"), F.count("*").alias("trades"))


@query
def max_drawdown(spark, d):
    return G.drawdown(curve_of(spark, d))


@query
def bar_returns(spark, d):
    return G.risk_ratios(G.bar_returns(curve_of(spark, d)))


@query
def buy_and_hold(spark, d):
    return G.buy_and_hold(swept(spark, d))


@query
def backtest_metrics(spark, d):
    b = swept(spark, d)
    return G.metrics(b, G.run_backtests(b))


@query
def backtest_sweep(spark, d):
    b = swept(spark, d, RUNS)
    return G.metrics(b, G.run_backtests(b))


@query
def backtest_report(spark, d):
    b = swept(spark, d, RUNS)
    return G.report(G.metrics(b, G.run_backtests(b)), M.symbol_dim(spark))


def load_steps(spark) -> DataFrame:
    """Ten equal ranges over the month of the log."""
    began = 1704067200 * B.NS + F.col("id") * (3 * DAY * B.NS)
    return spark.range(10).select(F.col("id").alias("step"), began.alias("began"), (began + (3 * DAY * B.NS - 1)).alias("ended"))


def spreads(spark, d) -> DataFrame:
    return V.spread_samples(intervals_of(spark, d, 10), 5, 3)


def obligations(spark, d) -> DataFrame:
    """Makers' own books: one book per maker and symbol."""
    own, units = F.col("user_id") < M.MARKET_MAKERS, units_of(spark, d)
    key = ("user_id", "symbol_id")
    quotes = V.book_intervals(K.level_changes(K.order_states(events_of(spark, d)).where(own), *key), units, B.NS, DAY * B.NS, 1, key)
    return V.obligation_intervals(V.best_quotes(quotes), logs(spark, d)[0].where(own).select(*key).distinct(), units, B.NS, DAY * B.NS, 2000, 20)


@query
def spread_bps(spark, d):
    return spreads(spark, d).select("symbol_id", "from_ns", "to_ns", "steps", "one_sided", "spread_bps")


@query
def thin_side_depth(spark, d):
    return spreads(spark, d).where("not one_sided").select("symbol_id", "from_ns", "to_ns", "steps", "thin_qty")


@query
def nearest_rank(spark, d):
    s = M.load_samples(M.base(spark, d)).select("status", (F.col("acked_ns") - F.col("intended_ns")).alias("x"))
    return Q.nearest_rank(s, "x", ["status"], {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999})


@query
def quality_by_step(spark, d):
    units, steps = units_of(spark, d), load_steps(spark)
    cut = lambda x: V.within(x, steps, units, B.NS, DAY * B.NS)
    samples = V.placed(spreads(spark, d).withColumn("unit_ns", X.bucket("from_ns", DAY * B.NS)), units, B.NS)
    return Q.by_step(cut(samples), cut(Q.breach_rows(obligations(spark, d), "at")), steps)


@query
def obligation_samples(spark, d):
    return Q.breach_rows(obligations(spark, d))


@query
def obligation_summary(spark, d):
    return Q.obligation_summary(obligations(spark, d), 0.95)


@query
def maker_activity(spark, d):
    a, _, c = logs(spark, d)
    return Q.maker_activity(a, c, L.positions(legs_of(spark, d)), M.MARKET_MAKERS)


@query
def quote_panel(spark, d):
    """What each user with a position would quote around the last price, and whether an unskewed bid would have to move."""
    last = B.last_trade(prints(spark, d)).select("symbol_id", F.col("price_ticks").alias("fair"))
    rows = L.positions(legs_of(spark, d)).withColumnRenamed("position", "inventory").join(F.broadcast(last), "symbol_id")
    p = Q.quote_panel(rows, 25, 25, 100)
    still = F.col("fair") - F.greatest(F.lit(1).cast("long"), X.floor_div(F.col("fair") * 25, 10_000))
    return p.select("user_id", "symbol_id", "fair", "inventory", "bid", "ask", (F.col("bid") != still).alias("requote"))


@query
def order_trace(spark, d):
    b = M.base(spark, d)
    return Q.order_trace(M.inbound(b), M.accepts(b), M.fills(b))


@query
def ambiguous_client_ids(spark, d):
    return Q.ambiguous_ids(M.base(spark, d).where("event_type = 'view'").select(F.col("k").alias("client_order_id"), "user_id"))


@query
def load_result(spark, d):
    s = M.load_samples(M.base(spark, d))
    receipts = s.where("k % 4 <> 0").select("client_order_id", (F.col("acked_ns") + 5).alias("received_ns"))
    return Q.load_result(s, receipts, load_steps(spark), HOUR * B.NS)


def delays(spark, d) -> DataFrame:
    hour = X.bucket("timestamp_ns", HOUR * B.NS)
    frames = changes_of(spark, d).groupBy("symbol_id", hour.alias("h")).agg(F.max("seq_ord").alias("frame_seq")).select("symbol_id", "frame_seq", (F.col("h") + HOUR // 2 * B.NS).alias("arrival_ns"))
    return Q.next_frame(logs(spark, d)[0].withColumnRenamed("timestamp_ns", "stamped_ns"), frames)


@query
def conflation_delay(spark, d):
    return delays(spark, d)


@query
def update_delay(spark, d):
    users = logs(spark, d)[0].select("symbol_id", "seq_ord", (F.col("user_id") % 4).alias("clients"))
    return Q.delay_summary(delays(spark, d).join(users, ["symbol_id", "seq_ord"]), ["clients"])


def streamed(spark, d, parts: int = 4) -> DataFrame:
    """The log as a stream of several triggers: its events in files by time, a range of them at a time."""
    folder = shared_folder(spark, "log")
    return S.stream_log(spark, folder, S.write_in_order(spark.read.parquet(f"{d}/events.parquet"), folder, parts))


@query
def stream_tape(spark, d):
    return S.run_to_end(S.stream_tape(streamed(spark, d)), shared_folder(spark, "stream"))


@query
def stream_bars(spark, d):
    return S.run_to_end(S.stream_bars(streamed(spark, d), HOUR), shared_folder(spark, "stream"))


def stateful(spark, d, build) -> DataFrame:
    return S.with_rocks(spark, lambda: S.run_to_end(build(streamed(spark, d)), shared_folder(spark, "stream")))


@query
def stream_bars_on_next_trade(spark, d):
    return stateful(spark, d, lambda log: S.stream_bars_on_next_trade(log, HOUR))


@query
def stream_book(spark, d):
    return stateful(spark, d, S.stream_book)


@query
def stream_private(spark, d):
    return stateful(spark, d, S.stream_private)


@query
def stream_gaps(spark, d):
    return stateful(spark, d, lambda log: S.stream_gaps(frames_of(log)))


def model_of(spark, d) -> tuple[RM.ReadModel, int]:
    """The read model after a stream of six batches, and its version."""
    model = RM.ReadModel(spark, shared_folder(spark, "model"))
    q = RM.stream_read_model(streamed(spark, d, 6), model)
    q.awaitTermination()
    return model, RM.last_version(q)


def model_rows(model: RM.ReadModel, version: int) -> DataFrame:
    """Accounts, positions, open orders and house fees in one shape."""
    line = lambda tbl, a, b, n: model.read(tbl, version).select(F.lit(tbl).alias("tbl"), F.expr(a).cast("long").alias("a"), F.expr(b).cast("long").alias("b"), F.col(n).cast("long").alias("amount"))
    rows = line("accounts", "user_id", "created", "cash_ticks").union(line("positions", "user_id", "symbol_id", "position"))
    return rows.union(line("open_orders", "order_id", "user_id", "remaining")).union(line("house_fees", "symbol_id", "unix_date(to_date(date))", "fees"))


@query
def stream_ledger(spark, d):
    model, version = model_of(spark, d)
    return model.read("accounts", version).select("user_id", "cash_ticks")


@query
def stream_read_model(spark, d):
    """All tables of the ledger after six batches."""
    return model_rows(*model_of(spark, d))


@query
def stream_house_fees(spark, d):
    model, version = model_of(spark, d)
    return model.house_fees(version)


@query
def archive_scan(spark, d):
    """Trades written by symbol and day, read back for two symbols and ten days."""
    folder = shared_folder(spark, "archive")
    archive_write(prints(spark, d), M.symbol_dim(spark), folder, "timestamp_ns")
    rows = read_archive(spark, folder, ["QAB", "QAE"], "2024-01-10", "2024-01-19")
    return rows.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), "seq_ord", "price_ticks", "qty")


def wire_log(spark, d) -> DataFrame:
    """Accepts, fills and cancels as (stream_id, payload) of the binary log, written and read as the table a decoder would find.

    Unwritten, the encoder's expression would be computed anew in every field of the decoder.
    """
    a, f, c = logs(spark, d)
    u = lambda name: F.greatest(F.col(name), F.lit(0))  # noqa: E731  (ids are unsigned)
    same = lambda *names: {n: F.col(n) for n in ("seq_ms", "seq_ord", "timestamp_ns", "symbol_id", *names)}
    made = [
        (a, I.encode_record(10, **same("order_id", "client_order_id", "user_id", "price_ticks", "qty", "side"), tif=F.lit(1))),
        (f, I.encode_record(12, **same("maker_user_id", "taker_user_id", "price_ticks", "qty", "aggressor_side"), maker_order_id=u("maker_order_id"), taker_order_id=u("taker_order_id"))),
        (c, I.encode_record(13, **same("user_id", "remaining_qty", "reason"), order_id=u("order_id"))),
    ]
    x, y, z = (df.select(F.concat_ws("-", "seq_ms", "seq_ord").alias("stream_id"), payload.alias("payload")) for df, payload in made)
    folder = shared_folder(spark, "wire")
    x.unionByName(y).unionByName(z).write.parquet(folder)
    return spark.read.schema("stream_id string, payload binary").parquet(folder)


def decoded(good: DataFrame) -> DataFrame:
    ids = [F.col(c).cast("long").alias(c) for c in ("order_id", "user_id", "maker_order_id", "taker_order_id", "maker_user_id", "taker_user_id")]
    return good.select("seq_ms", "seq_ord", "timestamp_ns", "record_type", "record", "symbol_id", "price_ticks", "qty", "remaining_qty", *ids)


@query
def decode_wire_log(spark, d):
    """The log encoded as binary records and decoded again."""
    return decoded(I.decode_wire_log(wire_log(spark, d))[0])


def damaged() -> Column:
    """Payloads of which some have another version, an unknown type, are cut off, too short, or lost."""
    at = X.stream_ord("stream_id") % 7
    tail = lambda n: F.substring("payload", n, 1000)
    return (
        F.when(at == 1, F.concat(F.unhex(F.lit("0900")), tail(3))).when(at == 2, F.concat(F.substring("payload", 1, 2), F.unhex(F.lit("6300")), tail(5)))
        .when(at == 3, tail(1).substr(F.lit(1), F.length("payload") - 1)).when(at == 4, F.substring("payload", 1, 7)).when(at != 5, F.col("payload"))
    )


@query
def decode_quarantine(spark, d):
    _, bad = I.decode_wire_log(wire_log(spark, d).withColumn("payload", damaged()))
    return bad.select("stream_id", "reason")


@query
def feed_frames_parse(spark, d):
    """The tape as feed frames in JSON, parsed again; each ninth line is cut off and has no kind."""
    t = prints(spark, d)
    frame = F.to_json(F.struct(F.concat(F.lit("tape:"), F.col("symbol_id")).alias("ch"), "seq", "price_ticks", "qty"))
    lines = t.select(F.when(F.col("seq_ord") % 9 == 0, F.substring(frame, 1, 12)).otherwise(frame).alias("value"))
    return I.parse_frames(lines).select("kind", "subject", "seq", "price_ticks", "qty")


@query
def breach_log_parse(spark, d):
    """Log lines with breaches, other lines, and breaches without a kind."""
    stamp = F.date_format(F.timestamp_millis("seq_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    word = F.when(F.col("event_type") == "error", " quote_sent ").otherwise(" obligation_breach ")
    body = F.when(F.col("event_type") == "click", "{}").otherwise(F.concat(F.lit('{"kind": "'), F.col("event_type"), F.lit('"}')))
    lines = M.base(spark, d).select(F.concat(F.lit("bots-1 | "), stamp, word, body).alias("value"))
    return I.parse_breaches(lines).select(F.unix_seconds("at").alias("at_s"), "kind")


@query
def archive_stats(spark, d):
    """Files by symbol of an archive by symbol and day: one file a day; bytes depend on the writer."""
    folder = shared_folder(spark, "archive")
    archive_write(prints(spark, d), M.symbol_dim(spark), folder, "timestamp_ns")
    return stats_of_archive(spark, folder).select("symbol", "files", (F.col("bytes") > 0).alias("filled"))


@query
def bar_partition_audit(spark, d):
    """Bars of which those that open at an odd hour's end are filed under the day after."""
    b = both_bars(spark, d).where("bucket_seconds = 3600")
    wrong = F.when(F.col("open_ns") % 7 == 3, F.lit(DAY * B.NS)).otherwise(F.lit(0))
    return B.misfiled(b.withColumn("date", X.utc_date(F.col("open_ns") + wrong))).select("symbol_id", "open_ns", "date")


@query
def l2_frames(spark, d):
    """Nested frames of five levels a side, with the depth and the best price of each."""
    f = V.with_best(intervals_of(spark, d, 5))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda t, x: t + x["qty"])
    return f.select("symbol_id", "from_ns", "steps", F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"), "bid", "ask", total("bids").alias("bid_qty"), total("asks").alias("ask_qty"))


@query
def manifest(spark, d):
    """Manifests of one run per symbol over its history."""
    p = M.price_history(M.base(spark, d)).groupBy("symbol_id").agg(F.count("*").alias("minutes"), F.min("close_ticks").alias("lowest"))
    return G.manifest(p)


@query
def read_model_upsert(spark, d):
    """The tables brought up to date by three batches of the log, ten days each; the second is applied twice."""
    b, model = M.base(spark, d), RM.ReadModel(spark, shared_folder(spark, "model"))
    day = F.call_function("div", F.col("seq_ms") - 1704067200000, F.lit(10 * DAY * 1000))
    for version, n in enumerate((0, 1, 2)):
        batch = b.where(F.least(F.greatest(day, F.lit(0)), F.lit(2)) == n)
        model.apply(batch, version)
        if n == 1:
            model.apply(batch, version)
    return model_rows(model, 2)


@query
def stream_log(spark, d):
    return S.run_to_end(streamed(spark, d), shared_folder(spark, "stream")).drop("event_time")


def streamed_wire(spark, d, damage=None) -> str:
    """The folder of a stream's two sinks: the binary log in files by time, decoded."""
    wire = wire_log(spark, d).withColumn("ord", X.stream_ord("stream_id"))
    source, folder = shared_folder(spark, "wire"), shared_folder(spark, "stream")
    files = S.write_in_order(wire if damage is None else wire.withColumn("payload", damage), source, 3, "ord")
    rows = spark.readStream.schema("stream_id string, payload binary, ord long").option("maxFilesPerTrigger", files).parquet(source)
    S.stream_decode(rows.drop("ord"), folder).awaitTermination()
    return folder


@query
def stream_decode(spark, d):
    """The binary log as a stream: its records."""
    good, _ = I.decode_wire_log(spark.createDataFrame([], "stream_id string, payload binary"))
    return decoded(spark.read.schema(good.schema).parquet(streamed_wire(spark, d) + "/records"))


@query
def stream_quarantine(spark, d):
    """The binary log as a stream, with damage: what can't be read."""
    return spark.read.schema("stream_id string, payload binary, reason string").parquet(streamed_wire(spark, d, damaged()) + "/quarantine").select("stream_id", "reason")


@query
def stream_dedupe(spark, d):
    """The rule of first_outcome_dedupe as a stream.

    The log comes by its time, four ranges of it: all files of a range are one
    batch of a run that goes on where the last one ended, so no row is late
    however ids and files lie.
    """
    log, folder = shared_folder(spark, "log"), shared_folder(spark, "stream")
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("us", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)))

    def run():
        for part, files in S.in_ranges(events, 4, "us", 500_000):
            part.drop("us").repartition(files, "event_id").write.mode("append").parquet(log)
            s = M.inbound(S.stream_log(spark, log, ALL_FILES)).where("record_type = 'submit'")
            s = s.select("user_id", ((F.col("qty") - 1) % 10).alias("client_order_id"), "seq_ord", "timestamp_ns")
            out = S.run_to_end(S.stream_dedupe(s.withColumn("event_time", F.timestamp_micros(F.call_function("div", F.col("timestamp_ns"), F.lit(1000)))), DAY * B.NS), folder)
        return out

    return S.with_rocks(spark, run)


def sealed_units(spark, d) -> DataFrame:
    """Units that ended a second before the last event, as the streams' watermark has it."""
    log = M.base(spark, d)
    seen = log.agg((F.max("seq_ms") * 1_000_000 - B.NS).alias("seen"))  # one row
    return units_of(spark, d).join(F.broadcast(seen)).where(F.col("unit_ns") + DAY * B.NS <= F.col("seen")).drop("seen")


def quotes_of(spark, d) -> str:
    """The folder of makers' quotes as a stream has left it."""
    folder = shared_folder(spark, "stream")
    S.with_rocks(spark, lambda: S.run_to_end(S.stream_quotes(streamed(spark, d), M.MARKET_MAKERS, B.NS, DAY * B.NS), folder))
    return f"{folder}/out"


QUOTES = "user_id long, symbol_id int, from_ns long, to_ns long, bid long, bid_qty long, ask long, ask_qty long"


@query
def stream_obligations(spark, d):
    """Breaches of makers by the quotes that the stream kept, over the units it has sealed."""
    quotes, units = V.cut_by_unit(spark.read.schema(QUOTES).parquet(quotes_of(spark, d)), B.NS, DAY * B.NS), sealed_units(spark, d)
    pairs = logs(spark, d)[0].where(F.col("user_id") < M.MARKET_MAKERS).select("user_id", "symbol_id").distinct()
    return Q.breach_rows(V.obligation_intervals(quotes, pairs, units, B.NS, DAY * B.NS, 2000, 20))


@query
def stream_uptime(spark, d):
    """A second stream reads the quotes of the first and keeps each maker's running seconds; here its last word on each."""
    folder, units = shared_folder(spark, "stream"), sealed_units(spark, d)
    quotes = spark.readStream.schema(QUOTES).option("maxFilesPerTrigger", 8).parquet(quotes_of(spark, d))
    emit = lambda df, n: df.withColumn("v", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/uptime/batch={n}")
    S.stream_uptime(V.cut_by_unit(quotes, B.NS, DAY * B.NS).join(units.select("unit_ns"), "unit_ns", "left_semi"), 20, emit, folder).awaitTermination()
    last = spark.read.parquet(f"{folder}/uptime").groupBy("user_id", "symbol_id")
    return last.agg(F.max_by("quoted", "v").alias("quoted"), F.max_by("full_size", "v").alias("full_size"))


@query
def stream_conflated_book(spark, d):
    """Ticks of 50 ms by event time."""
    return stateful(spark, d, lambda log: S.stream_conflated(log, 50_000_000))


def archive_of(spark, d) -> S.SealedArchive:
    """An archive of days by a stream whose time goes back by 26 hours in every ninth record."""
    archive = S.SealedArchive(spark, M.symbol_dim(spark), shared_folder(spark, "stream"), DAY)
    S.stream_archive(with_steps_back(streamed(spark, d)), archive).awaitTermination()
    return archive


@query
def stream_archive(spark, d):
    """Trades of the days that are sealed."""
    return read_archive(spark, f"{archive_of(spark, d).folder}/trades").select("symbol", "seq_ord", "price_ticks", "qty")


@query
def stream_late_rows(spark, d):
    return archive_of(spark, d).late()


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from tickloom.plans.oracle import ORACLES

    return {k: v for k, v in ORACLES.items() if k in QUERIES}

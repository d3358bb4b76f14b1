"""Structured Streaming over the log; each query has a batch operator with the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators import bars as B
from tickloom.operators.intervals import SideOfBook
from tickloom.sources import market as M

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream_log(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """The log's base view as a stream, with an event time in microseconds for watermarks. `path` is a folder, or a pattern for one file."""

    b = M.view(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path))
    return b.withColumn("event_time", F.timestamp_micros(F.call_function("div", F.col("timestamp_ns"), F.lit(1000))))


def in_ranges(events: DataFrame, parts: int, key: str, rows_per_file: int = 5_000_000) -> Iterator[tuple[DataFrame, int]]:
    """`parts` ranges of a number, one after the other, each with the number of files it fills if rows are spread evenly."""
    low, high, n = events.agg(F.min(key), F.max(key), F.count("*")).first()
    files = 1 + n // (parts * rows_per_file)
    for k in range(parts if n else 1):
        part = events.where(F.col(key).between(low + (high - low + 1) * k // parts, low + (high - low + 1) * (k + 1) // parts - 1)) if n else events
        yield part, files


def write_in_order(events: DataFrame, folder: str, parts: int, key: str = "event_id", rows_per_file: int = 5_000_000) -> int:
    """Rows as files that a stream takes in order: `parts` ranges of a number, each written after the one before; returns the files of a range."""
    for part, files in in_ranges(events, parts, key, rows_per_file):
        part.repartitionByRange(files, key).write.mode("append").parquet(folder)
    return files


def run_to_end(df: DataFrame, folder: str) -> DataFrame:
    """Everything that is there now through an append query into a table; a second call goes on where the first ended."""
    spark = df.sparkSession
    q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def with_rocks(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """Run with the state store that stateful processors need, which writes what has changed and not the whole state, and put the session's own settings back."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    old = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        return run()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def stream_tape(log: DataFrame) -> DataFrame:
    return B.tape(M.fills(log)).drop(*M.SEQ)


def stream_bars(log: DataFrame, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """Tumbling OHLCV, written when the watermark passes the bar's end."""
    at = F.struct(*M.SEQ)
    f = log.where("event_type = 'purchase'").withColumn("qty", 1 + F.col("k") % 20).withWatermark("event_time", delay)
    g = f.groupBy(F.window("event_time", f"{seconds} seconds"), "symbol_id").agg(
        F.min_by("price_ticks", at).alias("open_ticks"), F.max("price_ticks").alias("high_ticks"), F.min("price_ticks").alias("low_ticks"), F.max_by("price_ticks", at).alias("close_ticks"),
        F.sum("qty").alias("volume"), F.count("*").alias("trades"),
    )
    return g.select("symbol_id", (F.unix_micros("window.start") * 1000).alias("open_ns"), "open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "trades")


class BarOnNextTrade(StatefulProcessor):
    """Keeps the open bar of a symbol; a trade in any other bucket closes it, also one that comes late."""

    def __init__(self, width_ns: int):
        self.width = width_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bar = handle.getValueState("bar", "open_ns long, o long, h long, l long, c long, v long, n long")

    def handleInputRows(self, key, rows: Iterator, timer_values) -> Iterator:
        import pandas as pd

        trades = pd.concat(list(rows)).sort_values(["seq_ms", "seq_ord"])
        bar = list(self.bar.get()) if self.bar.exists() else None
        out = []
        for t, p, n in zip(trades["timestamp_ns"].tolist(), trades["price_ticks"].tolist(), trades["qty"].tolist(), strict=True):
            start = t - t % self.width
            if bar and start != bar[0]:
                out.append((key[0], *bar))
                bar = None
            if bar is None:
                bar = [start, p, p, p, p, n, 1]
            else:
                bar = [bar[0], bar[1], max(bar[2], p), min(bar[3], p), p, bar[5] + n, bar[6] + 1]
        if bar:
            self.bar.update(tuple(int(x) for x in bar))
        yield pd.DataFrame(out, columns=["symbol_id", "open_ns", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "trades"])

    def close(self) -> None:
        pass


def stream_bars_on_next_trade(log: DataFrame, seconds: int) -> DataFrame:
    f = M.fills(log).select("symbol_id", *M.SEQ, "timestamp_ns", "price_ticks", "qty")
    schema = "symbol_id int, open_ns long, open_ticks long, high_ticks long, low_ticks long, close_ticks long, volume long, trades long"
    return f.groupBy("symbol_id").transformWithStateInPandas(BarOnNextTrade(seconds * B.NS), schema, "Append", "None")


class Kept:
    """A map state for the time of one call: each key is read once and written once."""

    def __init__(self, state):
        self.state, self.now, self.changed = state, {}, set()

    def get(self, key: tuple):
        if key not in self.now:
            self.now[key] = tuple(self.state.getValue(key)) if self.state.containsKey(key) else None
        return self.now[key]

    def put(self, key: tuple, value) -> None:
        """A value of None takes the key away."""
        self.now[key] = value
        self.changed.add(key)

    def write(self) -> None:
        for key in self.changed:
            if self.now[key] is not None:
                self.state.updateValue(key, self.now[key])
            elif self.state.containsKey(key):
                self.state.removeKey(key)


def order_moves(records, orders: Kept):
    """(time, seq_ord, [(order's value, change of what rests)]) of each record in order; `orders` holds (user, side, price, rest) of live orders."""
    cols = ["timestamp_ns", "seq_ord", "event_type", "a", "b", "user_id", "side", "price_ticks", "qty"]
    for at, seq, kind, a, b, user, side, price, qty in zip(*[records[c].tolist() for c in cols], strict=True):
        moves = []
        if kind == "accept":
            order = (int(user), int(side), int(price), int(qty))
            orders.put((int(a),), order)
            moves.append((order, int(qty)))
        else:
            for o in (a, b) if kind == "fill" else (a,):
                order = None if o is None or o != o else orders.get((int(o),))
                if order is None:
                    continue
                off = order[3] if kind == "cancel" else min(order[3], int(qty))
                left = order[3] - off
                orders.put((int(o),), (*order[:3], left) if left else None)
                moves.append((order, -off))
        yield int(at), int(seq), moves


def level_moves(records, orders: Kept, levels: Kept):
    """(time, seq_ord, side, price, quantity after it) of each level that a record changes."""
    for at, seq, moves in order_moves(records, orders):
        moved: dict = {}
        for (_, side, price, _), d in moves:
            moved[side, price] = moved.get((side, price), 0) + d
        for key, d in moved.items():
            if d:
                before = levels.get(key)
                now = (before[0] if before else 0) + d
                levels.put(key, (now,) if now else None)
                yield at, seq, *key, now


class BookBySymbol(StatefulProcessor):
    """Live orders and level quantities of a symbol, for processors that watch its whole book."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.orders = handle.getMapState("orders", "order_id long", "user long, side int, price long, rem long")
        self.levels = handle.getMapState("levels", "side int, price long", "qty long")

    def moves(self, rows: Iterator):
        import pandas as pd

        orders, levels = Kept(self.orders), Kept(self.levels)
        yield from level_moves(pd.concat(list(rows)).sort_values(["seq_ms", "seq_ord"]), orders, levels)
        orders.write()
        levels.write()

    def close(self) -> None:
        pass


class ConflatedBook(BookBySymbol):
    """The book with what has moved since the last tick: a tick's levels are handed on when a later one begins or its time is over."""

    def __init__(self, tick_ns: int):
        self.tick = tick_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "tick long")
        self.moved = handle.getMapState("moved", "side int, price long", "qty long, seq long")

    def table(self, out):
        import pandas as pd

        return pd.DataFrame(out, columns=["symbol_id", "side", "price_ticks", "window_ns", "qty", "seq_ord"]).astype({"symbol_id": "int32", "side": "int32", "price_ticks": "int64", "window_ns": "int64", "qty": "int64", "seq_ord": "int64"})

    def handleInputRows(self, key, rows: Iterator, timer_values) -> Iterator:
        tick = self.open.get()[0] if self.open.exists() else None
        before = tick
        moved = {tuple(k): tuple(v) for k, v in self.moved.iterator()} if tick is not None else {}
        out = []
        for at, seq, side, price, qty in self.moves(rows):
            if tick is not None and at - at % self.tick != tick:
                out += [(key[0], *k, tick, *v) for k, v in moved.items()]
                moved = {}
            tick = at - at % self.tick
            moved[side, price] = (qty, seq)
        if tick != before:
            if before is not None:
                self.handle.deleteTimer(self.over(before))
            self.open.update((tick,))
            self.handle.registerTimer(self.over(tick))
        self.moved.clear()
        for k, v in moved.items():
            self.moved.updateValue(k, v)
        yield self.table(out)

    def over(self, tick: int) -> int:
        """Milliseconds of event time at which a tick has ended."""
        return -(-(tick + self.tick) // 1_000_000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        tick = self.open.get()[0] if self.open.exists() else None
        out = [] if tick is None else [(key[0], *k, tick, *v) for k, v in self.moved.iterator()]
        self.open.clear()
        self.moved.clear()
        yield self.table(out)


class MakerQuotes(StatefulProcessor):
    """Makers' live orders of a symbol; emits each maker's best quote for as long as it stood, in steps.

    A step has the quote after its last record. A quote that still stands is
    handed on up to the end of each archive unit that is over.
    """

    COLUMNS = ["user_id", "symbol_id", "from_ns", "to_ns", "bid", "bid_qty", "ask", "ask_qty"]

    def __init__(self, step_ns: int, unit_ns: int):
        self.step, self.unit = step_ns, unit_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.orders = handle.getMapState("orders", "order_id long", "user long, side int, price long, rem long")
        self.levels = handle.getMapState("levels", "user long, side int, price long", "qty long")
        self.quotes = handle.getMapState("quotes", "user long", "since long, bid long, bid_qty long, ask long, ask_qty long")
        self.timer = handle.getValueState("timer", "at long")

    def table(self, out):
        import pandas as pd

        return pd.DataFrame(out, columns=self.COLUMNS).astype({c: "Int64" for c in self.COLUMNS} | {"symbol_id": "int32"})

    def handleInputRows(self, key, rows: Iterator, timer_values) -> Iterator:
        import pandas as pd

        orders, levels, quotes = Kept(self.orders), Kept(self.levels), Kept(self.quotes)
        books: dict = {}
        for (user, side, price), (qty,) in self.levels.iterator():
            books.setdefault(user, (SideOfBook(-1), SideOfBook(1)))[side - 1].put(price, qty)
        out, touched, step = [], set(), None

        def settle() -> None:
            """The step that has ended."""
            for user in touched:
                bid, ask = (s.best(1) or ((None, None),) for s in books[user])
                now, was = (*bid[0], *ask[0]), quotes.get((user,))
                if was is None or now != was[1:]:
                    if was is not None and was[0] < step:
                        out.append((user, key[0], was[0], step, *was[1:]))
                    quotes.put((user,), (step, *now) if any(x is not None for x in now) else None)
            touched.clear()

        for at, _, moves in order_moves(pd.concat(list(rows)).sort_values(["seq_ms", "seq_ord"]), orders):
            if at - at % self.step != step:
                if step is not None:
                    settle()
                step = at - at % self.step
            for (user, side, price, _), d in moves:
                before = levels.get((user, side, price))
                now = (before[0] if before else 0) + d
                levels.put((user, side, price), (now,) if now else None)
                books.setdefault(user, (SideOfBook(-1), SideOfBook(1)))[side - 1].put(price, now)
                touched.add(user)
        if step is not None:
            settle()
        for state in (orders, levels, quotes):
            state.write()
        if not self.timer.exists() and step is not None:
            self.wake(step)
        yield self.table(out)

    def wake(self, after: int) -> None:
        at = (after - after % self.unit + self.unit) // 1_000_000
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now = timerValues.getCurrentWatermarkInMs() * 1_000_000
        end = now - now % self.unit
        out = []
        for (user,), quote in list(self.quotes.iterator()):
            if quote[0] < end:
                out.append((user, key[0], quote[0], end, *quote[1:]))
                self.quotes.updateValue((user,), (end, *quote[1:]))
        self.wake(end)
        yield self.table(out)

    def close(self) -> None:
        pass


def book_records(log: DataFrame, *more: str) -> DataFrame:
    """Accepts, fills and cancels of the log in one shape."""
    k = F.col("k")
    kind = F.expr("case event_type when 'view' then 'accept' when 'click' then 'accept' when 'purchase' then 'fill' when 'error' then 'cancel' end")
    a = F.when(kind == "accept", F.col("seq_ord")).when(kind == "fill", F.col("seq_ord") - 10 * (1 + k % 50)).otherwise(F.col("seq_ord") - 10 * (1 + k % 20))
    b = F.when(kind == "fill", F.col("seq_ord") - 10 * (1 + (k + 7) % 50))
    qty = F.when(kind == "fill", 1 + k % 20).otherwise(1 + k)
    side = F.when(F.col("event_type") == "view", 1).otherwise(2)
    return log.where("event_type <> 'signup'").select("symbol_id", *M.SEQ, "timestamp_ns", kind.alias("event_type"), a.alias("a"), b.alias("b"), "user_id", side.alias("side"), "price_ticks", qty.alias("qty"), *more)


class OrderMoves(StatefulProcessor):
    """Live orders of one slot of a symbol; emits what each record takes off or adds to a level."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.orders = handle.getMapState("orders", "order_id long", "user long, side int, price long, rem long")

    def handleInputRows(self, key, rows: Iterator, timer_values) -> Iterator:
        import pandas as pd

        orders = Kept(self.orders)
        records = pd.concat(list(rows)).sort_values(["seq_ms", "seq_ord"])
        out = [(key[0], order[1], order[2], at, seq, d) for at, seq, moves in order_moves(records, orders) for order, d in moves]
        orders.write()
        yield pd.DataFrame(out, columns=["symbol_id", "side", "price_ticks", "timestamp_ns", "seq_ord", "delta"])

    def close(self) -> None:
        pass


class LevelTotals(StatefulProcessor):
    """Quantities of one slot of a symbol's price levels; emits each level after a record that changes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side int, price long", "qty long")

    def handleInputRows(self, key, rows: Iterator, timer_values) -> Iterator:
        import pandas as pd

        levels, out = Kept(self.levels), []
        moves = pd.concat(list(rows)).groupby(["timestamp_ns", "seq_ord", "side", "price_ticks"], as_index=False)["delta"].sum()  # sorted by its keys
        for _, seq, side, price, d in zip(*[moves[c].tolist() for c in moves.columns], strict=True):
            if d:
                before = levels.get((side, price))
                now = (before[0] if before else 0) + d
                levels.put((side, price), (now,) if now else None)
                out.append((key[0], side, price, seq, now))
        levels.write()
        yield pd.DataFrame(out, columns=["symbol_id", "side", "price_ticks", "seq_ord", "qty"])

    def close(self) -> None:
        pass


def stream_book(log: DataFrame, slots: int = 2) -> DataFrame:
    """Each level after a record that changes it. Two stateful steps: orders are keyed by symbol and a slot of their id, levels by symbol and a slot of their price, so `slots` divide a symbol's work."""
    slot = lambda c: F.pmod(F.col(c), F.lit(slots)).cast("int")
    legs = book_records(log).withColumn("a", F.explode(F.array_compact(F.array("a", "b")))).withColumn("b", F.lit(None).cast("long")).withColumn("slot", slot("a"))
    moved = "symbol_id int, side int, price_ticks long, timestamp_ns long, seq_ord long, delta long"
    moves = legs.groupBy("symbol_id", "slot").transformWithStateInPandas(OrderMoves(), moved, "Append", "None")
    schema = "symbol_id int, side int, price_ticks long, seq_ord long, qty long"
    return moves.withColumn("slot", slot("price_ticks")).groupBy("symbol_id", "slot").transformWithStateInPandas(LevelTotals(), schema, "Append", "None")


def stream_conflated(log: DataFrame, tick_ns: int, delay: str = "1 second") -> DataFrame:
    """(symbol_id, side, price_ticks, window_ns, qty, seq_ord): per tick of event time the last quantity of the levels that moved in it."""
    records = book_records(log, "event_time").withWatermark("event_time", delay)
    schema = "symbol_id int, side int, price_ticks long, window_ns long, qty long, seq_ord long"
    return records.groupBy("symbol_id").transformWithStateInPandas(ConflatedBook(tick_ns), schema, "Append", "EventTime")


def stream_quotes(log: DataFrame, makers_below: int, step_ns: int, unit_ns: int, delay: str = "1 second") -> DataFrame:
    """(user_id, symbol_id, from_ns, to_ns, bid, bid_qty, ask, ask_qty): how long each maker's best quote stood, up to the units that are over."""
    records = book_records(log, "event_time").where((F.col("event_type") != "accept") | (F.col("user_id") < makers_below)).withWatermark("event_time", delay)
    schema = "user_id long, symbol_id int, from_ns long, to_ns long, bid long, bid_qty long, ask long, ask_qty long"
    return records.groupBy("symbol_id").transformWithStateInPandas(MakerQuotes(step_ns, unit_ns), schema, "Append", "EventTime")


class Numbered(StatefulProcessor):
    """A dense number per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n long")

    def handleInputRows(self, key, rows: Iterator, timer_values) -> Iterator:
        import pandas as pd

        x = pd.concat(list(rows)).sort_values(["seq_ms", "seq_ord"])
        n = self.n.get()[0] if self.n.exists() else 0
        self.n.update((n + len(x),))
        yield pd.DataFrame({"user_id": x["user_id"], "user_seq": range(n + 1, n + len(x) + 1), "seq_ord": x["seq_ord"], "event_type": x["event_type"]})

    def close(self) -> None:
        pass


def stream_private(log: DataFrame) -> DataFrame:
    """Every record of a user's own with a dense number."""
    x = log.select("user_id", *M.SEQ, "event_type")
    return x.groupBy("user_id").transformWithStateInPandas(Numbered(), "user_id long, user_seq long, seq_ord long, event_type string", "Append", "None")


class Verdicts(StatefulProcessor):
    """The verdict on each frame against the one before on its channel."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "a long, b long")

    def handleInputRows(self, key, rows: Iterator, timer_values) -> Iterator:
        import pandas as pd

        x = pd.concat(list(rows)).sort_values("arrival")
        was = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for at, private, a, b in zip(x["arrival"].tolist(), x["private"].tolist(), x["seq_a"].tolist(), x["seq_b"].tolist(), strict=True):
            now = (a, b)
            v = "ok" if was is None else "duplicate" if now == was else "out_of_order" if now < was else "gap" if private and b > was[1] + 1 else "ok"
            out.append((key[0], at, v))
            was = now
        self.last.update(was)
        yield pd.DataFrame(out, columns=["channel", "arrival", "verdict"])

    def close(self) -> None:
        pass


def stream_gaps(frames: DataFrame) -> DataFrame:
    return frames.groupBy("channel").transformWithStateInPandas(Verdicts(), "channel string, arrival long, verdict string", "Append", "None")


class FirstOutcome(StatefulProcessor):
    """The times of kept submissions of a slot of keys, as columns; one call and one value serve all keys of the slot.

    What is past its TTL goes when rows of the slot come, and all of it when
    its last one is past it.
    """

    def __init__(self, ttl_ns: int):
        self.ttl = ttl_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "user_id array<long>, client_order_id array<long>, kept array<long>")

    def expiry(self, kept: int) -> int:
        """Milliseconds of event time, rounded up, at which nothing falls under the TTL any more."""
        return -(-(kept + self.ttl) // 1_000_000)

    def handleInputRows(self, key, rows: Iterator, timer_values) -> Iterator:
        import pandas as pd

        x = pd.concat(list(rows)).sort_values(["timestamp_ns", "seq_ord"])
        users, ids, times = self.kept.get() if self.kept.exists() else ((), (), ())
        kept = {(u, c): t for u, c, t in zip(users, ids, times, strict=True)}
        before, flags = max(times, default=None), []
        for u, c, t in zip(x["user_id"].tolist(), x["client_order_id"].tolist(), x["timestamp_ns"].tolist(), strict=True):
            since = kept.get((u, c))
            dup = since is not None and t - since < self.ttl
            if not dup:
                kept[u, c] = t
            flags.append(dup)
        passed = timer_values.getCurrentWatermarkInMs()  # rows of later batches are not behind it
        left = [(u, c, t) for (u, c), t in kept.items() if self.expiry(t) > passed]
        last = max((t for _, _, t in left), default=None)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self.expiry(before))
            if last is not None:
                self.handle.registerTimer(self.expiry(last))
        if left:
            self.kept.update(tuple(list(c) for c in zip(*left, strict=True)))
        else:
            self.kept.clear()
        _, no_user, no_id = key
        yield pd.DataFrame({"user_id": None if no_user else x["user_id"], "client_order_id": None if no_id else x["client_order_id"], "seq_ord": x["seq_ord"], "duplicate": flags})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        self.kept.clear()
        yield pd.DataFrame({"user_id": [], "client_order_id": [], "seq_ord": [], "duplicate": []}).astype({"user_id": "int64", "client_order_id": "int64", "seq_ord": "int64", "duplicate": "bool"})

    def close(self) -> None:
        pass


def stream_dedupe(orders: DataFrame, ttl_ns: int, delay: str = "0 seconds", slots: int = 512) -> DataFrame:
    """(user_id, client_order_id, seq_ord, duplicate) of each submission, by the rule of the batch operator `first_outcomes`.

    The TTL counts in the submissions' own time from the kept one. Keys are
    dealt over `slots`, so a batch costs calls and state reads by slot, not by
    key; keys with a null are apart from others. Keys that the watermark has passed by their TTL are dropped; rows
    behind the watermark are late and are dropped.
    """
    slot = F.pmod(F.xxhash64("user_id", "client_order_id"), F.lit(slots)).cast("int").alias("slot")
    known = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("user_id", "client_order_id")]  # beside a null, pandas would have floats
    x = orders.select(slot, F.isnull("user_id").alias("no_user"), F.isnull("client_order_id").alias("no_id"), *known, "seq_ord", "timestamp_ns", "event_time").withWatermark("event_time", delay)
    schema = "user_id long, client_order_id long, seq_ord long, duplicate boolean"
    return x.groupBy("slot", "no_user", "no_id").transformWithStateInPandas(FirstOutcome(ttl_ns), schema, "Append", "EventTime")


def stream_uptime(quotes: DataFrame, min_size: int, emit: Callable[[DataFrame, int], None], folder: str):
    """Running steps with a quote of both sides, and of those the ones of full size, per maker and symbol; handed on as they change. `quotes` have `steps`."""
    two = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    full = (F.col("bid_qty") >= min_size) & (F.col("ask_qty") >= min_size)
    g = quotes.where(two).groupBy("user_id", "symbol_id").agg(F.sum("steps").alias("quoted"), F.sum(F.when(full, F.col("steps")).otherwise(0)).alias("full_size"))
    return g.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


class SealedArchive:
    """Trades of sealed units, written once each, and a count of the rows that came too late.

    A batch merges the first record of each unit into a table of one row a
    unit, from which follows what is sealed and by which record. Its rows are
    late if their unit was sealed before them; the others are staged by unit.
    Units that this batch has sealed are written from the stage, under names
    that follow from the data. All tables of a batch carry its number, so one
    that runs again, also after a stop in its middle, leaves the same files.
    """

    UNITS = "unit_ns long, first struct<seq_ms: long, seq_ord: long>"

    def __init__(self, spark: SparkSession, symbols: DataFrame, folder: str, unit_seconds: int):
        self.spark, self.symbols, self.folder, self.unit = spark, symbols, folder, unit_seconds

    def units(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.UNITS).parquet(f"{self.folder}/units/v={version}") if version >= 0 else self.spark.createDataFrame([], self.UNITS)

    def apply(self, log: DataFrame, version: int) -> None:
        from tickloom.functions.ticks import bucket
        from tickloom.sources.sinks import archive_write

        rows = log.withColumn("unit_ns", bucket("timestamp_ns", self.unit * B.NS))
        old = self.units(version - 1)
        mine = rows.groupBy("unit_ns").agg(F.min(F.struct(*M.SEQ)).alias("first"))
        old.unionByName(mine).groupBy("unit_ns").agg(F.min("first").alias("first")).write.mode("overwrite").parquet(f"{self.folder}/units/v={version}")
        seals = B.seals_of(self.units(version), self.unit)
        judged = rows.join(seals, "unit_ns", "left").withColumn("late", F.coalesce(F.struct(*M.SEQ) > F.col("seal"), F.lit(False)))
        judged.where("late").groupBy("unit_ns").agg(F.count("*").alias("late")).write.mode("overwrite").parquet(f"{self.folder}/late/v={version}")
        trades = M.fills(judged.where("not late")).select("symbol_id", *M.SEQ, "price_ticks", "qty", "aggressor_side", "timestamp_ns")
        trades.withColumn("unit_ns", bucket("timestamp_ns", self.unit * B.NS)).write.mode("overwrite").partitionBy("unit_ns").parquet(f"{self.folder}/stage/v={version}")
        now = seals.select("unit_ns").join(B.seals_of(old, self.unit), "unit_ns", "left_anti")
        stage = self.spark.read.schema("symbol_id int, seq_ms long, seq_ord long, price_ticks long, qty long, aggressor_side int, timestamp_ns long, v int, unit_ns long").parquet(f"{self.folder}/stage")
        done = stage.where(F.col("v") <= version).join(now, "unit_ns", "left_semi").drop("v", "unit_ns")
        archive_write(done, self.symbols, f"{self.folder}/trades", "timestamp_ns", self.unit * B.NS)

    def late(self) -> DataFrame:
        return self.spark.read.schema("unit_ns long, late long, v int").parquet(f"{self.folder}/late").groupBy("unit_ns").agg(F.sum("late").alias("late"))


def stream_archive(log: DataFrame, archive: SealedArchive):
    return log.writeStream.foreachBatch(archive.apply).option("checkpointLocation", f"{archive.folder}/state").trigger(availableNow=True).start()


def stream_decode(wire: DataFrame, folder: str):
    """One source of binary records, two sinks: typed records, and those that can't be read with the reason."""
    from tickloom.sources.ingest import decode_wire_log

    def batch(df: DataFrame, n: int) -> None:
        df = df.persist()
        try:
            for part, name in zip(decode_wire_log(df), ("records", "quarantine"), strict=True):
                part.write.mode("overwrite").parquet(f"{folder}/{name}/v={n}")
        finally:
            df.unpersist()

    return wire.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()

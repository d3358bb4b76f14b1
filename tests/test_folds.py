"""Windows and aggregates against plain folds of the rules over random logs."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import backtest as G
from tickloom.operators import bars as B
from tickloom.operators import book as K
from tickloom.operators import intervals as V
from tickloom.operators import ledger as L
from tickloom.operators import quality as Q
from tickloom.operators import risk as R
from tickloom.sources import market as M

ACC = "seq_ms long, seq_ord long, timestamp_ns long, symbol_id int, user_id long, order_id long, client_order_id long, side int, price_ticks long, qty long"
FILL = "seq_ms long, seq_ord long, timestamp_ns long, symbol_id int, price_ticks long, qty long, aggressor_side int, maker_order_id long, taker_order_id long, maker_user_id long, taker_user_id long"
CAN = "seq_ms long, seq_ord long, timestamp_ns long, symbol_id int, user_id long, order_id long, remaining_qty long, reason int"


def random_log(seed, n=300):
    r, acc, fil, can, log = random.Random(seed), [], [], [], []
    for i in range(1, n):
        ms, ns, s = 1000 + i // 3, i * 1_000_000_000 + r.randrange(1000), r.randint(1, 2)
        kind = r.random()
        if kind < 0.5:
            x = (ms, i, ns, s, r.randint(1, 5), i, i, r.randint(1, 2), r.randint(90, 110), r.randint(1, 20))
            acc.append(x)
            log.append(("a", x))
        elif kind < 0.8:
            x = (ms, i, ns, s, r.randint(90, 110), r.randint(1, 9), r.randint(1, 2), r.randint(1, i), r.randint(1, i), r.randint(1, 5), r.randint(1, 5))
            fil.append(x)
            log.append(("f", x))
        else:
            x = (ms, i, ns, s, r.randint(1, 5), r.randint(1, i), r.randint(1, 9), 1)
            can.append(x)
            log.append(("c", x))
    return acc, fil, can, log


def frames(spark, seed):
    acc, fil, can, log = random_log(seed)
    return spark.createDataFrame(acc, ACC), spark.createDataFrame(fil, FILL), spark.createDataFrame(can, CAN), log


def fold_book(log):
    """Live orders by id: [symbol, side, price, rest, arrival]; yields after each record."""
    live = {}
    for kind, x in log:
        if kind == "a":
            live[x[5]] = [x[3], x[7], x[8], x[9], x[1]]
        elif kind == "f":
            for o in (x[7], x[8]):
                if o in live:
                    live[o][3] -= x[5]
                    if live[o][3] <= 0:
                        del live[o]
        else:
            live.pop(x[5], None)
        yield kind, x, live


@pytest.mark.parametrize("seed", [1, 2])
def test_book(spark, seed):
    a, f, c, log = frames(spark, seed)
    for _, _, live in fold_book(log):
        pass
    events = K.order_events(a, f, c)
    got = {r["order_id"]: r["rem"] for r in K.resting_orders(events).collect()}
    assert got == {o: v[3] for o, v in live.items()}
    levels = {}
    for v in live.values():
        levels[tuple(v[:3])] = levels.get(tuple(v[:3]), 0) + v[3]
    ours = {(r["symbol_id"], r["side"], r["price_ticks"]): r["qty"] for r in K.book_levels(K.resting_orders(events)).collect()}
    assert ours == levels
    last = {(r["symbol_id"], r["side"], r["price_ticks"]): r["qty"] for r in K.level_changes(K.order_states(events)).orderBy("seq_ms", "seq_ord").collect()}
    assert {k: v for k, v in last.items() if v} == levels
    assert all(r["difference"] == 0 for r in K.conservation(events).collect())


@pytest.mark.parametrize("parity", [False, True])
def test_snapshots(spark, parity):
    """Every covered second against a fold, laid out from the intervals; with parity as the archive had it."""
    a, f, c, log = frames(spark, 3)
    log = [x for x in log if x[1][2] // B.NS % 50 > 6 and not 100 < x[1][2] // B.NS < 150]  # units that begin quietly, and one without a record
    keep = (F.col("timestamp_ns") / B.NS % 50 >= 7) & ~F.col("timestamp_ns").between(100 * B.NS, 150 * B.NS)
    a, f, c = (x.where(keep) for x in (a, f, c))
    log = [x for x in log if x[1][2] // B.NS % 50 >= 7]
    second, unit = B.NS, 50 * B.NS
    allrows = a.select("timestamp_ns").union(f.select("timestamp_ns")).union(c.select("timestamp_ns"))
    units = V.covered_units(allrows, second, unit)
    iv = V.book_intervals(K.level_changes(K.order_states(K.order_events(a, f, c))), units, second, unit, 3, parity=parity)
    ours, states = {}, {}
    for r in V.laid_out(iv, "symbol_id").collect():
        assert r["steps"] == (r["to_ns"] - r["from_ns"]) // second > 0
        for s in range(r["from_ns"], r["to_ns"], second):
            assert (s, r["symbol_id"], r["side"], r["level"]) not in ours
            ours[s, r["symbol_id"], r["side"], r["level"]] = (r["price_ticks"], r["qty"])
    want = {}
    for u in units.collect():
        for s in range(u["unit_ns"], u["unit_ns"] + unit, second):
            upto = max(s, u["first_active_ns"]) if parity else s
            live = {}
            for _, _, live in fold_book([x for x in log if x[1][2] < upto + second]):
                pass
            levels = {}
            for v in live.values():
                levels[tuple(v[:3])] = levels.get(tuple(v[:3]), 0) + v[3]
            for sym in (1, 2):
                for side in (1, 2):
                    p = sorted((k[2] for k in levels if k[:2] == (sym, side)), reverse=side == 1)[:3]
                    want |= {(s, sym, side, i): (x, levels[sym, side, x]) for i, x in enumerate(p)}
    assert ours == want
    # neighbours in a unit differ
    for r in iv.orderBy("symbol_id", "from_ns").collect():
        was = states.get((r["symbol_id"], r["unit_ns"]))
        assert was is None or was[0] < r["from_ns"] or was[1] != (r["bids"], r["asks"])
        states[r["symbol_id"], r["unit_ns"]] = (r["to_ns"], (r["bids"], r["asks"]))


def test_obligations_by_second(spark):
    """Breach seconds of each maker and symbol, and their share of a load step, against a count second by second."""
    a, f, c, log = frames(spark, 8)
    second, unit, key = B.NS, 50 * B.NS, ("user_id", "symbol_id")
    units = V.covered_units(a.select("timestamp_ns").union(f.select("timestamp_ns")).union(c.select("timestamp_ns")), second, unit)
    states = K.order_states(K.order_events(a, f, c)).where("user_id < 3")
    quotes = V.best_quotes(V.book_intervals(K.level_changes(states, *key), units, second, unit, 1, key))
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (77, 1)], "user_id long, symbol_id int")
    ob = V.obligation_intervals(quotes, pairs, units, second, unit, 300, 8)
    want = {}
    for u in sorted(x["unit_ns"] for x in units.collect()):
        for s in range(u, u + unit, second):
            live = {}
            for _, _, live in fold_book([x for x in log if x[1][2] < s + second]):
                pass
            owner = {x[1][5]: x[1][4] for x in log if x[0] == "a"}
            for user, sym in [(1, 1), (1, 2), (2, 1), (2, 2), (77, 1)]:
                side = lambda n: [(v[2], v[3]) for o, v in live.items() if owner[o] == user and v[0] == sym and v[1] == n]  # noqa: B023, E731
                bids, asks = side(1), side(2)
                kinds = []
                if not bids or not asks:
                    kinds.append("not_two_sided")
                else:
                    bid, ask = max(bids)[0], min(asks)[0]
                    if (ask + bid) // 2 > 0 and (ask - bid) * 10_000 // ((ask + bid) // 2) > 300:
                        kinds.append("spread_too_wide")
                    kinds += ["size_too_small"] * sum(sum(q for p, q in x if p == best) < 8 for x, best in ((bids, bid), (asks, ask)))
                for k in kinds:
                    want.setdefault((user, sym, k), []).append(s)
    got = {tuple(r)[:3]: r["n"] for r in Q.breach_rows(ob).groupBy("user_id", "symbol_id", "kind").agg(F.sum("steps").alias("n")).collect()}
    assert got == {k: len(v) for k, v in want.items()}
    steps = spark.createDataFrame([(0, 30 * second + 5, 90 * second), (1, 0, 20 * second - 1), (2, 10_000 * second, 20_000 * second)], "step long, began long, ended long")
    cut = V.within(Q.breach_rows(ob, "at"), steps, units, second, unit)
    got = {tuple(r)[:4]: r["n"] for r in cut.groupBy("step", "user_id", "symbol_id", "kind").agg(F.sum("steps").alias("n")).collect()}
    assert got == {(n, *k): m for n, lo, hi in ((0, 31 * second, 90 * second), (1, 0, 19 * second)) for k, v in want.items() if (m := sum(lo <= s <= hi for s in v))}


@pytest.mark.parametrize("bins", [2, 1024])
def test_nearest_rank(spark, bins):
    r = random.Random(6)
    rows = [(g, v, r.randint(1, 3)) for g, n in (("a", 500), ("b", 1), ("c", 40)) for v in [int(r.paretovariate(0.3)) % 10**15 for _ in range(n)]] + [("a", None, 1), ("c", -5, 2)]
    df = spark.createDataFrame(rows, "g string, v long, w long")
    q = {"q0": 0.0, "q5": 0.5, "q9": 0.99, "q1": 1.0}
    for weight in (None, "w"):
        got = {x["g"]: x for x in Q.nearest_rank(df, "v", ["g"], q, weight, bins=bins).collect()}
        for g in "abc":
            x = sorted(v for h, v, w in rows if h == g and v is not None for _ in range(w if weight else 1))
            assert (got[g]["n"], got[g]["least"], got[g]["greatest"]) == (len(x), x[0], x[-1])
            assert all(got[g][name] == x[min(int(p * len(x)), len(x) - 1)] for name, p in q.items())
    x = sorted(v / 7 for _, v, _ in rows if v is not None)
    assert Q.nearest_rank(df.withColumn("v", F.col("v") / 7), "v", [], {"q": 0.3}, bins=bins).first()["q"] == x[int(0.3 * len(x))]


def test_joins_by_range(spark):
    """As-of joins and numbering whose ranges hold a few rows give what one sort gives."""
    r = random.Random(2)
    left = [(i, r.randint(1, 2), i * 10, i) for i in range(1, 200) if r.random() < 0.5]
    right = [(i, r.randint(1, 2), i * 10, i) for i in range(1, 200) if r.random() < 0.1]
    cols = "v long, s long, seq_ms long, seq_ord long"
    for strict in (True, False):
        got = K.as_of(spark.createDataFrame(left, cols).drop("v"), spark.createDataFrame(right, cols), "s", ["v"], strict, 70).collect()
        want = {x[3]: max((y[0] for y in right if y[1] == x[1] and (y[3] < x[3] or not strict and y[3] == x[3])), default=None) for x in left}
        assert {x["seq_ord"]: x["v"] for x in got} == want
    orders = spark.createDataFrame([(s, n, n) for _, s, _, n in left], "symbol_id long, seq_ord long, stamped_ns long")
    seen = spark.createDataFrame([(s, n, n + 5) for _, s, _, n in right], "symbol_id long, frame_seq long, arrival_ns long")
    want = {n: min((y[3] for y in right if y[1] == s and y[3] >= n), default=None) for _, s, _, n in left}
    assert {x["seq_ord"]: x["frame_seq"] for x in Q.next_frame(orders, seen, 13).collect()} == want
    rows = spark.createDataFrame(left, cols)
    got = {x["seq_ord"]: x["n"] for x in M.numbered(rows, "s", "n", 9).collect()}
    assert got == {x[3]: sum(y[1] == x[1] and y[3] < x[3] for y in left) for x in left}


def test_price_time(spark):
    a, f, c, log = frames(spark, 5)
    want, live = set(), {}
    takers = {}
    for kind, x in log:
        if kind == "a":
            takers[x[5]] = x
        if kind == "f" and x[8] in takers:
            t = takers[x[8]]
            fit = [(o, v) for o, v in live.items() if v[0] == t[3] and v[1] != t[7] and (v[2] <= t[8] if t[7] == 1 else v[2] >= t[8])]
            if fit:
                best = min(fit, key=lambda z: (z[1][2] if t[7] == 1 else -z[1][2], z[1][4]))[0]
                if best != x[7]:
                    want.add((x[1], x[7], best))
        for _ in fold_one(live, kind, x):
            pass
    for slice_ns in (40 * B.NS, 3 * B.NS, 86_400 * B.NS):
        got = {(r["seq_ord"], r["maker_order_id"], r["better_order_id"]) for r in K.audit_price_time(a, f, c, slice_ns).collect()}
        assert got == want and want


def fold_one(live, kind, x):
    if kind == "a":
        live[x[5]] = [x[3], x[7], x[8], x[9], x[1]]
    elif kind == "f":
        for o in (x[7], x[8]):
            if o in live:
                live[o][3] -= x[5]
                if live[o][3] <= 0:
                    del live[o]
    else:
        live.pop(x[5], None)
    yield live


def test_ledger(spark):
    a, f, c, log = frames(spark, 7)
    cash, pos, fees = {}, {}, 0
    for kind, x in log:
        if kind != "f":
            continue
        n = x[4] * x[5]
        for user, side, bps in ((x[9], 3 - x[6], 2), (x[10], x[6], 10)):
            fee = n * bps // 10000
            fees += fee
            cash[user] = cash.get(user, 0) + (-n if side == 1 else n) - fee
            pos[user, x[3]] = pos.get((user, x[3]), 0) + (x[5] if side == 1 else -x[5])
    legs = L.fill_legs(f)
    none = spark.createDataFrame([], "user_id long, seq_ms long, seq_ord long, timestamp_ns long, created boolean, amount_ticks long")
    assert {r["user_id"]: r["cash_ticks"] for r in L.cash_balances(L.cash_events(none, legs)).collect()} == cash
    assert {(r["user_id"], r["symbol_id"]): r["position"] for r in L.positions(legs).collect()} == {k: v for k, v in pos.items() if v}
    assert L.fees(f).agg(F.sum("total_fee")).first()[0] == fees


def test_created_resets_cash(spark):
    acc = spark.createDataFrame([(1, 10, 1, 0, True, 100), (1, 11, 2, 0, False, 5), (1, 12, 3, 0, True, 50), (1, 13, 4, 0, False, 7), (2, 9, 1, 0, False, 3)], "user_id long, seq_ms long, seq_ord long, timestamp_ns long, created boolean, amount_ticks long")
    e = L.cash_events(acc, L.fill_legs(spark.createDataFrame([], FILL)))
    assert {r["user_id"]: r["cash_ticks"] for r in L.cash_balances(e).collect()} == {1: 57, 2: 3}
    h = [r["balance"] for r in L.cash_history(e).where("user_id = 1").orderBy("seq_ord").collect()]
    assert h == [100, 105, 50, 57]


def test_late_rows(spark):
    r = random.Random(9)
    times = [max(0, i + r.choice([0, 0, 0, -15, -25, 30])) for i in range(200)]
    opened, sealed, late = set(), -1, set()
    for i, t in enumerate(times):
        u = t // 10
        if u > sealed:
            opened.add(u)
        if u not in opened or u <= sealed:
            late.add(i)
        if u > sealed:
            gone = {x for x in opened if x < u}
            sealed = max([sealed, *gone])
            opened -= gone
    log = spark.createDataFrame([(0, i, t * B.NS) for i, t in enumerate(times)], "seq_ms long, seq_ord long, timestamp_ns long")
    assert {x["seq_ord"] for x in B.late_rows(log, 10).collect()} == late
    first = log.groupBy((F.floor(F.col("timestamp_ns") / (10 * B.NS)) * 10 * B.NS).alias("unit_ns")).agg(F.min(F.struct("seq_ms", "seq_ord")).alias("first"))
    whole = {(x["unit_ns"], x["least"]) for x in B.over_units(first, "first", "least", True, True, 1000, 10 * B.NS).collect()}
    assert whole == {(x["unit_ns"], x["least"]) for x in B.over_units(first, "first", "least", True, True, 2, 10 * B.NS).collect()}


def test_rate_limit(spark):
    r, rows, want, state = random.Random(4), [], {}, {}
    for i in range(200):
        rows.append((r.randint(1, 3), i, i, i * 150_000_000 + r.randrange(10**8)))
    for u, _, i, t in rows:
        tokens, last = state.get(u, (3.0, t))
        tokens = min(3.0, tokens + (t - last) / 1e9 * 3.0)
        want[i] = tokens >= 1
        state[u] = (tokens - want[i], t)
    df = spark.createDataFrame(rows, "user_id long, client_order_id long, seq_ord long, timestamp_ns long")
    assert {x["seq_ord"]: x["allowed"] for x in R.rate_limited(df, 3.0).collect()} == want


def test_user_strategy(spark):
    class EveryOther:
        """Buys two on even bars, sells one and far too many on odd ones."""

        def on_bar(self, bar, cash, position):
            return [(1, 2)] if bar.index % 2 == 0 else [(2, 1), (2, 100)]

    bars = spark.createDataFrame([(1, 1, i, 100 + i, 101 + i, None, 1, 450, i) for i in range(6)], "run_id long, symbol_id int, bar_index long, open_ticks long, close_ticks long, long boolean, qty long, initial_cash long, bar_no int")
    out = G.run_backtests(bars, lambda qty: EveryOther())
    trades = [(r["bar_index"], r["side"], r["qty"], r["price_ticks"]) for r in out.where("kind = 'trade'").orderBy("bar_index").collect()]
    assert trades == [(1, 1, 2, 101), (2, 2, 1, 102), (3, 1, 2, 103), (4, 2, 1, 104), (5, 1, 2, 105)]
    last = out.where("kind = 'bar'").orderBy(F.desc("bar_index")).first()
    assert (last["cash_ticks"], last["position"], last["refused"], last["pending"]) == (450 - 202 + 102 - 206 + 104 - 210, 4, 2, 2)


def test_report_and_manifest(spark):
    p = spark.createDataFrame([(1, 3, 8)], "b long, a long, c long")
    m = G.manifest(p).first()
    assert m["manifest_json"] == '{"a":3,"b":1,"c":8}' and len(m["manifest_id"]) == 16


def test_audits_are_quiet_on_a_valid_log(spark):
    acc = [(1, 1, 1, 1, 1, 1, 1, 2, 100, 5), (1, 2, 2, 1, 2, 2, 2, 2, 101, 5), (1, 3, 3, 1, 3, 3, 3, 1, 101, 7)]
    fil = [(1, 4, 4, 1, 100, 5, 1, 1, 3, 1, 3), (1, 5, 5, 1, 101, 2, 1, 2, 3, 2, 3)]
    can = [(1, 6, 6, 1, 2, 2, 3, 1)]
    a, f, c = spark.createDataFrame(acc, ACC), spark.createDataFrame(fil, FILL), spark.createDataFrame(can, CAN)
    assert K.audit_event_log(a, f, c).count() == 0
    assert K.audit_price_time(a, f, c).count() == 0
    bad = spark.createDataFrame([(1, 4, 4, 1, 101, 5, 1, 2, 3, 2, 3)], FILL)
    assert K.audit_price_time(a, bad, c).count() == 1

"""DuckDB SQL of the registered queries, from shared table expressions."""

from __future__ import annotations

CTE: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTE[name], NEEDS[name] = sql.strip(), list(needs)


def q(sql: str, *needs: str) -> str:
    """A query with the table expressions it needs, each after its own."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS[n]:
            add(m)
        if n not in order:
            order.append(n)

    for n in needs:
        add(n)
    return ("with recursive " + ", ".join(f"{n} as ({CTE[n]})" for n in order) + "\n" if order else "") + sql.strip()


SYMBOLS = "(1,'QAA',100,1),(2,'QAB',100,1),(3,'QAC',100,1),(4,'QAD',100,1),(5,'QAE',10000,10),(6,'QAF',10000,10),(7,'QAG',100000,100),(8,'QAH',1000,1),(9,'QAI',1000,1),(10,'QAJ',1000,1)"
cte("sym", f"select * from (values {SYMBOLS}) t(symbol_id, name, tick_size_ticks, lot_size)")
cte("base", """
select epoch_us(ts) // 1000 as seq_ms, event_id as seq_ord, epoch_us(ts) * 1000 as ns, cast(event_id % 10 + 1 as int) as symbol_id, user_id,
       cast(json_extract_string(props, '$.k') as bigint) as k, event_type, cast(round(value * 100) as bigint) as price from events
""")  # fmt: skip
cte("acc", """
select seq_ms, seq_ord, ns, symbol_id, user_id, seq_ord as order_id, case event_type when 'view' then 1 else 2 end as side, price, 1 + k as qty
from base where event_type in ('view', 'click')
""", "base")  # fmt: skip
cte("fill", """
select seq_ms, seq_ord, ns, symbol_id, price, 1 + k % 20 as qty, cast(1 + k % 2 as int) as aggr, seq_ord - 10 * (1 + k % 50) as maker_oid,
       seq_ord - 10 * (1 + (k + 7) % 50) as taker_oid, user_id as maker_uid, (user_id * 7 + 3) % 150 as taker_uid
from base where event_type = 'purchase'
""", "base")  # fmt: skip
cte("can", """
select seq_ms, seq_ord, ns, symbol_id, user_id, seq_ord - 10 * (1 + k % 20) as order_id, 1 + k % 10 as remaining_qty, cast(1 + k % 2 as int) as reason
from base where event_type = 'error'
""", "base")  # fmt: skip
cte("acct", """
select seq_ms, seq_ord, ns, user_id, rn = 1 as created, case when rn = 1 then 10000000 else price end as amount
from (select *, row_number() over (partition by user_id order by seq_ord) as rn from base where event_type = 'signup')
""", "base")  # fmt: skip
cte("hist", "select symbol_id, row_number() over (partition by symbol_id order by seq_ord) - 1 as minute_index, price as close_ticks from base", "base")

ORACLES: dict[str, str] = {}

# --- bars -----------------------------------------------------------------
ORACLES["outbound_log"] = q("""
select seq_ms, seq_ord, ns as timestamp_ns, symbol_id, user_id, event_type from base
where seq_ms > 1704326400000 or (seq_ms = 1704326400000 and seq_ord > 5)
""", "base")  # fmt: skip
ORACLES["stream_id_order"] = q("""
select symbol_id, min(seq_ms) as first_ms, arg_min(o, seq_ms * 1000000 + o) as first_ord, max(seq_ms) as last_ms, arg_max(o, seq_ms * 1000000 + o) as last_ord
from (select symbol_id, seq_ms, case when k % 5 = 0 then 0 else seq_ord end as o from base) group by symbol_id
""", "base")  # fmt: skip
ORACLES["price_history"] = q("select symbol_id, minute_index, close_ticks from hist", "hist")
ORACLES["build_price_history"] = q("""
select 'SERIES_' || lpad(symbol_id::varchar, 2, '0') as symbol, minute_index,
       greatest(1, v // 10000 + case when v % 10000 > 5000 or (v % 10000 = 5000 and (v // 10000) % 2 = 1) then 1 else 0 end)::bigint as close_ticks
from (select b.symbol_id, row_number() over (partition by b.symbol_id order by seq_ord) - 1 as minute_index,
             (cast(round(value * 100) as bigint) * 5 + k) * 10 * (tick_size_ticks // 100) as v
      from base b join events e on e.event_id = b.seq_ord join sym using (symbol_id))
""", "base", "sym")  # fmt: skip
ORACLES["history_quality"] = q("""
select name, s.n, s.min_close, s.n_closes, s.min_close > 0 as all_positive, s.n_closes > 1 as moves, coalesce(t.twins, 0)::bigint as twins
from sym left join (select symbol_id, count(*) as n, min(close_ticks) as min_close, count(distinct close_ticks) as n_closes from hist group by symbol_id) s using (symbol_id)
left join (select symbol_id, count(*) over (partition by path) - 1 as twins from (select symbol_id, list(close_ticks order by minute_index) as path from hist group by 1)) t using (symbol_id)
""", "hist", "sym")  # fmt: skip
ORACLES["symbol_dim"] = q("""
select name, tick_size_ticks, lot_size, count(f.symbol_id) as trades, coalesce(sum(qty), 0)::bigint as volume from sym left join fill f using (symbol_id) group by all
""", "fill", "sym")  # fmt: skip
ORACLES["order_validation"] = q("""
select client_order_id, case when side not in (1, 2) then 'INVALID_SIDE' when tif not in (1, 2) then 'INVALID_TIF' when p <= 0 then 'INVALID_PRICE'
  when qty <= 0 then 'INVALID_QUANTITY' when symbol_id not in (select symbol_id from sym) then 'UNKNOWN_SYMBOL' end as reason
from (select seq_ord as client_order_id, case when k % 11 = 0 then 3 when event_type = 'click' then 2 else 1 end as side, case when k % 13 = 0 then 9 else 1 end as tif,
             case when k % 17 = 0 then -price else price end as p, case when k % 7 = 0 then 0 else 1 + k end as qty, case when k % 19 = 0 then symbol_id + 10 else symbol_id end as symbol_id
      from base where event_type in ('view', 'click'))
""", "base", "sym")  # fmt: skip
ORACLES["tape"] = q("select symbol_id, price as price_ticks, qty, aggr as aggressor_side, ns as timestamp_ns, seq_ms || '-' || seq_ord as seq from fill", "fill")
cte("w", "select unnest([3600, 86400])::bigint as bs")
cte("bar", """
select symbol_id, bs as bucket_seconds, ns // (bs * 1000000000) * bs * 1000000000 as open_ns, arg_min(price, seq_ord) as open_ticks, max(price) as high_ticks,
       min(price) as low_ticks, arg_max(price, seq_ord) as close_ticks, sum(qty)::bigint as volume, count(*) as trades
from fill, w group by all
""", "fill", "w")  # fmt: skip
ORACLES["bars_multi_width"] = q("select * from bar", "bar")
ORACLES["bars_ohlcv"] = q("select * from bar where bucket_seconds = 3600", "bar")
_LATER = "open_ns < max(open_ns) over (partition by symbol_id, bucket_seconds)"
ORACLES["bars_closed"] = q(f"select * from (select *, {_LATER} as closed from bar) where closed", "bar")
ORACLES["bars_open"] = q(f"select * from (select *, {_LATER} as closed from bar) where not closed", "bar")
ORACLES["bars_force_closed"] = q(f"select * exclude (closed) from (select *, {_LATER} as closed from bar) where closed or open_ns + bucket_seconds * 1000000000 <= 1706486400000000000", "bar")
cte("unit", """
select ns // 86400000000000 * 86400000000000 as unit_ns, min(seq_ord) as first_ord, arg_min(seq_ms, seq_ord) as first_ms, max(seq_ord) as last_ord, arg_max(seq_ms, seq_ord) as last_ms, count(*) as n
from base group by 1
""", "base")  # fmt: skip
ORACLES["flush_units"] = q("""
select unit_ns, first_ms, first_ord, last_ms, last_ord, n, coalesce(lag(last_ms) over (order by unit_ns), 0) as resume_ms, coalesce(lag(last_ord) over (order by unit_ns), 0) as resume_ord from unit
""", "unit")  # fmt: skip
cte("jlog", "select seq_ms, seq_ord, case when k % 9 = 0 then ns - 93600000000000 else ns end // 86400000000000 as u from base", "base")
ORACLES["late_rows"] = q("""
select seq_ms, r.seq_ord, u * 86400000000000 as unit_ns from jlog r join (
  select a.u as v, min(seal) as seal from (select distinct u from jlog) a join (
    select x.u, x.f, (select min(seq_ord) from jlog z where z.u > x.u) as seal from (select u, min(seq_ord) as f from jlog group by u) x) b on b.u >= a.u and b.f < b.seal group by a.u) s
on s.v = r.u where r.seq_ord > s.seal
""", "jlog")  # fmt: skip
ORACLES["bars_reconcile"] = q("select *, 'rebuilt' as side from bar where open_ns % 7 = 3 union all select * replace (volume + 1 as volume), 'archived' as side from bar where open_ns % 7 = 3", "bar")
ORACLES["research_bars"] = q("""
select symbol_id, (minute_index - 100) // 15 as bar_index, min(minute_index) as first_minute, arg_min(close_ticks, minute_index) as open_ticks, max(close_ticks) as high_ticks,
       min(close_ticks) as low_ticks, arg_max(close_ticks, minute_index) as close_ticks
from hist where minute_index >= 100 and minute_index < 877 group by all having count(*) = 15
""", "hist")  # fmt: skip
ORACLES["last_trade"] = q("select symbol_id, arg_max(price, seq_ord) as price_ticks, arg_max(qty, seq_ord) as qty, arg_max(seq_ms || '-' || seq_ord, seq_ord) as seq from fill group by 1", "fill")
ORACLES["recent_trades"] = q("""
select symbol_id, price as price_ticks, qty, seq_ms || '-' || seq_ord as seq, row_number() over (partition by symbol_id order by seq_ord desc) as rank from fill qualify rank <= 200
""", "fill")  # fmt: skip
ORACLES["bar_series"] = q("""
select symbol_id, bucket_seconds, open_ns, close_ticks, case when open_ns % 3 = 0 then volume + 1 else volume end as volume,
       row_number() over (partition by symbol_id, bucket_seconds order by open_ns desc) as rank from bar qualify rank <= 600
""", "bar")  # fmt: skip
ORACLES["bar_direction"] = q("""
select symbol_id, bucket_seconds, sum(case when close_ticks >= open_ticks then volume else 0 end)::bigint as up_volume, sum(case when close_ticks < open_ticks then volume else 0 end)::bigint as down_volume from bar group by all
""", "bar")  # fmt: skip
ORACLES["width_label"] = q("""
select distinct bucket_seconds, case bucket_seconds when 60 then '1h' when 1 then '1m' when 300 then '300m' when 1440 then '1d' else bucket_seconds || 'm' end as label
from (select unnest([1, 60, 300, 1440])::bigint as bucket_seconds from fill)
""", "fill")  # fmt: skip
ORACLES["replay_price_join"] = q("""
select b.seq_ord, b.symbol_id, h.minute_index, h.close_ticks
from (select seq_ord, symbol_id, (symbol_id * 37 + (ns - 1704067200000000000) // 60000000000) as m from base) b
join (select symbol_id, count(*) as n from hist group by 1) c using (symbol_id) join hist h on h.symbol_id = b.symbol_id and h.minute_index = m % n
""", "hist")  # fmt: skip

# --- book -----------------------------------------------------------------
cte("oev", """
select a.order_id, a.symbol_id, a.side, a.price, a.qty, a.user_id, a.seq_ord as a_ord, x.seq_ord, x.seq_ms, x.ns, x.kind, x.filled, x.fp
from acc a join (select seq_ord, seq_ms, ns, order_id, 'accept' as kind, 0 as filled, 0 as fp from acc
  union all select seq_ord, seq_ms, ns, maker_oid, 'maker', qty, price from fill union all select seq_ord, seq_ms, ns, taker_oid, 'taker', qty, price from fill
  union all select seq_ord, seq_ms, ns, order_id, 'cancel', 0, 0 from can) x on x.order_id = a.order_id
where x.seq_ord > a.seq_ord or x.kind = 'accept'
""", "acc", "fill", "can")  # fmt: skip
cte("oev1", "select order_id, symbol_id, side, price, qty, user_id, a_ord, seq_ord, seq_ms, ns, sum(filled) as filled, bool_or(kind = 'cancel') as c from oev group by all", "oev")
cte("ost0", """
select *, case when bool_or(c) over w then 0 else greatest(0, qty - sum(filled) over w) end::bigint as rem from oev1 window w as (partition by order_id order by seq_ord)
""", "oev1")  # fmt: skip
cte("ost", "select *, rem - coalesce(lag(rem) over (partition by order_id order by seq_ord), 0) as delta from ost0", "ost0")
cte("rest", "select order_id, symbol_id, side, price, qty, user_id, a_ord, arg_max(rem, seq_ord) as rem from ost group by all having arg_max(rem, seq_ord) > 0", "ost")
cte("lvl0", "select symbol_id, side, price, sum(rem)::bigint as qty, count(*) as orders from rest group by all", "rest")
cte("lvl", "select *, row_number() over (partition by symbol_id, side order by case side when 1 then -price else price end) - 1 as level from lvl0", "lvl0")
ORACLES["order_events"] = q("select order_id, seq_ord, kind, filled::bigint as filled from oev", "oev")
ORACLES["order_lifecycle"] = q("""
select order_id, symbol_id, side, price as price_ticks, qty, user_id, f::bigint as filled_qty, fn::bigint as filled_notional, c as cancelled, first_ns, last_ns,
       case when f > 0 then (fn // f)::bigint end as avg_price_ticks, case when c then 0 else greatest(0, qty - f) end::bigint as remaining,
       case when c then 'CANCELLED' when f >= qty then 'FILLED' when f > 0 then 'PARTIAL' else 'OPEN' end as status
from (select order_id, symbol_id, side, price, qty, user_id, sum(filled)::bigint as f, sum(filled * fp)::bigint as fn, bool_or(kind = 'cancel') as c, min(ns) as first_ns, max(ns) as last_ns from oev group by all)
""", "oev")  # fmt: skip
ORACLES["resting_orders"] = q("""
select order_id, symbol_id, side, price as price_ticks, user_id, (qty - f)::bigint as rem from (
  select order_id, symbol_id, side, price, user_id, qty, sum(filled)::bigint as f, bool_or(kind = 'cancel') as c from oev where seq_ms <= 1705276800000 group by all) where not c and f < qty
""", "oev")  # fmt: skip
ORACLES["book_levels"] = q("select symbol_id, side, price as price_ticks, qty, orders, level from lvl where level < 20", "lvl")
ORACLES["bbo"] = q("""
select symbol_id, bid, ask, bid is not null and ask is not null as two_sided, ask - bid as spread, (ask + bid) // 2 as mid
from (select symbol_id, max(price) filter (side = 1) as bid, min(price) filter (side = 2) as ask from lvl group by 1)
""", "lvl")  # fmt: skip
cte("chg0", "select symbol_id, side, price, seq_ord, ns, sum(delta)::bigint as delta from ost where delta <> 0 group by all having sum(delta) <> 0", "ost")
cte("chg", "select *, sum(delta) over (partition by symbol_id, side, price order by seq_ord)::bigint as qty from chg0", "chg0")
ORACLES["level_changes"] = q("select symbol_id, side, price as price_ticks, seq_ord, qty from chg", "chg")
_DAY, _SEC = 86_400_000_000_000, 1_000_000_000
cte("cov", f"""
select u as unit_ns, first_ns, (row_number() over (order by u) - 1) * 86400 as covered from (select ns // {_DAY} * {_DAY} as u, min(ns) // {_SEC} * {_SEC} as first_ns from base group by 1)
""", "base")  # fmt: skip


def intervals(name: str, changes: str, by: str, depth: int, parity: bool = False, units: str = "cov") -> None:
    """Tables <name>l, the levels at each second that has a change and at each unit's start, and <name>, the intervals in which the best `depth` levels stay."""
    at = f"case when s <= first_ns then s // {_DAY} * {_DAY} else s end" if parity else "s"
    cte(f"{name}0", f"""
select *, coalesce(lead(step) over (partition by {by}, side, price order by step), 9000000000000000000) as nxt from (
  select {by}, side, price, step, arg_max(qty, seq_ord) as qty from (
    select *, {at} as step from (select *, ns // {_SEC} * {_SEC} as s from {changes}) join {units} on unit_ns = s // {_DAY} * {_DAY}) group by all)
""", changes, units)  # fmt: skip
    cte(f"{name}p", f"select distinct {by}, step, step // {_DAY} * {_DAY} as unit_ns from {name}0 union select {by}, unit_ns, unit_ns from {units}, (select distinct {by} from {name}0)", f"{name}0", units)
    cte(f"{name}l", f"""
select *, row_number() over (partition by {by}, step, side order by case side when 1 then -price else price end) as rk from (
  select {by}, p.step, side, price, qty from {name}p p join {name}0 l using ({by}) where l.step <= p.step and nxt > p.step and qty > 0)
""", f"{name}p", f"{name}0")  # fmt: skip
    cte(name, f"""
select {by}, unit_ns, step as from_ns, upto as to_ns, (upto - step) // {_SEC} as steps from (
  select *, coalesce(lead(step) over (partition by {by}, unit_ns order by step), unit_ns + {_DAY}) as upto from (
    select *, lag(state) over (partition by {by}, unit_ns order by step) as was from (
      select {name}p.*, coalesce(state, '') as state from {name}p left join (
        select {by}, step, string_agg(side || ':' || rk || ':' || price || ':' || qty, ',' order by side, rk) as state from {name}l where rk <= {depth} group by all) using ({by}, step)))
  where was is null or was <> state) where state <> ''
""", f"{name}p", f"{name}l")  # fmt: skip


for _d in (1, 5, 10):
    intervals(f"top{_d}_", "chg", "symbol_id", _d)
intervals("par", "chg", "symbol_id", 3, parity=True)
_LONG = "select symbol_id, from_ns, to_ns, steps, side, price as price_ticks, qty, rk - 1 as level from {0} t join {0}l l using (symbol_id) where l.step = from_ns and rk <= {1}"
ORACLES["book_snapshots_1hz"] = q(_LONG.format("top10_", 10), "top10_")
ORACLES["book_snapshots_parity"] = q(_LONG.format("par", 3), "par")
ORACLES["book_at"] = q(f"""
select symbol_id, {1705305600 * _SEC} as step_ns, side, price as price_ticks, qty, row_number() over (partition by side order by case side when 1 then -price else price end) - 1 as level
from (select symbol_id, side, price, arg_max(qty, seq_ord) as qty from chg where symbol_id = 3 and ns < {1705305601 * _SEC} group by all) where qty > 0
""", "chg")  # fmt: skip
ORACLES["conflated_book"] = q("""
select symbol_id, side, price as price_ticks, ns // 50000000 * 50000000 as window_ns, arg_max(qty, seq_ord) as qty, max(seq_ord) as seq_ord from chg group by all
""", "chg")  # fmt: skip
cte("best", "select t.symbol_id, from_ns, any_value(steps) as steps, max(price) filter (side = 1) as bid, min(price) filter (side = 2) as ask from top1_ t join top1_l l on l.symbol_id = t.symbol_id and l.step = from_ns and rk <= 1 group by all", "top1_")
ORACLES["crossed_books"] = q("""
select symbol_id, sum(n)::bigint as snapshots, sum(run)::bigint as crossed, max(run)::bigint as longest_run from (
  select symbol_id, island, sum(steps) as n, sum(c * steps) as run from (
    select *, sum(1 - c) over (partition by symbol_id order by from_ns) as island from (select *, case when bid >= ask then 1 else 0 end as c from best)) group by all) group by 1
""", "best")  # fmt: skip
ORACLES["depth_share"] = q("select symbol_id, from_ns, steps, side, rk - 1 as level, qty, qty / max(qty) over (partition by symbol_id, from_ns) as share from top5_ t join top5_l l using (symbol_id) where l.step = from_ns and rk <= 5", "top5_")
cte("bb", """
select symbol_id, at_ord as seq_ord, max(price) filter (side = 1) as bid, min(price) filter (side = 2) as ask from (
  select distinct c.symbol_id, c.seq_ord as at_ord, l.side, l.price from chg c left join (
    select *, coalesce(lead(seq_ord) over (partition by symbol_id, side, price order by seq_ord), 9000000000) as to_ord from chg) l
  on l.symbol_id = c.symbol_id and l.qty > 0 and l.seq_ord <= c.seq_ord and c.seq_ord < l.to_ord) group by all
""", "chg")  # fmt: skip
ORACLES["banded_price"] = q("""
select order_id, side, bid, ask, case when side = 1 then (ask * 10500 + 9999) // 10000 else greatest(1, bid * 9500 // 10000) + (bid - bid) end as limit_ticks
from (select a.order_id, a.side, b.bid, b.ask from acc a asof left join bb b on a.symbol_id = b.symbol_id and a.seq_ord > b.seq_ord)
""", "acc", "bb")  # fmt: skip
cte("bef", "select order_id, seq_ord, rem - delta as before from ost where seq_ord > a_ord", "ost")
cte("fx", """
select f.*, m.before as mr, ma.side as ms, ma.symbol_id as msy, ma.price as mp, t.before as tr, ta.side as ts, ta.symbol_id as tsy
from fill f left join bef m on m.order_id = maker_oid and m.seq_ord = f.seq_ord left join acc ma on ma.order_id = m.order_id
left join bef t on t.order_id = taker_oid and t.seq_ord = f.seq_ord left join acc ta on ta.order_id = t.order_id
""", "fill", "bef", "acc")  # fmt: skip
_RULES = {
    "maker_unknown": "mr is null", "taker_unknown": "tr is null", "maker_gone": "mr = 0", "taker_gone": "tr = 0", "same_side": "ms = ts", "aggressor_side": "aggr <> ts",
    "symbol": "msy <> symbol_id or tsy <> symbol_id", "price": "mp <> price", "qty": "qty <= 0", "maker_overfill": "mr > 0 and qty > mr", "taker_overfill": "tr > 0 and qty > tr",
}
ORACLES["audit_event_log"] = q(
    " union all ".join(f"select seq_ms, seq_ord, '{r}' as rule from fx where {c}" for r, c in _RULES.items())
    + " union all select seq_ms, seq_ord, r from (select c.*, before, unnest([case when before is null then 'cancel_unknown' when before = 0 then 'cancel_gone' when before <> remaining_qty then 'cancel_qty' end]) as r from can c left join bef b on b.order_id = c.order_id and b.seq_ord = c.seq_ord) where r is not null",
    "fx", "can",
)
cte("live", "select order_id, symbol_id, side, price, a_ord as f, coalesce(min(seq_ord) filter (rem = 0), 9000000000) as t from ost group by all", "ost")
ORACLES["audit_price_time"] = q("""
select seq_ms, seq_ord, maker_oid as maker_order_id, better as better_order_id from (
  select f.seq_ms, f.seq_ord, f.maker_oid, arg_min(l.order_id, case t.side when 1 then l.price else -l.price end * 100000000 + l.f) as better
  from fill f join acc t on t.order_id = f.taker_oid and t.seq_ord < f.seq_ord
  join live l on l.symbol_id = t.symbol_id and l.side <> t.side and l.f < f.seq_ord and l.t >= f.seq_ord and case t.side when 1 then l.price <= t.price else l.price >= t.price end
  group by all) where better <> maker_oid
""", "fill", "acc", "live")  # fmt: skip
ORACLES["audit_crossed_final"] = q("select symbol_id, bid, ask, coalesce(bid >= ask, false) as crossed from (select symbol_id, max(price) filter (side = 1) as bid, min(price) filter (side = 2) as ask from lvl group by 1)", "lvl")
ORACLES["conservation"] = q("""
select symbol_id, sum(qty)::bigint as accepted, sum(fl)::bigint as filled, sum(off)::bigint as cancelled, sum(rem)::bigint as resting, (sum(qty) - sum(fl) - sum(off) - sum(rem))::bigint as difference
from (select symbol_id, order_id, qty, arg_max(rem, seq_ord) as rem, sum(case when c then -delta else 0 end) as off, sum(case when not c and delta < 0 then -delta else 0 end) as fl from ost group by all) group by 1
""", "ost")  # fmt: skip

# --- ledger ---------------------------------------------------------------
cte("fee", "select *, price * qty as notional, price * qty * 2 // 10000 as mfee, price * qty * 10 // 10000 as tfee from fill", "fill")
ORACLES["fees"] = q("select seq_ms, seq_ord, symbol_id, notional, mfee as maker_fee, tfee as taker_fee, mfee + tfee as total_fee from fee", "fee")
cte("leg", """
select seq_ms, seq_ord, symbol_id, price, qty, 'maker' as role, maker_uid as user_id, maker_oid as order_id, 3 - aggr as side, mfee as fee,
       case when aggr = 2 then qty else -qty end as sq, case when aggr = 2 then -notional else notional end - mfee as cash from fee
union all select seq_ms, seq_ord, symbol_id, price, qty, 'taker', taker_uid, taker_oid, aggr, tfee, case when aggr = 1 then qty else -qty end, case when aggr = 1 then -notional else notional end - tfee from fee
""", "fee")  # fmt: skip
ORACLES["fill_legs"] = q("select seq_ord, symbol_id, role, user_id, order_id, side, fee, sq as signed_qty, cash as cash_delta from leg", "leg")
cte("cev", """
select user_id, seq_ms, seq_ord, 0 as leg, created, amount as delta from acct union all select user_id, seq_ms, seq_ord, case role when 'maker' then 1 else 2 end, false, cash from leg
""", "acct", "leg")  # fmt: skip
cte("bal", """
select user_id, coalesce(sum(delta) filter (seq_ord * 10 + leg >= since), 0)::bigint as cash_ticks
from (select *, coalesce(max(case when created then seq_ord * 10 + leg end) over (partition by user_id), -1) as since from cev) group by 1
""", "cev")  # fmt: skip
ORACLES["cash_balances"] = q("select * from bal", "bal")
ORACLES["cash_history"] = q("""
select user_id, seq_ord, leg, delta, sum(delta) over (partition by user_id, e order by seq_ord, leg)::bigint as balance
from (select *, sum(case when created then 1 else 0 end) over (partition by user_id order by seq_ord, leg) as e from cev)
""", "cev")  # fmt: skip
cte("pos", "select user_id, symbol_id, sum(sq)::bigint as position from leg group by all having sum(sq) <> 0", "leg")
ORACLES["positions"] = q("select * from pos", "pos")
ORACLES["open_orders"] = q("""
select a.order_id, user_id, symbol_id, side, price as price_ticks, qty, (qty - coalesce(off, 0))::bigint as remaining from acc a left join (
  select m.order_id, sum(off) as off from (select order_id, seq_ord, qty as off from leg union all select order_id, seq_ord, remaining_qty from can) m join acc using (order_id)
  where m.seq_ord > acc.seq_ord group by 1) o using (order_id) where qty - coalesce(off, 0) > 0
""", "acc", "leg", "can")  # fmt: skip
cte("oo", """
select a.order_id, a.user_id, (a.qty - coalesce(off, 0))::bigint as remaining from acc a left join (
  select m.order_id, sum(off) as off from (select order_id, seq_ord, qty as off from leg union all select order_id, seq_ord, remaining_qty from can) m join acc using (order_id)
  where m.seq_ord > acc.seq_ord group by 1) o using (order_id) where a.qty - coalesce(off, 0) > 0
""", "acc", "leg", "can")  # fmt: skip
_MODEL = """
select 'accounts' as tbl, user_id as a, bool_or(created)::bigint as b, any_value(cash_ticks)::bigint as amount from cev join bal using (user_id) group by 2
union all select 'positions', user_id, symbol_id, position from pos
union all select 'open_orders', order_id, user_id, remaining from oo
union all select 'house_fees', symbol_id, ns // 86400000000000, sum(mfee + tfee)::bigint from fee group by all
"""
ORACLES["stream_read_model"] = ORACLES["read_model_upsert"] = q(_MODEL, "cev", "bal", "pos", "oo", "fee")
ORACLES["house_fees"] = q("""
select symbol_id, strftime(make_timestamp(ns // 1000), '%Y-%m-%d') as date, sum(mfee + tfee)::bigint as fees, count(*) as fills from fee group by grouping sets ((symbol_id, date), (symbol_id), ())
""", "fee")  # fmt: skip
ORACLES["cash_conservation"] = q("""
select c as cash, f as fees, d as deposits, n as largest_net_position, c + f - d as difference from (
  select (select sum(cash_ticks) from bal)::bigint as c, (select sum(mfee + tfee) from fee)::bigint as f, (select sum(amount) from acct)::bigint as d,
         (select coalesce(max(abs(n)), 0) from (select sum(position) as n from pos group by symbol_id))::bigint as n)
""", "bal", "fee", "acct", "pos")  # fmt: skip
ORACLES["portfolio"] = q("""
select user_id, coalesce(cash_ticks, 0) as cash_ticks, coalesce(n, 0) as n_positions, coalesce(p, '') as positions
from (select distinct user_id from base) left join bal using (user_id)
left join (select user_id, count(*) as n, string_agg(name || ':' || position, ' ' order by name) as p from pos join sym using (symbol_id) group by 1) using (user_id)
""", "base", "bal", "pos", "sym")  # fmt: skip
cte("priv", """
select user_id, seq_ord, 0 as leg, 'accepted' as kind, null as role, symbol_id, order_id, qty from acc
union all select user_id, seq_ord, case role when 'maker' then 1 else 2 end, 'fill', role, symbol_id, order_id, qty from leg
union all select user_id, seq_ord, 0, 'cancelled', null, symbol_id, order_id, remaining_qty from can
union all select user_id, seq_ord, 0, case when created then 'account_created' else 'cash_credited' end, null, null, null, amount from acct
""", "acc", "leg", "can", "acct")  # fmt: skip
ORACLES["private_timeline"] = q("""
select user_id, row_number() over (partition by user_id order by seq_ord, leg) as user_seq, seq_ord, kind, role, name as symbol, order_id, qty from priv left join sym using (symbol_id)
""", "priv", "sym")  # fmt: skip
ORACLES["changed_keys"] = q("""
select distinct seq_ord // 500 as batch, kind, user_id, other from (
  select 'account' as kind, user_id, null::bigint as other, seq_ord from acct union all select 'account', user_id, null, seq_ord from leg union all select 'position', user_id, symbol_id, seq_ord from leg
  union all select 'order', user_id, order_id, seq_ord from acc union all select 'order', user_id, order_id, seq_ord from leg union all select 'order', user_id, order_id, seq_ord from can)
""", "acct", "leg", "acc", "can")  # fmt: skip
cte("lt", "select symbol_id, arg_max(price, seq_ord) as px from fill group by 1", "fill")
ORACLES["mark_to_market"] = q("""
select user_id, cash_ticks, coalesce(h, 0)::bigint as holdings, (cash_ticks + coalesce(h, 0))::bigint as equity from bal left join (select user_id, sum(position * px) as h from pos join lt using (symbol_id) group by 1) using (user_id)
""", "bal", "pos", "lt")  # fmt: skip
cte("state_rows", """
select 'cash' as tbl, user_id || ':' || cash_ticks as line from bal union all select 'position', user_id || ':' || symbol_id || ':' || position from pos union all select 'resting', order_id || ':' || rem from rest
""", "bal", "pos", "rest")  # fmt: skip
ORACLES["state_snapshot"] = q("select tbl, count(*) as n, sum(('0x' || substr(sha256(line), 1, 12))::bigint)::bigint as digest from state_rows group by 1", "state_rows")

# --- risk -----------------------------------------------------------------
_COST = "{q} * (price + (price * 10 + 9999) // 10000)"
ORACLES["buy_cost"] = q(f"select order_id, {_COST.format(q='qty')} as cost from acc where side = 1", "acc")
cte("resv", f"select user_id, symbol_id, sum(case when side = 1 then {_COST.format(q='rem')} else 0 end)::bigint as cash, sum(case when side = 2 then rem else 0 end)::bigint as units from rest group by all", "rest")
ORACLES["reservations"] = q("select * from resv", "resv")
ORACLES["available"] = q("""
select user_id, null::int as symbol_id, (coalesce(cash_ticks, 0) - coalesce(r, 0))::bigint as available from bal full join (select user_id, sum(cash) as r from resv group by 1) using (user_id)
union all select user_id, symbol_id, (coalesce(position, 0) - coalesce(units, 0))::bigint from pos full join (select * from resv where units > 0) using (user_id, symbol_id)
""", "bal", "resv", "pos")  # fmt: skip
cte("mv", f"""
select user_id, seq_ord, leg, created, delta, 0 as reserve from cev union all
select user_id, seq_ord, 3, false, 0, {_COST.format(q='delta')} from ost where side = 1 and delta <> 0
""", "cev", "ost")  # fmt: skip
cte("free", """
select user_id, seq_ord, arg_max(free, n) as free, min(free) as lowest from (
  select *, (sum(delta) over (partition by user_id, e order by seq_ord, leg rows unbounded preceding) - sum(reserve) over (partition by user_id order by seq_ord, leg rows unbounded preceding))::bigint as free, leg as n from (
    select *, sum(case when created then 1 else 0 end) over (partition by user_id order by seq_ord, leg rows unbounded preceding) as e from mv)) group by all
""", "mv")  # fmt: skip
cte("funits", """
select user_id, symbol_id, seq_ord, sum(d) over (partition by user_id, symbol_id order by seq_ord)::bigint as fu from (
  select user_id, symbol_id, seq_ord, sum(d) as d from (select user_id, symbol_id, seq_ord, sq as d from leg union all select user_id, symbol_id, seq_ord, -delta from ost where side = 2 and delta <> 0) group by all)
""", "leg", "ost")  # fmt: skip
ORACLES["admission_audit"] = q(f"""
select order_id, reason from (
  select a.order_id, case when side = 1 and coalesce(free, 0) < {_COST.format(q='qty')} then 'INSUFFICIENT_CASH' when side = 2 and a.user_id >= 10 and coalesce(fu, 0) < qty then 'INSUFFICIENT_POSITION' end as reason
  from acc a asof left join free on a.user_id = free.user_id and a.seq_ord > free.seq_ord asof left join funits u on a.user_id = u.user_id and a.symbol_id = u.symbol_id and a.seq_ord > u.seq_ord) where reason is not null
""", "acc", "free", "funits")  # fmt: skip
ORACLES["retail_short_violations"] = q("""
select user_id, symbol_id, seq_ord, position from (
  select user_id, symbol_id, seq_ord, sum(d) over (partition by user_id, symbol_id order by seq_ord)::bigint as position from (select user_id, symbol_id, seq_ord, sum(sq) as d from leg where user_id >= 10 group by all)) where position < 0
""", "leg")  # fmt: skip
ORACLES["insolvency_violations"] = q("select user_id, seq_ord, lowest from free where lowest < 0", "free")
cte("dsub", "select seq_ord, ns, user_id, k % 10 as cid, row_number() over (partition by user_id, k % 10 order by ns, seq_ord) as rn from base where event_type in ('view', 'click')", "base")
cte("dfold", """
select user_id, cid, rn, seq_ord, ns, ns as kept, false as dup from dsub where rn = 1
union all select s.user_id, s.cid, s.rn, s.seq_ord, s.ns, case when s.ns - d.kept < 86400000000000 then d.kept else s.ns end, s.ns - d.kept < 86400000000000
from dfold d join dsub s on s.user_id = d.user_id and s.cid = d.cid and s.rn = d.rn + 1
""", "dsub")  # fmt: skip
ORACLES["first_outcome_dedupe"] = q("select user_id, cid as client_order_id, seq_ord, dup as duplicate from dfold", "dfold")
ORACLES["reject_summary"] = q("""
select name, r as reason, count(*) as orders, count(distinct user_id) as users from (
  select symbol_id, user_id, case k % 4 when 0 then 'INSUFFICIENT_CASH' when 1 then 'INVALID_PRICE' when 2 then 'UNKNOWN_SYMBOL' else 'INSUFFICIENT_POSITION' end as r from base where event_type = 'error') left join sym using (symbol_id) group by all
""", "base", "sym")  # fmt: skip
ORACLES["recovery_check"] = q("""
select 'missing' as problem, seq_ord as id from base where event_type in ('view', 'error') and k % 3 = 0 and event_type <> 'view' union all
select 'extra', order_id from acc where side = 2 or order_id not in (select seq_ord from base where event_type = 'view' and k % 3 = 0) union all
select 'duplicate_fill', taker_oid from fill group by maker_oid, taker_oid having count(*) > 1
""", "base", "acc", "fill")  # fmt: skip
cte("frm", """
select case when k % 2 = 0 then 'private:' || user_id else 'tape:' || symbol_id end as channel, k % 2 = 0 as private, seq_ord as arrival,
       case when k % 2 = 0 then 0 else seq_ms end as a, case when k % 2 = 0 then seq_ord // 700 else seq_ord - (k % 5) * 30 end as b from base
""", "base")  # fmt: skip
ORACLES["sequence_verdicts"] = q("""
select channel, arrival, case when pb is null then 'ok' when a = pa and b = pb then 'duplicate' when a < pa or (a = pa and b < pb) then 'out_of_order' when private and b > pb + 1 then 'gap' else 'ok' end as verdict
from (select *, lag(a) over w as pa, lag(b) over w as pb from frm window w as (partition by channel order by arrival))
""", "frm")  # fmt: skip

# --- backtests ------------------------------------------------------------
cte("prm", "select * from (values (1, 15, 3, 8, 5), (2, 15, 5, 20, 5), (3, 60, 2, 5, 3)) t(run_id, minutes, fast, slow, qty)")
cte("rbar", """
select run_id, symbol_id, minute_index // minutes as i, arg_min(close_ticks, minute_index) as o, max(close_ticks) as h, min(close_ticks) as l, arg_max(close_ticks, minute_index) as c, any_value(fast) as fast, any_value(slow) as slow, any_value(qty) as qty
from hist, prm group by run_id, symbol_id, minutes, minute_index // minutes having count(*) = minutes
""", "hist", "prm")  # fmt: skip
cte("sig", """
select r.*, (select case when count(*) = r.slow then sum(c) filter (i > r.i - r.fast) * r.slow > sum(c) * r.fast end from rbar x where x.run_id = r.run_id and x.symbol_id = r.symbol_id and x.i <= r.i and x.i > r.i - r.slow) as long,
       first_value(o) over (partition by run_id, symbol_id order by i) * 10 as cash0, count(*) over (partition by run_id, symbol_id) as nb
from rbar r
""", "rbar")  # fmt: skip
_FEE = "(s.o * abs({q}) * 10 // 10000)"
cte("btf", """
select run_id, symbol_id, i, o, c, long, qty, cash0, cash0 as cash, 0::bigint as pos, 0::bigint as basis, case when long then qty else 0 end::bigint as gap, long is not null as live, 0::bigint as tq, 0::bigint as fee, 0::bigint as gain, 0::bigint as refused
from sig where i = 0 and nb > 1
union all
select run_id, symbol_id, i, o, c, long, qty, cash0, cash, pos, basis, case when long then qty else 0 end - pos, long is not null, tq, fee, gain, refused from (
  select s.run_id, s.symbol_id, s.i, s.o, s.c, s.long, s.qty, s.cash0, g.refused + case when g.want > 0 and not g.ok then 1 else 0 end as refused,
         case when g.ok then g.cash - s.o * g.want - g.f else g.cash end::bigint as cash, case when g.ok then g.pos + g.want else g.pos end::bigint as pos,
         case when not g.ok then g.basis when g.want > 0 then (g.basis * g.pos + s.o * g.want) // (g.pos + g.want) when g.pos + g.want = 0 then 0 else g.basis end::bigint as basis,
         case when g.ok then g.want else 0 end::bigint as tq, case when g.ok then g.f else 0 end::bigint as fee, case when g.ok and g.want < 0 then (s.o - g.basis) * -g.want - g.f else 0 end::bigint as gain
  from (select b.*, s2.i as ni, case when b.live then b.gap else 0 end as want, s2.o * abs(case when b.live then b.gap else 0 end) * 10 // 10000 as f,
               case when not b.live or b.gap = 0 then false when b.gap > 0 then s2.o * b.gap + s2.o * b.gap * 10 // 10000 <= b.cash else true end as ok
        from btf b join sig s2 on s2.run_id = b.run_id and s2.symbol_id = b.symbol_id and s2.i = b.i + 1) g
  join sig s on s.run_id = g.run_id and s.symbol_id = g.symbol_id and s.i = g.ni)
""", "sig")  # fmt: skip
ORACLES["sma_signal"] = q("select run_id, symbol_id, i as bar_index, long from sig where run_id = 1", "sig")
ORACLES["backtest_trades"] = q("select run_id, symbol_id, i as bar_index, case when tq > 0 then 1 else 2 end as side, abs(tq) as qty, o as price_ticks, fee as fee_ticks, gain as realised_ticks from btf where run_id = 1 and tq <> 0", "btf")
ORACLES["equity_curve"] = q("select run_id, symbol_id, i as bar_index, cash as cash_ticks, pos as position, (cash + pos * c)::bigint as equity_ticks, refused from btf where run_id = 1", "btf")
ORACLES["realised_pnl"] = q("select run_id, symbol_id, sum(gain)::bigint as realised_ticks, count(*) as trades from btf where run_id = 1 and tq <> 0 group by all", "btf")
cte("eq", "select run_id, symbol_id, i, cash + pos * c as e from btf", "btf")
cte("dd", """
select run_id, symbol_id, round(coalesce(max(case when peak > 0 then (peak - e) / peak end), 0) * 100, 6) as dd from (select *, max(e) over (partition by run_id, symbol_id order by i) as peak from eq) group by all
""", "eq")  # fmt: skip
cte("ret", "select run_id, symbol_id, i, (e - b) / b as r from (select *, lag(e) over (partition by run_id, symbol_id order by i) as b from eq) where b > 0", "eq")
cte("rat", """
select run_id, symbol_id, round(sd * 100, 6) as vol, round(case when sd > 0 then m / sd else 0 end, 6) as sharpe from (select run_id, symbol_id, avg(r) as m, case when count(*) > 1 then stddev_pop(r) else 0 end as sd from ret group by all)
""", "ret")  # fmt: skip
cte("bh", """
select run_id, symbol_id, case when entry > 0 and k > 0 then round((cash0 - (entry * k + entry * k * 10 // 10000) + k * lastc - cash0) / cash0 * 100, 6) else 0 end as bh from (
  select run_id, symbol_id, cash0, entry, lastc, list_max(list_filter(generate_series(0, cash0 // entry), lambda x: entry * x + entry * x * 10 // 10000 <= cash0)) as k from (
    select run_id, symbol_id, any_value(cash0) as cash0, max(o) filter (i = 1) as entry, arg_max(c, i) as lastc from sig group by run_id, symbol_id having count(*) > 1))
""", "sig")  # fmt: skip
ORACLES["max_drawdown"] = q("select run_id, symbol_id, dd as max_drawdown_pct from dd where run_id = 1", "dd")
ORACLES["bar_returns"] = q("select run_id, symbol_id, vol as volatility_per_bar_pct, sharpe as sharpe_per_bar from rat where run_id = 1", "rat")
ORACLES["buy_and_hold"] = q("select run_id, symbol_id, bh as buy_and_hold_return_pct from bh where run_id = 1", "bh")
_METRICS = """
select run_id, symbol_id, cash0 as initial_cash_ticks, fe as final_equity_ticks, (fe - cash0)::bigint as pnl_ticks, round((fe - cash0) / cash0 * 100, 6) as return_pct, n as trade_count, wins as win_count,
       case when closing > 0 then round(wins / closing * 100, 6) else 0 end as win_rate_pct, coalesce(dd, 0) as max_drawdown_pct, coalesce(vol, 0) as volatility_per_bar_pct, coalesce(sharpe, 0) as sharpe_per_bar, fees as fees_paid_ticks,
       bh as buy_and_hold_return_pct, round(round((fe - cash0) / cash0 * 100, 6) - bh, 6) as excess_return_pct, refused, pend as unfilled_at_end, ft as first_trade_bar
from (select run_id, symbol_id, any_value(cash0) as cash0, arg_max(cash + pos * c, i)::bigint as fe, count(*) filter (tq <> 0) as n, count(*) filter (gain > 0) as wins, count(*) filter (gain <> 0) as closing, sum(fee)::bigint as fees,
             max(refused)::bigint as refused, arg_max(case when live and gap <> 0 then 1 else 0 end, i)::bigint as pend, min(i) filter (tq <> 0) as ft from btf group by all)
join dd using (run_id, symbol_id) left join rat using (run_id, symbol_id) left join bh using (run_id, symbol_id)
"""
ORACLES["backtest_metrics"] = q(_METRICS + " where run_id = 1", "btf", "dd", "rat", "bh")
ORACLES["backtest_sweep"] = q(_METRICS, "btf", "dd", "rat", "bh")


def _money(c: str) -> str:
    return f"case when {c} < 0 then '-' else '' end || (abs({c}) // tick_size_ticks) || '.' || lpad((abs({c}) % tick_size_ticks)::varchar, (length(tick_size_ticks::varchar) - 1)::int, '0') as {c.removesuffix('_ticks')}"


ORACLES["backtest_report"] = q(f"""
select run_id, name, {_money('initial_cash_ticks')}, {_money('final_equity_ticks')}, {_money('pnl_ticks')}, format('{{:,.2f}}', return_pct) as return_pct, trade_count, refused, unfilled_at_end, first_trade_bar,
       'fills at the next bar''s open, taker fee, whole units, no slippage' as fill_model
from ({_METRICS}) join sym using (symbol_id)
""", "btf", "dd", "rat", "bh", "sym")  # fmt: skip
_RULE = "case i % 5 when 0 then qty when 3 then -{0} else 0 end"
cte("cyc", CTE["btf"].replace("case when long then qty else 0 end::bigint", _RULE.format("0") + "::bigint").replace("case when long then qty else 0 end - pos", _RULE.format("pos")).replace("long is not null", "true").replace("from btf b", "from cyc b"), "sig")
ORACLES["strategy_udf"] = q("select run_id, symbol_id, i as bar_index, case when tq > 0 then 1 else 2 end as side, abs(tq) as qty, o as price_ticks, fee as fee_ticks, gain as realised_ticks from cyc where run_id = 1 and tq <> 0", "cyc")
ORACLES["result_json"] = q("""
select run_id, symbol_id, '{"limitations":"no slippage","realised_ticks":' || realised_ticks || ',"run_id":' || run_id || ',"symbol_id":' || symbol_id || ',"trades":' || trades || '}' as document
from (select run_id, symbol_id, sum(gain)::bigint as realised_ticks, count(*) as trades from btf where run_id = 1 and tq <> 0 group by all)
""", "btf")  # fmt: skip
ORACLES["dataset_checksum"] = q("""
select name || '-' || minute_index // 10000 as name, sha256(string_agg(close_ticks || chr(10), '' order by minute_index)) as found, symbol_id <> 4 as ok from hist join sym using (symbol_id) group by all
union all select 'none-0', null, false
""", "sym", "hist")  # fmt: skip

# --- quality --------------------------------------------------------------
cte("sp0", "select t.*, side, price, qty, row_number() over (partition by symbol_id, from_ns, side order by l.rk) as rk from top10_ t join top10_l l using (symbol_id) where l.step = from_ns and l.rk <= 10 and price > 5", "top10_")
cte("sp", """
select symbol_id, from_ns, to_ns, unit_ns, steps, bid, ask, bid is null or ask is null as one_sided, (ask - bid) / ((bid + ask) / 2) * 10000 as spread_bps, case when bid is not null and ask is not null then least(bq, aq) end::bigint as thin_qty from (
  select symbol_id, from_ns, to_ns, unit_ns, steps, max(price) filter (side = 1 and rk = 1) as bid, max(price) filter (side = 2 and rk = 1) as ask, sum(qty) filter (side = 1 and rk <= 3) as bq, sum(qty) filter (side = 2 and rk <= 3) as aq from sp0 group by all)
""", "sp0")  # fmt: skip
ORACLES["spread_bps"] = q("select symbol_id, from_ns, to_ns, steps, one_sided, spread_bps from sp", "sp")
ORACLES["thin_side_depth"] = q("select symbol_id, from_ns, to_ns, steps, thin_qty from sp where not one_sided", "sp")
cte("smp", """
select seq_ord as client_order_id, ns as intended, ns + k * 1000 + price * 1000 as acked, case event_type when 'view' then 202 when 'click' then 202 when 'purchase' then 200 when 'error' then 429 else 500 end as status, k from base
""", "base")  # fmt: skip


def _rank(col: str, qv: float) -> str:
    return f"list_sort(list({col}))[least(floor({qv}::double * count({col}))::bigint, count({col}) - 1) + 1]"


ORACLES["nearest_rank"] = q(f"""
select status, count(*) as n, min(x) as least, {_rank('x', .5)} as p50, {_rank('x', .95)} as p95, {_rank('x', .99)} as p99, {_rank('x', .999)} as p999, max(x) as greatest from (select status, acked - intended as x from smp) group by status
""", "smp")  # fmt: skip
cte("steps10", "select n as step, 1704067200000000000 + n * 259200000000000 as began, 1704067200000000000 + (n + 1) * 259200000000000 - 1 as ended from (select unnest(generate_series(0, 9)) as n)")
cte("mst", "select user_id, symbol_id, side, price, seq_ord, ns, sum(delta)::bigint as delta from ost where user_id < 10 and delta <> 0 group by all having sum(delta) <> 0", "ost")
cte("mch", "select *, sum(delta) over (partition by user_id, symbol_id, side, price order by seq_ord)::bigint as qty from mst", "mst")


def obligations(mark: str, units: str) -> None:
    """Tables ob<mark>, all covered seconds of each maker and symbol as intervals, and br<mark>, their breaches."""
    intervals(f"mq{mark}", "mch", "user_id, symbol_id", 1, units=units)
    cte(f"two{mark}", f"""
select user_id, symbol_id, from_ns, to_ns, steps, covered + (from_ns - t.unit_ns) // {_SEC} as ix, bid, ask, bq, aq from (
  select t.*, max(price) filter (side = 1) as bid, max(price) filter (side = 2) as ask, max(qty) filter (side = 1) as bq, max(qty) filter (side = 2) as aq
  from mq{mark} t join mq{mark}l l using (user_id, symbol_id) where l.step = from_ns and rk <= 1 group by all) t join {units} using (unit_ns) where bid is not null and ask is not null
""", f"mq{mark}", units)  # fmt: skip
    cte(f"ends{mark}", f"select min(unit_ns) as lo, max(unit_ns) + {_DAY} as hi, count(*) * 86400 as n from {units}", units)
    # a second is two-sided or lies between two such intervals
    cte(f"ob{mark}", f"""
select user_id, symbol_id, from_ns, to_ns, ix, steps, true as two_sided, bid, ask, bq, aq from two{mark} union all
select user_id, symbol_id, to_ns, next_ns, ix + steps, next_ix - ix - steps, false, null, null, null, null from (
  select *, lead(ix) over w as next_ix, lead(from_ns) over w as next_ns from (
    select user_id, symbol_id, from_ns, to_ns, ix, steps from two{mark}
    union all select user_id, symbol_id, lo, lo, 0, 0 from p, ends{mark} union all select user_id, symbol_id, hi, hi, n, 0 from p, ends{mark}) window w as (partition by user_id, symbol_id order by ix, steps)) where next_ix > ix + steps
""", f"two{mark}", "p", f"ends{mark}")  # fmt: skip
    cols = f"select user_id, symbol_id, from_ns, to_ns, ix, steps, '{{0}}' as kind from ob{mark} where {{1}}"
    wide = "two_sided and (ask + bid) // 2 > 0 and cast(floor((ask - bid) * 10000 / ((ask + bid) // 2)) as bigint) > 2000"
    rules = [("not_two_sided", "not two_sided"), ("spread_too_wide", wide), ("size_too_small", "two_sided and bq < 20"), ("size_too_small", "two_sided and aq < 20")]
    cte(f"br{mark}", " union all ".join(cols.format(*r) for r in rules), f"ob{mark}")


cte("p", "select distinct user_id, symbol_id from acc where user_id < 10", "acc")
obligations("", "cov")
ORACLES["obligation_samples"] = q("select user_id, symbol_id, from_ns, to_ns, steps, kind from br", "br")
ORACLES["obligation_summary"] = q("""
select user_id, symbol_id, samples, round(up, 4) as two_sided_uptime, up >= 0.95 as meets, coalesce(a, 0)::bigint as not_two_sided, coalesce(b, 0)::bigint as spread_too_wide, coalesce(c, 0)::bigint as size_too_small,
  (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0))::bigint as total
from (select user_id, symbol_id, sum(steps)::bigint as samples, sum(case when two_sided then steps else 0 end) / sum(steps) as up from ob group by all) left join (
  select user_id, symbol_id, sum(steps) filter (kind = 'not_two_sided') as a, sum(steps) filter (kind = 'spread_too_wide') as b, sum(steps) filter (kind = 'size_too_small') as c from br group by all) using (user_id, symbol_id)
""", "ob", "br")  # fmt: skip
# seconds are counted one by one: which of them lie in a load step follows from their own time
cte("sec", f"select unit_ns, covered, unit_ns + i * {_SEC} as t, covered + i as ix from cov, range(86400) r(i)", "cov")
cte("secstep", "select step, min(ix) as low, max(ix) + 1 as high from sec join steps10 on t between began and ended group by step", "sec", "steps10")
cte("spw", f"select step, spread_bps, least(covered + (from_ns - unit_ns) // {_SEC} + steps, high) - greatest(covered + (from_ns - unit_ns) // {_SEC}, low) as n from sp join cov using (unit_ns) join secstep on covered + (from_ns - unit_ns) // {_SEC} < high and covered + (from_ns - unit_ns) // {_SEC} + steps > low where spread_bps is not null", "sp", "cov", "secstep")
cte("spc", "select *, sum(n) over (partition by step order by spread_bps) as upto, sum(n) over (partition by step) as total from (select step, spread_bps, sum(n) as n from spw group by all)", "spw")
ORACLES["quality_by_step"] = q("""
select step, n::bigint as n, least, p50, p95, greatest, coalesce(a, 0)::bigint as not_two_sided, coalesce(b, 0)::bigint as spread_too_wide, coalesce(c, 0)::bigint as size_too_small from steps10
left join (select step, max(total) as n, min(spread_bps) as least, min(spread_bps) filter (upto > least(floor(0.5::double * total), total - 1)) as p50, min(spread_bps) filter (upto > least(floor(0.95::double * total), total - 1)) as p95, max(spread_bps) as greatest
  from spc group by step) using (step)
left join (select step, sum(m) filter (kind = 'not_two_sided') as a, sum(m) filter (kind = 'spread_too_wide') as b, sum(m) filter (kind = 'size_too_small') as c
  from (select step, kind, least(ix + steps, high) - greatest(ix, low) as m from br join secstep on ix < high and ix + steps > low) group by step) using (step)
""", "spc", "steps10", "br", "secstep")  # fmt: skip
ORACLES["maker_activity"] = q("""
select user_id, symbol_id, coalesce(p, 0) as placed, coalesce(c, 0) as cancelled, coalesce(position, 0) as position from (select user_id, symbol_id, count(*) as p from acc where user_id < 10 group by all)
full join (select user_id, symbol_id, count(*) as c from can where user_id < 10 group by all) using (user_id, symbol_id) full join (select * from pos where user_id < 10) using (user_id, symbol_id)
""", "acc", "can", "pos")  # fmt: skip
ORACLES["quote_panel"] = q("""
select user_id, symbol_id, fair, inventory, bid, greatest(bid + 1, mid + half) as ask, bid <> fair - half as requote from (
  select *, greatest(1, mid - half) as bid from (select *, fair - sign(inventory)::bigint * (fair * 25 * abs(inventory) // 1000000) as mid, greatest(1, fair * 25 // 10000) as half from (select user_id, symbol_id, px as fair, position as inventory from pos join lt using (symbol_id))))
""", "pos", "lt")  # fmt: skip
ORACLES["order_trace"] = q("""
select a.user_id, a.order_id as client_order_id, 1 as accept_hop_ms, coalesce(f, 0) as fills, ff - a.seq_ms as fill_hop_ms
from acc a left join (select order_id, count(*) filter (kind <> 'accept' and kind <> 'cancel') as f, min(seq_ms) filter (kind <> 'accept' and kind <> 'cancel') as ff from oev group by 1) using (order_id)
""", "acc", "oev")  # fmt: skip
ORACLES["ambiguous_client_ids"] = q("select k as client_order_id, count(distinct user_id) as users, count(*) as orders from base where event_type = 'view' group by 1 having count(distinct user_id) > 1", "base")
ORACLES["load_result"] = q(f"""
select step, attempted, accepted, limited, errors, other, received, timed, fastest, p50, p99, p999, slowest, round(accepted / ((ended - began - 3600000000000) / 1e9), 6) as achieved_per_s from (
  select step, began, ended, count(*) as attempted, count(*) filter (status = 202) as accepted, count(*) filter (status = 429) as limited, count(*) filter (status >= 500) as errors, count(*) filter (status not in (202, 429) and status < 500) as other,
         count(*) filter (k % 4 <> 0) as received, nullif(count(x), 0) as timed, min(x) as fastest, {_rank('x', .5)} as p50, {_rank('x', .99)} as p99, {_rank('x', .999)} as p999, max(x) as slowest
  from (select *, case when status = 202 then acked - intended end as x from smp) join steps10 on intended between began + 3600000000000 and ended group by all)
""", "smp", "steps10")  # fmt: skip
cte("fr", "select symbol_id, max(seq_ord) as fseq, ns // 3600000000000 as h from chg group by symbol_id, ns // 3600000000000", "chg")
cte("cd", "select a.symbol_id, a.seq_ord, f.fseq as frame_seq, h * 3600000000000 + 1800000000000 - a.ns as delay_ns from acc a asof left join fr f on f.symbol_id = a.symbol_id and a.seq_ord <= f.fseq", "acc", "fr")
ORACLES["conflation_delay"] = q("select * from cd", "cd")
ORACLES["update_delay"] = q(f"""
select user_id % 4 as clients, count(*) filter (delay_ns < 0) as negative, count(*) filter (delay_ns is null) as unmatched, nullif(count(delay_ns), 0) as n, min(delay_ns) as least, {_rank('delay_ns', .5)} as p50, {_rank('delay_ns', .99)} as p99, max(delay_ns) as greatest
from cd join acc using (symbol_id, seq_ord) group by 1
""", "cd", "acc")  # fmt: skip

# --- streams and archive ---------------------------------------------------
ORACLES["stream_tape"] = ORACLES["tape"]
_B = "select symbol_id, open_ns, open_ticks, high_ticks, low_ticks, close_ticks, volume, trades from bar where bucket_seconds = 3600 and "
ORACLES["stream_bars"] = q(_B + "open_ns + 3600000000000 <= (select max(ns) // 1000000 * 1000000 from fill)", "bar", "fill")
ORACLES["stream_bars_on_next_trade"] = q("select * exclude (bucket_seconds, closed) from (select *, " + _LATER + " as closed from bar where bucket_seconds = 3600) where closed", "bar")
ORACLES["stream_book"] = ORACLES["level_changes"]
ORACLES["stream_private"] = q("select user_id, row_number() over (partition by user_id order by seq_ord) as user_seq, seq_ord, event_type from base", "base")
ORACLES["stream_ledger"] = ORACLES["cash_balances"]
ORACLES["stream_gaps"] = ORACLES["sequence_verdicts"]
ORACLES["archive_scan"] = q("""
select name as symbol, strftime(make_timestamp(ns // 1000), '%Y-%m-%d') as date, seq_ord, price as price_ticks, qty from fill join sym using (symbol_id) where symbol_id in (2, 5) and ns >= 1704844800000000000 and ns < 1705708800000000000
""", "fill", "sym")  # fmt: skip

# --- encoded, filed and streamed again --------------------------------------
_NULL = "null::bigint"
ORACLES["decode_wire_log"] = q(f"""
select seq_ms, seq_ord, ns as timestamp_ns, 10 as record_type, 'OrderAccepted' as record, symbol_id::bigint as symbol_id, price as price_ticks, qty, {_NULL} as remaining_qty,
       order_id, user_id, {_NULL} as maker_order_id, {_NULL} as taker_order_id, {_NULL} as maker_user_id, {_NULL} as taker_user_id from acc
union all select seq_ms, seq_ord, ns, 12, 'Fill', symbol_id, price, qty, null, null, null, greatest(maker_oid, 0), greatest(taker_oid, 0), maker_uid, taker_uid from fill
union all select seq_ms, seq_ord, ns, 13, 'OrderCancelled', symbol_id, null, null, remaining_qty, greatest(order_id, 0), user_id, null, null, null, null from can
""", "acc", "fill", "can")  # fmt: skip
ORACLES["decode_quarantine"] = q("""
select seq_ms || '-' || seq_ord as stream_id, case seq_ord % 7 when 1 then 'schema_version' when 2 then 'record_type' when 3 then 'size' else 'short' end as reason
from base where event_type <> 'signup' and seq_ord % 7 in (1, 2, 3, 4, 5)
""", "base")  # fmt: skip
ORACLES["feed_frames_parse"] = q("""
select case when ok then 'tape' end as kind, case when ok then symbol_id::varchar end as subject, case when ok then seq_ms || '-' || seq_ord end as seq, case when ok then price end as price_ticks, case when ok then qty end as qty
from (select *, seq_ord % 9 <> 0 as ok from fill)
""", "fill")  # fmt: skip
ORACLES["breach_log_parse"] = q("select seq_ms // 1000 as at_s, case event_type when 'click' then 'unknown' else event_type end as kind from base where event_type <> 'error'", "base")
ORACLES["archive_stats"] = q("select name as symbol, count(distinct ns // 86400000000000) as files, true as filled from fill join sym using (symbol_id) group by 1", "fill", "sym")
ORACLES["bar_partition_audit"] = q("select symbol_id, open_ns, strftime(make_timestamp(open_ns // 1000 + 86400000000), '%Y-%m-%d') as date from bar where bucket_seconds = 3600 and open_ns % 7 = 3", "bar")
ORACLES["l2_frames"] = q("""
select symbol_id, from_ns, any_value(steps) as steps, count(*) filter (side = 1) as n_bids, count(*) filter (side = 2) as n_asks, max(price) filter (side = 1) as bid, min(price) filter (side = 2) as ask,
  coalesce(sum(qty) filter (side = 1), 0)::bigint as bid_qty, coalesce(sum(qty) filter (side = 2), 0)::bigint as ask_qty
from top5_ t join top5_l l using (symbol_id) where l.step = from_ns and rk <= 5 group by all
""", "top5_")  # fmt: skip
ORACLES["manifest"] = q("""
select symbol_id, minutes, lowest, j as manifest_json, substr(sha256(j), 1, 16) as manifest_id
from (select *, '{"lowest":' || lowest || ',"minutes":' || minutes || ',"symbol_id":' || symbol_id || '}' as j from (select symbol_id, count(*) as minutes, min(close_ticks) as lowest from hist group by 1))
""", "hist")  # fmt: skip
ORACLES["stream_house_fees"] = ORACLES["house_fees"]
ORACLES["stream_log"] = q("select seq_ms, seq_ord, ns as timestamp_ns, symbol_id, user_id, k, event_type, price as price_ticks from base", "base")
ORACLES["stream_dedupe"] = ORACLES["first_outcome_dedupe"]
# what the streams have sealed: days and windows that ended a second before the last event
_SEEN = "(select max(ns) // 1000000 * 1000000 - 1000000000 from base)"
cte("sealed", f"select * from cov where unit_ns + {_DAY} <= {_SEEN}", "cov", "base")
obligations("s", "sealed")
ORACLES["stream_obligations"] = q("select user_id, symbol_id, from_ns, to_ns, steps, kind from brs", "brs")
ORACLES["stream_uptime"] = q("select user_id, symbol_id, sum(steps)::bigint as quoted, sum(case when bq >= 20 and aq >= 20 then steps else 0 end)::bigint as full_size from twos group by all", "twos")
ORACLES["stream_conflated_book"] = q(f"""
select * from (select symbol_id, side, price as price_ticks, ns // 50000000 * 50000000 as window_ns, arg_max(qty, seq_ord) as qty, max(seq_ord) as seq_ord from chg group by all) where window_ns + 50000000 <= {_SEEN}
""", "chg", "base")  # fmt: skip
cte("jfirst", "select u, min(seq_ord) as f from jlog group by u", "jlog")
cte("jseal", """
select a.u, min(seal) as seal from jfirst a join (select u, f, (select min(z.f) from jfirst z where z.u > x.u) as seal from jfirst x) b on b.u >= a.u and b.f < b.seal group by a.u
""", "jfirst")  # fmt: skip
ORACLES["stream_late_rows"] = q("select u * 86400000000000 as unit_ns, count(*) as late from jlog join jseal using (u) where seq_ord > seal group by 1", "jlog", "jseal")
ORACLES["stream_archive"] = q("""
select name as symbol, seq_ord, price as price_ticks, qty from fill join sym using (symbol_id) join jlog using (seq_ord) join jseal using (u) where seq_ord <= seal
""", "fill", "sym", "jlog", "jseal")  # fmt: skip
ORACLES["stream_decode"] = ORACLES["decode_wire_log"]
ORACLES["stream_quarantine"] = ORACLES["decode_quarantine"]
cte("rsub", """
select user_id, seq_ord, (ns - 1000000) // 43200 as t, row_number() over (partition by user_id order by (ns - 1000000) // 43200, seq_ord) as rn from base where event_type in ('view', 'click')
""", "base")  # fmt: skip
cte("rfold", """
select user_id, rn, seq_ord, t, true as ok, 0::double as rest from rsub where rn = 1
union all select user_id, rn, seq_ord, t, tk >= 1.0, case when tk >= 1.0 then tk - 1.0 else tk end
from (select s.*, least(1.0::double, f.rest + greatest(0, s.t - f.t) / 1e9::double) as tk from rfold f join rsub s on s.user_id = f.user_id and s.rn = f.rn + 1)
""", "rsub")  # fmt: skip
ORACLES["rate_limit_audit"] = q("select user_id, seq_ord as client_order_id, ok as allowed from rfold", "rfold")

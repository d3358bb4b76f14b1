"""Integer arithmetic, ids, labels and formats as columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MAKER_BPS, TAKER_BPS, BPS = 2, 10, 10_000
# Enumerations of the log.
SIDES = {1: "BUY", 2: "SELL"}
TIFS = {1: "GTC", 2: "IOC"}
# Simulated minutes to their channel suffix.
MINUTE_LABELS = {1: "1m", 5: "5m", 15: "15m", 60: "1h", 240: "4h", 1440: "1d"}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def floor_div(a, b) -> Column:
    """Integer division that rounds down for any sign of `a`; `b` is positive."""
    a, b = _c(a), _c(b)
    return F.call_function("div", a - F.pmod(a, b), b)


def ceil_div(a, b) -> Column:
    return -floor_div(-_c(a), b)


def bucket(ns, width_ns) -> Column:
    """Start of the bucket that holds a time."""
    return _c(ns) - F.pmod(_c(ns), _c(width_ns))


def wrapped(n) -> Column:
    """A whole decimal number modulo 2^64, as the signed long of the same 64 bits; itself where it fits a long."""
    m = F.pmod(_c(n).cast("decimal(38,0)"), F.lit(Decimal(1 << 64)))
    return F.when(m >= F.lit(Decimal(1 << 63)), m - F.lit(Decimal(1 << 64))).otherwise(m).cast("long")


def fee(price, qty, bps: int) -> Column:
    """Fee of one side of a fill, rounded down."""
    return floor_div(_c(price) * _c(qty) * bps, BPS)


def buy_cost(price, qty) -> Column:
    """Cash a buy commits: notional and the taker's fee, rounded up for each unit."""
    return _c(qty) * (_c(price) + ceil_div(_c(price) * TAKER_BPS, BPS))


def stream_ms(stream_id) -> Column:
    return F.split_part(_c(stream_id), F.lit("-"), F.lit(1)).cast("long")


def stream_ord(stream_id) -> Column:
    """The number behind the dash; 0 where there is none."""
    return F.coalesce(F.nullif(F.split_part(_c(stream_id), F.lit("-"), F.lit(2)), F.lit("")).cast("long"), F.lit(0).cast("long"))


def width_label(bucket_seconds, ratio: int = 1) -> Column:
    """Channel suffix of a bucket width in simulated time."""
    minutes = floor_div(bucket_seconds, max(1, ratio))
    out = F.concat(minutes.cast("string"), F.lit("m"))
    for n, label in MINUTE_LABELS.items():
        out = F.when(minutes == n, F.lit(label)).otherwise(out)
    return F.when(minutes < 1, F.concat(_c(bucket_seconds).cast("string"), F.lit("s"))).otherwise(out)


def enum_name(value, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for n, name in names.items():
        out = F.when(_c(value) == n, F.lit(name)).otherwise(out)
    return out


def format_ticks(ticks, tick_size) -> Column:
    """Ticks as a decimal number with the digits of the size; an error without a size."""
    t, size = _c(ticks), _c(tick_size)
    digits = F.length(size.cast("string")) - 1
    whole, part = floor_div(F.abs(t), size), F.pmod(F.abs(t), size)
    tail = F.when(digits > 0, F.concat(F.lit("."), F.lpad(part.cast("string"), digits, "0"))).otherwise(F.lit(""))
    text = F.concat(F.when(t < 0, F.lit("-")).otherwise(F.lit("")), whole.cast("string"), tail)
    return F.when(size.isNull(), F.raise_error(F.lit("a price has no scale without a tick size")).cast("string")).otherwise(text)


def to_ticks(display, size) -> Column:
    return F.round(_c(display) * _c(size)).cast("long")


def utc_time(ns) -> Column:
    """Timestamp (microseconds) of a time in nanoseconds."""
    return F.timestamp_micros(floor_div(ns, 1000))


def utc_date(ns) -> Column:
    return F.date_format(utc_time(ns), "yyyy-MM-dd")


def unit_label(ns) -> Column:
    return F.date_format(utc_time(ns), "HHmmss")


def half_even(value) -> Column:
    """A decimal to the nearest integer, halves to the even one."""
    return F.bround(_c(value), 0).cast("long")


def grouped_ticks(ticks, tick_size, currency: bool = False, sign: bool = False) -> Column:
    """`format_ticks` for display: digits grouped by the last three and then by twos, on wish a rupee mark and a plus."""
    t = _c(ticks)
    plain = format_ticks(F.abs(t), tick_size)
    grouped = F.regexp_replace(F.substring_index(plain, ".", 1), r"(\d)(?=(\d\d)+\d$)", "$1,")
    mark = F.when(t < 0, F.lit("-")).when((t > 0) & F.lit(sign), F.lit("+")).otherwise(F.lit(""))
    tail = F.when(F.contains(plain, F.lit(".")), F.concat(F.lit("."), F.substring_index(plain, ".", -1))).otherwise(F.lit(""))
    return F.concat(mark, F.lit("₹" if currency else ""), grouped, tail)


def signed_percent(value, digits: int = 2) -> Column:
    """A percentage with its sign; zero has none."""
    return F.concat(F.when(_c(value) > 0, F.lit("+")).otherwise(F.lit("")), F.format_string(f"%.{digits}f%%", _c(value).cast("double")))


def tone(value) -> Column:
    return F.when(_c(value) > 0, "up").when(_c(value) < 0, "down").otherwise("flat")


def clock(ms) -> Column:
    """HH:mm:ss, in the session's time zone, of milliseconds since the epoch."""
    return F.date_format(F.timestamp_millis(_c(ms)), "HH:mm:ss")


def day_range_minutes(first_day, last_day) -> Column:
    """Days counted from 1, both ends in, as a struct of minutes [first, last); an error for a range that isn't one."""
    a, b = _c(first_day), _c(last_day)
    bad = a.isNull() | b.isNull() | (a < 1) | (b < a)
    minutes = F.struct(((a - 1) * 1440).cast("long").alias("first"), (b * 1440).cast("long").alias("last"))
    return F.when(bad, F.raise_error(F.lit("days must be 1 <= first <= last")).cast("struct<first:bigint,last:bigint>")).otherwise(minutes)


def hash_halves(digest_hex) -> Column:
    """The first 128 bits of a hex digest as a struct of two unsigned 64-bit numbers, (hi, lo)."""
    half = lambda at: F.conv(F.substring(_c(digest_hex), at, 16), 16, 10).cast("decimal(20,0)")
    return F.struct(half(1).alias("hi"), half(17).alias("lo"))

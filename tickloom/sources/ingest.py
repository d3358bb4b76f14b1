"""Raw inputs to typed rows: the binary log, feed frames, breach lines, files with digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The wire format, little-endian and packed.
SCHEMA_VERSION = 2
SIZES = {"u8": 1, "u16": 2, "i16": 2, "u64": 8, "i64": 8}
HEADER = "schema_version:u16 record_type:u16 seq_ms:u64 seq_ord:u64 timestamp_ns:i64"
RECORDS = {
    1: ("SubmitOrder", "client_order_id:u64 user_id:u64 price_ticks:i64 qty:i64 symbol_id:i16 side:u8 tif:u8"),
    2: ("CancelOrder", "client_order_id:u64 user_id:u64 target_client_order_id:u64"),
    3: ("CreateAccount", "client_order_id:u64 user_id:u64"),
    4: ("CreditCash", "client_order_id:u64 user_id:u64 amount_ticks:i64"),
    5: ("ConfigureReplay", "client_order_id:u64 real_seconds_per_simulated_minute:i64 config_hash_hi:u64 config_hash_lo:u64"),
    10: ("OrderAccepted", "order_id:u64 client_order_id:u64 user_id:u64 price_ticks:i64 qty:i64 symbol_id:i16 side:u8 tif:u8"),
    11: ("OrderRejected", "client_order_id:u64 user_id:u64 symbol_id:i16 reason:u16"),
    12: ("Fill", "maker_order_id:u64 taker_order_id:u64 maker_user_id:u64 taker_user_id:u64 price_ticks:i64 qty:i64 symbol_id:i16 aggressor_side:u8"),
    13: ("OrderCancelled", "order_id:u64 client_order_id:u64 user_id:u64 remaining_qty:i64 symbol_id:i16 reason:u8"),
    14: ("BookChanged", "price_ticks:i64 qty_at_level:i64 symbol_id:i16 side:u8"),
    15: ("AccountCreated", "client_order_id:u64 user_id:u64 initial_cash_ticks:i64"),
    16: ("CashCredited", "client_order_id:u64 user_id:u64 amount_ticks:i64"),
    17: ("ReplayConfigured", "client_order_id:u64 real_seconds_per_simulated_minute:i64 config_hash_hi:u64 config_hash_lo:u64"),
}
FRAME = "ch string, seq string, symbol string, price_ticks long, qty long, bids array<array<long>>, asks array<array<long>>, type string"


def _fields(spec: str, offset: int = 0) -> tuple[list[tuple[str, str, int]], int]:
    out = []
    for item in spec.split():
        name, kind = item.split(":")
        out.append((name, kind, offset))
        offset += SIZES[kind]
    return out, offset


def wire_size(record_type: int) -> int:
    return _fields(RECORDS[record_type][1], _fields(HEADER)[1])[1]


def _number(hexed: Column, kind: str, offset: int) -> Column:
    """A field as decimal(20,0) from the payload's hex digits, bytes put in order and the sign restored."""
    n = SIZES[kind]
    digits = F.concat(*[F.substring(hexed, 2 * (offset + i) + 1, 2) for i in reversed(range(n))])
    value = F.conv(digits, 16, 10).cast("decimal(20,0)")
    if kind[0] == "i":
        half, whole = F.lit(str(1 << (8 * n - 1))).cast("decimal(20,0)"), F.lit(str(1 << (8 * n))).cast("decimal(20,0)")
        value = F.when(value >= half, value - whole).otherwise(value)
    return value.cast("decimal(20,0)")


def encode_record(record_type: int, **values) -> Column:
    """The payload of one record as binary: columns by field name, header fields included; a field that is not named is zero."""
    parts = []
    for name, kind, _ in _fields(f"{HEADER} {RECORDS[record_type][1]}")[0]:
        known = {"schema_version": F.lit(SCHEMA_VERSION), "record_type": F.lit(record_type)}
        digits = F.lpad(F.hex(F.coalesce(known.get(name, values.get(name, F.lit(0))), F.lit(0)).cast("long")), 16, "0")
        parts += [F.substring(digits, 15 - 2 * i, 2) for i in range(SIZES[kind])]
    return F.unhex(F.concat(*parts))


def decode_wire_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) from (stream_id, payload).

    Records have one wide row with the union of all fields; the stream id
    gives seq_ms and seq_ord. Rows of another schema version, an unknown
    type, a wrong size or a null payload go to the quarantine with a reason.
    """
    from tickloom.functions.ticks import stream_ms, stream_ord

    head, size = _fields(HEADER)
    x = log.withColumn("h", F.hex("payload"))
    at = {name: (kind, off) for name, kind, off in head}
    version, rtype = (_number(F.col("h"), *at[n]).cast("int") for n in ("schema_version", "record_type"))
    sizes = F.create_map(*[F.lit(v) for t in RECORDS for v in (t, wire_size(t))])
    long_enough = F.coalesce(F.length("payload") >= size, F.lit(False))
    x = x.withColumn("schema_version", F.when(long_enough, version)).withColumn("record_type", F.when(long_enough, rtype))
    reason = (
        F.when(~long_enough, "short").when(F.col("schema_version") != SCHEMA_VERSION, "schema_version")
        .when(~F.col("record_type").isin(list(RECORDS)), "record_type").when(F.length("payload") != F.try_element_at(sizes, F.col("record_type")), "size")
    )
    x = x.withColumn("reason", reason)
    places: dict[str, list[tuple[int, str, int]]] = {}
    for t, (_, spec) in RECORDS.items():
        for name, kind, off in _fields(spec, size)[0]:
            places.setdefault(name, []).append((t, kind, off))
    cols = []
    for name, where in places.items():
        value = F.lit(None).cast("decimal(20,0)")
        for t, kind, off in where:
            value = F.when(F.col("record_type") == t, _number(F.col("h"), kind, off)).otherwise(value)
        wide = any(k == "u64" for _, k, _ in where)
        cols.append((value if wide else value.cast("long")).alias(name))
    names = F.create_map(*[F.lit(v) for t, (n, _) in RECORDS.items() for v in (t, n)])
    good = x.where("reason is null").select(
        "stream_id", stream_ms("stream_id").alias("seq_ms"), stream_ord("stream_id").alias("seq_ord"), _number(F.col("h"), *at["timestamp_ns"]).cast("long").alias("timestamp_ns"),
        "record_type", F.try_element_at(names, F.col("record_type")).alias("record"), *cols,
    )
    return good, x.where("reason is not null").select("stream_id", "payload", "reason")


def verify_files(spark: SparkSession, path: str, digests: DataFrame, name: str = r"([^/]*)$") -> DataFrame:
    """(name, expected, found, ok) of each recorded file under `path`; a missing file is not ok. `name` takes a file's name out of its path; a file has at most 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = files.select(F.regexp_extract("path", name, 1).alias("name"), F.sha2("content", 256).alias("found"))
    return digests.join(found, "name", "left").select("name", "expected", "found", F.coalesce(F.col("expected") == F.col("found"), F.lit(False)).alias("ok"))


def parse_frames(lines: DataFrame) -> DataFrame:
    """Feed frames as JSON text (`value`) to typed rows by channel kind and subject; broken lines have a null kind."""
    f = F.from_json("value", FRAME)
    x = lines.select("*", f.alias("f"))
    level = lambda c: F.transform(c, lambda a: F.struct(F.get(a, F.lit(0)).alias("price_ticks"), F.get(a, F.lit(1)).alias("qty")))
    ch = F.split("f.ch", ":")
    return x.select(F.get(ch, F.lit(0)).alias("kind"), F.get(ch, F.lit(1)).alias("subject"), "f.seq", "f.price_ticks", "f.qty", level("f.bids").alias("bids"), level("f.asks").alias("asks"), "f.type")


def parse_breaches(lines: DataFrame) -> DataFrame:
    """(at, kind) from text lines that report an obligation breach; lines without a time or readable JSON are dropped, a missing kind is unknown."""
    x = lines.where(F.col("value").contains("obligation_breach"))
    body = F.from_json(F.regexp_extract("value", r"(\{.*)$", 1), "kind string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    stamp = F.regexp_extract("value", r"(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)?)[^{]*\{", 1)
    ok = F.try_parse_json(F.regexp_extract("value", r"(\{.*)$", 1)).isNotNull()
    return x.where(ok).select(F.try_to_timestamp(F.nullif(stamp, F.lit(""))).alias("at"), F.coalesce(body["kind"], F.lit("unknown")).alias("kind")).where("at is not null")

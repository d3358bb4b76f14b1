"""The ledger's read model kept current batch by batch: accounts, positions, open orders and house fees.

Each table is cut in buckets of its key. A batch reads the buckets its keys
fall in, merges its changes and writes those buckets as `<table>/v=<batch>/
bucket=<k>`; a manifest of the batch says which version of each bucket
counts, so buckets without a change are carried on by name. A reader takes a
manifest and so sees one state of all four tables. A batch that runs again
starts from the manifest before it and writes the same files.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.ticks import utc_date
from tickloom.operators import ledger as L
from tickloom.sources import market as M

MANIFEST = "tbl string, bucket int, version long"
#: Columns of each table, and the key that deals its rows to buckets.
TABLES = {
    "accounts": ("user_id long, cash_ticks long, created boolean", "user_id"),
    "positions": ("user_id long, symbol_id int, position long", "user_id"),
    "open_orders": ("order_id long, user_id long, symbol_id int, side int, price_ticks long, qty long, remaining long", "order_id"),
    "house_fees": ("symbol_id int, date string, fees long, fills long", "symbol_id"),
}


def merged_accounts(before: DataFrame, accounts: DataFrame, legs: DataFrame) -> DataFrame:
    """A creation in the batch sets the balance and what comes after it adds; without one all adds to the balance before."""
    events = L.cash_events(accounts, legs)
    at = F.struct(*M.SEQ, "leg")
    since = events.where("created").groupBy("user_id").agg(F.max(at).alias("since"))
    counted = F.when(F.col("since").isNull() | (at >= F.col("since")), F.col("delta")).otherwise(0)
    g = events.join(since, "user_id", "left").groupBy("user_id").agg(F.sum(counted).alias("delta"), F.max(F.col("since").isNotNull()).alias("resets"))
    resets = F.coalesce("resets", F.lit(False))
    cash = F.coalesce("delta", F.lit(0)) + F.when(resets, 0).otherwise(F.coalesce("cash_ticks", F.lit(0)))
    return before.join(g, "user_id", "full").select("user_id", cash.cast("long").alias("cash_ticks"), (F.coalesce("created", F.lit(False)) | resets).alias("created"))


def merged_positions(before: DataFrame, legs: DataFrame) -> DataFrame:
    more = legs.select("user_id", "symbol_id", F.col("signed_qty").alias("position"))
    return before.unionByName(more).groupBy("user_id", "symbol_id").agg(F.sum("position").alias("position")).where("position <> 0")


def merged_orders(before: DataFrame, accepts: DataFrame, legs: DataFrame, cancels: DataFrame) -> DataFrame:
    """What fills and cancels after the acceptance leave; an order that reaches zero is gone for good, one that is not known is ignored."""
    cols = ["order_id", "user_id", "symbol_id", "side", "price_ticks", "qty"]
    none = F.struct(F.lit(-1).cast("long").alias("seq_ms"), F.lit(-1).cast("long").alias("seq_ord"))
    known = before.select(*cols, "remaining", none.alias("since")).unionByName(accepts.select(*cols, F.col("qty").alias("remaining"), F.struct(*M.SEQ).alias("since")))
    moves = legs.select("order_id", *M.SEQ, F.col("qty").alias("off")).unionByName(cancels.select("order_id", *M.SEQ, F.col("remaining_qty").alias("off")))
    off = moves.join(known.select("order_id", "since"), "order_id").where(F.struct(*M.SEQ) > F.col("since")).groupBy("order_id").agg(F.sum("off").alias("off"))
    left = F.col("remaining") - F.coalesce("off", F.lit(0))
    return known.join(off, "order_id", "left").withColumn("remaining", left).where("remaining > 0").select(*cols, "remaining")


def merged_fees(before: DataFrame, fills: DataFrame) -> DataFrame:
    from tickloom.functions.ticks import MAKER_BPS, TAKER_BPS, fee

    both = fee("price_ticks", "qty", MAKER_BPS) + fee("price_ticks", "qty", TAKER_BPS)
    more = fills.select("symbol_id", utc_date("timestamp_ns").cast("string").alias("date"), both.cast("long").alias("fees"), F.lit(1).cast("long").alias("fills"))
    return before.unionByName(more).groupBy("symbol_id", "date").agg(F.sum("fees").alias("fees"), F.sum("fills").alias("fills"))


class ReadModel:
    """The four tables under `folder`; `buckets` of each is fixed for its life."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(self.buckets)).cast("int")

    def manifest(self, version: int) -> dict[tuple[str, int], int]:
        """Version of each bucket that has one after batch `version`: tables times buckets at most."""
        if version < 0:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/v={version}").collect()
        return {(r["tbl"], r["bucket"]): r["version"] for r in rows}

    def read(self, name: str, version: int, only: set[int] | None = None) -> DataFrame:
        """A table as it is after batch `version`, or some buckets of it."""
        return self._rows(name, {b: v for (t, b), v in self.manifest(version).items() if t == name and (only is None or b in only)})

    def _rows(self, name: str, versions: dict[int, int]) -> DataFrame:
        schema, key = TABLES[name]
        paths = [f"{self.folder}/{name}/v={v}/bucket={b}" for b, v in sorted(versions.items())]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.where(F.col(key).isNotNull())  # the row that keeps a bucket without keys in being

    def apply(self, log: DataFrame, version: int) -> None:
        """Bring all tables up to date by one batch of the log's records, which come after those of the batches before."""
        log = log.persist()
        try:
            old = self.manifest(version - 1)
            accepts, fills, cancels = M.accepts(log), M.fills(log), M.cancels(log)
            legs, signups = L.fill_legs(fills), log.where("event_type = 'signup'")
            orders = [x.select("order_id") for x in (accepts, legs, cancels)]
            keys = {"accounts": [signups.select("user_id"), legs.select("user_id")], "positions": [legs.select("user_id")], "open_orders": orders, "house_fees": [fills.select("symbol_id")]}
            merges = {
                "accounts": lambda t: merged_accounts(t, M.account_records(log, t.where("created")), legs),
                "positions": lambda t: merged_positions(t, legs),
                "open_orders": lambda t: merged_orders(t, accepts, legs, cancels),
                "house_fees": lambda t: merged_fees(t, fills),
            }
            now = dict(old)
            dealt = [rows.select(F.lit(name).alias("tbl"), self._bucket(TABLES[name][1]).alias("b")) for name in TABLES for rows in keys[name]]
            found = reduce(DataFrame.unionByName, dealt).distinct().collect()  # tables times buckets at most
            touched = {name: {r["b"] for r in found if r["tbl"] == name} for name in TABLES}

            def merge(name: str) -> None:
                key, wanted = TABLES[name][1], touched[name]
                before = self._rows(name, {b: v for (t, b), v in old.items() if t == name and b in wanted})
                after = merges[name](before).select(*[F.col(f.name).cast(f.dataType) for f in before.schema]).withColumn("bucket", self._bucket(key))
                bare = self.spark.createDataFrame([(b,) for b in sorted(wanted)], "bucket int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in before.schema], "bucket")
                after.unionByName(bare).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/v={version}")

            with ThreadPoolExecutor(len(TABLES)) as pool:  # the tables don't depend on each other
                list(pool.map(merge, [name for name in TABLES if touched[name]]))
            now |= {(name, b): version for name in TABLES for b in touched[name]}
            rows = [(t, b, v) for (t, b), v in sorted(now.items())]
            self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/v={version}")
        finally:
            log.unpersist()

    def vacuum(self, version: int, keep: int = 2) -> int:
        """Delete bucket versions that none of the last `keep` manifests up to `version` names; returns how many."""
        live = {(t, b, v) for n in range(max(0, version - keep + 1), version + 1) for (t, b), v in self.manifest(n).items()}
        seen = {(t, b, v) for n in range(max(0, version - keep + 1)) if self._exists(n) for (t, b), v in self.manifest(n).items()}
        for t, b, v in seen - live:
            self._delete(f"{self.folder}/{t}/v={v}/bucket={b}")
        for n in range(max(0, version - keep + 1)):
            self._delete(f"{self.folder}/manifest/v={n}")
        return len(seen - live)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _exists(self, n: int) -> bool:
        path, fs = self._path(f"{self.folder}/manifest/v={n}")
        return fs.exists(path)

    def _delete(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def house_fees(self, version: int) -> DataFrame:
        """Fees by symbol and day, by symbol, and in all (nulls)."""
        f = self.read("house_fees", version)
        return f.groupingSets([["symbol_id", "date"], ["symbol_id"], []], "symbol_id", "date").agg(F.sum("fees").alias("fees"), F.sum("fills").alias("fills"))


def stream_read_model(log: DataFrame, model: ReadModel):
    """The model kept current by a stream of the log; each batch is a version."""
    return log.writeStream.foreachBatch(model.apply).option("checkpointLocation", f"{model.folder}/state").trigger(availableNow=True).start()


def last_version(query) -> int:
    """The last batch of an ended stream that had data."""
    done = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    return max(done, default=-1)

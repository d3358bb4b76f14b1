"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: code points that are not ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of an Arrow batch, and rows that are taken apart at once in Python.
BATCH = 4 << 20
SLICE = 250


#: Bytes of text that are taken apart at once in numpy.
CHUNK = 1 << 18


def _shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share.

    Only where the master is local, so that all run on this machine, a
    temporary folder may stand in for one that is not named.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder: they cut lineage as a checkpoint does, but are columns, compressed, and can be dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, f"{_shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        """Write `df` and read it again; what it shuffled is deleted at once, as nothing will ask for it."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        old = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(key, old) if old else self.spark.conf.unset(key)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing needs any more."""
        jvm = self.spark._jvm
        for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` as a lambda variable.

    A lambda that names an outer expression computes it again for each
    element; a bound variable is computed once a row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with batches of about BATCH bytes.

    Texts may be long, and a batch is held several times over by the JVM and
    by Python. Spark reads the bound when the plan runs, so it stays lowered
    in the session; it has no influence on results.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key)
    if not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= BATCH:
        df.sparkSession.conf.set(key, str(BATCH))
    return df.mapInArrow(run, schema)


def arrow_schema(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def digests(data, start, end, seed=None):
    """128 bits of hash, as two longs, of each data[start:end]; numpy arrays."""
    import numpy as np
    import xxhash

    view, digest = memoryview(data), xxhash.xxh3_128_digest
    seeds = [0] * len(start) if seed is None else seed.tolist()
    found = b"".join([digest(view[s:e], x) for s, e, x in zip(start.tolist(), end.tolist(), seeds, strict=True)])
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def text_groups(column):
    """The texts of a binary Arrow column, so many at a time that they have about CHUNK bytes: (number of the first, list)."""
    texts, first, size = [], 0, 0
    for i, cell in enumerate(column):
        t = cell.as_py()
        texts.append(t)
        size += len(t)
        if size > CHUNK:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts


def map_rows(df: DataFrame, start, schema: str) -> DataFrame:
    """Run Python over rows in Arrow batches.

    `start()` is called once a task and returns a function from one input
    row (a tuple; text as UTF-8 bytes where the column is binary) to an
    iterable of output tuples in the order of `schema`.
    """
    import pyarrow as pa

    out = arrow_schema(schema)

    def run(batches):
        row = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):  # few texts at a time are Python objects
                cols = [c.to_pylist() for c in batch.slice(at, SLICE).columns]
                got = [x for r in zip(*cols, strict=True) for x in row(*r)]
                for i in range(0, len(got), 20_000):
                    part = list(zip(*got[i : i + 20_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(part, out, strict=True)], schema=out)

    return map_batches(df, run, schema)


def text_bytes(column: str = "text"):
    """The text as UTF-8 bytes; null as none."""
    return text_or_empty(column).cast("binary")

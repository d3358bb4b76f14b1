"""Target-distribution importance resampling: hashed n-grams weigh each text by how much likelier the target makes it.

Texts are taken apart by Arrow kernels, a batch at a time: `ascii_lower`,
`split_pattern_regex`, `list_flatten` and `dictionary_encode` turn them into
one array of word codes. Codes shifted against each other form n-grams; each
distinct pair of a shorter n-gram and a word is hashed once, its CRC going on
from that of the shorter one, and `take` spreads the buckets to all places.
A first pass counts the buckets of both tables, a second sums the gains of
each text by segments.

Tables of `buckets` longs are the only thing that driver and tasks hold. The
draw is Gumbel top-k: highest weight plus seeded noise. The lowest drawn
score is found by narrowing a histogram, and only rows from there on are
sorted, by ranges.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, map_batches, text_or_empty

#: What lies between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Scores in a bin of the first histogram.
BIN = 256


def word_codes(texts) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text of each word, code of each word, words by code) of a string Arrow array."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BETWEEN)
    flat, text = pc.list_flatten(parts), pc.list_parent_indices(parts)
    is_word = pc.greater(pc.binary_length(flat), 0)  # a separator at an end leaves an empty part
    coded = pc.filter(flat, is_word).dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(flat.type) else pa.binary()).to_pylist()
    return pc.filter(text, is_word).to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64), words


def hashed_ngrams(texts, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each n-gram of 1 to max_n words, its bucket)."""
    text, word, words = word_codes(texts)
    n_words = np.bincount(text, minlength=len(texts))
    gram, crc = word, np.array([zlib.crc32(w) for w in words], np.int64)
    found_text, found = [text], [(crc % buckets)[gram] if len(crc) else gram]
    for n in range(2, max_n + 1):
        inside = text[: len(text) - n + 1] == text[n - 1 :]
        pair = gram[: len(inside)] * max(len(words), 1) + word[n - 1 :]
        distinct, at = np.unique(pair[inside], return_inverse=True)
        crc = np.array([zlib.crc32(b" " + words[p % len(words)], int(crc[p // len(words)])) for p in distinct.tolist()], np.int64)
        gram = np.zeros(len(inside), np.int64)  # places where no n-gram starts are not inside for longer ones either
        gram[inside] = at
        found_text.append(text[: len(inside)][inside])
        found.append((crc % buckets)[at] if len(crc) else at)
    return n_words, np.concatenate(found_text), np.concatenate(found)


def bucket_counts(texts: DataFrame, max_n: int, buckets: int) -> np.ndarray:
    """Occurrences of each bucket in all texts of a (text) table; each task sends one row a bucket at most."""
    out = arrow_schema("bucket int, n long")

    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(hashed_ngrams(b.column(0), max_n, buckets)[2], minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], schema=out)

    counts = np.zeros(buckets, np.int64)
    for r in map_batches(texts, run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target; one is added to each bucket."""
    rest, total = float(int(raw.sum()) + len(raw)), float(int(target.sum()) + len(target))
    return np.array([math.floor(1000 * math.log((float(t) + 1) * rest / ((float(s) + 1) * total))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id, text: str, seed: int) -> int:
    """Thousandths of a Gumbel draw from the id, or from the text where there is none."""
    name = f"null:{hashlib.sha256(text.encode()).hexdigest()}" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: np.ndarray, max_n: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of (doc_id, t)."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long, score long"
    out = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n_words, text, bucket = hashed_ngrams(b.column(1), max_n, len(gains))
            order = np.argsort(text, kind="stable")
            total = np.concatenate([[0], np.cumsum(gains[bucket[order]])])
            ends = np.searchsorted(text[order], np.arange(b.num_rows + 1))
            n = np.diff(ends)
            weight = np.where(n > 0, np.floor_divide(total[ends[1:]] - total[ends[:-1]], np.maximum(n, 1)), 0)
            drawn = np.array([noise(i, "" if i is not None else b.column(1)[k].as_py(), seed) for k, i in enumerate(b.column(0).to_pylist())], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(out.field(0).type), *(pa.array(c.astype(np.int64)) for c in (n_words, n, weight, weight + drawn))], schema=out)

    return map_batches(docs, run, schema)


def cut_of(eligible: DataFrame, percent: int) -> tuple[int, int | None]:
    """(rows to draw, lowest drawn score) by counting bins of scores, then the scores of one bin; scores lie within some 60,000, whatever the input."""
    bins = dict(eligible.groupBy(F.floor(F.col("score") / BIN).alias("b")).count().collect())
    draw = left = percent * sum(bins.values()) // 100
    if not draw:
        return 0, None
    for b in sorted(bins, reverse=True):
        if left <= bins[b]:
            break
        left -= bins[b]
    for score, n in sorted(eligible.where(F.floor(F.col("score") / BIN) == b).groupBy("score").count().collect(), reverse=True):
        if left <= n:
            break
        left -= n
    return draw, score


def _ranked(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """`rows` with their `rank` by score, highest first, then id: sorted by ranges, each numbered on from those before."""
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = scratch.table(placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = dict(placed.groupBy("part").count().collect())
    before = dict(zip(sorted(sizes), accumulate([0, *(sizes[p] for p in sorted(sizes))]), strict=False))
    if not before:
        return placed.select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    starts = F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)])
    return placed.select(*rows.columns, (starts[F.col("part")] + F.col("at") + 1).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, max_n: int = 2, buckets: int = 10_000, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of `docs`.

    Words are maximal runs without ASCII separators, A-Z lower-cased; features
    are all n-grams of 1 to max_n words, repeats counted. Of the texts with
    `min_words` words or more, `percent` in a hundred are drawn, those of the
    highest score; ranks count from 1, and are null for what is not drawn.
    Ties go to the smaller id, a null id last, and equal rows in any order,
    each with a rank of its own. A null or empty text has no words, weight 0
    and a score of its noise. A row without id draws its noise from its text.
    An empty target leaves the prior alone. Columns of `docs` beside id and
    text play no part.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    gains = gains_of(bucket_counts(d.select("t"), max_n, buckets), bucket_counts(target.select(text_or_empty(target_text_col).alias("t")), max_n, buckets))
    scratch = Scratch(docs.sparkSession, "resample")
    scored = scratch.table(weigh(d, gains, max_n, seed))
    eligible: Column = F.col("n_words") >= min_words
    draw, cut = cut_of(scored.where(eligible), percent)
    none = F.lit(None).cast("long").alias("rank")
    if not draw:
        return scored.select("*", none)
    high = eligible & (F.col("score") >= cut)
    ranked = _ranked(scratch, scored.where(high)).select(*scored.columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return scored.where(~high).select("*", none).unionByName(ranked)

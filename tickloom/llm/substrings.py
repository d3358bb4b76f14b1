"""Substring dedup: passages of words that a document of a smaller id holds too, found by difference-cover anchors.

A difference cover of a period v is a set of residues of which some two are
any distance apart. So for any two places of a text a shift below v brings
both on a place whose residue is in the cover. Windows of `length` words that
are equal thus share an anchor, a shorter window of length - v + 1 words,
that starts at a cover place in both texts by the same shift; only windows at
cover places are hashed, 6 of 31.

* Anchors that come once in the table are gone after a count of their hash.
* The others are extended to their context: all words of the windows that
  hold them. Anchors of one context share all these windows, so the smallest
  id in it settles them for all other ids at once. Copies of a text and
  passages that are long enough end here, however many there are.
* Anchors of one hash in unlike contexts share some windows or none: the
  windows around them are hashed each by itself, once in a document, and
  grouped.

Anchors are grouped by 64 bits of hash, which can only make work; contexts
and windows are compared by 128 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, digests, map_batches, map_rows, text_bytes

# Residues of perfect difference covers by their period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def cover_of(length: int) -> tuple[int, tuple[int, ...]]:
    """The longest period whose anchors still have two fifths of the window, and its cover."""
    return max((v, c) for v, c in COVERS.items() if 5 * (length - v + 1) >= 2 * length or v == 1)


def placed_words(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, where each starts and where each ends."""
    words = text.split()
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    return b" ".join(words), ends - size, ends


def anchor_places(n: int, length: int) -> np.ndarray:
    """Cover places of a text of n words at which an anchor starts that lies in a window."""
    v, cover = cover_of(length)
    if n < length:
        return np.zeros(0, np.int64)
    place = np.arange(n - (length - v + 1) + 1)
    return place[np.isin(place % v, cover)]


def window_range(place: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows that hold the anchors at `place`."""
    v, _ = cover_of(length)
    return np.maximum(place - v + 1, 0), np.minimum(place, n - length)


def _identity(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long"


def anchor_table(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, place, key): the anchors of (doc_id, th, t)."""
    schema = f"{_identity(docs)}, place int, key long"
    out = arrow_schema(schema)
    size = length - cover_of(length)[0] + 1

    def run(batches):
        import pyarrow as pa
        import xxhash

        hashed = xxhash.xxh3_64_intdigest
        for b in batches:
            for i, cell in enumerate(b.column(2)):
                data, starts, ends = placed_words(cell.as_py())
                place = anchor_places(len(starts), length)
                if not len(place):
                    continue
                view = memoryview(data)
                keys = np.array([hashed(view[s:e]) for s, e in zip(starts[place].tolist(), ends[place + size - 1].tolist(), strict=True)], np.uint64)
                row = pa.array(np.full(len(place), i))
                cols = [b.column(0).take(row).cast(out.field(0).type), b.column(1).take(row), pa.array(place.astype(np.int32)), pa.array(keys.view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, schema=out)

    return map_batches(docs.select("doc_id", "th", "t"), run, schema)


def _with_text(docs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """`docs` that have `rows`, with these as an array `at` of structs of `columns`."""
    per_doc = rows.groupBy(F.col("doc_id").alias("w"), F.col("th").alias("wh")).agg(F.collect_set(F.struct(*columns)).alias("at"))
    return docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("w")) & (F.col("th") == F.col("wh"))).select("doc_id", "th", "t", "at")


def context_table(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, key, place, first, stop, c1, c2): anchors with the words [first, stop) of all windows that hold them, hashed."""

    def start():
        def row(doc_id, th, t, at):
            data, starts, ends = placed_words(t)
            place, keys = np.array([x["place"] for x in at]), [x["key"] for x in at]
            first, last = window_range(place, len(starts), length)
            stop = last + length
            c = digests(data, starts[first], ends[stop - 1], place - first)
            columns = (x.tolist() for x in (place, first, stop, c[:, 0], c[:, 1]))
            return [(doc_id, th, k, *x) for k, x in zip(keys, zip(*columns, strict=True), strict=True)]

        return row

    return map_rows(texts, start, f"{_identity(texts)}, key long, place int, first int, stop int, c1 long, c2 long")


def window_table(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, first, w1, w2): each window that holds one of the anchors of a text, once."""

    def start():
        def row(doc_id, th, t, at):
            data, starts, ends = placed_words(t)
            low, high = window_range(np.array([x["place"] for x in at]), len(starts), length)
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, low, 1)
            np.add.at(edge, high + 1, -1)
            first = np.flatnonzero(np.cumsum(edge))
            w = digests(data, starts[first], ends[first + length - 1])
            return [(doc_id, th, *x) for x in zip(first.tolist(), w[:, 0].tolist(), w[:, 1].tolist(), strict=True)]

        return row

    return map_rows(texts, start, f"{_identity(texts)}, first int, w1 long, w2 long")


def _later() -> Column:
    """Whether the row's id comes after the smallest one; null comes last."""
    return F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, first, stop): spans of words in windows that also start in a text of a smaller id; spans may overlap."""
    scratch = Scratch(docs.sparkSession, "substrings")
    anchors = scratch.table(anchor_table(docs, length))
    shared = scratch.table(anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    live = scratch.table(anchors.join(shared, "key", "left_semi"))
    scratch.drop(anchors, shared)
    texts = scratch.table(_with_text(docs, live, "place", "key"))
    scratch.drop(live)
    contexts = scratch.table(context_table(texts, length))
    kinds = scratch.table(contexts.groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), F.min("key").alias("key")))
    mixed = scratch.table(kinds.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    judged = scratch.table(contexts.join(kinds.select("c1", "c2", "least"), ["c1", "c2"]).select("doc_id", "th", "key", "place", "first", "stop", _later().alias("later")))
    scratch.drop(contexts, kinds)
    unsettled = judged.where(~F.col("later")).join(mixed, "key", "left_semi")
    windows = scratch.table(window_table(_with_text(texts.drop("at"), unsettled, "place"), length))
    scratch.drop(texts)
    least = scratch.table(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null").drop("n"))
    found = windows.join(least, ["w1", "w2"]).where(_later()).select("doc_id", "th", "first", (F.col("first") + length).alias("stop"))
    return judged.where("later").select("doc_id", "th", "first", "stop").unionByName(found)


def joined_spans(spans) -> list[tuple[int, int]]:
    """Spans that touch or overlap made one."""
    out: list[list[int]] = []
    for first, stop in sorted((x["first"], x["stop"]) for x in spans or ()):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([first, stop])
    return [(a, b) for a, b in out]


def remove_passages(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, kept) for every row of `docs`.

    Words that lie in a window of `length` words whose sequence also starts in
    a row of a smaller id are taken out; `spans` are the maximal removed runs
    of words [first, stop) and `kept` the words left, joined by one space.
    Words are what ASCII white space separates. A null or empty text has no
    words. A null id comes after all others. Rows of one id take nothing from
    each other, so the copies with the smallest id stay, and so does what one
    text repeats. Columns of `docs` beside id and text play no part.
    """
    t = text_bytes(text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("t"))
    spans = repeated_spans(d.where(F.length("t") >= 2 * length - 1), length)
    per_doc = spans.groupBy(F.col("doc_id").alias("w"), F.col("th").alias("wh")).agg(F.collect_set(F.struct("first", "stop")).alias("at"))

    def start():
        def row(doc_id, t, at):
            words, spans = t.split(), joined_spans(at)
            stops = [0, *(b for _, b in spans)]
            kept = [w for a, (z, _) in zip(stops, [*spans, (len(words), 0)], strict=True) for w in words[a:z]]
            yield doc_id, len(words), spans, b" ".join(kept)

        return row

    rows = d.join(per_doc, F.col("doc_id").eqNullSafe(F.col("w")) & (F.col("th") == F.col("wh")), "left").select("doc_id", "t", "at")
    found = map_rows(rows, start, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words long, spans array<struct<first: int, stop: int>>, kept binary")
    return found.withColumn("kept", F.col("kept").cast("string"))

"""Suffix-array dedup: repeated strings of a fixed length by bucket-pointer refinement.

A suffix array is not needed as a whole: of each position only whether its
string of `length` bytes starts elsewhere too. So positions are sorted into
buckets that are refined until each is settled:

* First buckets: each string is filed under the smallest q-gram inside it,
  which neighbouring strings share, so that one row stands for a run of
  strings by their distances to the q-gram.
* A bucket with one row is settled: nothing in it repeats. Rows with the
  same bytes all around are settled too: all their strings repeat. One of
  them stays as partner for the rows that differ.
* What is left is refined. Rows are cut in nodes of ever fewer distances,
  64, 8 and 1, whose strings share ever more bytes, and each node's bucket
  is its row's bucket sorted further by the bucket identifiers of two later
  offsets, which cover the bytes that the node shares beyond its row.
  Identifiers of 2h bytes are made from those of h bytes at the offset and
  h later, so that each length reuses the one before.

Rounds work on ever fewer rows. Buckets are 64-bit identifiers, whose
collisions only leave more for the next round; that strings repeat is
decided by 128 bits of hash of all their bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, digests, map_batches, map_rows, text_bytes, text_groups

Q = 32
#: Distances in a node, by round, and bytes of the identifiers that refine its bucket: they cover the distances of the round before.
ROUNDS = ((64, 256), (8, 64), (1, 8))
LEFT, RIGHT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
PLACE = np.uint64(24)
PART = 1 << 18


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * LEFT + b * RIGHT
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    return h


class Buckets:
    """Bucket identifiers of every position, by string length; longer ones reuse the shorter."""

    def __init__(self, data: np.ndarray):
        self.ids = {1: _pair(data.astype(np.uint64), np.ones(1, np.uint64))}

    def of(self, length: int) -> np.ndarray:
        if length not in self.ids:
            half = 1 << ((length - 1).bit_length() - 1)
            b = self.of(half)
            self.ids[length] = _pair(b[: len(b) - (length - half)], b[length - half :])
        return self.ids[length]


def smallest_place(keys: np.ndarray, window: int) -> np.ndarray:
    """For each place the first of the smallest keys among the `window` keys from there on."""
    place = np.arange(len(keys), dtype=np.uint64)
    m = (keys >> PLACE << PLACE) | place
    size = 1
    while 2 * size <= window:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = window - size
    m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
    return (m & np.uint64((1 << 24) - 1)).astype(np.int64)


def anchored_runs(data: np.ndarray, ends: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of strings under one q-gram: its bucket, distance from the first string to it, first string, count, hash of all their bytes.

    `ends` has for each byte where its text ends; strings across texts don't count.
    """
    n = len(data) - length + 1
    if n <= 0:
        return {}
    keys = Buckets(data).of(min(Q, length))
    anchor = smallest_place(keys, length - min(Q, length) + 1)
    ok = np.arange(n) + length <= ends[:n]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1]) | (ends[1:n] != ends[: n - 1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    good = ok[first]
    first, count = first[good], count[good]
    at = anchor[first]
    w = digests(data, first, first + count - 1 + length, at - first)
    return {"key": keys[at].view(np.int64), "before": at - first, "run": first, "n": count, "w1": w[:, 0], "w2": w[:, 1]}


def _parts(texts: list[bytes], length: int):
    """Buffers of some whole texts, or of pieces of a long one that overlap by length - 1: (data, ends, text of each byte, offset of each text in the buffer)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    stops = np.cumsum(sizes)
    for a in range(0, max(len(data) - length + 1, 0), PART):
        b = min(len(data), a + PART + length - 1)
        text = np.searchsorted(stops, np.arange(a, b), side="right")
        yield data[a:b], stops[text] - a, text, a - (stops - sizes)


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def anchor_table(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, run, key, w1, w2, before, at, n): the first buckets, over all bytes of (doc_id, th, t); `run` is the first string's place."""
    schema = f"doc_id {_kind(docs)}, th long, run int, key long, w1 long, w2 long, before int, at int, n int"
    out = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, hashes = b.column(0), b.column(2)
            for first, texts in text_groups(b.column(1)):
                for data, ends, text, offset in _parts(texts, length):
                    r = anchored_runs(data, ends, length)
                    if not r:
                        continue
                    own = text[r["run"]]
                    row = pa.array(own + first)
                    cols = [ids.take(row), hashes.take(row), r["run"] + offset[own], r["key"], r["w1"], r["w2"], r["before"], np.zeros(len(own), np.int32), r["n"]]
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return map_batches(docs.select("doc_id", "t", "th"), run, schema)


def settle(scratch: Scratch, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled, open) of (doc_id, th, run, key, w1, w2, before, at, n).

    `settled`: (doc_id, th, first, n) of nodes that have a like one. `open`:
    of the buckets with unlike nodes one of each kind. Nodes are counted by
    bucket first, so that those alone in theirs are gone before they are
    grouped. The counts are tables of their own, so that a join can split a
    bucket that holds many rows.
    """
    sizes = scratch.table(nodes.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"))
    live = scratch.table(nodes.join(sizes, "key", "left_semi"))
    kinds = live.groupBy("key", "w1", "w2").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "th", "run", "before", "at", "n")).alias("one"))
    kinds = scratch.table(kinds)
    alike = live.join(kinds.where("copies > 1").select("key", "w1", "w2"), ["key", "w1", "w2"], "left_semi")
    mixed = scratch.table(kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key"))
    still = kinds.join(mixed, "key", "left_semi").select("one.*", "key")
    return alike.select("doc_id", "th", (F.col("run") + F.col("at")).alias("first"), "n"), still


def _contexts(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, run, key, before, at, n, bytes): the bytes of all strings of each open run."""
    per_doc = runs.groupBy(F.col("doc_id").alias("w"), F.col("th").alias("wh")).agg(F.collect_set(F.struct("run", "key", "before", "n")).alias("runs"))

    def start():
        def row(doc_id, th, t, runs):
            for r in runs:
                yield doc_id, th, r["run"], r["key"], r["before"], 0, r["n"], t[r["run"] : r["run"] + r["n"] - 1 + length]

        return row

    both = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("w")) & (F.col("th") == F.col("wh"))).select("doc_id", "th", "t", "runs")
    return map_rows(both, start, f"doc_id {_kind(docs)}, th long, run int, key long, before int, at int, n int, bytes binary")


def split_nodes(before: np.ndarray, at: np.ndarray, n: np.ndarray, size: int):
    """Nodes of `size` distances: (row, number, first string, count). String i of a row has the distance before - i."""
    high, low = (before - at) // size, (before - at - n + 1) // size
    per = high - low + 1
    row = np.repeat(np.arange(len(at)), per)
    number = np.repeat(high, per) - (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per))
    first = np.maximum(before[row] - (number * size + size - 1), at[row])
    end = np.minimum(before[row] - number * size + 1, (at + n)[row])
    return row, number, first, end - first


def refined(rows: DataFrame, length: int, size: int, covered: int) -> DataFrame:
    """The nodes of one round: from (doc_id, th, run, key, before, at, n, bytes) to the columns of `settle`."""
    schema = f"doc_id {_kind(rows)}, th long, run int, key long, w1 long, w2 long, before int, at int, n int"
    out = arrow_schema(schema)
    covered = min(covered, length - size + 1)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            numbers = [b.column(i).to_numpy() for i in range(2, 7)]
            for first, texts in text_groups(b.column(7)):
                data = np.frombuffer(b"".join(texts), np.uint8)
                base = np.cumsum([0] + [len(t) for t in texts[:-1]])
                _, key, before, at, n = (x[first : first + len(texts)] for x in numbers)
                row, number, f, c = split_nodes(before, at, n, size)
                ids = Buckets(data).of(covered)
                # bytes that all strings of the full node share, from its last string's first byte to its first string's last
                lo = base[row] + before[row] - number * size
                hi = lo - (size - 1) + length
                bucket = _pair(_pair(key[row].view(np.uint64), number.astype(np.uint64)), _pair(ids[lo], ids[hi - covered])).view(np.int64)
                w = digests(data, base[row] + f, base[row] + f + c - 1 + length, before[row] - f)
                at_row = pa.array(row + first)
                cols = [*(b.column(i).take(at_row) for i in range(3)), bucket, w[:, 0], w[:, 1], before[row], f, c]
                yield pa.RecordBatch.from_arrays([pa.array(x).cast(t.type) if isinstance(x, np.ndarray) else x.cast(t.type) for x, t in zip(cols, out, strict=True)], schema=out)

    return map_batches(rows.select("doc_id", "th", "run", "key", "before", "at", "n", "bytes"), run, schema)


def repeated_runs(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, first, n): all strings of `length` bytes that also start elsewhere, as runs of n from `first`; runs may come twice."""
    scratch = Scratch(docs.sparkSession, "suffix")
    anchors = scratch.table(anchor_table(docs, length))
    found, still = settle(scratch, anchors)
    contexts = rows = scratch.table(_contexts(docs, still, length))
    scratch.drop(anchors)
    for k, (size, covered) in enumerate(ROUNDS):
        size = min(size, 1 << (length.bit_length() - 3))
        nodes = scratch.table(refined(rows, length, size, covered))
        settled, still = settle(scratch, nodes)
        found = found.unionByName(settled)
        if k + 1 < len(ROUNDS):
            same = contexts.select("doc_id", "th", "run", "bytes").dropDuplicates(["doc_id", "th", "run"])
            on = still["doc_id"].eqNullSafe(same["doc_id"]) & (still["th"] == same["th"]) & (still["run"] == same["run"])
            rows = still.join(same, on).select(still["*"], same["bytes"])
    return found


def removed_spans(runs, length: int) -> list[list[int]]:
    """Maximal spans of bytes that the strings of the runs cover."""
    out: list[list[int]] = []
    for r in sorted((r["first"], r["n"]) for r in runs or ()):
        s, e = r[0], r[0] + r[1] - 1 + length
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row of `docs`.

    Bytes covered by a string of `length` bytes (at least Q) that also starts
    anywhere else in the table, same text included, are taken out; `spans`
    are the maximal removed runs [start, end) and `kept` the bytes that are
    left. Null is an empty text. A row is known by its id and its text, so
    rows with one id and different texts are apart, and equal rows are
    copies of each other. Columns of `docs` beside id and text play no part.
    """
    t = text_bytes(text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), t.alias("t"), F.xxhash64(t).alias("th"))
    runs = repeated_runs(d.where(F.length("t") >= length), length)
    per_doc = runs.groupBy(F.col("doc_id").alias("w"), F.col("th").alias("wh")).agg(F.collect_set(F.struct("first", "n")).alias("runs"))

    def start():
        def row(doc_id, t, runs):
            spans = removed_spans(runs, length)
            at, kept = 0, []
            for s, e in spans:
                kept.append(t[at:s])
                at = e
            kept.append(t[at:])
            yield doc_id, len(t), spans, b"".join(kept)

        return row

    rows = d.join(per_doc, F.col("doc_id").eqNullSafe(F.col("w")) & (F.col("th") == F.col("wh")), "left").select("doc_id", "t", "runs")
    return map_rows(rows, start, f"doc_id {_kind(d)}, n_bytes long, spans array<array<int>>, kept binary")

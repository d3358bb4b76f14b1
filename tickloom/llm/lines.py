"""Line dedup: exact copies by 128 bits of hash of each line, near copies by a segment-partition edit join.

Of two lines within `tau` byte edits of each other one has a segment, of
tau + 1, that stands unchanged in the other. Each line stores its segments
in an index by length and segment number and probes the indexes of its own
and smaller lengths with the substrings that can match; candidates are
verified by a banded bit-parallel edit distance.

Beyond that, long lines may differ in whole words (`word_edits`). Lines up
to WINNOWED words meet by segments of words in the same way; of longer ones
with few enough edits RUN words in a row stand unchanged, and of these both
lines pick the same GRAM_WORDS words (winnowing), so keys grow only in
proportion to the words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, digests, map_batches, map_rows, text_bytes, text_groups

_rng = np.random.default_rng(4)
BASES = [np.uint64(int(x) * 8 + 5) for x in _rng.integers(1 << 58, 1 << 60, 3)]
SALTS = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GRAM = np.uint64(int(_rng.integers(1 << 58, 1 << 60)) * 2 + 1)
#: Lines that a task remembers.
SEEN = 1 << 18
#: Word edits: none in lines under FEW words, one up to WINNOWED, one in PER words from there on.
FEW, WINNOWED, PER = 10, 40, 20
#: n words less n / PER edits, in n / PER + 1 runs: one run has at least RUN words if n >= WINNOWED.
GRAM_WORDS, RUN = 6, 13


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any substring of a buffer from its prefix sums; `base` is odd, so powers can be undone."""

    powers: dict = {}

    def __init__(self, data: np.ndarray, base: np.uint64):
        n = len(data)
        if len(self.powers.get(base, ((),))[0]) <= n:  # the same for every buffer
            size = 1 << max(12, (n + 1).bit_length())
            self.powers[base] = tuple(np.cumprod(np.full(size, b, np.uint64)) for b in (base, np.uint64(pow(int(base), -1, 1 << 64))))
        up, self.inverse = self.powers[base]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _scramble((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def line_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each \\n-split line."""
    cuts = np.flatnonzero(data == 10)
    return np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(data)]))


def gram_parities(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 parities of a line's byte pairs. One edit changes at most 4 of them."""
    pairs = (data[:-1].astype(np.uint64) << np.uint64(8)) | data[1:].astype(np.uint64)
    bits = np.uint64(1) << (_scramble(pairs * GRAM) >> np.uint64(58))
    runs = np.zeros(len(data) + 1, np.uint64)
    if len(bits):
        np.bitwise_xor.accumulate(bits, out=runs[1 : len(bits) + 1])
        runs[len(bits) + 1 :] = runs[len(bits)]
    return (runs[np.maximum(end - 1, start)] ^ runs[start]).view(np.int64)


def segment(length: np.ndarray, i: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Offset and size of segment i of tau + 1 even ones; the last ones are the longer."""
    small, rest = length // (tau + 1), length % (tau + 1)
    short = tau + 1 - rest
    return i * small + np.maximum(i - short, 0), small + (i >= short)


def segment_keys(h: Hashes, start: np.ndarray, end: np.ndarray, tau: int) -> tuple[list, list]:
    """(line numbers, keys) of the index entries and of the probes."""
    size = end - start
    lines = np.arange(len(start))
    key = lambda at, n, length, i: _scramble(h.of(at, at + n) * SALTS[i] + length.astype(np.uint64)).view(np.int64)
    index, probe = [], []
    for i in range(tau + 1):
        offset, n = segment(size, i, tau)
        index.append((lines, key(start + offset, n, size, i)))
        for shorter in range(tau + 1):  # the other line's length is size - shorter
            other = size - shorter
            offset, n = segment(other, i, tau)
            for move in range(-tau, tau + 1):
                # i edits at most lie before, tau - i behind, and both sides together keep within tau
                if abs(move) > i or abs(shorter - move) > tau - i:
                    continue
                at = offset + move
                ok = (at >= 0) & (at + n <= size) & (other > 0)
                probe.append((lines[ok], key(start[ok] + at[ok], n[ok], other[ok], i)))
    return index, probe


def edits_within(a: bytes, b: bytes, tau: int) -> bool:
    """Whether the edit distance of two byte strings is at most tau.

    Bit-parallel in a band of 2 tau + 1 diagonals: bit d of row e tells which
    diagonals reach their furthest point with e edits; runs of equal bytes
    are skipped by comparing slices.
    """
    if abs(len(a) - len(b)) > tau:
        return False
    if a == b:
        return True
    # common ends never need an edit
    n = min(len(a), len(b))
    lo = _common(a, b, n)
    a, b = a[lo:], b[lo:]
    n = min(len(a), len(b))
    hi = _common(a[::-1], b[::-1], n)
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    if not a or not b:
        return max(len(a), len(b)) <= tau
    # Myers' vectors over the band: positions of b around the diagonal are bits
    width = 2 * tau + 1
    mask = (1 << width) - 1
    state = [((1 << (e + 1)) - 1) << tau & mask for e in range(tau + 1)]  # e insertions of b before any byte of a
    for i, byte in enumerate(a):
        equal = 0
        for d in range(width):
            j = i + d - tau
            if 0 <= j < len(b) and b[j] == byte:
                equal |= 1 << d
        before = None
        for e in range(tau + 1):
            old = state[e]
            new = old & equal
            if before is not None:
                was, now = before
                new |= was | was >> 1 | now << 1
            new &= mask
            before = old, new
            state[e] = new
        if not new:  # no diagonal is left with tau edits
            return False
    end = len(b) - len(a) + tau
    return 0 <= end < width and bool(state[tau] >> end & 1)


def _common(a: bytes, b: bytes, n: int) -> int:
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _lines(texts: list[bytes]):
    """All lines of some texts in one buffer: data, row of each line, its number in the text, start, end."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    start, end = line_bounds(data)
    per_text = np.array([t.count(b"\n") + 1 for t in texts])
    row = np.repeat(np.arange(len(texts)), per_text)
    return data, row, np.arange(len(start)) - np.repeat(np.cumsum(per_text) - per_text, per_text), start, end


def word_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Letters, digits and bytes of other code points in each line."""
    lower = data | 32
    runs = np.concatenate(([0], np.cumsum((data > 127) | (data >= 48) & (data <= 57) | (lower >= 97) & (lower <= 122))))
    return runs[end] - runs[start]


def word_edits(n: int) -> int:
    """Word edits within which two lines are near, by the words of the shorter."""
    return max(1, n // PER) if n >= FEW else 0


def near_lines(a: bytes, b: bytes, tau: int, words: bool) -> bool:
    """Whether two lines are within tau byte edits or, with `words`, within the word edits of the shorter."""
    if edits_within(a, b, tau):
        return True
    if not words:
        return False
    a, b = a.split(), b.split()
    few = word_edits(min(len(a), len(b)))
    return few > 0 and edits_within(a, b, few)


def word_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are not ASCII white space."""
    inside = np.concatenate(([False], (data != 32) & ((data < 9) | (data > 13)), [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


def winnowed(h: Hashes, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line numbers, keys): the least hash of GRAM_WORDS words in each RUN words of each line of WINNOWED words or more."""
    lines = np.flatnonzero(last - first >= WINNOWED)
    if not len(lines):
        return lines, np.zeros(0, np.int64)
    at = np.arange(len(h.sums) - GRAM_WORDS)
    grams = _scramble(h.of(at, at + GRAM_WORDS) * SALTS[-1])
    wide = np.lib.stride_tricks.sliding_window_view(grams, RUN - GRAM_WORDS + 1)
    per = last[lines] - first[lines] - RUN + 1
    line = np.repeat(lines, per)
    window = np.arange(len(line)) - np.repeat(np.cumsum(per) - per, per) + first[line]
    least = wide[window].min(axis=1).view(np.int64)
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (line[1:] != line[:-1])))
    return line[new], least[new]


def word_parities(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each line and 256 parities of them, four longs a line."""
    ws, we = word_starts(data)
    first, last = np.searchsorted(ws, start), np.searchsorted(ws, end)
    at = _scramble(Hashes(data, BASES[1]).of(ws, we) * GRAM) >> np.uint64(56)
    out = np.zeros((len(start), 4), np.int64)
    for k in range(4):
        bits = np.where(at >> np.uint64(6) == k, np.uint64(1) << (at & np.uint64(63)), np.uint64(0))
        runs = np.concatenate(([np.uint64(0)], np.bitwise_xor.accumulate(bits)))
        out[:, k] = (runs[last] ^ runs[first]).view(np.int64)
    return (last - first).astype(np.int32), out


def word_table(docs: DataFrame, least: int) -> DataFrame:
    """(key, h): keys by words of the distinct lines of each task."""
    schema = "key long, h long"

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for b in batches:
            for _, texts in text_groups(b.column(0)):
                data, _, _, start, end = _lines(texts)
                ws, we = word_starts(data)
                first, last = np.searchsorted(ws, start), np.searchsorted(ws, end)
                big = np.flatnonzero((end - start >= least) & (last - first >= FEW))
                ids, once = np.unique(digests(data, start[big], end[big])[:, 0], return_index=True)
                new = np.fromiter((i not in seen for i in ids.tolist()), bool, len(ids))
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(ids[new].tolist())
                first, last, ids = first[big[once[new]]], last[big[once[new]]], ids[new]
                h = Hashes(Hashes(data, BASES[1]).of(ws, we), BASES[2])
                few = np.flatnonzero(last - first <= WINNOWED)
                # probes of a line's own length are what it stores
                out = [(few[lines], keys) for lines, keys in segment_keys(h, first[few], last[few], 1)[1]]
                for lines, keys in (*out, winnowed(h, first, last)):
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids[lines], pa.int64())], names=["key", "h"])

    return map_batches(docs.select("t"), run, schema)


def word_buckets(docs: DataFrame, least: int, places: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, at, words, p): the lines under each key that several lines share; `places` are (h1, at, words, p)."""
    entries = scratch.table(word_table(docs, least))
    shared = scratch.table(entries.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("key"))
    met = entries.join(shared, "key").distinct()
    return scratch.table(met.join(places, met["h"] == places["h1"]).select("key", "at", "words", "p"))


def word_pairs(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """(x, y): places of lines of one key, x first, that may be within their word edits.

    An edit changes two parities at most, or one and the number of words.
    """
    x, y = (t.select("key", *[F.col(c).alias(f"{c}_{i}") for c in ("at", "words", "p")]) for i, t in enumerate((earlier, later)))
    few = F.greatest(F.lit(1), F.floor(F.least("words_0", "words_1") / PER))
    apart = F.abs(F.col("words_0") - F.col("words_1"))
    for k in range(4):
        apart += F.bit_count(F.col("p_0")[f"p{k}"].bitwiseXOR(F.col("p_1")[f"p{k}"]))
    return x.join(y, "key").where((F.col("at_0") < F.col("at_1")) & (apart <= 2 * few)).select(F.col("at_0").alias("x"), F.col("at_1").alias("y")).distinct()


def line_table(docs: DataFrame, least: int, short: bool = False, words: bool = False) -> DataFrame:
    """(doc_id, th, line, n, h1, h2, sig) from (doc_id, th, t): every line of at least `least` bytes and, if `short`, every shorter one that holds a letter or digit.

    `n` are its bytes, h1 and h2 128 bits of hash, `sig` 64 parities; with
    `words` also its words and 256 parities of them, p0 to p3.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, th long, line int, n int, h1 long, h2 long, sig long"
    schema += ", words int, p0 long, p1 long, p2 long, p3 long" if words else ""
    out = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for first, texts in text_groups(b.column(2)):
                data, row, number, start, end = _lines(texts)
                taken = end - start >= least
                if short:
                    taken |= word_bytes(data, start, end) > 0
                row, number, start, end = row[taken], number[taken], start[taken], end[taken]
                h = digests(data, start, end)
                at = pa.array(row + first)
                cols = [b.column(0).take(at), b.column(1).take(at), number.astype(np.int32), (end - start).astype(np.int32), h[:, 0], h[:, 1], gram_parities(data, start, end)]
                if words:
                    many, p = word_parities(data, start, end)
                    cols += [many, *p.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), type=f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return map_batches(docs.select("doc_id", "th", "t"), run, schema)


def segment_table(docs: DataFrame, least: int, tau: int, probing: bool) -> DataFrame:
    """(key, sig): index entries or probes of the distinct lines of each task, dealt out by key and made distinct there."""
    schema = "key long, sig long"

    def run(batches):
        import pyarrow as pa

        seen: set[bytes] = set()
        for b in batches:
            for _, texts in text_groups(b.column(0)):
                data, _, _, start, end = _lines(texts)
                big = np.flatnonzero(end - start >= least)
                h = Hashes(data, BASES[2])
                raw = digests(data, start[big], end[big]).tobytes()
                if len(seen) > SEEN:
                    seen.clear()
                known, new = len(seen), []
                for i in range(len(big)):
                    seen.add(raw[16 * i : 16 * i + 16])
                    if len(seen) > known:
                        known += 1
                        new.append(i)
                big = big[new]
                sig = gram_parities(data, start[big], end[big])
                for lines, keys in segment_keys(h, start[big], end[big], tau)[probing]:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sig[lines], pa.int64())], names=["key", "sig"])

    return map_batches(docs.select("t"), run, schema).repartition("key").distinct()


def duplicate_lines(docs: DataFrame, tau: int, least: int, short: bool = False, words: bool = False) -> DataFrame:
    """(doc_id, th, line) of the lines that have an earlier copy or near copy, from (doc_id, th, t); a line may come twice."""
    scratch = Scratch(docs.sparkSession, "lines")
    place = F.struct("doc_id", "th", "line")
    lines = scratch.table(line_table(docs, least, short, words))
    by_words = ["words", "p0", "p1", "p2", "p3"] if words else []
    known = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("sig").alias("sig"), *[F.min(c).alias(c) for c in by_words])
    firsts = scratch.table(known)
    copies = lines.join(firsts.where("copies > 1").select("h1", "h2", "first"), ["h1", "h2"]).where(place != F.col("first")).select("doc_id", "th", "line")

    keys = segment_table(docs, least, tau, False)
    probes = segment_table(docs, least, tau, True).withColumnRenamed("sig", "other")
    close = F.bit_count(F.col("sig").bitwiseXOR(F.col("other"))) <= 4 * tau
    pairs = keys.join(probes, "key").where(close & (F.col("sig") != F.col("other")))
    pairs = scratch.table(pairs.select(F.least("sig", "other").alias("s"), F.greatest("sig", "other").alias("o")).distinct())

    long = firsts.where(F.col("n") >= least)
    side = lambda key, as_key, name: long.select(F.col(key).alias(as_key), F.col("first").alias(name), F.col("n").alias(f"n_{name}"))
    twins = scratch.table(long.groupBy("sig").count().where("count > 1").select(F.col("sig").alias("s"), F.col("sig").alias("o")))
    met = pairs.unionByName(twins).join(side("sig", "s", "x"), "s").join(side("sig", "o", "y"), "o").where(F.abs(F.col("n_x") - F.col("n_y")) <= tau).select("x", "y")
    asked = met.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    if not words:
        near = _confirmed(docs, scratch.table(asked), tau, False).select("y")
        return copies.union(near.select("y.doc_id", "y.th", "y.line"))

    # An earlier near line is enough for a line to go, so lines meet the first of each of their keys;
    # only those that stay after that meet the other earlier ones.
    places = long.select("h1", F.col("first").alias("at"), "words", F.struct(*by_words[1:]).alias("p"))
    buckets = word_buckets(docs, least, places, scratch)
    heads = buckets.groupBy("key").agg(F.min(F.struct("at", "words", "p")).alias("u")).select("key", "u.*")
    asked = scratch.table(asked.union(word_pairs(heads, buckets)).distinct())
    gone = scratch.table(_confirmed(docs, asked, tau, True).select("y").distinct())
    left = buckets.join(gone, buckets["at"] == gone["y"], "left_anti")
    others = word_pairs(buckets, left).join(asked, ["x", "y"], "left_anti")
    near = gone.union(_confirmed(docs, scratch.table(others), tau, True).select("y"))
    return copies.union(near.select("y.doc_id", "y.th", "y.line"))


def _confirmed(docs: DataFrame, pairs: DataFrame, tau: int, words: bool) -> DataFrame:
    """The pairs (x, y) of line places whose lines are near."""
    places = pairs.select("x").union(pairs.select(F.col("y").alias("x"))).distinct()
    per_doc = places.groupBy(F.col("x.doc_id").alias("w"), F.col("x.th").alias("wh")).agg(F.collect_set("x.line").alias("wanted"))

    def pick():
        def row(doc_id, th, t, wanted):
            lines = t.split(b"\n")
            for i in wanted:
                yield {"doc_id": doc_id, "th": th, "line": i}, lines[i]

        return row

    place = pairs.schema["x"].dataType.simpleString()
    texts = map_rows(_with(docs, per_doc, "inner").select("doc_id", "th", "t", "wanted"), pick, f"x {place}, t binary")

    def check():
        def row(x, y, a, b):
            if near_lines(a, b, tau, words):
                yield x, y

        return row

    texts = texts.dropDuplicates(["x"])  # equal rows hold equal lines
    both = pairs.join(texts.withColumnRenamed("t", "a"), "x").join(texts.withColumnRenamed("x", "y").withColumnRenamed("t", "b"), "y")
    return map_rows(both.select("x", "y", "a", "b"), check, f"x {place}, y {place}")


def _with(docs: DataFrame, per_doc: DataFrame, how: str) -> DataFrame:
    """Rows (doc_id, th, ..) with what `per_doc` has under (w, wh)."""
    return docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("w")) & (F.col("th") == F.col("wh")), how)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = text_bytes(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("t"))


def dedup_lines(docs: DataFrame, tau: int = 2, least: int = 30, id_col: str = "doc_id", text_col: str = "text", short: bool = False, words: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text) for every row of `docs` with its whole text.

    Lines are \\n-split. One of at least `least` bytes is removed if an
    earlier line, by (doc_id, hash of the text, place), has the same bytes or
    lies within `tau` byte edits of it, itself removed or not. Shorter lines
    stay, but with `short` those that hold a letter or digit go if an earlier
    line has the same bytes. With `words` a line of at least `least` bytes
    goes also if an earlier one is within `word_edits` of the shorter of
    both: one word, from 10 words on, or 5 % of the words from 40 on. Null
    and empty texts have one empty line. A null id comes before all others.
    A row is known by its id and its text: rows with one id and different
    texts are apart, equal rows are one document and lose the same lines.
    Other columns of `docs` play no part.
    """
    d = _keyed(docs, id_col, text_col)
    drop = duplicate_lines(d, tau, least, short, words).groupBy(F.col("doc_id").alias("w"), F.col("th").alias("wh")).agg(F.collect_set("line").alias("gone"))

    def start():
        def row(doc_id, t, gone):
            lines = t.split(b"\n")
            gone = set(gone or ())
            kept = [x for i, x in enumerate(lines) if i not in gone]
            yield doc_id, len(lines), len(lines) - len(kept), b"\n".join(kept).decode()

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(_with(d, drop, "left").select("doc_id", "t", "gone"), start, f"doc_id {kind}, n_lines long, n_removed long, kept_text string")


def drop_duplicate_lines(docs: DataFrame, tau: int = 2, least: int = 30, id_col: str = "doc_id", text_col: str = "text", short: bool = False, words: bool = False) -> DataFrame:
    """The rows of `docs` with their columns and the text that is left, by the rules of `dedup_lines`. Rows that lost lines and have no word left go."""
    drop = duplicate_lines(_keyed(docs, id_col, text_col), tau, least, short, words)
    drop = drop.groupBy(F.col("doc_id").alias("_lines_of"), F.col("th").alias("_lines_hash")).agg(F.collect_set("line").alias("_lines_gone"))
    same = docs[id_col].eqNullSafe(drop["_lines_of"]) & (F.xxhash64(text_bytes(text_col)) == drop["_lines_hash"])
    gone, text = drop["_lines_gone"], docs[text_col]
    kept = F.when(gone.isNotNull(), F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")).otherwise(text)
    rows = docs.join(drop, same, "left").where(gone.isNull() | kept.rlike("[^\\x20\\x09-\\x0D]"))
    return rows.select(*[kept.alias(c) if c == text_col else docs[c] for c in docs.columns])

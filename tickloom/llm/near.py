"""MinHash near-duplicates with b-bit signatures, and links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, map_rows, text_bytes

SHINGLE = 5
BANDS, ROWS = 32, 4
HASHES = 2 * BANDS * ROWS  # the bands take the first half, estimates take all
BITS = 4
PER_LONG = 64 // BITS
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD_CACHE = 1_000_000
#: Bytes of the texts that are compared with one hub in one place, or so many times the hub's own.
SLOT, PER_HUB = 1 << 18, 8

_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
MIX = _rng.integers(1, 1 << 63, max(ROWS, SHINGLE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_SALT = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; fewer words are one shingle, none an empty set."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    last = len(words) - n + 1
    h = np.full(last, n, np.uint64)
    for i in range(n):
        h = h * MIX[i] + w[i : i + last]
    return np.unique(_scramble(h))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over a set, in pieces that fit the cache."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        part = shingles[None, i : i + 512] * MULTIPLY[:, None]
        part += ADD[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    return _scramble((mins[: BANDS * ROWS].reshape(BANDS, ROWS) * MIX[:ROWS]).sum(axis=1, dtype=np.uint64) ^ BAND_SALT).view(np.int64)


def packed_bits(mins: np.ndarray) -> np.ndarray:
    """The kept bits of each minimum, packed in longs."""
    low = ((mins >> np.uint64(40)) & np.uint64((1 << BITS) - 1)).reshape(-1, PER_LONG)
    return (low << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, set_key, bands, bits) from (doc_id, th, t); `set_key` is 128 bits of hash of the shingle set, null if it is empty."""

    def start():
        hashes = WordHashes()

        def row(doc_id, th, t):
            s = shingle_set(t, hashes)
            if not len(s):
                yield doc_id, th, 0, None, None, None
            else:
                m = minima(s)
                yield doc_id, th, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), band_keys(m).tolist(), packed_bits(m).tolist()

        return row

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "th", "t"), start, f"doc_id {kind}, th long, n_shingles long, set_key binary, bands array<long>, bits array<long>")


def estimated_similarity(a: Column, b: Column) -> Column:
    """Share of equal packed values, corrected for the 1 in 2^b that agree by chance."""
    ones = sum(1 << (BITS * i) for i in range(PER_LONG))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones
    differ = F.lit(0)
    for k in range(HASHES // PER_LONG):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        y = x
        for i in range(1, BITS):
            y = y.bitwiseOR(F.shiftrightunsigned(x, i))
        differ = differ + F.bit_count(y.bitwiseAND(F.lit(ones)))
    chance = 1.0 / (1 << BITS)
    return (1 - differ / HASHES - chance) / (1 - chance)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node each node reaches, from (a, b). Nodes are of any type that has an order.

    Each round every node takes the smallest label around it, then that
    label's own label; a long chain takes a logarithm of its length. Labels
    live in checkpoints, never on the driver.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).where(F.col("a") != F.col("b")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        near = labels.join(around, "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        new = checkpointed(near.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("component")))
        labels = new.select("node", "component")
        if not new.where(F.col("old") != F.col("component")).limit(1).count():
            return labels


def linked(both, x, y, percent: int):
    """100 * intersection >= percent * union, from the size of the intersection and of both sets."""
    return 100 * both >= percent * (x + y - both)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, edits: bool = False) -> DataFrame:
    """The (a, b) whose full shingle sets are linked; `texts` are (node, t, n_bytes).

    The members b of one a are dealt out to slots of SLOT bytes, or of some
    times the text of a if that is longer. The text of a is sent once to each
    slot, ahead of its members, so no row holds both texts and a task holds
    one set beside the batch it reads, however many members there are.

    With `edits` every pair comes, with `is_link`, the sizes of both sets and
    the shingles that b adds to and removes from those of a.
    """

    def start():
        hashes = WordHashes()
        hub = [None, None]

        def row(a, b, t):
            if b is None:
                if hub[0] != a:
                    hub[:] = [a, shingle_set(t, hashes)]
                return
            x, y = hub[1], shingle_set(t, hashes)
            both = len(np.intersect1d(x, y, assume_unique=True))
            link = bool(both) and linked(both, len(x), len(y), percent)
            if edits:
                added, removed = np.setdiff1d(y, x, True), np.setdiff1d(x, y, True)
                yield a, b, link, len(x), len(y), added.view(np.int64).tolist(), removed.view(np.int64).tolist()
            elif link:
                yield a, b

        return row

    side = lambda name, *more: texts.select(F.col("node").alias(name), *more)
    size = pairs.join(side("b", "n_bytes"), "b").groupBy("a").agg(F.sum("n_bytes").alias("met"))
    room = F.greatest(F.lit(SLOT), PER_HUB * F.col("n_bytes"))
    slots = size.join(side("a", "n_bytes"), "a").select("a", F.ceil(F.greatest(F.col("met"), F.lit(1)) / room).cast("int").alias("slots"))
    members = pairs.join(slots, "a").select("a", F.pmod(F.xxhash64("b"), F.col("slots")).cast("int").alias("slot"), "b").join(side("b", "t"), "b")
    hubs = slots.join(side("a", "t"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "t")
    rows = hubs.unionByName(members).repartition("a", "slot").sortWithinPartitions("a", "slot", F.col("b").isNotNull())
    kind = pairs.schema["a"].dataType.simpleString()
    more = ", is_link boolean, n_a int, n_b int, added array<long>, removed array<long>" if edits else ""
    return map_rows(rows.select("a", "b", "t"), start, f"a {kind}, b {kind}{more}")


def _groups(d: DataFrame, percent: int, slack: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n_shingles, set_key) of every row of (doc_id, th, t), and (set_key, component) of every shingle set.

    Nodes are shingle sets, known by their 128-bit `set_key`, so rows that
    share an id, or have none, take part each with its own text.
    """
    scratch = Scratch(d.sparkSession, "near")
    sigs = scratch.table(signatures(d))
    full = sigs.where(F.col("n_shingles") > 0)
    classes = scratch.table(full.groupBy(F.col("set_key").alias("rep")).agg(F.min(F.struct("doc_id", "th")).alias("one"), F.first("bands").alias("bands"), F.first("bits").alias("bits")))
    reps = classes.select("rep", "bits")
    members = classes.select("rep", F.explode("bands").alias("band"))
    shared = scratch.table(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    members = scratch.table(members.join(shared, "band"))
    meets = members.groupBy("rep").agg(F.sum("n").alias("meets"))
    hubs = members.join(meets, "rep").groupBy("band").agg(F.max(F.struct("meets", "rep")).alias("hub")).select("band", F.col("hub.rep").alias("leader"))
    members = scratch.table(members.join(scratch.table(hubs), "band").select("band", "rep", "leader"))
    least = percent / 100 - slack

    def with_bits(pairs: DataFrame) -> DataFrame:
        bits = lambda side: reps.select(F.col("rep").alias(side), F.col("bits").alias(f"bits_{side}"))
        both = pairs.join(bits("a"), "a").join(bits("b"), "b")
        return both.where(estimated_similarity(F.col("bits_a"), F.col("bits_b")) >= least).select("a", "b")

    def confirmed(pairs: DataFrame, edits: bool = False) -> DataFrame:
        wanted = pairs.select("a").union(pairs.select("b")).distinct()
        rows = wanted.join(classes, F.col("a") == F.col("rep")).select(F.col("rep").alias("node"), F.col("one.doc_id").alias("w"), F.col("one.th").alias("wh"))
        texts = d.join(rows, F.col("doc_id").eqNullSafe(F.col("w")) & (F.col("th") == F.col("wh"))).select("node", "t", F.octet_length("t").alias("n_bytes")).dropDuplicates(["node"])
        return scratch.table(confirm(pairs, scratch.table(texts), percent, edits))

    met = members.where(F.col("rep") != F.col("leader"))
    tried = scratch.table(with_bits(met.select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()))
    seen = confirmed(tried, edits=True)
    links = seen.where("is_link").select("a", "b")
    first = components(links)
    label = lambda n: first.select(F.col("node").alias(n), F.col("component").alias(f"c_{n}"))

    # Members near their hub, by their edits of the hub's set: the join itself decides exactly and gives links only.
    placed = seen.join(label("a"), "a", "left").join(label("b"), "b", "left")
    placed = placed.withColumn("hub_c", F.coalesce("c_a", "a")).withColumn("c", F.coalesce("c_b", "b"))
    apart = placed.where("c <> hub_c")
    x = apart.select(F.col("a").alias("h"), F.col("b").alias("x"), F.col("c").alias("cx"), F.col("n_a"), F.col("n_b").alias("nx"), F.col("added").alias("ax"), F.col("removed").alias("rx"))
    y = placed.join(apart.select(F.col("a").alias("h")).distinct(), F.col("a") == F.col("h"), "left_semi")
    y = y.select(F.col("a").alias("h"), F.col("b").alias("y"), F.col("c").alias("cy"), F.col("n_b").alias("ny"), F.col("added").alias("ay"), F.col("removed").alias("ry"))
    both = F.col("n_a") - F.size(F.array_union("rx", "ry")) + F.size(F.array_intersect("ax", "ay"))
    roomy = linked(F.least("nx", "ny"), F.col("nx"), F.col("ny"), percent)
    around = scratch.table(x.join(y, (x["h"] == y["h"]) & (F.col("cx") != F.col("cy")) & roomy & linked(both, F.col("nx"), F.col("ny"), percent)).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())

    # Pairs of a band with a member far from its hub: estimates inside the join, full sets after it.
    labelled = members.join(label("rep"), "rep", "left").select("band", "leader", "rep", F.coalesce("c_rep", "rep").alias("c"))
    open_bands = labelled.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2").select("band")
    near_hub = tried.select(F.col("a").alias("leader"), F.col("b").alias("rep"), F.lit(True).alias("near"))
    rest = labelled.where(F.col("rep") != F.col("leader")).join(scratch.table(open_bands), "band", "left_semi").join(near_hub, ["leader", "rep"], "left")
    rest = scratch.table(rest.join(reps, "rep").select("band", "rep", "c", F.coalesce("near", F.lit(False)).alias("near"), "bits"))
    side = lambda n: rest.select("band", F.col("rep").alias(n), F.col("c").alias(f"c{n}"), F.col("near").alias(f"near_{n}"), F.col("bits").alias(f"bits_{n}"))
    likely = estimated_similarity(F.col("bits_a"), F.col("bits_b")) >= least
    p, o = side("a").where("not near_a"), side("b")
    across = p.join(o, (p["band"] == o["band"]) & (F.col("ca") != F.col("cb")) & (F.col("near_b") | (F.col("a") < F.col("b"))) & likely).select("a", "b").distinct()
    more = confirmed(scratch.table(across))
    found = components(links.union(around).union(more))

    named = classes.select("rep").join(found, F.col("rep") == F.col("node"), "left").select(F.col("rep").alias("set_key"), F.coalesce("component", "rep").alias("component"))
    return sigs.select("doc_id", "th", "n_shingles", "set_key"), scratch.table(named)


def _with_hash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = text_bytes(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("t"))


def near_duplicates(docs: DataFrame, percent: int = 75, slack: float = 0.125, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of `docs`.

    Rows with equal shingle sets are one class; classes are compared through
    one row's text. Candidates share one of 32 bands of 4 minima: a pair at
    the threshold is missed with a chance of 5 in a million. Estimates from
    packed bits drop candidates more than `slack`, four and a half standard
    deviations, below the threshold; what is left is confirmed on full sets.

    A band's bucket is not paired with itself. First each member is compared
    with the bucket's hub, the member that meets most others in all its
    bands, which is the text that near copies were made from if it is there.
    Then members of different components are compared where they share a
    hub or, for those far from it, a bucket. A member near its hub is known
    by its edits of the hub's set, from which a pair's intersection follows
    exactly inside the join. Members that are connected already need no
    comparison.

    Null and empty texts have no shingles and are linked with nothing: each
    is kept under its own id. Rows that share an id are apart, each with the
    links of its own text; of them all those are `kept` whose component has
    no smaller id. A component without any id has a null component_id, and
    its rows are kept. Other columns of `docs` play no part.
    """
    rows, groups = _groups(_with_hash(docs, id_col, text_col), percent, slack)
    sizes = rows.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    groups = groups.join(sizes, "set_key")
    smallest = groups.groupBy("component").agg(F.min("least").alias("c"))
    named = Scratch(docs.sparkSession, "near").table(groups.join(smallest, "component").select(F.col("set_key").alias("k"), "c"))
    found = rows.join(named, F.col("set_key") == F.col("k"), "left")
    component = F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("c"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 75, slack: float = 0.125, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with their columns, without the near copies: one row of each group stays.

    It is the row with the smallest id, of rows with that id the one with
    the smallest text hash, and of equal rows any one; a null id comes after
    all others. Rows without shingles are in no group and stay all.
    """
    d = _with_hash(docs, id_col, text_col)
    rows, groups = _groups(d, percent, slack)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    per_set = rows.where("set_key is not null").groupBy("set_key").agg(F.min(order).alias("o"))
    stay = groups.join(per_set, "set_key").groupBy("component").agg(F.min("o").alias("o")).select(F.col("o.doc_id").alias("_stays_id"), F.col("o.th").alias("_stays_hash"))
    lone = rows.where("set_key is null").select(F.col("doc_id").alias("_stays_id"), F.col("th").alias("_stays_hash")).distinct()
    stay = Scratch(docs.sparkSession, "near").table(stay.withColumn("_stays_one", F.lit(True)).unionByName(lone.withColumn("_stays_one", F.lit(False))))
    same = docs[id_col].eqNullSafe(stay["_stays_id"]) & (F.xxhash64(text_bytes(text_col)) == stay["_stays_hash"])
    kept = docs.join(stay, same).select(*[docs[c] for c in docs.columns], stay["_stays_id"], stay["_stays_hash"], stay["_stays_one"])
    names = [f"_c{i}" for i in range(len(docs.columns))]  # the caller's names may clash with others
    kept = kept.toDF(*names, "_stays_id", "_stays_hash", "_stays_one")
    one = kept.where("_stays_one").dropDuplicates(["_stays_id", "_stays_hash"])
    return one.unionByName(kept.where("not _stays_one")).select(*names).toDF(*docs.columns)

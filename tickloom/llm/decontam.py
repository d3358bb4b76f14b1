"""Benchmark decontamination with a distributed positional inverted index.

The documents' postings are kept for the rarest terms of the benchmark's
windows. Lists are adjusted by the term's place in its item and intersected;
where both of a window's rarest terms fall on one alignment, the window is
compared word by word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, map_rows, text_bytes

#: Any byte to the byte that words are made of, or to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The benchmark is a stated query set, asked in blocks of about so many words; the driver and each task hold one block's terms, never more.
BLOCK_WORDS = 1_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def window_starts(n: int, size: int) -> range:
    """Where the windows of an item of n words begin; a shorter item is one window."""
    return range(1 if 0 < n < size else max(0, n - size + 1))


def rare_terms(items: dict, counts: dict[bytes, int], size: int) -> dict:
    """item -> for each window its two rarest places (one if it has one word)."""
    out = {}
    for item, words in items.items():
        rank = [(counts.get(w, 0), w, i) for i, w in enumerate(words)]
        out[item] = [tuple(i for _, _, i in sorted(rank[s : s + size])[:2]) for s in window_starts(len(words), size)]
    return out


def term_counts(docs: DataFrame, terms: set[bytes]) -> DataFrame:
    """(term, n): occurrences in all whole texts of the given terms; summed in each task before the shuffle."""
    import pyarrow as pa

    def run(batches):
        from collections import Counter

        n: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                n.update(x for x in words_of(t.as_py()) if x in terms)
        found = sorted(n.items())
        yield pa.RecordBatch.from_pydict({"term": pa.array([k for k, _ in found], pa.binary()), "n": pa.array([v for _, v in found], pa.int64())})

    return map_batches(docs.select("t"), run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, terms: set[bytes]) -> DataFrame:
    """(term, th, positions): the positional index of all whole texts for the given terms; a text is known by its hash `th`, so copies share one entry."""

    def start():
        def row(th, t):
            found: dict[bytes, list[int]] = {}
            words = words_of(t)
            if not terms.isdisjoint(words):
                for i, w in enumerate(words):
                    if w in terms:
                        found.setdefault(w, []).append(i)
            for w, places in found.items():
                yield w, th, places

        return row

    return map_rows(docs.select("th", "t"), start, "term binary, th long, positions array<int>")


def proximity_matches(index: DataFrame, first: bytes, second: bytes, within: int) -> DataFrame:
    """(th, a, b): places of two terms at most `within` words apart, from their posting lists."""
    side = lambda w, name: index.where(F.col("term") == F.lit(w)).select("th", F.explode("positions").alias(name)).distinct()
    return side(first, "a").join(side(second, "b"), "th").where((F.col("a") != F.col("b")) & (F.abs(F.col("a") - F.col("b")) <= within))


def alignments(index: DataFrame, places: DataFrame) -> DataFrame:
    """(th, item, shift, at): posting lists less the term's place in the item.

    `at` are the item's places found on one alignment: two at least, or one
    in items of which a window has a single place.
    """
    hits = index.join(places, "term").select("th", "item", "place", "need", F.explode("positions").alias("p"))
    found = hits.groupBy("th", "item", (F.col("p") - F.col("place")).alias("shift")).agg(F.collect_set("place").alias("at"), F.min("need").alias("need"))
    return found.where(F.size("at") >= F.col("need")).drop("need")


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, th, n_words, hit_runs, items) for every row of `docs` with its whole text.

    A window is `size` consecutive words of an item, or all of a shorter
    one. `hit_runs` are the maximal runs [start, end) of document words
    inside any occurrence of a window, `items` the sorted ids, as strings,
    of the items with occurring windows. Null and empty texts have no words;
    a null id is an id like others. What aligns is filed under the hash `th`
    of a text, so rows that share an id or have none do not meet, and each
    row is compared by its own text. A null item id counts as an empty
    one. Other columns of both tables play no part.

    Each block of the benchmark asks the documents for its terms' counts and
    for the postings of its windows' rarest terms. Items stay a table: what
    aligns is joined with its item's text by key and compared there.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    t = text_bytes(text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("t"))
    name = F.coalesce(F.col(item_col).cast("string"), F.lit(""))
    items = benchmark.select(name.alias("name"), text_bytes(item_text_col).alias("item_t")).where(F.length("item_t") > 0)
    items = scratch.table(items.distinct().withColumn("item", F.xxhash64("name", "item_t")))
    n_blocks = -(-(items.agg(F.sum(F.length("item_t"))).first()[0] or 0) // (4 * BLOCK_WORDS))
    found = None
    for k in range(n_blocks):
        rows = items.where(F.pmod("item", F.lit(n_blocks)) == k).select("item", "item_t").collect()  # one block
        block = {r["item"]: w for r in rows if (w := words_of(bytes(r["item_t"])))}
        if not block:
            continue
        terms = {w for words in block.values() for w in words}
        counts = {bytes(r["term"]): r["n"] for r in term_counts(d, terms).collect()}  # at most the block's terms
        asked = rare_terms(block, counts, size)
        need = {i: 1 if any(len(set(w)) == 1 for w in windows) else 2 for i, windows in asked.items()}
        places = {(block[i][p], i, p) for i, windows in asked.items() for w in windows for p in w if all(counts.get(block[i][q]) for q in w)}
        if not places:
            continue
        table = docs.sparkSession.createDataFrame([(bytearray(w), i, p, need[i]) for w, i, p in sorted(places)], "term binary, item long, place int, need int")
        hits = alignments(postings(d, {w for w, _, _ in places}), table)
        found = hits if found is None else found.unionByName(hits)

    def start():
        def row(doc_id, th, t, hits):
            words = words_of(t)
            runs, names = [], set()
            for h in hits or ():
                item = words_of(h["item_t"])
                n = min(size, len(item))
                for x in h["places"]:
                    shift, done = x["shift"], -1
                    for a in sorted(x["at"]):
                        for s in range(max(0, a - n + 1, done + 1), min(a, len(item) - n) + 1):
                            done = s
                            i = shift + s
                            if i >= 0 and words[i : i + n] == item[s : s + n]:
                                runs.append((i, i + n))
                                names.add(h["name"])
            yield doc_id, th, len(words), [list(r) for r in joined(runs)], sorted(names)

        return row

    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, th long, n_words long, hit_runs array<array<int>>, items array<string>"
    if found is None:
        rows = d.withColumn("hits", F.lit(None).cast("array<struct<name:string,item_t:binary,places:array<struct<shift:int,at:array<int>>>>>"))
    else:
        per_item = scratch.table(found.groupBy("th", "item").agg(F.collect_set(F.struct("shift", "at")).alias("places")))
        with_text = per_item.join(items, "item").select("th", F.struct("name", "item_t", "places").alias("h"))
        per_text = scratch.table(with_text.groupBy("th").agg(F.collect_list("h").alias("hits")))  # a table, so that the join can split a text of many copies
        rows = d.join(per_text, "th", "left")
    return map_rows(rows.select("doc_id", "th", "t", "hits"), start, schema)


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted maximal runs of overlapping or touching ones."""
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(r) for r in out]


def run_words():
    """Words in hit_runs."""
    return F.aggregate("hit_runs", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])


def items_digest(column: str = "items"):
    return F.sha2(F.array_join(column, ","), 256)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with their columns, whose text has no benchmark window. Rows that share an id are judged each by its own text."""
    found = find_contamination(docs, benchmark, size, id_col, text_col)
    hit = found.where(F.size("items") > 0).select(F.col("doc_id").alias("_hit_id"), F.col("th").alias("_hit_hash")).distinct()
    same = docs[id_col].eqNullSafe(hit["_hit_id"]) & (F.xxhash64(text_bytes(text_col)) == hit["_hit_hash"])
    return docs.join(hit, same, "left_anti")

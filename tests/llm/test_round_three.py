"""Periodic runs, importance resampling and substring dedup against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import periodic, queries, resampling, substrings

DOCS = "doc_id long, text string, runs string, at int, rank long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 1) for i, t in rows], DOCS)


def runs_by_hand(w, exponent=4, least=6):
    found = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, exponent * q) and not any(q % p == 0 and s <= i and i + n <= s + m for s, m, p in found):
                found.append((i, n, q))
            i = j + (i == j)
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_texts(seed, n=60):
    r = random.Random(seed)
    for _ in range(n):
        letters, t = "abcdefgh"[: r.choice([1, 2, 2, 3, 5])], []
        while len(t) < r.randint(0, 80):
            t += [r.choice(letters) for _ in range(r.randint(1, 9))] * r.choice([1, 1, 2, 3, 5, 7])
        yield [x.encode() for x in t]


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_runs(exponent):
    texts = list(periodic_texts(exponent))
    assert periodic.runs_of(texts, exponent, 6) == [runs_by_hand(t, exponent) for t in texts]
    fib = [b"a"], [b"a", b"b"]
    while len(fib[1]) < 400:
        fib = fib[1], fib[1] + fib[0]
    thue = [b"%d" % (bin(i).count("1") % 2) for i in range(512)]
    for t in (fib[1], thue, [b"a"] * 300, [*[b"a"] * 20, b"c"] * 9):
        assert periodic.runs_of([t], exponent, 6) == [runs_by_hand(t, exponent)]


def test_runs_do_not_depend_on_how_words_are_appended():
    r = random.Random(4)
    for t in periodic_texts(9, 40):
        words = np.array([ord(x) for x in t], np.int64)
        whole, parts = (periodic.Catchers(max(len(t) // 2, 1)) for _ in range(2))
        whole.append(words)
        at = 0
        while at < len(words):
            n = r.choice([1, 1, 1, 3, 7])
            parts.append(words[at : at + n])
            at += n
        assert whole.runs == parts.runs


def test_runs_survive_equal_hashes(monkeypatch):
    monkeypatch.setattr(periodic, "MIX", np.uint64(0))  # all blocks look alike
    texts = list(periodic_texts(5, 20))
    assert periodic.runs_of(texts, 4, 6) == [runs_by_hand(t) for t in texts]


def test_long_texts_are_linear():
    assert periodic.runs_of([[b"a"] * 300_000], 4, 6) == [[(0, 300_000, 1)]]


def test_find_runs(spark):
    texts = [" ".join(x.decode() for x in t) for t in periodic_texts(2)] + [None, "", "  \n", "x\ny\tx y x y  x y", "ü ü ü ü ü ü", "a b c " * 4000]
    rows = [*enumerate(texts), (None, "a a a a a a"), (0, texts[0]), (0, texts[0])]
    got = sorted((str(x["doc_id"]), x["n_words"], [tuple(r) for r in x["runs"]], x["collapsed"]) for x in periodic.find_runs(docs_of(spark, rows)).collect())
    want = []
    for i, t in rows:
        w = (t or "").split()
        runs = runs_by_hand(w) if len(w) < 1000 else [(0, 12_000, 3)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((str(i), len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want)


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(t):
    return WORDS.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def resampled_by_hand(rows, targets, percent, max_n, buckets, least, seed=2024):
    grams = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]
    s = Counter(g for _, t in rows for g in grams(words_of(t)))
    t_ = Counter(g for t in targets for g in grams(words_of(t)))
    S, T = sum(s.values()), sum(t_.values())
    out = []
    for i, t in rows:
        w = words_of(t)
        g = grams(w)
        gain = [math.floor(1000 * math.log((t_[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in g]
        weight = sum(gain) // len(g) if g else 0
        name = i if i is not None else "null:" + hashlib.sha256((t or "").encode()).hexdigest()
        h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    draw = percent * len(order) // 100
    return sorted((str(x), None) for x in out if x[1] < least) + [(str(x), k + 1 if k < draw else None) for k, x in enumerate(order)]


@pytest.mark.parametrize(("max_n", "percent"), [(1, 10), (2, 50), (3, 100), (2, 0)])
def test_resampling(spark, max_n, percent):
    r = random.Random(max_n)
    vocab = ["".join(r.choice("abcdeÄé9") for _ in range(r.randint(1, 4))) for _ in range(80)]
    rows = [(i, r.choice([" ", ", ", "\n", "\x00"]).join(r.choice(vocab) for _ in range(r.randint(0, 30)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "..."), (None, "Ab ab AB " * 5), (None, "zz y " * 9), (203, "É é ÀB " * 3000)]
    targets = [" ".join(vocab[:20]), "ab ab", None, ""]
    got = resampling.resample(docs_of(spark, rows), spark.createDataFrame([(t,) for t in targets], "text string"), percent, max_n, 500, 8).collect()
    assert sorted(((str((x["doc_id"], x["n_words"], x["n_features"], x["weight"], x["score"])), x["rank"]) for x in got), key=str) == sorted(resampled_by_hand(rows, targets, percent, max_n, 500, 8), key=str)


def test_resampling_of_equal_rows(spark):
    """Rows that tie in everything are drawn one by one; a large group of them is not dropped or kept whole."""
    rows = [(7, "a b c d")] * 60 + [(i, "q r s t") for i in range(100, 140)]
    got = resampling.resample(docs_of(spark, rows), spark.createDataFrame([("a b",)], "text string"), 30, 2, 100, 2).collect()
    assert len(got) == 100 and sorted(x["rank"] for x in got if x["rank"]) == list(range(1, 31))


def passages_by_hand(rows, length):
    words = [(t or "").split() for _, t in rows]
    rank = [(i is None, i or 0) for i, _ in rows]
    least = {}
    for r, w in zip(rank, words, strict=True):
        for k in range(len(w) - length + 1):
            x = tuple(w[k : k + length])
            least[x] = min(least.get(x, r), r)
    out = []
    for (i, _), r, w in zip(rows, rank, words, strict=True):
        gone = {p for k in range(len(w) - length + 1) if least[tuple(w[k : k + length])] < r for p in range(k, k + length)}
        out.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("v", sorted(substrings.COVERS))
def test_difference_covers(v):
    c = substrings.COVERS[v]
    assert {(a - b) % v for a in c for b in c} == set(range(v)) and set(c) <= set(range(v))


@pytest.mark.parametrize("length", [1, 2, 5, 12, 50])
def test_passages(spark, length):
    r = random.Random(length)
    vocab = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    prose = lambda n: [r.choice(vocab) for _ in range(n)]
    shared = [prose(n) for n in (length, length + 1, 2 * length, 3 * length + 7, max(length - 1, 1))]
    rows = []
    for i in range(70):
        w = prose(r.randint(0, 3 * length))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(shared)
        rows.append((i * 3 % 70, r.choice([" ", "\n", " \t "]).join(w)))
    t = rows[5][1].split()
    if t:
        t[len(t) // 2] = "changed"
    rows += [(500, rows[5][1]), (501, " ".join(t)), (None, rows[9][1]), (None, rows[9][1]), (3, rows[5][1]), (600, None), (601, ""), (602, " \n"), (603, "a " * 4 * length)]
    rows += [(700 + i, " ".join(shared[3])) for i in range(20)] + [(800, " ".join(prose(3000) + shared[2]))]
    got = sorted((str(x["doc_id"]), x["n_words"], sum(s["stop"] - s["first"] for s in x["spans"]), x["kept"]) for x in substrings.remove_passages(docs_of(spark, rows), length).collect())
    assert got == passages_by_hand(rows, length)


def test_many_copies_make_no_pairs(spark):
    """A group of copies is settled by contexts, so hardly any window is hashed by itself."""
    r = random.Random(1)
    text = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(300))
    rows = [(i, text) for i in range(200)] + [(1000 + i, f"x{i} " + text + f" y{i}") for i in range(100)]
    docs = docs_of(spark, rows)
    got = {x["doc_id"]: x for x in substrings.remove_passages(docs).collect()}
    assert not got[0]["spans"] and all(got[i]["kept"] == "" for i in range(1, 200))
    assert all(got[1000 + i]["kept"] == f"x{i} y{i}" for i in range(100))


def test_empty_tables(spark):
    d, b = docs_of(spark, []), spark.createDataFrame([], "text string")
    assert periodic.find_runs(d).count() == 0
    assert resampling.resample(d, b).count() == 0
    assert substrings.remove_passages(d).count() == 0
    some = docs_of(spark, [(1, "a b c"), (2, None)])
    assert resampling.resample(some, b, 100, min_words=1).where("rank is not null").count() == 1
    assert substrings.remove_passages(some).where(F.size("spans") > 0).count() == 0


def test_planted_words(spark):
    """The words that the contract of op11 plants."""
    rows = [(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(300)] + [(None, "a b"), (5000, None)]
    for x in queries._planted(docs_of(spark, rows).select("doc_id", "text")).collect():
        t = dict(rows)[x["doc_id"]] if x["doc_id"] is not None else "a b"
        w = (t or "").split()
        h = zlib.crc32(str(x["doc_id"]).encode())
        n, g = len(w), h // 10
        if x["doc_id"] is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert (x["text"] or "").split() == w

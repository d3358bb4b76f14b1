"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

The lexicon and the curve from weight to score are learned from labelled
rows; the columns of a row other than its text never enter its score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, map_rows, text_bytes

# Look-alike letters and digits that stand for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# Phrases in which a listed word is no insult.
EXCEPTIONS = ("clown fish", "idiot proof", "idiot light", "scum of the pond", "pond scum", "loser pays", "moron test", "trash can", "garbage collection", "stupid simple")

HIDDEN = re.compile("[­​-‏⁠﻿]")
RARE = re.compile("[­Ͱ-ԯ​-‏⁠﻿！-～]")
FOLD_WIDE = str.maketrans(HOMOGLYPHS | {chr(c): chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)})
SIGNS, STANDS = b"!$@", "".join(DIGITS).encode()
FOLD_BYTES = bytes(b if b > 127 or chr(b) in DIGITS else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
AS_LETTERS = bytes(ord(DIGITS.get(chr(b), chr(b))) if b < 128 else b for b in range(256))
#: A word of which some byte stands for a letter or is a number or sign, and runs of signs.
MIXED = re.compile(b"(?<![^ ])[^ " + STANDS + b"]*[" + STANDS + b"][^ ]*")
SIGN_RUN = re.compile(b"[" + SIGNS + b"]+")


def readings(word: bytes):
    """What a word with digits or signs may stand for: first as it is read without a lexicon, then with its ends read otherwise, then parted at signs."""
    if not word.strip(STANDS):
        yield b""  # no letter
        return
    ends = [(word.lstrip(x), y) for x in (SIGNS, b"", STANDS) for y in (STANDS, SIGNS, b"")]
    for w, y in ends if word[0] in STANDS or word[-1] in STANDS else ends[:1]:
        yield (w.rstrip(y) if y else w).translate(AS_LETTERS)
    if SIGN_RUN.search(word.strip(SIGNS)):
        yield b" ".join(next(readings(w)) if w.translate(None, STANDS) != w else w for w in SIGN_RUN.split(word) if w)


def fold(text: bytes, known=frozenset()) -> str:
    """Lower case, look-alikes and digits as letters, one space between words and at both ends.

    Digits and signs stand for letters only where a letter follows in the
    same word; signs before a word, digits and signs behind it and numbers
    part words as other signs do. Where the word is then none of the `known`
    ones (bytes) but another reading of it is one, the other reading is taken.
    """
    if not text.isascii():
        s = text.decode()
        if RARE.search(s):
            s = HIDDEN.sub("", s).lower().translate(FOLD_WIDE)
        text = s.lower().encode()

    def letters(m):
        first = next(readings(m[0]))
        if not known or first in known:
            return first
        return next((r for r in readings(m[0]) if not known.isdisjoint(r.split())), first)

    return " ".join(["", *[w.decode() for w in MIXED.sub(letters, b" ".join(text.translate(FOLD_BYTES).split())).split()], ""])


@dataclass
class Lexicon:
    """Weights by folded word, and the curve: score = 1 / (1 + exp(-(a + b * rate + c * log(1 + weight))))."""

    weights: dict[str, float]
    curve: tuple[float, float, float] = (-4.0, 1.0, 1.0)
    exceptions: tuple[str, ...] = EXCEPTIONS
    automaton: object = field(default=None, repr=False, compare=False)
    known: frozenset = field(default=frozenset(), repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "curve": self.curve, "exceptions": self.exceptions, "automaton": None, "known": frozenset()}

    def weight_of(self, text: bytes) -> tuple[float, int]:
        """Summed weight of the listed words outside exception phrases, and the number of words."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for w, x in self.weights.items():
                self.automaton.add_word(f" {w} ", (w, x))
            for e in self.exceptions:
                self.automaton.add_word(f" {e} ", (e, None))
            self.automaton.make_automaton()
            self.known = frozenset(w.encode() for x in (*self.weights, *self.exceptions) for w in x.split())
        folded = fold(text, self.known)
        n = folded.count(" ") - 1
        if not len(self.automaton):
            return 0.0, n
        hits = [(end - len(w) - 1, end, x) for end, (w, x) in self.automaton.iter(folded)]
        free = [(s, e) for s, e, x in hits if x is None]
        return sum(x for s, e, x in hits if x is not None and not any(a <= s and e <= b for a, b in free)), n

    @staticmethod
    def inputs(weight: float, n: int) -> tuple[float, float, float]:
        return 1.0, 100.0 * weight / max(n, 50), float(np.log1p(weight))

    def score(self, text: bytes) -> float:
        z = float(np.dot(self.curve, self.inputs(*self.weight_of(text))))
        return 1.0 / (1.0 + float(np.exp(-np.clip(z, -30, 30))))


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id as text, modulo 3, is 1. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000, min_texts: int = 5, min_ratio: float = 6.0, sure: float = 2.0) -> Lexicon:
    """Fit on at most `max_rows` labelled rows that are not held out, picked by a hash of their id.

    A word is listed if at least `min_texts` toxic texts hold it (2 where
    there are fewer than 20 toxic texts) and its share among toxic texts is
    at least `min_ratio` times that among others, still so when the logarithm
    of the ratio is taken `sure` standard errors lower than the square root
    of `min_ratio` asks; its weight is that logarithm. Words are counted by
    Spark. What comes to the driver are the listed words and two numbers for
    each of the `max_rows` rows at most: of rows that share an id one is
    taken, the least text. Without toxic or without other labels nothing is
    learned and every score is low.
    """
    chosen = (
        labels.where(F.col("toxic").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("t")).join(F.broadcast(chosen), "doc_id")  # at most max_rows pairs of numbers
    rows = Scratch(docs.sparkSession, "labelled").table(rows.groupBy("doc_id", "toxic").agg(F.min("t").alias("t")).select("doc_id", "t", "toxic"))

    def words():
        def row(doc_id, t, toxic):
            for w in set(fold(t).split()):
                yield w, toxic

        return row

    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Lexicon({})
    counted = map_rows(rows, words, "w string, toxic int").groupBy("w").agg(F.sum("toxic").alias("x"), F.count("*").alias("n"))
    x, y = F.col("x") + 0.5, F.col("n") - F.col("x") + 0.5
    weight = F.log((x / (toxic + 1)) / (y / (clean + 1)))
    listed = (weight >= float(np.log(min_ratio))) & (weight - sure * F.sqrt(1 / x + 1 / y) >= float(np.log(min_ratio)) / 2)
    found = counted.where((F.col("x") >= (min_texts if toxic >= 20 else 2)) & listed).select("w", weight.alias("weight")).orderBy("w")
    lexicon = Lexicon({r["w"]: r["weight"] for r in found.collect()})

    def weigh():
        def row(doc_id, t, toxic):
            yield (*lexicon.weight_of(t), toxic)

        return row

    seen = map_rows(rows, weigh, "weight double, n long, toxic int").collect()
    x = np.array([Lexicon.inputs(r["weight"], r["n"]) for r in seen])
    y = np.array([r["toxic"] for r in seen], dtype=float)
    lexicon.curve = tuple(float(v) for v in fit_logistic(x, y))
    return lexicon


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Newton steps for a small logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every whole text; null is an empty text, which gets the score of no listed word."""

    def start():
        def row(doc_id, held, t):
            s = lexicon.score(t)
            yield doc_id, held, s, int(s >= threshold)

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_bytes(text_col).alias("t"))
    return map_rows(rows, start, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` whose score is below the threshold, with their columns.

    The score is made in the same pass over the rows, so rows that share an
    id are judged each by its own text.
    """
    import pyarrow as pa

    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            col = b.column(at).cast(pa.binary())
            yield b.filter(pa.array([lexicon.score(t.as_py() or b"") < threshold for t in col], type=pa.bool_()))

    return map_batches(docs, run, docs.schema)

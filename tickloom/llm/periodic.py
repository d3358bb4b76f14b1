"""Periodic runs of words: squares caught online over dyadic blocks, merged into runs.

A square of period q is a stretch of 2q words whose halves are equal. Its
first half holds a whole aligned block of 2^k words, where 2^(k+1) - 1 <= q <
2^(k+2) - 1. So each completed block of 2^k words keeps a catcher that waits
for the block's words to come again q places later, for the periods of its
level only; a block meets 2^(k+1) distances, which makes 2n comparisons a
level. What a catcher sees is compared on, to the left once and to the right
with each word that is appended. As soon as the stretch has 2q words it is a
square; each further word is the next square of the same period, and all of
them merge into one run. Periods that are multiples of a run's own are
passed over there.

Blocks are compared by a 64-bit hash, stretches word by word, so a collision
costs a look and changes nothing.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_batches, text_bytes, text_groups

BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Words that are appended at once.
STEP = 1 << 16
#: Runs a row of the Arrow batches that are written may hold in total.
MOST_OUT = 20_000


def prime_factors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*found, n] if n > 1 else found


class Catchers:
    """Runs of two or more periods in a growing sequence of word numbers; `runs` maps (period, start) to the end."""

    def __init__(self, longest_period: int):
        self.longest_period = longest_period
        self.n = 0
        self.words = np.zeros(0, np.int64)
        self.sums = np.zeros(1, np.uint64)  # of word hash times a power of BASE, up to each place
        self.far_end, self.far_period = np.zeros(0, np.int64), np.ones(0, np.int64)  # of the run over each place that ends last
        self.runs: dict[tuple[int, int], int] = {}
        self.growing: dict[tuple[int, int], int] = {}  # stretches that reach the last word

    def append(self, words: np.ndarray) -> None:
        before, self.n = self.n, self.n + len(words)
        self.words = np.append(self.words, words)
        self.far_end, self.far_period = (np.append(a, np.full(len(words), x)) for a, x in ((self.far_end, 0), (self.far_period, 1)))
        # powers of an odd base and of its inverse, by running products that wrap round
        powers, inverse = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(self.n, b & (1 << 64) - 1, np.uint64))) for b in (BASE, pow(BASE, -1, 1 << 64)))
        hashes = (words.astype(np.uint64) + np.uint64(1)) * MIX
        hashes ^= hashes >> np.uint64(31)
        self.sums = np.append(self.sums, self.sums[-1] + np.cumsum(hashes * powers[before : self.n]))
        grown, self.growing = self.growing, {}
        for (period, start), end in grown.items():
            self._settle(period, start, self._right(end, period))
        size = 1
        while 2 * size - 1 <= self.longest_period:
            self._catch(size, before, inverse)
            size *= 2

    def _catch(self, size: int, before: int, inverse: np.ndarray) -> None:
        """Copies that end in the new words, of completed blocks of `size` words, at the distances of their level."""
        least, most = 2 * size - 1, min(4 * size - 2, self.longest_period)
        first = max(0, before - size + 1)  # the first window that ends in a new word
        low = max(0, first - most) // size * size
        n = self.n - size + 1 - low  # windows from `low` on
        if n <= least:
            return
        ids = (self.sums[low + size : self.n + 1] - self.sums[low : self.n - size + 1]) * inverse[low : self.n - size + 1]
        blocks = ids[: n - least : size]
        later = np.lib.stride_tricks.sliding_window_view(np.append(ids, np.zeros(most, np.uint64)), most - least + 1)[least::size][: len(blocks)]
        at, distance = np.nonzero(later == blocks[:, None])
        block, period = low + at * size, least + distance
        real = (block + period >= first) & (block + period < low + n)
        block, period = block[real], period[real]
        new = ~self._known(block, period)
        block, period = block[new], period[new]
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        bounds = np.flatnonzero(np.diff(period)) + 1
        for own in np.split(np.arange(len(block)), bounds) if len(block) else ():
            q = int(period[own[0]])
            places = block[own]
            places = places[~self._known(places, q)]
            k = 0
            while k < len(places):
                b = int(places[k])
                start, end = self._left(b + size, q), self._right(b + size + q, q)
                if start > b:  # another block of the same hash
                    k += 1
                    continue
                if (q, start) not in self.runs and (q, start) not in self.growing:
                    self._settle(q, start, end)
                k = int(np.searchsorted(places, end - q - size, side="right"))

    def _known(self, place, period):
        """Whether one period from `place` on lies in a run of this period or one that divides it."""
        return (self.far_end[place] >= place + period) & (period % self.far_period[place] == 0)

    def _left(self, end: int, period: int) -> int:
        """The first place from which all words up to `end` come again a period later."""
        step = 16
        while end > 0:
            a = max(0, end - step)
            other = np.flatnonzero(self.words[a:end] != self.words[a + period : end + period])
            if len(other):
                return a + int(other[-1]) + 1
            end, step = a, 2 * step
        return 0

    def _right(self, end: int, period: int) -> int:
        """The first place from `end` on whose word differs from that a period before."""
        step = 16
        while end < self.n:
            z = min(self.n, end + step)
            other = self.words[end:z] != self.words[end - period : z - period]
            if other.any():
                return end + int(other.argmax())
            end, step = z, 2 * step
        return self.n

    def _settle(self, period: int, start: int, end: int) -> None:
        """A stretch is a run once it has two periods, unless a shorter period is its own; it grows on if it reaches the last word."""
        if end - start >= 2 * period:
            w = self.words[start : start + period]
            if (period, start) not in self.runs and any((w[period // f :] == w[: period - period // f]).all() for f in prime_factors(period)):
                return
            self.runs[period, start] = end
            further = self.far_end[start:end] < end
            self.far_end[start:end][further] = end
            self.far_period[start:end][further] = period
        if end == self.n:
            self.growing[period, start] = end


def runs_of(texts: list[list[bytes]], exponent: int, least: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs of `least` words and `exponent` periods, by start, then period."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(t) for t in texts])
    sequence = np.empty(int(sizes.sum()) + len(texts), np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    for k, t in enumerate(texts):  # a number of its own ends each text
        sequence[starts[k] : starts[k] + len(t)] = list(map(number.__getitem__, t))
        sequence[starts[k] + len(t)] = -2 - k
    catchers = Catchers(int(sizes.max(initial=0)) // max(exponent, 2))
    for a in range(0, len(sequence), STEP):
        catchers.append(sequence[a : a + STEP])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (period, start), end in sorted(catchers.runs.items(), key=lambda r: (r[0][1], r[0][0])):
        if end - start >= max(least, exponent * period):
            k = int(np.searchsorted(starts, start, side="right")) - 1
            found[k].append((start - int(starts[k]), end - start, period))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g] if runs else words)


def find_runs(docs: DataFrame, exponent: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of `docs`.

    `runs` are all stretches (start, length, period) of words, numbered from
    0, with that smallest period, at least `exponent` (2 or more) periods and
    `least` words long, which no neighbouring word extends; by start, then
    period. `collapsed` is the text with each run cut to its first period,
    words joined by one space. Words are what ASCII white space separates. A
    null or empty text has no words and no runs. Rows are judged one by one,
    so repeated rows give equal results; columns beside id and text play no
    part. A text is held whole, at about 60 bytes a word.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    out = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for first, texts in text_groups(b.column(1)):
                words = [t.split() for t in texts]
                found = runs_of(words, exponent, least)
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
                kept = [collapsed(w, r) for w, r in zip(words, found, strict=True)]
                a = 0
                while a < len(texts):  # rows whose runs and texts make one batch
                    z, n = a + 1, len(runs[a])
                    while z < len(texts) and n + len(runs[z]) <= MOST_OUT:
                        n += len(runs[z])
                        z += 1
                    ids = b.column(0).slice(first + a, z - a).cast(out.field(0).type)
                    cols = [ids, pa.array([len(w) for w in words[a:z]], pa.int64()), pa.array(runs[a:z], out.field(2).type), pa.array(kept[a:z], pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, schema=out)
                    a = z

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("t")), run, schema)

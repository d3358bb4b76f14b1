"""Token counts: a prefix dynamic programme over the pieces of a text.

For each piece the table holds the exact number of tokens of every prefix of
it, so totals, truncation points and budgets are sums and look-ups; no text
is encoded twice.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import accumulate

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_bytes

# The white space of the vocabulary's pattern.
SPACE = r"\t-\r \x85\xa0  -     　"
LETTER, NUMBER, OTHER = regex.compile(r"\p{L}+"), regex.compile(r"\p{N}"), regex.compile(rf"[^{SPACE}\p{{L}}\p{{N}}]+")
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Entries of a cache, bytes of the runs in it, and the longest run that is kept.
CACHE, CACHE_BYTES, LONGEST_KEPT = 1_000_000, 1 << 26, 200


def followers() -> frozenset[str]:
    """Characters that may compose with the one before them although they are no combining marks."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x80, 0x20000))
    second = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    return frozenset(c for c in second if not unicodedata.combining(c)) | {chr(c) for a, b in ((0x1161, 0x1176), (0x11A7, 0x11C3)) for c in range(a, b)}



def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PrefixCounter:
    """Exact token counts of a BPE vocabulary with word ends, for every prefix.

    A piece's encoding is the one chain of tokens whose neighbours all stay
    apart when the two are encoded alone. So the last token of each prefix
    follows from the last tokens of shorter prefixes: a piece's table, filled
    from left to right, holds last token and count of every prefix in its
    open form (more symbols follow). Where the piece ends, one more step
    from the table gives the closed count.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ranks, self.halves = {}, {}
        for i, (left, right) in enumerate(model["merges"]):
            self.ranks[left, right] = i
            self.halves.setdefault(left + right, (left, right, i))
        self.open = {t for t in model["vocab"] if not t.endswith(self.end)}
        self.closed = {t.removesuffix(self.end) for t in model["vocab"] if t.endswith(self.end)}
        self.longest = max(map(len, self.open | self.closed))
        self.symbols = dict(enumerate(byte_symbols()))
        self.edges: dict[tuple, list] = {}
        self.joins: dict[tuple, bool] = {}
        self.pieces: dict[str, int] = {}
        self.followers = followers()
        self.split_special = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at one edge of a token while it is merged, each with the rank that ends it."""
        found = self.edges.get((token, side))
        if found is None:
            chain, rank = [], 1 << 60
            while token in self.halves:
                chain.append((token, rank))
                rank = self.halves[token][2]
                token = self.halves[token][side]
            chain.append((token, rank))
            found = self.edges[token if len(chain) == 1 else chain[0][0], side] = chain[::-1]
        return found

    def stay_apart(self, left: str, right: str) -> bool:
        """No merge crosses from one token to the next: whenever two symbols meet at the border, one of them goes on first."""
        a, b = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            rank = self.ranks.get((x, y), 1 << 60)
            if rank < x_ends and rank <= y_ends and rank < 1 << 60:
                return False
            if x_ends == y_ends == 1 << 60:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def fits(self, left: str, token: str) -> bool:
        """stay_apart, kept for each pair."""
        key = (left, token)
        found = self.joins.get(key)
        if found is None:
            if len(self.joins) > CACHE:
                self.joins.clear()
            found = self.joins[key] = self.stay_apart(left, token)
        return found

    def table(self, raw: str) -> tuple[list[str], list[int]]:
        """Last token and count of every prefix, open form."""
        last, count = [""], [0]
        self.fill(raw, last, count, len(raw), True)
        return last, count

    def fill(self, raw: str, last: list[str], count: list[int], upto: int, whole: bool) -> None:
        """Carry a table on to `upto` symbols; `whole` if raw starts where its piece does."""
        known, joins, longest = self.open, self.joins, self.longest
        for i in range(len(last), upto + 1):
            for j in range(i - longest if i > longest else 0, i):
                token = raw[j:i]
                if token in known and (whole and not j or (joins[pair] if (pair := (last[j], token)) in joins else self.fits(*pair))):
                    last.append(token)
                    count.append(count[j] + 1)
                    break

    def closed_count(self, raw: str, n: int, table: tuple[list[str], list[int]], whole: bool = True) -> int:
        """Tokens of raw[:n] where the piece ends there."""
        last, count = table
        for j in range(max(0, n - self.longest), n):
            token = raw[j:n]
            if token in self.closed and (whole and not j or self.fits(last[j], token + self.end)):
                return count[j] + 1
        raise ValueError("a byte is missing from the vocabulary")

    def closed_with(self, raw: str, n: int, table: tuple[list[str], list[int]], more: str) -> int:
        """Tokens of raw[:n] + more where the piece ends there, from the table of raw: only its last entries are looked at."""
        lo = max(0, n - self.longest)
        text, last, count = raw[lo:n] + more, table[0][lo : n + 1], table[1][lo : n + 1]
        self.fill(text, last, count, len(text) - 1, not lo)
        return self.closed_count(text, len(text), (last, count), not lo)

    def symbols_of(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.symbols)

    def piece_count(self, piece: str) -> int:
        found = self.pieces.get(piece)
        if found is None:
            raw = self.symbols_of(piece)
            # A token of the vocabulary is its own encoding; other pieces need their last symbol closed only.
            found = 1 if raw in self.closed else self.closed_count(raw, len(raw), self.table(raw[:-1]))
            if len(piece) <= LONGEST_KEPT:
                if len(self.pieces) > CACHE:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def normal(self, word: str) -> str:
        """Composed and in lower case, character by character."""
        if word.isascii():
            return word.lower()
        word = unicodedata.normalize("NFC", word)
        return word.lower() if "Σ" not in word else "".join(c.lower() for c in word)

    def plain_count(self, normal: str) -> int:
        return sum(self.piece_count(p) for p in PIECE.findall(normal))

    def word_count(self, word: str) -> int:
        """Tokens of a run without ASCII white space; a special string inside counts as one."""
        parts = self.split_special.split(word)
        return sum(self.plain_count(self.normal(part)) for part in parts) + len(parts) - 1

    def word_prefixes(self, word: str) -> list[int]:
        """Tokens of each prefix of a run, by characters. A special string that is cut is plain text."""
        out, done, at = [0], 0, 0
        for m in self.split_special.finditer(word):
            inner = self.plain_prefixes(word[at : m.end() - 1])
            out += [done + n for n in inner[1:]]
            done += inner[m.start() - at] + 1
            out.append(done)
            at = m.end()
        return out + [done + n for n in self.plain_prefixes(word[at:])[1:]]

    def plain_prefixes(self, word: str) -> list[int]:
        """Tokens of each prefix of a run without special strings, in time linear in its length.

        The run is cut in clusters that compose each on its own, so a cut
        between clusters is a cut of the normal form, and the table of the
        piece it falls in has the answer. A cut inside a cluster takes that
        table on by what the part of the cluster is alone. Contractions look
        ahead, so around an apostrophe the last few characters are taken anew.
        """
        if not word:
            return [0]
        starts = range(len(word)) if word.isascii() else [i for i, c in enumerate(word) if not i or not unicodedata.combining(c) and c not in self.followers]
        clusters = [word[a:b] for a, b in zip(starts, [*starts[1:], len(word)], strict=True)]
        normals = [self.normal(c) for c in clusters]
        text = "".join(normals)
        out, done, k, at = [0], 0, 0, 0  # tokens before the piece in work, its number, where the next cluster begins in text
        spans = [*([m.span() for m in PIECE.finditer(text)] or [(0, 0)]), (len(text), len(text))]
        work: dict[int, tuple] = {}  # symbols, table and places of the piece in work

        def upto(n: int, x: str) -> int:
            """Tokens of text[:n] + x; n never falls."""
            nonlocal k, done
            while spans[k + 1][0] < n:
                done += self.piece_count(text[spans[k][0] : spans[k][1]])
                work.clear()
                k += 1
            for j in range(max(0, k - 2), k + 1):
                s = spans[j][0]
                if n - 3 <= s < n and text[s] == "'":
                    return done - sum(self.piece_count(text[a:b]) for a, b in spans[j:k]) + self.plain_count(text[s:n] + x)
            s, e = spans[k]
            if n <= s or s == e:
                return done + self.plain_count(x)
            kind = next((c for c in (LETTER, OTHER) if c.match(text[s])), None)
            more = m[0] if n <= e and kind and (m := kind.match(x)) else ""
            if s not in work:
                raw = self.symbols_of(text[s:e])
                work[s] = raw, self.table(raw), [0, *accumulate(len(c.encode()) for c in text[s:e])]
            raw, table, ends = work[s]
            at = ends[min(n, e) - s]
            joined = self.closed_with(raw, at, table, self.symbols_of(more)) if more else self.closed_count(raw, at, table)
            return done + joined + self.plain_count(x[len(more) :])

        for raw, normal in zip(clusters, normals, strict=True):
            out += [upto(at, self.normal(raw[:i])) for i in range(1, len(raw))]
            at += len(normal)
            out.append(upto(at, ""))
        return out


class WordCounts(dict):
    """Tokens of runs as UTF-8 bytes, filled on first use and kept below a bound of entries and bytes; long runs aren't kept."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter, self.held = counter, 0

    def __missing__(self, word: bytes) -> int:
        n = self.counter.word_count(word.decode())
        if len(word) <= LONGEST_KEPT:
            if len(self) > CACHE or self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[word] = n
            self.held += len(word)
        return n


def worker_counts(path: str) -> WordCounts:
    """The tables of this worker process; a worker serves many tasks, and what one has counted the next ones find."""
    import sys

    kept = sys.__dict__.setdefault("_tickloom_word_counts", {})
    if path not in kept:
        kept[path] = WordCounts(PrefixCounter(path))
    return kept[path]


def longest_prefix(text: bytes, counts: list[int], limit: int, counter: PrefixCounter) -> int:
    """Characters in the longest prefix of `text` that takes at most `limit` tokens; `counts` are those of its runs."""
    if sum(counts) <= limit:
        return len(text.decode())
    done, at = 0, 0
    best = 0
    for word, n in zip(text.split(), counts, strict=True):
        start = text.index(word, at)
        at = start + len(word)
        if done + n <= limit:
            best, done = at, done + n
            continue
        inner = counter.word_prefixes(word.decode())
        fits = max(i for i, x in enumerate(inner) if done + x <= limit)
        return len(text[:start].decode()) + fits
    return len(text[:best].decode())


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fits_chars[, prefix_tokens]) for every whole text.

    `fits_chars`: characters of the longest prefix within `limit` tokens.
    With `prefixes`, `prefix_tokens` holds the count after each run of
    non-space characters, so that any later budget is answered from it.
    Counts are those of the vocabulary's own library, without begin, end or
    padding; special strings inside a text are one token each. Null is an
    empty text with no tokens. What a worker keeps of runs it has counted is
    bounded in entries and bytes. Time is linear in a text, also in one
    without any space.
    """

    def start():
        words = worker_counts(vocabulary)
        counter = words.counter

        def row(doc_id, text):
            counts = list(map(words.__getitem__, text.split()))
            n = sum(counts)
            fits = longest_prefix(text, counts, limit, counter)
            out = (doc_id, len(text), n, n > limit, fits)
            yield (*out, list(accumulate(counts))) if prefixes else out

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fits_chars long" + (", prefix_tokens array<long>" if prefixes else "")
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("t")), start, schema)

"""Secret scans: base patterns, then dictionary-primed zstandard novelty in sensitive contexts."""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_bytes

# The kinds in their order, the base patterns and the context words.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CONTEXT = re.compile(rb"password|passwd|passphrase|secret|token|api[ _-]?key|credential|private[_ -]?key|access[_ -]?key|bearer|auth")
CONTEXT_WORDS = (b"passw", b"passphrase", b"secret", b"token", b"api", b"credential", b"private", b"access", b"bearer", b"auth")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=!#%^&*$@~-]{8,}")
UUID = re.compile(rb"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Digits in a row that may be a secret without a letter.
LONG_NUMBER = 16
# What source code and identifiers commonly hold; it primes the compressor.
IDENTIFIERS = """
import from return function class public private static const value string number object array index length default
password passwd secret token api_key apikey access_key private_key credential authorization bearer client_id client_secret
username user_name email address config configuration settings environment variable production development localhost
request response header content_type application/json session cookie database connection timestamp created_at updated_at
the and that with this from have were which their about would there abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
0123456789 example_value placeholder changeme your_password_here your_api_key_here xxxxxxxxxxxxxxxx 00000000 true false null
get_set_is_has_to_of_in_on_by_id_key_name_type_data_list_item_file_path_url_host_port_time_date_size_count_max_min_new_old
""".encode()

HEX_BYTES = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def base_matches(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the three base kinds, without the failing matches."""
    out = []
    lower = text.translate(LOWER)
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"h" * 32 in text.translate(HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return out


class Novelty:
    """Marginal compressed bytes of a candidate behind its surroundings, with a primed dictionary."""

    def __init__(self, dictionary: bytes = IDENTIFIERS, level: int = 6):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zstd = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False)

    def marginal(self, before: bytes, candidate: bytes, after: bytes) -> int:
        """Bytes that the candidate adds to its compressed surroundings."""
        return len(self.zstd.compress(before + after + candidate)) - len(self.zstd.compress(before + after))


#: Each byte's class: lower case, upper case, digit, a sign that parts words in names, another sign.
CLASS = bytes(108 if 97 <= b <= 122 else 117 if 65 <= b <= 90 else 100 if 48 <= b <= 57 else 32 if chr(b) in "_-/=+@" else 115 for b in range(256))
#: Where the class changes inside a part of a name; a capital that begins a word of lower case is no change.
CHANGE = re.compile(rb"(?=l[uds]|u[ds]|d[ls]|du(?!l)|s[lud]|uul)")


def word_like(run: bytes) -> bool:
    """A run that may be a word, a name of code, a grouped number or an id by convention: those add as many bytes as random characters do.

    Not word-like are long numbers, and runs whose characters change class
    within the parts of a name as often as names don't: at every fourth
    place, twice at least.
    """
    if UUID.fullmatch(run):
        return True
    if run.isdigit():
        return len(run) < LONG_NUMBER
    return len(CHANGE.findall(run.translate(CLASS))) < max(2, 0.25 * len(run))


def novel_matches(text: bytes, taken: list[tuple[int, int, int]], novelty: Novelty, least: float, window: int) -> list[tuple[int, int, int]]:
    lower = text.translate(LOWER)
    if not any(w in lower for w in CONTEXT_WORDS):
        return []
    words = [(m.start(), m.end()) for m in CONTEXT.finditer(lower)]
    out, k = [], 0
    if not words:
        return out
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(words) and words[k][1] < start - window:
            k += 1
        if k == len(words):
            break
        found = m[0]
        if words[k][0] > end + window or any(s < end and start < e for s, _, e in taken):
            continue
        if word_like(found):
            continue
        near = text[max(0, start - window) : start], text[end : end + window]
        if novelty.marginal(near[0], found, near[1]) >= least * len(found):
            out.append((start, 3, end))
    return out


def code_points(text: bytes, places: list[int]) -> dict[int, int]:
    """Byte places to code points, in one walk over the text; `places` rise."""
    if text.isascii():
        return {i: i for i in places}
    out, at, n = {}, 0, 0
    for i in places:
        n += len(text[at:i].decode())
        out[i], at = n, i
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.70, window: int = 64) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_spans, spans) for every whole text.

    Spans are arrays of kind:start:end in code points, end exclusive, by
    start and kind. A run of 8 or more characters that is not word-like,
    within `window` bytes of a context word, that touches no base span, is
    novel if it adds at least `least` compressed bytes a character to its
    surroundings. Null and empty texts have no spans.
    """

    def start():
        novelty = Novelty()

        def row(doc_id, text):
            base = sorted(base_matches(text))
            every = sorted(base + novel_matches(text, base, novelty, least, window))
            at = code_points(text, sorted({i for x in every for i in (x[0], x[2])}))
            name = lambda x: f"{KINDS[x[1]]}:{at[x[0]]}:{at[x[2]]}"
            n = [sum(x[1] == k for x in every) for k in range(4)]
            yield (doc_id, *n, [name(x) for x in base], [name(x) for x in every])

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_spans array<string>, spans array<string>"
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("t")), start, schema)


def span_digest(column: str):
    """SHA-256 of the comma-joined spans."""
    return F.sha2(F.array_join(column, ","), 256)


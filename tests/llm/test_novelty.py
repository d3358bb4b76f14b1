"""Novel strings of the secret scan: against a plain search, and recall and false reports by alphabet and kind of name."""

import random
import re
import string

import pytest
import zstandard

from tickloom.llm import secrets

NOVELTY = secrets.Novelty()
PARTS = "_-/=+@"
RUN = string.ascii_letters + string.digits + "+/_=!#%^&*$@~-"
WORDS = "value client id name user token key data list item file path url host port time date size count max min new old get set is has request response header session config auth access".split()


def kind(c):
    return "l" if c in string.ascii_lowercase else "u" if c in string.ascii_uppercase else "d" if c in string.digits else "" if c in PARTS else "s"


def changes(run):
    """Places where the kind of character changes within a part of a name; a capital before lower case begins a word."""
    k = [kind(c) for c in run]
    n = 0
    for i in range(len(run) - 1):
        a, b = k[i], k[i + 1]
        after = k[i + 2] if i + 2 < len(run) else ""
        if not a or not b:
            continue
        if a == b == "u" and after == "l":
            n += 1
        elif a != b and (a, b) != ("u", "l") and not (a == "d" and b == "u" and after == "l"):
            n += 1
    return n


def novel_by_hand(text, base):
    """Every run of eight characters or more, every context word, a compressor of its own for each candidate."""
    out, i = [], 0
    lower = text.lower()
    words = [(m.start(), m.end()) for m in secrets.CONTEXT.finditer(lower.encode())]
    while i < len(text):
        j = i
        while j < len(text) and text[j] in RUN:
            j += 1
        run = text[i:j]
        if len(run) >= 8 and any(s <= j + 64 and e >= i - 64 for s, e in words) and not any(s < j and i < e for s, _, e in base):
            uuid = re.fullmatch(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", run)
            odd = len(run) >= 16 if run.isdigit() else changes(run) >= max(2, 0.25 * len(run))
            if odd and not uuid:
                d = zstandard.ZstdCompressionDict(secrets.IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                size = lambda b: len(zstandard.ZstdCompressor(level=6, dict_data=d, write_checksum=False, write_content_size=False).compress(b.encode()))  # noqa: B023, E731
                near = text[max(0, i - 64) : i] + text[j : j + 64]
                if size(near + run) - size(near) >= 0.70 * len(run):
                    out.append((i, 3, j))
        i = max(j, i + 1)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_novel_spans_against_a_plain_search(seed):
    r = random.Random(seed)
    found = 0
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 12)):
            parts.append(r.choice([r.choice(WORDS), "the auth of", "password: x1", "AKIA" + "Q" * 14, "".join(r.choice(RUN) for _ in range(r.randint(6, 30))), "".join(r.choice("0123456789") for _ in range(r.randint(6, 20)))]))
        text = " ".join(parts)
        base = sorted(secrets.base_matches(text.encode()))
        got = secrets.novel_matches(text.encode(), base, NOVELTY, 0.70, 64)
        assert got == novel_by_hand(text, base), text
        found += len(got)
    assert found > 20


def reported(candidate):
    text = f"the auth key of the service is {candidate} and more of it".encode()
    return bool(secrets.novel_matches(text, [], NOVELTY, 0.70, 64))


@pytest.mark.parametrize(("alphabet", "least"), [(string.ascii_letters + string.digits, 0.95), (string.ascii_letters + string.digits + "!#%^&*", 0.95), (string.ascii_letters + string.digits + "+/", 0.92), (string.ascii_letters, 0.88), (string.ascii_lowercase + string.digits, 0.80)])
@pytest.mark.parametrize("n", [12, 16, 24])
def test_recall_by_alphabet(alphabet, least, n):
    r = random.Random(n)
    assert sum(reported("".join(r.choice(alphabet) for _ in range(n))) for _ in range(400)) / 400 >= least


def test_names_are_not_reported():
    r = random.Random(3)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    kinds = {
        "snake": (lambda: "_".join(r.choice(WORDS) + r.choice(["", "", "1", "2", "10"]) for _ in range(r.randint(2, 5))), 0.02),
        "constant": (lambda: "_".join(r.choice(WORDS).upper() for _ in range(3)) + str(r.randint(1, 99)), 0.02),
        "path": (lambda: "/".join(r.choice(WORDS) for _ in range(4)), 0.02),
        "uuid": (lambda: "-".join([hexes(8), hexes(4), hexes(4), hexes(4), hexes(12)]), 0.0),
        "number": (lambda: "-".join(digits(r.randint(2, 6)) for _ in range(4)), 0.0),
        "mail": (lambda: r.choice(WORDS) + digits(2) + "@" + r.choice(WORDS), 0.02),
        "date": (lambda: f"2024-{r.randint(10, 12)}-{r.randint(10, 28)}", 0.0),
        "camel": (lambda: r.choice(WORDS) + "".join(r.choice(WORDS).capitalize() + r.choice(["", "", "2"]) for _ in range(r.randint(1, 3))), 0.12),
    }
    for name, (make, most) in kinds.items():
        assert sum(reported(make()) for _ in range(400)) / 400 <= most, name

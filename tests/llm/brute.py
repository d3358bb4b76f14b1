"""Brute-force versions of operators."""

import hashlib
from collections import Counter

from tickloom.llm.decontam import window_starts, words_of


def suffix_dedup(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans and digest of each text by counting every string."""
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = sorted({j for i in range(len(t) - length + 1) if n[t[i : i + length]] > 1 for j in range(i, i + length)})
        spans = sum(i == 0 or gone[i - 1] + 1 != x for i, x in enumerate(gone))
        hit = set(gone)
        kept = bytes(b for i, b in enumerate(t) if i not in hit)
        out.append((len(t), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def decontamination(doc: bytes, items: dict[str, bytes], size: int = 10) -> tuple[int, int, list[str]]:
    """n_words, n_hit and items by comparing every window with every place."""
    words, hit, found = words_of(doc), set(), []
    for name, text in items.items():
        item = words_of(text)
        windows = {tuple(item[s : s + size]) for s in window_starts(len(item), size)}
        n = min(size, len(item))
        at = [i for i in range(len(words) - n + 1) if n and tuple(words[i : i + n]) in windows]
        if at:
            found.append(name)
            hit.update(x for i in at for x in range(i, i + n))
    return len(words), len(hit), sorted(found)

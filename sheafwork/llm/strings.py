"""String tools of the matching operators, for use inside Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

from sheafwork.llm.confusables import clean_text


@lru_cache(20_000)
def fold(text: str) -> str:
    """Consistent form, lower case, no accents, single spaces."""
    text = unicodedata.normalize("NFKD", clean_text(text).lower().replace("ß", "ss").replace("ø", "o"))
    return re.sub(r"\s+", " ", "".join(c for c in text if not unicodedata.combining(c))).strip()


@lru_cache(50_000)
def distance(a: str, b: str) -> int:
    """Edits between two strings, a swap of neighbours counting once (optimal string alignment)."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def similarity(a: str, b: str) -> float:
    """1 - distance / longer length; 1 for two empty strings."""
    return 1.0 - distance(a, b) / max(len(a), len(b), 1)


@lru_cache(50_000)
def _letters(a: str) -> Counter:
    return Counter(a)


def similarity_from(a: str, b: str, least: float) -> float:
    """The similarity of two strings if it is at least `least`, else 0; lengths and letters rule most out before edits are counted."""
    if a == b:
        return 1.0
    longer = max(len(a), len(b), 1)
    edits = int((1.0 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > edits or longer - (_letters(a) & _letters(b)).total() > edits:
        return 0.0
    d = distance(a, b)
    return 1.0 - d / longer if d <= edits else 0.0


def abbreviates(short: str, word: str) -> bool:
    """Whether `short` (at least two letters) keeps the first letter of `word` and some of the others in order."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def grams(text: str, q: int) -> list[str]:
    """The set of padded q-grams, sorted."""
    if not text:
        return []
    padded = "^" * (q - 1) + text + "$" * (q - 1)
    return sorted({padded[i : i + q] for i in range(len(padded) - q + 1)})

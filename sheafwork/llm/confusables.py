"""Visually identical text with different characters: confusables skeletons and the consistent form.

Skeleton: decompose, replace every character by its prototype, decompose again. Texts with one skeleton look
alike and form one group. The consistent form is a member of its text's group: a word of mixed scripts becomes
its prototypes where these are letters of one script (back-translated where the word's home is another), letters
are composed again, and a form whose skeleton is not that of its text is refused.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from sheafwork.functions.text import INVISIBLE, LOOKALIKE

#: A text of these characters only is in its consistent form; all others are examined.
ORDINARY = r"^[\x09\x0A\x0D\x20-\x7E¡-¬®-ıĴ-ľŁ-ňŊ-ſ]*$"
# Hyphens that print like the ordinary one (dashes differ visibly and stay).
_HYPHENS = "‐‑﹣"
# Characters taken for one another within one script, for skeletons only.
_SAME_INK = {"I": "l", "1": "l", "|": "l", "0": "O", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}
# Latin letters written as one character, beside the ligatures of U+FB00 to U+FB06.
_JOINED = "ĲĳĿŀŉǄǅǆǇǈǉǊǋǌǱǲǳ"
_GONE = re.compile(INVISIBLE)
_FOREIGN = re.compile(r"[Ͱ-ϿЀ-ԯ԰-֏Ꭰ-ᏽἀ-῿]")
_RUN = re.compile(r"[^\W_]+", re.UNICODE)


@lru_cache(1)
def _single() -> dict[int, str | None]:
    """Replacements of single characters by rule: width and font variants, joined forms, spaces, hyphens; invisible ones vanish."""
    table: dict[int, str | None] = {}
    for code in (*range(0xA0, 0x20000), *range(0xE0000, 0xE0080)):
        ch = chr(code)
        if _GONE.match(ch):
            table[code] = None
            continue
        kind = unicodedata.decomposition(ch).split(" ", 1)[0]
        if unicodedata.category(ch) == "Zs":
            table[code] = " "
        elif kind in ("<wide>", "<narrow>", "<font>") or 0xFB00 <= code <= 0xFB06 or ch in _JOINED:
            table[code] = unicodedata.normalize("NFKC", ch)
    table.update({ord(h): "-" for h in _HYPHENS})
    return table


@lru_cache(1)
def _back() -> dict[str, dict[str, str]]:
    """Latin letter -> look-alike, by script."""
    out: dict[str, dict[str, str]] = {}
    for other, latin in LOOKALIKE.items():
        out.setdefault(_script(other), {}).setdefault(latin, other)
    return out


@lru_cache(5_000)
def _script(ch: str) -> str:
    return unicodedata.name(ch, "?").split(" ", 1)[0]


def _word(word: str) -> str:
    """Letters of one script within a decomposed word (between spaces); words wholly in another script stay."""
    scripts = {_script(c) for c in word if c.isalpha()}
    if len(scripts) < 2:
        return word
    latin_word = "LATIN" in scripts

    def run(m: re.Match) -> str:
        part = m.group()
        alien = [c for c in part if c.isalpha() and _script(c) != "LATIN"]
        if not alien:
            return part
        if latin_word and all(c in LOOKALIKE for c in alien):
            return "".join(LOOKALIKE.get(c, c) for c in part)
        home = max(sorted({_script(c) for c in alien}), key=lambda s: sum(_script(c) == s for c in alien))
        back = _back().get(home, {})
        return "".join(back.get(LOOKALIKE.get(c, c), c) if c.isalpha() and _script(c) != home else c for c in part)

    return _RUN.sub(run, word)


def _marks_joined(word: str) -> str:
    """Apply _word to the letters while their combining marks stay in place."""
    bare = [c for c in word if not unicodedata.combining(c)]
    fixed = iter(_word("".join(bare)))
    return "".join(c if unicodedata.combining(c) else next(fixed) for c in word)


def clean_text(text: str) -> str:
    """The consistent form of one text: the form of one script among the texts of its skeleton."""
    plain = text.translate(_single())
    if not _FOREIGN.search(plain):
        return unicodedata.normalize("NFC", plain)
    one = re.sub(r"\S+", lambda m: _marks_joined(m.group()) if _FOREIGN.search(m.group()) else m.group(), unicodedata.normalize("NFD", plain))
    return unicodedata.normalize("NFC", one if _prototypes(one) == _prototypes(plain) else plain)


def skeleton_text(text: str) -> str:
    """The skeleton of one text; equal skeletons look alike."""
    return unicodedata.normalize("NFD", "".join(_SAME_INK.get(c, c) for c in _prototypes(text.translate(_single()))))


def _prototypes(text: str) -> str:
    """Decomposed text with every look-alike as its prototype."""
    return unicodedata.normalize("NFD", "".join(LOOKALIKE.get(c, c) for c in unicodedata.normalize("NFD", text)))


@F.pandas_udf(StringType())
def _clean(texts: pd.Series) -> pd.Series:
    return texts.map(clean_text, na_action="ignore")


@F.pandas_udf(StringType())
def _skeleton(texts: pd.Series) -> pd.Series:
    return texts.map(skeleton_text, na_action="ignore")


def is_ordinary(text: Column) -> Column:
    """Whether a text is certainly consistent, judged in the JVM."""
    return text.rlike(ORDINARY)


def inconsistent(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text differs from its consistent form, with `clean`.

    Only texts with an unusual character leave the JVM. Null and empty texts have no other form and give no
    row; a text of invisible characters only gives an empty `clean`. Repeated rows are kept.
    """
    odd = df.where(F.col(text).isNotNull() & ~is_ordinary(F.col(text)))
    return odd.withColumn("clean", _clean(F.col(text))).where(F.col("clean") != F.col(text))


def cleaned(df: DataFrame, text: str, out: str) -> DataFrame:
    """All rows, with the consistent form in `out`; ordinary texts are passed through without Python."""
    odd = df.where(F.col(text).isNotNull() & ~is_ordinary(F.col(text))).withColumn(out, _clean(F.col(text)))
    plain = df.where(F.col(text).isNull() | is_ordinary(F.col(text))).withColumn(out, F.col(text))
    return plain.unionByName(odd)


def look_alike_groups(df: DataFrame, text: str = "text") -> DataFrame:
    """Groups of different texts with one skeleton: skeleton, forms (number of different texts), rows, common (the most frequent form, ties by code-point order).

    Equal texts are counted before any skeleton is computed, so a frequent text costs one row per input
    partition. Null texts belong to no group; texts without a twin give no row.
    """
    counted = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("form")).agg(F.count("*").alias("n"))
    best = F.min_by("form", F.struct(-F.col("n"), F.col("form")))
    groups = counted.withColumn("skeleton", _skeleton("form")).groupBy("skeleton").agg(F.count("*").alias("forms"), F.sum("n").alias("rows"), best.alias("common"))
    return groups.where("forms > 1")

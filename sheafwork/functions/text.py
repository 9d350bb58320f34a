"""Character folding in Catalyst expressions: no Python in the row path."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters without width or ink, as a Java character class.
INVISIBLE = r"[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]"
# All spaces that are not the ordinary one (line breaks and tabs stay).
ODD_SPACE = r"[   -   　]"
# Hyphens and minus signs that print like the ordinary hyphen.
ODD_HYPHEN = "‐‑‒–−﹣"
# Letters of other scripts that look like a Latin letter.
LOOKALIKE = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i",
    "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Օ": "O", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Տ": "S", "Լ": "L",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S", "Ꮲ": "P", "Ꮯ": "C", "Ꮮ": "L", "Ꮶ": "K", "Ᏼ": "B", "Ꮩ": "V",
}
# Accented letters of the languages handled and their bare letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
BARE = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def _translate_tables() -> tuple[str, str]:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    source = wide + "".join(LOOKALIKE) + ODD_HYPHEN + ACCENTED
    target = narrow + "".join(LOOKALIKE.values()) + "-" * len(ODD_HYPHEN) + BARE
    return source, target


_SOURCE, _TARGET = _translate_tables()


def ascii_fold(text: Column) -> Column:
    """Text for parsing: ordinary width, Latin look-alikes, no accents, nothing invisible, single spaces, trimmed.

    Null stays null, empty stays empty. Used where text is only matched, never shown.
    """
    visible = F.regexp_replace(text, INVISIBLE, "")
    plain = F.translate(F.regexp_replace(visible, ODD_SPACE, " "), _SOURCE, _TARGET)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\p{M}+", ""), r"\s+", " "))

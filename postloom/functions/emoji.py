"""Pictographs as column expressions; their names follow the Unicode character names."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.fixed import (
    EMOJI,
    EMOJI_RANGES,
    FIRST_FLAG_LETTER,
    FIRST_SKIN_TONE,
    FIRST_TAG,
    FLAG,
    KEYCAP,
    LAST_TAG,
    SKIN_TONES,
)

_CUT = "\u0001"
_SIGN = "\u0002"
# The two stretches of code points that hold the pictographs.
_STRETCHES = [(0xA9, 0x2B55), (0x1F004, 0x1FAFF)]


@cache
def _names(first: int, last: int) -> str:
    """Names of a stretch by rule, in code point order; empty where there is no pictograph."""
    marked = {c for lo, hi in EMOJI_RANGES for c in range(lo, hi + 1)}
    names = (
        unicodedata.name(chr(c), "").lower() if c in marked else "" for c in range(first, last + 1)
    )
    return "|".join(re.sub("[^a-z0-9-]+", "_", n) for n in names)


def emoji_name(symbol: Column, separator: str = "_") -> Column:
    """Name of the first code point in lower case, e.g. face_with_monocle.

    The names are one constant array per stretch, indexed by the code point.
    """
    code = F.ascii(symbol)
    found = [
        F.when(
            code.between(lo, hi),
            F.get(F.split(F.lit(_names(lo, hi).replace("_", separator)), r"\|"), code - lo),
        )
        for lo, hi in _STRETCHES
    ]
    return F.coalesce(*found, F.lit(""))


def sequence_name(symbols: Column, separator: str = "_") -> Column:
    """Name of one whole sequence in lower case, by rule from the names of its parts.

    Joined parts and skin tones follow each other (woman_medium_skin_tone_rocket), two
    regional letters are flag_xx, region tags are the letters after their flag, a framed
    digit or sign is keycap_x. Joiners and variation selectors have no name. Any two
    regional letters count as a flag, whether or not a region has that code.
    """
    tones = F.array(*[F.lit(t.replace("_", separator)) for t in SKIN_TONES])

    def part(c: Column) -> Column:
        code = F.ascii(c)
        tone = code - FIRST_SKIN_TONE
        return F.when(tone.between(0, len(SKIN_TONES) - 1), F.get(tones, tone)).otherwise(
            emoji_name(c, separator)
        )

    codes = F.split(symbols, "")
    named = F.filter(F.transform(codes, part), lambda n: n != "")
    tags = F.filter(codes, lambda c: F.ascii(c).between(FIRST_TAG, LAST_TAG - 1))
    # the letter of a tag is its code in the lowest plane
    region = F.array_join(F.transform(tags, lambda c: F.char(F.ascii(c) - (FIRST_TAG - 0x20))), "")
    letters = F.transform(codes, lambda c: F.char(F.ascii(c) - FIRST_FLAG_LETTER + ord("a")))
    whole = F.array_join(named, separator)
    return (
        F.when(symbols.rlike(f"^{KEYCAP}"), F.concat(F.lit(f"keycap{separator}"), codes[0]))
        .when(symbols.rlike(f"^{FLAG}$"), F.concat(F.lit(f"flag{separator}"), F.array_join(letters, "")))
        .when(region != "", F.concat(whole, F.lit(separator), region))
        .otherwise(whole)
    )


def mark_emoji(text: Column, marker: str = " xxemoji ") -> Column:
    return F.regexp_replace(text, EMOJI, marker)


def drop_emoji(text: Column) -> Column:
    return F.regexp_replace(text, EMOJI, "")


def name_emoji(text: Column, before: str, after: str, separator: str) -> Column:
    """Write every pictograph, joined ones as one, as ``before + name + after``.

    ``text`` occurs once, so a long cleaning before this step is evaluated once.
    """
    pieces = F.split(F.regexp_replace(text, f"({EMOJI})", f"{_CUT}{_SIGN}$1{_CUT}"), _CUT)
    named = F.transform(
        pieces,
        lambda p: F.when(
            F.startswith(p, F.lit(_SIGN)),
            F.concat(F.lit(before), sequence_name(F.substr(p, F.lit(2)), separator), F.lit(after)),
        ).otherwise(p),
    )
    return F.array_join(named, "")


def find_emoji(text: Column) -> Column:
    """Names of all pictographs, joined ones as one, comma-joined; NULL when there are none."""
    found = F.regexp_extract_all(text, F.lit(f"({EMOJI})"), F.lit(0))
    names = F.transform(found, lambda s: F.concat(F.lit(":"), sequence_name(s), F.lit(":")))
    return F.when(text.rlike(EMOJI), F.array_join(names, ","))

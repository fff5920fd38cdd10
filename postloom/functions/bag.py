"""Cleaning down to plain words, for counting rather than reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions import fixed
from postloom.functions.emoji import drop_emoji
from postloom.functions.markers import (
    clean_markers_first,
    collapse_spaces,
    newlines_to_space,
    space_punctuation,
    unify_disease_name,
)
from postloom.functions.words import (
    default_stop_words,
    drop_short_words,
    drop_stop_words,
    drop_words_within,
    without_characters,
    words,
)

MENTION = rf"@{fixed.WORD}+"
HASHTAG = rf"#+{fixed.WORD}[\p{{L}}\p{{N}}_'-]*{fixed.WORD}"
# Tried at the first sign of a row of signs only.
FAST_HASHTAG = f"(?<!#){HASHTAG}"
LINK = r"(?iu)https?://[!$-_a-z]+"


def bag_of_words(text: Column) -> Column:
    """Word array without pictographs, mentions, tags, links and loose punctuation."""
    out = newlines_to_space(drop_emoji(text))
    for pattern in (MENTION, FAST_HASHTAG, LINK):
        out = F.regexp_replace(out, pattern, "")
    out = without_characters(out, fixed.BAG_DROPPED_CHARACTERS)
    return drop_words_within(words(out), fixed.BAG_PUNCTUATION)


def remove_pattern(text: Column, pattern: str, space: bool = False) -> Column:
    return F.regexp_replace(text, pattern, " " if space else "")


def letters_only(text: Column, stop_words: Sequence[str] | None = None) -> Column:
    """Letters, words above three characters, no mentions, links or # signs."""
    out = remove_pattern(newlines_to_space(text), rf"@{fixed.WORD}*")
    out = F.regexp_replace(out, r"[^\p{Alpha}#]+", " ")
    # Up to here only letters, # and single spaces are left.
    out = remove_pattern(out, "(?<![^ ])[^ ]{1,3}(?![^ ])")
    out = remove_pattern(out, "http[^ ]+")
    tokens = words(F.lower(F.replace(out, F.lit("#"), F.lit(""))))
    stop = default_stop_words() if stop_words is None else stop_words
    return F.array_join(drop_stop_words(tokens, stop), " ")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def normalise_words(text: Column, stop_words: Sequence[str] | None = None) -> Column:
    """Unified disease terms, ASCII, lower case, no punctuation or stop words."""
    out = F.regexp_replace(text, *fixed.DISEASE_CODE_REPEATED)
    out = ascii_only(unify_disease_name(out, wide=True))
    out = F.lower(space_punctuation(out, fixed.ASCII_PUNCTUATION))
    tokens = drop_words_within(words(out), fixed.BAG_PUNCTUATION)
    stop = default_stop_words() if stop_words is None else stop_words
    return collapse_spaces(F.array_join(drop_stop_words(tokens, stop), " "))


def clean_words(text: Column, stop_words: Sequence[str] | None = None) -> Column:
    return normalise_words(clean_markers_first(text), stop_words)


def drop_joined_words(text: Column) -> Column:
    """Drop words that hold a hyphen or an apostrophe."""
    edge = rf"(?:(?<={fixed.WORD})(?!{fixed.WORD})|(?<!{fixed.WORD})(?={fixed.WORD}))"
    return F.regexp_replace(text, rf"{edge}{fixed.WORD}*[-']{fixed.WORD}*{edge}", "")

"""Cleaning that swaps parts of a post for marker words.

Every step takes and returns a Column, so a whole cleaning plan is one projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions import fixed
from postloom.functions.emoji import mark_emoji, name_emoji
from postloom.functions.words import (
    class_of,
    default_stop_words,
    drop_short_words,
    drop_stop_words,
    without_characters,
    words,
)


def _apply(text: Column, rule: tuple[str, str]) -> Column:
    pattern, replacement = rule
    return F.regexp_replace(text, pattern, replacement)


def newlines_to_space(text: Column) -> Column:
    return _apply(text, fixed.NEWLINES)


def unify_disease_name(text: Column, wide: bool = False) -> Column:
    return _apply(text, fixed.DISEASE_NAME_WIDE if wide else fixed.DISEASE_NAME)


def mark_disease_name_tag(text: Column, joined: bool = False) -> Column:
    marker = "xxhashcoronavirus" if joined else "xxhash coronavirus"
    return F.regexp_replace(text, fixed.DISEASE_NAME_TAG, marker)


def unify_disease_code(text: Column, narrow: bool = False) -> Column:
    return _apply(text, fixed.DISEASE_CODE_NARROW if narrow else fixed.DISEASE_CODE)


def mark_disease_code_tag(text: Column, joined: bool = False) -> Column:
    marker = "xxhashcovid19" if joined else "xxhash covid19"
    return F.regexp_replace(text, fixed.DISEASE_CODE_TAG, marker)


def unify_virus_code(text: Column) -> Column:
    return _apply(text, fixed.VIRUS_CODE)


def mark_hashtags(text: Column, how: str = "sign") -> Column:
    """``sign``: the # becomes a marker; ``drop``: it goes; ``whole``: the tag goes."""
    if how == "whole":
        return _apply(text, fixed.WHOLE_HASHTAG)
    return F.replace(text, F.lit("#"), F.lit("xxhash " if how == "sign" else ""))


def mark_mentions(text: Column, how: str = "sign") -> Column:
    if how == "whole":
        return _apply(text, fixed.WHOLE_MENTION)
    return F.replace(text, F.lit("@"), F.lit("xxmention " if how == "sign" else ""))


def mark_emoji_named(text: Column) -> Column:
    return name_emoji(text, " xxemoji ", " ", "")


def mark_picture_links(text: Column, padded: bool = True) -> Column:
    return F.regexp_replace(text, fixed.PICTURE_LINK, _pad("xxpictwit", padded))


def mark_video_links(text: Column, padded: bool = True) -> Column:
    return F.regexp_replace(text, fixed.VIDEO_LINK, _pad("xxyoutubeurl", padded))


def mark_links(text: Column, bare_domains: bool = True) -> Column:
    """Scheme and www links; bare domains too, which also takes ``end.The``."""
    marked = F.regexp_replace(text, fixed.FAST_SCHEME_OR_WWW_LINK, " xxurl ")
    return F.regexp_replace(marked, fixed.FAST_BARE_DOMAIN, "$1 xxurl ") if bare_domains else marked


def mark_scheme_links(text: Column) -> Column:
    return F.regexp_replace(text, fixed.FAST_SCHEME_LINK, "xxurl")


def mark_numbers(text: Column, marker: str = r"\$NUMBER\$") -> Column:
    return F.regexp_replace(text, fixed.FAST_NUMBER, marker)


def _pad(marker: str, padded: bool) -> str:
    return f" {marker} " if padded else marker


def space_punctuation(text: Column, characters: str = fixed.MARKER_PUNCTUATION) -> Column:
    return collapse_spaces(F.regexp_replace(text, f"({class_of(characters)})", " $1 "))


def mark_punctuation(
    text: Column, marker: str = "xxpunc", characters: str = fixed.MARKER_PUNCTUATION
) -> Column:
    """Space out punctuation, then mark (or, with an empty marker, drop) symbols."""
    symbols = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"
    spaced = F.regexp_replace(text, f"({class_of(characters)})", " $1 ")
    return collapse_spaces(F.regexp_replace(spaced, symbols, marker))


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, "[ ]{2,}", " ")


def plain_words(
    text: Column, stop_words: Sequence[str], characters: str = fixed.MARKER_PUNCTUATION
) -> Column:
    """Words without stop words, then without punctuation characters."""
    kept = drop_stop_words(words(text), stop_words)
    return without_characters(F.array_join(kept, " "), characters)


def clean_markers(
    text: Column,
    strip_words: bool = False,
    punctuation: bool = False,
    stop_words: Sequence[str] | None = None,
    bare_domains: bool = True,
) -> Column:
    """The current cleaning: markers keep a trace of tags, mentions, links, emoji."""
    out = newlines_to_space(text)
    out = unify_disease_name(out)
    out = mark_disease_name_tag(out)
    out = unify_disease_code(out)
    out = mark_disease_code_tag(out)
    out = unify_virus_code(out)
    out = mark_hashtags(out)
    out = mark_mentions(out)
    out = mark_emoji_named(out)
    out = mark_picture_links(out)
    out = mark_video_links(out)
    out = mark_links(out, bare_domains)
    if strip_words:
        out = plain_words(out, default_stop_words() if stop_words is None else stop_words)
    if punctuation:
        out = mark_punctuation(out)
    return F.trim(collapse_spaces(out))


def clean_markers_joined(
    text: Column, strip_words: bool = False, punctuation: bool = False, numbers: bool = False
) -> Column:
    """The older form: joined tag markers, bare # and @ dropped, scheme links only."""
    characters = fixed.ASCII_PUNCTUATION + "…–”“’"
    out = newlines_to_space(text)
    out = unify_disease_name(out)
    out = mark_disease_name_tag(out, joined=True)
    out = unify_disease_code(out, narrow=True)
    out = mark_disease_code_tag(out, joined=True)
    out = unify_virus_code(out)
    out = mark_hashtags(out, "drop")
    out = mark_mentions(out, "drop")
    if numbers:
        out = mark_emoji(mark_numbers(out))
        if punctuation:
            out = mark_punctuation(out, "", characters)
        return F.array_join(drop_short_words(words(out), 1), " ")
    out = mark_emoji(out)
    out = mark_picture_links(out, padded=False)
    out = mark_video_links(out, padded=False)
    out = mark_scheme_links(out)
    if strip_words:
        out = without_characters(F.array_join(words(out), " "), characters)
    if punctuation:
        out = mark_punctuation(out, "", characters)
    return F.trim(collapse_spaces(out))


def clean_markers_first(text: Column) -> Column:
    """The first form: whole tags and mentions, unpadded link markers."""
    out = newlines_to_space(text)
    out = mark_picture_links(out, padded=False)
    out = mark_video_links(out, padded=False)
    out = mark_scheme_links(out)
    out = mark_mentions(out, "whole")
    out = mark_hashtags(out, "whole")
    return mark_emoji(out)

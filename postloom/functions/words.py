"""Word arrays: splitting, stop words, short words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.fixed import SPACE


def default_stop_words(language: str = "english") -> list[str]:
    """Spark's own list; pass another list where a specific one is needed."""
    return StopWordsRemover.loadDefaultStopWords(language)


def words(text: Column) -> Column:
    """Non-empty whitespace-separated words."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def drop_stop_words(tokens: Column, stop_words: Sequence[str]) -> Column:
    """Case-sensitive; duplicates survive. ``isin`` becomes a hash-set test."""
    return F.filter(tokens, lambda w: ~w.isin(list(stop_words)))


def drop_short_words(tokens: Column, longer_than: int) -> Column:
    return F.filter(tokens, lambda w: F.length(w) > longer_than)


def drop_words_within(tokens: Column, symbols: str) -> Column:
    """Drop words that occur as they stand inside ``symbols``."""
    return F.filter(tokens, lambda w: ~F.contains(F.lit(symbols), w))


def remove_stop_words(tokens: Column, stop_words: Sequence[str]) -> Column:
    """The kept words as one text."""
    return F.array_join(drop_stop_words(tokens, stop_words), " ")


def class_of(characters: str) -> str:
    """A regex class of exactly these characters."""
    return "[" + "".join(f"\\{c}" if ord(c) < 128 else c for c in characters) + "]"


def without_characters(text: Column, characters: str) -> Column:
    return F.regexp_replace(text, class_of(characters), "")

"""Topic matching: the hits, their number, or a flag."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def topic_hits(text: Column, pattern: str, empty: str | None = "") -> Column:
    """All hits comma-joined; ``empty`` (or NULL) where there is none.

    The country topics give ``fixed.NO_TOPIC`` then, the others empty text.
    """
    hits = F.array_join(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0)), ",")
    if empty is None:
        return F.nullif(hits, F.lit(""))
    if empty == "":
        return hits
    # No topic matches an empty text, so an empty list is an empty join. One use of the
    # hits, one search of the text.
    return F.regexp_replace(hits, "^$", empty)


def topic_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def topic_flag(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def topic_pair(text: Column, first: str, second: str) -> Column:
    return F.struct(
        topic_count(text, first).alias("first"), topic_count(text, second).alias("second")
    )


def matched_topics(text: Column, catalogue: Mapping[str, str]) -> Column:
    """Names of all topics whose pattern occurs. Patterns are literals: compiled once."""
    flags = [F.when(text.rlike(p), F.lit(name)) for name, p in catalogue.items()]
    return F.filter(F.array(*flags), lambda t: t.isNotNull())

"""Nested and array fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined_items(items: Column, field: str) -> Column:
    """A field of an array of structs, comma-joined; NULL when empty or missing."""
    return F.when(F.size(items) > 0, F.concat_ws(",", items[field]))


def joined_list(items: Column) -> Column:
    """An array of strings, comma-joined; an empty array gives an empty text."""
    return F.array_join(items, ",")


def joined_cast(items: Column, field: str) -> Column:
    return F.array_join(F.transform(items, lambda x: x[field].cast("string")), ",")


def anchor_label(markup: Column) -> Column:
    """Text between the first > and the next <; NULL when there is no such pair."""
    pattern = "(?<=>).*?(?=<)"
    return F.when(markup.rlike(pattern), F.regexp_extract(markup, pattern, 0))


def optional_link(status: Column) -> Column:
    return status["url"]

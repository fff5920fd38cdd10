"""Projections, filters and checks over post tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql import types as T

from postloom import schemas
from postloom.functions import fixed
from postloom.functions.dates import local_to_utc
from postloom.functions.nested import (
    anchor_label,
    joined_cast,
    joined_items,
    joined_list,
    optional_link,
)
from postloom.functions.normalise import normalise_post


def clean_posts(raw: DataFrame, columns: Sequence[str] = tuple(schemas.CLEAN_COLUMNS)) -> DataFrame:
    """The flat columns of raw posts, with the author's id lifted out of ``user``."""
    lifted = {"user_id_str": F.col("user.id_str").cast("string").alias("user_id_str")}
    return raw.select(*[lifted.get(c, F.col(c)) for c in columns])


def flatten_user(raw: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    names = fields or [name for name, _ in schemas.USER_FIELDS]
    return raw.select(
        *[c for c in raw.columns if c != "user"],
        *[F.col(f"user.{n}").alias(f"user_{n}") for n in names],
    )


def flatten_posts(raw: DataFrame, user_fields: Sequence[str] | None = None) -> DataFrame:
    """Nested fields as flat columns; the nested ones are dropped."""
    entities = F.col("entities")
    flat = flatten_user(raw, user_fields).withColumns(
        {
            "hashtags": joined_items(entities["hashtags"], "text"),
            "symbols": joined_items(entities["symbols"], "text"),
            "urls": joined_items(entities["urls"], "url"),
            "user_mentions": joined_items(entities["user_mentions"], "screen_name"),
            "tweet_source": anchor_label(F.col("source")),
            "quoted_status_url": optional_link(F.col("quoted_status_permalink")),
        }
    )
    return flat.drop("entities", "source", "quoted_status_permalink", "_corrupt_record")


def flatten_scraped(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Scraped posts: local time to UTC, lists to text, reply list to two columns."""
    lists = [c for c in ("mentions", "urls", "photos", "hashtags") if c in df.columns]
    out = df.withColumns(
        {
            "created_at": local_to_utc(F.col("created_at").cast("timestamp")),
            **{c: joined_list(F.col(c)) for c in lists},
            "reply_to_userids": joined_cast(F.col("reply_to"), "user_id"),
            "reply_to_usernames": joined_cast(F.col("reply_to"), "username"),
        }
    )
    return blank_to_missing(out.drop("reply_to", *drop))


def fill_missing(df: DataFrame, value: str = fixed.MISSING) -> DataFrame:
    """NULL text becomes ``value``; other types keep their NULLs."""
    return df.na.fill(value)


def blank_to_missing(df: DataFrame, value: str = fixed.MISSING) -> DataFrame:
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns(
        {c: F.when(F.col(c) == "", F.lit(value)).otherwise(F.col(c)) for c in texts}
    )


def english(df: DataFrame) -> DataFrame:
    return df.where(F.col("lang") == "en")


def not_too_long(df: DataFrame, text: str, limit: int = fixed.MAX_POST_LENGTH) -> DataFrame:
    return df.where(F.length(text) <= limit)


def not_retweets(df: DataFrame, text: str = "text") -> DataFrame:
    """Without retweets: neither the struct nor the text sign of one; NULL text stays."""
    kept = df.where(~F.coalesce(F.contains(F.col(text), F.lit("RT @")), F.lit(False)))
    return kept.where(F.col("retweeted_status").isNull()) if "retweeted_status" in df.columns else kept


def matching(df: DataFrame, text: str, pattern: str) -> DataFrame:
    return df.where(F.col(text).rlike(pattern))


def matching_both(df: DataFrame, text: str, first: str, second: str) -> DataFrame:
    """Rows that hold both terms at least once."""
    return df.where(F.col(text).rlike(first) & F.col(text).rlike(second))


def present(df: DataFrame, column: str, missing: str = fixed.MISSING) -> DataFrame:
    return df.where(F.col(column) != missing)


def prepare_for_encoding(
    posts: DataFrame, text: str = "full_text", limit: int = fixed.MAX_POST_LENGTH
) -> DataFrame:
    """English posts of usual length with their normalised text."""
    return not_too_long(english(posts), text, limit).withColumn(
        "normalized_tweet", normalise_post(F.col(text))
    )


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows while they pass; read ``observation.get`` after the action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def same_row_count(before: Observation, after: Observation) -> None:
    if before.get["rows"] != after.get["rows"]:
        raise ValueError(f"rows changed: {before.get['rows']} -> {after.get['rows']}")


def expect_label_count(df: DataFrame, label: str, expected: int = fixed.NARRATIVE_COUNT) -> DataFrame:
    """One row with the number of labels; the query fails when it is another one."""
    found = F.count_distinct(label)
    message = F.format_string(f"expected {expected} labels, found %d", found)
    return df.agg(
        found.alias("labels"), F.assert_true(found == expected, message).alias("_check")
    ).where("_check is null").select("labels")


def union_posts(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Change column types; values that do not fit become NULL."""
    return df.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()})


def sort_by_time(df: DataFrame, ts: str = "created_at", newest_first: bool = False) -> DataFrame:
    return df.orderBy(F.desc(ts) if newest_first else F.asc(ts))


def latest_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One whole row per key, the one with the greatest ``order``; NULL is the smallest.

    Of equal ones the same row is picked on every run, by a hash of its values.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    plain = [f.name for f in df.schema if not isinstance(f.dataType, MapType)]
    place = F.struct(order.isNotNull(), order, F.xxhash64(*plain))
    return df.groupBy(key).agg(F.max_by(row, place).alias("_row")).select("_row.*")

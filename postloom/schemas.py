"""Explicit schemas. Ids are strings, so long ids never pass through a double."""

from __future__ import annotations

from pyspark.sql import types as T

USER_FIELDS = [
    ("created_at", T.StringType()),
    ("description", T.StringType()),
    ("favourites_count", T.IntegerType()),
    ("followers_count", T.IntegerType()),
    ("friends_count", T.IntegerType()),
    ("id_str", T.StringType()),
    ("location", T.StringType()),
    ("name", T.StringType()),
    ("profile_image_url_https", T.StringType()),
    ("screen_name", T.StringType()),
    ("statuses_count", T.IntegerType()),
    ("verified", T.BooleanType()),
]


def _items(field: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(field, T.StringType())]))


USER = T.StructType([T.StructField(name, kind) for name, kind in USER_FIELDS])

ENTITIES = T.StructType(
    [
        T.StructField("hashtags", _items("text")),
        T.StructField("symbols", _items("text")),
        T.StructField("urls", _items("url")),
        T.StructField("user_mentions", _items("screen_name")),
    ]
)

# One post per JSON line. The last column keeps lines that do not parse.
RAW_POST = T.StructType(
    [
        T.StructField("created_at", T.StringType()),
        T.StructField("id_str", T.StringType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("is_quote_status", T.BooleanType()),
        T.StructField("retweet_count", T.IntegerType()),
        T.StructField("favorite_count", T.IntegerType()),
        T.StructField("in_reply_to_screen_name", T.StringType()),
        T.StructField("in_reply_to_status_id_str", T.StringType()),
        T.StructField("quoted_status_id_str", T.StringType()),
        T.StructField(
            "quoted_status_permalink", T.StructType([T.StructField("url", T.StringType())])
        ),
        T.StructField("user", USER),
        T.StructField("entities", ENTITIES),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

# The flat table kept per day.
CLEAN_COLUMNS = [
    "created_at",
    "id_str",
    "user_id_str",
    "source",
    "is_quote_status",
    "retweet_count",
    "favorite_count",
    "lang",
    "full_text",
]

# The narrow form used where only text and author matter.
NARROW_COLUMNS = ["created_at", "id_str", "user_id_str", "lang", "full_text"]

# What a live feed delivers per post.
STREAM_POST = T.StructType(
    [
        T.StructField("created_at", T.TimestampType()),
        T.StructField("id_str", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField(
            "user",
            T.StructType(
                [
                    T.StructField("id_str", T.StringType()),
                    T.StructField("screen_name", T.StringType()),
                    T.StructField("name", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "extended_tweet", T.StructType([T.StructField("full_text", T.StringType())])
        ),
        T.StructField(
            "retweeted_status", T.StructType([T.StructField("id_str", T.StringType())])
        ),
        T.StructField("reply_count", T.IntegerType()),
        T.StructField("retweet_count", T.IntegerType()),
        T.StructField("favorite_count", T.IntegerType()),
    ]
)

CAPTURE_COLUMNS = [
    "created_at",
    "id",
    "user_id",
    "username",
    "name",
    "tweet",
    "replies_count",
    "retweets_count",
    "likes_count",
]

NARRATIVE_POST = T.StructType(
    [
        T.StructField("created_at", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("tweet", T.StringType()),
    ]
)

EMBEDDING = T.StructType(
    [
        T.StructField("tweet_id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.operators import clean as K
from postloom.session import spread
from postloom.registry.base import query, table

LONG_WORDS = "[A-Z][a-z]{7,}"


def raw_posts(spark, sf_dir):
    """Documents in the nested shape posts arrive in."""
    found = F.regexp_extract_all("text", F.lit(LONG_WORDS), F.lit(0))

    def items(field):
        return F.transform(found, lambda w: F.struct(w.alias(field)))

    return spread(table(spark, sf_dir, "documents")).select(
        F.expr("timestampadd(MINUTE, doc_id, timestamp_ntz'2024-01-01 00:00:00')").alias("created_at"),
        F.col("doc_id").cast("string").alias("id_str"),
        F.struct(
            (F.col("doc_id") % 97).cast("string").alias("id_str"),
            F.col("source").alias("screen_name"),
            F.concat_ws("_", "source", "lang").alias("name"),
            (F.col("n_chars") % 1000).cast("int").alias("followers_count"),
            (F.col("n_chars") % 2 == 0).alias("verified"),
        ).alias("user"),
        F.concat(
            F.lit('<a href="http://'), "source", F.lit('.example.org">'), "source", F.lit("</a>")
        ).alias("source"),
        (F.col("n_chars") % 3 == 0).alias("is_quote_status"),
        (F.col("n_chars") % 100).cast("int").alias("retweet_count"),
        (F.col("n_chars") % 7).cast("int").alias("favorite_count"),
        "lang",
        F.col("text").alias("full_text"),
        F.when(
            F.col("n_chars") % 3 == 0,
            F.struct(F.concat(F.lit("http://q/"), F.col("doc_id").cast("string")).alias("url")),
        ).alias("quoted_status_permalink"),
        F.struct(
            items("text").alias("hashtags"),
            F.filter(items("text"), lambda x: F.length(x["text"]) > 12).alias("symbols"),
            items("url").alias("urls"),
            items("screen_name").alias("user_mentions"),
        ).alias("entities"),
    )


RAW_SQL = f"""
with raw as (
  select timestamp '2024-01-01 00:00:00' + to_minutes(doc_id) as created_at,
         cast(doc_id as varchar) as id_str, cast(doc_id % 97 as varchar) as user_id_str,
         source as user_screen_name, source || '_' || lang as user_name,
         cast(n_chars % 1000 as integer) as user_followers_count,
         n_chars % 2 = 0 as user_verified,
         '<a href="http://' || source || '.example.org">' || source || '</a>' as source,
         source as tweet_source,
         n_chars % 3 = 0 as is_quote_status, cast(n_chars % 100 as integer) as retweet_count,
         cast(n_chars % 7 as integer) as favorite_count, lang, text as full_text,
         case when n_chars % 3 = 0 then 'http://q/' || doc_id end as quoted_status_url,
         regexp_extract_all(text, '{LONG_WORDS}') as found
  from documents)
"""


@query(
    "clean_posts",
    RAW_SQL
    + """select created_at, id_str, user_id_str, source, is_quote_status, retweet_count,
       favorite_count, lang, full_text from raw""",
)
def clean_posts(spark, sf_dir):
    return K.clean_posts(raw_posts(spark, sf_dir))


@query(
    "narrow_posts",
    RAW_SQL + "select created_at, id_str, user_id_str, lang, full_text from raw",
)
def narrow_posts(spark, sf_dir):
    return K.clean_posts(
        raw_posts(spark, sf_dir), ["created_at", "id_str", "user_id_str", "lang", "full_text"]
    )


JOINED = "nullif(array_to_string(found, ','), '')"


@query(
    "flatten_posts",
    RAW_SQL
    + f"""select created_at, id_str, is_quote_status, retweet_count, favorite_count, lang,
       full_text, user_id_str, user_screen_name, user_name, user_followers_count, user_verified,
       {JOINED} as hashtags,
       nullif(array_to_string(list_filter(found, lambda w: length(w) > 12), ','), '') as symbols,
       {JOINED} as urls, {JOINED} as user_mentions, tweet_source, quoted_status_url
from raw""",
)
def flatten_posts(spark, sf_dir):
    raw = raw_posts(spark, sf_dir)
    return K.flatten_posts(raw, raw.schema["user"].dataType.names)


@query(
    "user_flatten",
    """select c_custkey, c_name as user_name, cast(c_nationkey as varchar) as user_location,
       c_mktsegment as user_description from customer""",
)
def user_flatten(spark, sf_dir):
    nested = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.struct(
            F.col("c_name").alias("name"),
            F.col("c_nationkey").cast("string").alias("location"),
            F.col("c_mktsegment").alias("description"),
        ).alias("user"),
    )
    return K.flatten_user(nested, ["name", "location", "description"])


@query("english_posts", "select * from documents where lang = 'en'")
def english_posts(spark, sf_dir):
    return K.english(table(spark, sf_dir, "documents"))


@query("long_post_filter", "select doc_id, text from documents where length(text) <= 330")
def long_post_filter(spark, sf_dir):
    return K.not_too_long(table(spark, sf_dir, "documents"), "text").select("doc_id", "text")


@query(
    "fill_missing",
    """select doc_id, coalesce(nullif(lang, 'en'), 'none') as lang,
       nullif(n_chars % 5, 0) as remainder from documents""",
)
def fill_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.nullif("lang", F.lit("en")).alias("lang"),
        F.nullif(F.col("n_chars") % 5, F.lit(0)).alias("remainder"),
    )
    return K.fill_missing(rows)


@query(
    "blank_to_missing",
    """with r as (select doc_id, regexp_replace(lang, '^en$', '') as lang from documents)
select doc_id, case when lang = '' then 'none' else lang end as lang from r""",
)
def blank_to_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_replace("lang", "^en$", "").alias("lang")
    )
    return K.blank_to_missing(rows)


@query("row_count_check", "select count(distinct label) as labels from embeddings")
def row_count_check(spark, sf_dir):
    return K.expect_label_count(table(spark, sf_dir, "embeddings"), "label", 10)


@query(
    "union_sources",
    """select 'documents' as origin, text, lang from documents
union all select 'benchmark', text, null from benchmark
union all select 'conversations', text, null from conversations""",
)
def union_sources(spark, sf_dir):
    def part(name, *columns):
        return table(spark, sf_dir, name).select(F.lit(name).alias("origin"), *columns)

    return K.union_posts(
        part("documents", "text", "lang"), part("benchmark", "text"), part("conversations", "text")
    )


@query(
    "typed_columns",
    """select cast(event_id as varchar) as event_id,
       try_cast(regexp_extract(props, '[0-9]+') as integer) as k,
       try_cast(event_type as integer) as event_type,
       try_cast(cast(ts as varchar) as timestamp) as ts
from events""",
)
def typed_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.regexp_extract("props", "[0-9]+", 0).alias("k"),
        "event_type",
        F.col("ts").cast("string").alias("ts"),
    )
    return K.typed(
        rows, {"event_id": "string", "k": "int", "event_type": "int", "ts": "timestamp_ntz"}
    )


@query("drop_columns", "select doc_id, lang, n_chars from documents")
def drop_columns(spark, sf_dir):
    return table(spark, sf_dir, "documents").drop("text", "source")


@query(
    "retweet_filter",
    "select conv_id, turn, text from conversations where not contains(text, 'Re')",
)
def retweet_filter(spark, sf_dir):
    """The sign of a retweet, looked for with a text the table has."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    marked = rows.withColumn("signed", F.replace("text", F.lit("Re"), F.lit("RT @")))
    return K.not_retweets(marked, "signed").drop("signed")


@query(
    "pattern_filter",
    r"select doc_id, text from documents where regexp_matches(text, '(?i)token[\s]*=')",
)
def pattern_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return K.matching(rows, "text", r"(?iu)token[\s]*=")


@query(
    "pattern_pair_filter",
    """select doc_id, len(regexp_extract_all(text, '(?i)the'))::integer as first,
       len(regexp_extract_all(text, '(?i)tion'))::integer as second
from documents where regexp_matches(text, '(?i)the') and regexp_matches(text, '(?i)tion')""",
)
def pattern_pair_filter(spark, sf_dir):
    from postloom.functions.topics import topic_pair

    rows = K.matching_both(table(spark, sf_dir, "documents"), "text", "(?iu)the", "(?iu)tion")
    return rows.select("doc_id", topic_pair(F.col("text"), "(?iu)the", "(?iu)tion").alias("p")).select(
        "doc_id", "p.*"
    )


@query("present_filter", "select doc_id, lang from documents where lang <> 'de'")
def present_filter(spark, sf_dir):
    return K.present(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "de")


@query(
    "latest_per_user",
    """select user_id, event_id, ts, event_type from events
qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
)
def latest_per_user(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return K.latest_per_key(rows, "user_id", F.struct("ts", "event_id"))


@query(
    "narrative_columns",
    """select cast(d.doc_id as varchar) as id, d.text as tweet, l.quality as narrative
from documents d join labels l using (doc_id)""",
)
def narrative_columns(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("tweet"),
        F.col("quality").alias("narrative"),
    )


# ---- nested fields -----------------------------------------------------------------


@query(
    "entity_lists",
    f"""select doc_id,
       nullif(array_to_string(regexp_extract_all(text, '{LONG_WORDS}'), ','), '') as hashtags
from documents""",
)
def entity_lists(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(LONG_WORDS), F.lit(0))
    items = F.transform(found, lambda w: F.struct(w.alias("text")))
    rows = table(spark, sf_dir, "documents").select("doc_id", items.alias("items"))
    return rows.select("doc_id", K.joined_items(F.col("items"), "text").alias("hashtags"))


@query(
    "joined_lists",
    f"""select conv_id, turn,
       array_to_string(regexp_extract_all(text, '{LONG_WORDS}'), ',') as mentions
from conversations""",
)
def joined_lists(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(LONG_WORDS), F.lit(0))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", K.joined_list(found).alias("mentions")
    )


@query(
    "reply_lists",
    f"""with r as (select conv_id, turn, regexp_extract_all(text, '{LONG_WORDS}') as w
from conversations)
select conv_id, turn,
       array_to_string(list_transform(w, lambda x: length(x)::varchar), ',') as reply_to_userids,
       array_to_string(w, ',') as reply_to_usernames
from r""",
)
def reply_lists(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(LONG_WORDS), F.lit(0))
    items = F.transform(
        found, lambda w: F.struct(F.length(w).alias("user_id"), w.alias("username"))
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", items.alias("reply_to"))
    return rows.select(
        "conv_id",
        "turn",
        K.joined_cast(F.col("reply_to"), "user_id").alias("reply_to_userids"),
        K.joined_cast(F.col("reply_to"), "username").alias("reply_to_usernames"),
    )


@query("json_props", "select event_id, cast(props->>'k' as integer) as k from events")
def json_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    "anchor_label",
    """with a as (
  select page_id, unnest(regexp_extract_all(html, '<a [^>]*>[^<]*</a>')) as anchor from pages)
select page_id, anchor, regexp_extract(anchor, '>(.*?)<', 1) as label from a""",
)
def anchor_label(spark, sf_dir):
    anchors = F.regexp_extract_all("html", F.lit("(<a [^>]*>[^<]*</a>)"), F.lit(0))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(anchors).alias("anchor"))
    return rows.withColumn("label", K.anchor_label(F.col("anchor")))


@query(
    "scraped_posts",
    f"""with r as (select event_id, ts, regexp_extract_all(props, '[a-z]+|[0-9]+') as parts,
       event_type from events)
select event_id, ts + interval 8 hour as created_at, array_to_string(parts, ',') as hashtags,
       coalesce(nullif(case when event_type = 'click' then '' else event_type end, ''), 'none')
         as photos,
       array_to_string(list_transform(parts, lambda x: length(x)::varchar), ',')
         as reply_to_userids,
       array_to_string(parts, ',') as reply_to_usernames
from r""",
)
def scraped_posts(spark, sf_dir):
    parts = F.regexp_extract_all("props", F.lit("([a-z]+|[0-9]+)"), F.lit(0))
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("created_at"),
        parts.alias("hashtags"),
        F.when(F.col("event_type") == "click", F.array(F.lit("")))
        .otherwise(F.array("event_type"))
        .alias("photos"),
        F.transform(
            parts, lambda w: F.struct(F.length(w).alias("user_id"), w.alias("username"))
        ).alias("reply_to"),
        F.lit("x").alias("near"),
    )
    out = K.flatten_scraped(rows, drop=["near"])
    return out.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))

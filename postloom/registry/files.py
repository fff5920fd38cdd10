"""Sources and sinks: the tables are written in each format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postloom import schemas
from postloom.operators import clean as K
from postloom.plans import days as PD
from postloom.plans import stages
from postloom.registry.base import query, table
from postloom.registry.tables import LONG_WORDS, RAW_SQL, raw_posts
from postloom.session import shared_folder
from postloom.sources import csv_ranges as SR
from postloom.sources import embeddings as SE
from postloom.sources import posts as SP
from postloom.sources import warehouse as SW

CLEAN_SQL = """select created_at, id_str, user_id_str, source, is_quote_status, retweet_count,
       favorite_count, lang, full_text from raw"""


def _platform_lines(spark, sf_dir):
    """Raw posts as they arrive: time stamps in the platform's spelling."""
    stamp = F.date_format(F.col("created_at").cast("timestamp"), "E MMM dd HH:mm:ss Z yyyy")
    return raw_posts(spark, sf_dir).withColumn("created_at", stamp)


@query(
    "json_lines",
    f"""select cast(doc_id as varchar) as id_str, text as full_text, lang,
       cast(n_chars % 100 as integer) as retweet_count,
       cast(doc_id % 97 as varchar) as user_id_str,
       nullif(array_to_string(regexp_extract_all(text, '{LONG_WORDS}'), ','), '') as hashtags
from documents""",
)
def json_lines(spark, sf_dir):
    path = shared_folder(spark, "raw")
    SP.write_json(_platform_lines(spark, sf_dir), path)
    raw = SP.read_raw_posts(spark, path, ["id_str", "full_text", "lang", "retweet_count", "user", "entities"])
    return raw.select(
        "id_str",
        "full_text",
        "lang",
        "retweet_count",
        F.col("user.id_str").alias("user_id_str"),
        K.joined_items(F.col("entities.hashtags"), "text").alias("hashtags"),
    )


@query("ingest_days", RAW_SQL + CLEAN_SQL.replace(" from raw", ", cast(created_at as date) as day from raw"))
def ingest_days(spark, sf_dir):
    """Raw gzip lines to the clean table by day, all days in one job."""
    path, target = shared_folder(spark, "raw"), shared_folder(spark, "clean")
    SP.write_json(_platform_lines(spark, sf_dir), path)
    stages.ingest(spark, path, target)
    out = SP.read_days(spark, target)
    return out.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("id_list", "select cast(doc_id as varchar) as value from labels")
def id_list(spark, sf_dir):
    source, target = shared_folder(spark, "ids"), shared_folder(spark, "ids")
    rows = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "tweet_id")
    rows.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(source)
    SP.write_ids(SP.read_ids(spark, source), target)
    return spark.read.text(target)


@query(
    "day_tables",
    """select event_id, user_id, cast(ts as date) as day from events
where cast(ts as date) in (date '2024-01-03', date '2024-01-20')""",
)
def day_tables(spark, sf_dir):
    target = shared_folder(spark, "days")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    SP.write_days(rows, target)
    return SP.read_days(spark, target, ["2024-01-03", "2024-01-20"])


@query(
    "day_overwrite",
    """select cast(ts as date) as day, count(*) as n, min(case when ts >= '2024-01-25'
       then 'second' else 'first' end) as run from events group by 1""",
)
def day_overwrite(spark, sf_dir):
    """The second write replaces its days and leaves the others."""
    target = shared_folder(spark, "days")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.to_date("ts").alias("day"))
    SP.write_days(rows.withColumn("run", F.lit("first")), target)
    late = rows.where(F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-25")))
    SP.write_days(late.withColumn("run", F.lit("second")), target)
    return SP.read_days(spark, target).groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.min("run").alias("run")
    )


@query(
    "vector_csv",
    "select cast(vec_id as varchar) as tweet_id, list_transform(embedding, lambda x: x)[64] as last,"
    " len(embedding)::integer as width from embeddings",
)
def vector_csv(spark, sf_dir):
    path = shared_folder(spark, "wide")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("tweet_id"), "embedding"
    )
    SE.write_wide_csv(rows, path, 64)
    back = SE.read_wide_csv(spark, path, 64)
    return back.select(
        "tweet_id", F.col("embedding")[63].alias("last"), F.size("embedding").alias("width")
    )


@query(
    "vector_parquet",
    "select cast(vec_id as varchar) as tweet_id, embedding[1] as first, embedding[64] as last"
    " from embeddings",
)
def vector_parquet(spark, sf_dir):
    path = shared_folder(spark, "vectors")
    SE.write_embeddings(
        table(spark, sf_dir, "embeddings").select(
            F.col("vec_id").cast("string").alias("tweet_id"), "embedding"
        ),
        path,
    )
    back = SE.read_embeddings(spark, path)
    return back.select(
        "tweet_id", F.col("embedding")[0].alias("first"), F.col("embedding")[63].alias("last")
    )


@query(
    "labelled_files",
    """select 'lang=' || lang as narrative, cast(doc_id as varchar) as id, text as tweet
from documents""",
)
def labelled_files(spark, sf_dir):
    """One folder per label, all read in one scan."""
    root = shared_folder(spark, "labelled")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("tweet"), "lang"
    )
    rows.write.partitionBy("lang").json(root)
    return SP.read_labelled(spark, root, schemas.NARRATIVE_POST).select("narrative", "id", "tweet")


@query(
    "csv_roundtrip",
    "select conv_id, turn, role, text, array_to_string(list_value(role, lang_), '+') as tags "
    "from (select *, length(text)::varchar as lang_ from conversations)",
)
def csv_roundtrip(spark, sf_dir):
    """Texts with newlines and quotes, and an array, through CSV."""
    path = shared_folder(spark, "csv")
    rows = table(spark, sf_dir, "conversations").withColumn(
        "tags", F.array("role", F.length("text").cast("string"))
    )
    SP.write_csv(rows, path)
    back = SP.read_csv(spark, path, "conv_id bigint, turn bigint, role string, text string, tags string")
    tags = F.from_json("tags", "array<string>")
    return back.withColumn("tags", F.array_join(tags, "+"))


@query("csv_ranges", "select doc_id, text, lang, source, n_chars from documents")
def csv_ranges(spark, sf_dir):
    """Whole texts through CSV, each file read by as many tasks as it has splits."""
    path = shared_folder(spark, "csv")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    SP.write_csv(rows, path)
    return SR.read_csv_ranges(spark, path, rows.schema)


@query("stored_frame", "select item_id, text from benchmark")
def stored_frame(spark, sf_dir):
    path = shared_folder(spark, "frame")
    SP.write_table(table(spark, sf_dir, "benchmark"), path)
    return spark.read.parquet(path)


@query(
    "warehouse_table",
    """select doc_id, text, lang from documents where lang = 'en'""",
)
def warehouse_table(spark, sf_dir):
    """A table per day, written once; a second load of another content changes nothing."""
    name = SW.table_of_day(f"posts_{uuid.uuid4().hex}", "2024-01-10")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    SW.load_once(rows, name, shared_folder(spark, "warehouse"))
    if SW.load_once(rows.limit(0), name):
        raise ValueError("an existing table was replaced")
    rows = SW.english_rows(spark, name)
    SW.drop_table(spark, name)  # the rows are read from their own path
    return rows


@query(
    "warehouse_days",
    """select distinct case lang when 'de' then date '2024-01-01' when 'en' then date '2024-01-02'
       when 'es' then date '2024-01-03' else date '2024-01-04' end as day from documents""",
)
def warehouse_days(spark, sf_dir):
    """Days listed from the names of their tables."""
    prefix = f"daily_{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    for i, lang in enumerate(["de", "en", "es", "fr"], start=1):
        name = SW.table_of_day(prefix, f"2024-01-0{i}")
        SW.load_once(rows.where(F.col("lang") == lang), name, shared_folder(spark, "warehouse"))
    days = SW.table_days(spark, prefix)
    for name in SW.table_names(spark, prefix):
        SW.drop_table(spark, name)
    return days


@query(
    "day_runner",
    """select cast(ts as date) as day, count(*) as n, sum(length(event_type))::bigint as letters
from events where cast(ts as date) >= (select cast(max(ts) as date) - 4 from events) group by 1""",
)
def day_runner(spark, sf_dir):
    """Two runs over the missing days, newest first: three days, then the next two."""
    target, status = shared_folder(spark, "days"), shared_folder(spark, "status")
    source = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))

    def work(rows):
        return rows.select("day", "event_id", F.length("event_type").alias("letters"))

    for n in (3, 2):
        PD.run_days(spark, source, "letters", work, target, status, at_most=n)
    return SP.read_days(spark, target).groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("letters").alias("letters")
    )

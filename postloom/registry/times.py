from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions import dates as D
from postloom.operators import clean as K
from postloom.operators import timeseries as TS
from postloom.registry.base import query, table


def bucket_sql(width):
    return f"select time_bucket(interval '{width}', ts) as bucket, count(*) as n from events group by 1"


@query("tumbling_15m", bucket_sql("15 minutes"))
def tumbling_15m(spark, sf_dir):
    return TS.bucket_counts(table(spark, sf_dir, "events"), "ts", "15 minutes")


@query("tumbling_30m", bucket_sql("30 minutes"))
def tumbling_30m(spark, sf_dir):
    return TS.bucket_counts(table(spark, sf_dir, "events"), "ts", "30 minutes", "event_id")


RIGHT = """time_bucket(interval '15 minutes', ts - interval 1 microsecond)
         + interval 15 minute"""


@query("right_closed_15m", f"select {RIGHT} as bucket, count(*) as n from events group by 1")
def right_closed_15m(spark, sf_dir):
    return TS.bucket_counts(table(spark, sf_dir, "events"), "ts", "15 minutes", right_closed=True)


def dense_sql(bucket):
    return f"""
with c as (select {bucket} as bucket, count(*) as n from events group by 1),
s as (select unnest(generate_series((select min(bucket) from c), (select max(bucket) from c),
                                    interval 15 minute)) as bucket)
select s.bucket, coalesce(c.n, 0) as n from s left join c using (bucket)"""


@query("dense_15m", dense_sql("time_bucket(interval '15 minutes', ts)"))
def dense_15m(spark, sf_dir):
    return TS.dense_counts(table(spark, sf_dir, "events"), "ts", "15 minutes")


@query("dense_right_closed_15m", dense_sql(RIGHT))
def dense_right_closed_15m(spark, sf_dir):
    return TS.dense_counts(table(spark, sf_dir, "events"), "ts", "15 minutes", right_closed=True)


@query(
    "gap_runs",
    """with c as (select distinct time_bucket(interval '2 minutes', ts) as bucket from events),
p as (select bucket + interval 2 minute as gap_start, lead(bucket) over (order by bucket) as gap_end
      from c)
select gap_start, gap_end, cast(epoch(gap_end - gap_start) / 120 as bigint) as buckets
from p where gap_end > gap_start""",
)
def gap_runs(spark, sf_dir):
    return TS.gaps(table(spark, sf_dir, "events"), "ts", "2 minutes")


# Daylight time of these years runs from the first Sunday of April to the last of October.
SUMMER = """
with o as (select o_orderkey, o_orderdate + interval 150 minute as ts from orders),
y as (select *, make_date(cast(year(ts) as integer), 4, 1) as april,
             make_date(cast(year(ts) as integer), 10, 31) as october from o),
s as (select *, april + cast((7 - dayofweek(april)) % 7 as integer) as first_day,
             october - cast(dayofweek(october) as integer) as last_day from y)
select o_orderkey, case
    when cast(ts as date) = first_day then date_trunc('day', ts) + interval 10 hour
         - interval 1 microsecond
    when cast(ts as date) > first_day and cast(ts as date) < last_day then ts + interval 7 hour
    else ts + interval 8 hour end as utc
from s"""


@query("local_to_utc", SUMMER)
def local_to_utc(spark, sf_dir):
    """Half past two in the night of every order: one night a year has no such time."""
    local = (F.col("o_orderdate") + F.expr("interval 150 minutes")).cast("timestamp")
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", D.local_to_utc(local).cast("timestamp_ntz").alias("utc"))


@query("platform_time", "select event_id, date_trunc('second', ts) as created_at from events")
def platform_time(spark, sf_dir):
    stamp = F.col("ts").cast("timestamp")
    text = F.date_format(stamp, "E MMM dd HH:mm:ss Z yyyy")
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("created_at"))
    return rows.select(
        "event_id", D.platform_time(F.col("created_at")).cast("timestamp_ntz").alias("created_at")
    )


@query(
    "day_slice",
    "select event_id, ts from events where ts >= '2024-01-10' and ts < '2024-01-11'",
)
def day_slice(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(D.on_day(F.col("ts"), "2024-01-10"))
    return rows.select("event_id", "ts")


@query(
    "date_spine",
    """select cast(unnest(generate_series(min(o_orderdate), max(o_orderdate), interval 1 day))
       as date) as day from orders""",
)
def date_spine(spark, sf_dir):
    ends = table(spark, sf_dir, "orders").agg(
        F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi")
    )
    return ends.select(D.days_between(F.col("lo"), F.col("hi")).alias("day"))


@query(
    "day_names",
    """select strftime(day, '%Y-%m-%d') as plain, strftime(day, '%Y_%m_%d') as table_name,
       day from (select distinct cast(ts as date) as day from events)""",
)
def day_names(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d")).distinct()
    path = F.concat(F.lit("dailies/"), D.day_text(F.col("d")), F.lit("/x_clean.json.gz"))
    return days.select(
        D.day_text(F.col("d")).alias("plain"),
        D.day_text(F.col("d"), underscores=True).alias("table_name"),
        D.day_of_path(path).alias("day"),
    )


@query("newest_first", "select event_id, ts from events order by ts desc")
def newest_first(spark, sf_dir):
    return K.sort_by_time(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", True)

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.operators import joins as J
from postloom.operators import sampling as L
from postloom.registry.base import query, table

ORDER_DAYS = "select distinct cast(o_orderdate as date) as day from orders"
SHIP_DAYS = "select distinct cast(l_shipdate as date) as day from lineitem"


def _days(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    done = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    return wanted, done


@query("missing_days", f"{SHIP_DAYS} except {ORDER_DAYS}")
def missing_days(spark, sf_dir):
    return J.missing_days(*_days(spark, sf_dir))


@query("present_days", f"{SHIP_DAYS} intersect {ORDER_DAYS}")
def present_days(spark, sf_dir):
    return J.present_days(*_days(spark, sf_dir))


@query("set_difference", f"{SHIP_DAYS} except {ORDER_DAYS}")
def set_difference(spark, sf_dir):
    return J.day_difference(*_days(spark, sf_dir))


@query(
    "latest_missing_days", f"select day from ({SHIP_DAYS} except {ORDER_DAYS}) order by day desc limit 2"
)
def latest_missing_days(spark, sf_dir):
    return L.newest_days(J.missing_days(*_days(spark, sf_dir)), 2)


@query(
    "missing_days_two_names",
    f"""with files as (
  select case when day(day) % 2 = 0 then 'dailies/' || day || '/' || day || '_clean.json'
              else 'dailies/' || day || '/first_' || day || '_clean.json' end as path
  from ({ORDER_DAYS}))
{SHIP_DAYS} except select cast(regexp_extract(path, '[0-9-]{{10}}') as date) from files""",
)
def missing_days_two_names(spark, sf_dir):
    """A day is there when a file of either name is."""
    from postloom.functions.dates import day_of_path, day_text

    wanted, done = _days(spark, sf_dir)
    name = day_text(F.col("day"))
    prefix = F.when(F.day("day") % 2 == 0, F.lit("")).otherwise(F.lit("first_"))
    files = done.distinct().select(
        F.concat(F.lit("dailies/"), name, F.lit("/"), prefix, name, F.lit("_clean.json")).alias("path")
    )
    return J.missing_days(wanted, files.select(day_of_path(F.col("path")).alias("day")))


@query(
    "exact_sample",
    "select event_id, ts, user_id from events order by md5('8:' || event_id), event_id limit 1000",
)
def exact_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return L.exact_sample(rows, "event_id", 1000)


@query("exact_sample_of_few", "select vec_id, label from embeddings")
def exact_sample_of_few(spark, sf_dir):
    """More rows asked for than there are: all of them."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return L.exact_sample(rows, "vec_id", 10_000_000)


@query(
    "bernoulli_sample",
    """select l_orderkey, l_linenumber from lineitem
where substr(md5('8:' || l_orderkey), 1, 8) < '028f5c28'""",
)
def bernoulli_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return L.bernoulli(rows, "l_orderkey", 0.01)


@query("first_rows", "select doc_id, text from documents order by doc_id limit 20")
def first_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return L.first_rows(rows, 20, "doc_id")

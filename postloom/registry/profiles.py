from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from postloom.operators import frequent as FQ
from postloom.operators import profile as P
from postloom.operators import sketch_days as SD
from postloom.session import shared_folder, spread
from postloom.registry.base import query, rounded, table
from postloom.registry.texts import STOP_WORDS, in_list, word_list


@query(
    "top_values",
    "select c_nationkey, count(*) as n from customer group by 1 order by n desc, 1 limit 15",
)
def top_values(spark, sf_dir):
    return P.value_counts(table(spark, sf_dir, "customer"), "c_nationkey", 15)


@query(
    "top_values_skip_missing",
    """select event_type, count(*) as n from events where event_type <> 'signup'
group by 1 order by n desc, 1 limit 15""",
)
def top_values_skip_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return P.value_counts(rows, "event_type", 15, skip_missing=True, missing="signup")


@query(
    "value_share",
    """select lang, count(*) as n, round(count(*) / sum(count(*)) over () * 100, 4) as percent
from documents group by lang""",
)
def value_share(spark, sf_dir):
    return P.value_shares(table(spark, sf_dir, "documents"), "lang")


@query(
    "value_counts_with_null",
    """select l.quality, count(*) as n from documents d left join labels l using (doc_id)
group by 1""",
)
def value_counts_with_null(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return P.value_counts(rows, "quality", keep_null=True)


@query(
    "value_counts_without_null",
    """select l.quality, count(*) as n from documents d join labels l using (doc_id)
where quality is not null group by 1""",
)
def value_counts_without_null(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return P.value_counts(rows, "quality")


LINE_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice "
    "l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()


@query(
    "distinct_per_column",
    " union all ".join(
        f"select '{c}' as column, count(distinct {c}) + "
        f"coalesce(max(case when {c} is null then 1 end), 0) as distinct_values from lineitem"
        for c in LINE_COLUMNS
    ),
)
def distinct_per_column(spark, sf_dir):
    return P.distinct_counts(table(spark, sf_dir, "lineitem"), LINE_COLUMNS)


@query("distinct_per_column_approx")
def distinct_per_column_approx(spark, sf_dir):
    return P.approx_distinct_counts(table(spark, sf_dir, "lineitem"))


@query(
    "distinct_approx_error",
    " union all ".join(f"select '{c}' as column, true as within" for c in LINE_COLUMNS),
)
def distinct_approx_error(spark, sf_dir):
    """Whether each approximate count is within 15 % of the exact one, three of its deviations."""
    lines = table(spark, sf_dir, "lineitem")
    about = P.approx_distinct_counts(lines, LINE_COLUMNS)
    named = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("about")) for c in LINE_COLUMNS]
    )
    both = P.distinct_counts(lines, LINE_COLUMNS).join(about.select(F.inline(named)), "column")
    off = F.abs(F.col("about") - F.col("distinct_values"))
    return both.select("column", (off <= 0.15 * F.col("distinct_values")).alias("within"))


SKETCHED = ["event_id", "user_id", "event_type", "value"]


@query(
    "sketch_days",
    " union all ".join(
        f"select '{c}' as column, count(*) as rows, count({c}) as present, "
        f"count(distinct {c}) as exact, true as distinct_near, true as quartiles_near from events"
        for c in SKETCHED
    ),
)
def sketch_days(spark, sf_dir):
    """Two days of part of the rows, both again with all, then the other days, merged: distinct
    values within 4 % (five deviations), ranks of the quartiles within 2 % of the exact ones."""
    start = date(2024, 1, 1)
    days = [start + timedelta(d) for d in range(7)]
    events = table(spark, sf_dir, "events").withColumn(
        "day", F.date_add(F.lit(start), F.pmod("event_id", F.lit(7)).cast("int"))
    )
    path = shared_folder(spark, "sketch-days")
    SD.update_sketches(events.where("event_id % 3 = 0"), path, days[:2], SKETCHED)
    SD.update_sketches(events, path, days[:2], SKETCHED)
    SD.update_sketches(events, path, days[2:], SKETCHED)
    ranks = (0.25, 0.5, 0.75)
    about = SD.profile_of_days(spark, path, ranks=ranks)
    exact = events.agg(*[F.count_distinct(c).alias(c) for c in SKETCHED])
    named = [F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in SKETCHED]
    both = about.join(exact.select(F.inline(F.array(*named))), "column")
    # numbers at most a quantile reach its rank, those below it don't pass it
    shares = events.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("number"))
        for c in ("event_id", "user_id", "value")
    ]))).join(F.broadcast(about.select("column", "quantiles")), "column").groupBy("column").agg(
        *[F.avg((F.col("number") <= F.col("quantiles")[i]).cast("int")).alias(f"upto{i}") for i in range(3)],
        *[F.avg((F.col("number") < F.col("quantiles")[i]).cast("int")).alias(f"below{i}") for i in range(3)],
    )
    right = F.lit(True)
    for i, rank in enumerate(ranks):
        right &= (F.col(f"upto{i}") >= rank - 0.02) & (F.col(f"below{i}") <= rank + 0.02)
    checked = both.join(shares.select("column", right.alias("right")), "column", "left")
    return checked.select(
        "column",
        "rows",
        "present",
        "exact",
        (F.abs(F.col("distinct_values") - F.col("exact")) <= 0.04 * F.col("exact")).alias("distinct_near"),
        F.coalesce("right", F.col("quantiles").isNull()).alias("quartiles_near"),
    )


@query("distinct_values", "select distinct label from embeddings")
def distinct_values(spark, sf_dir):
    return P.distinct_values(table(spark, sf_dir, "embeddings"), "label")


@query("duplicate_count", "select count(*) - count(distinct text) as duplicates from documents")
def duplicate_count(spark, sf_dir):
    return P.duplicate_count(table(spark, sf_dir, "documents"), "text")


@query(
    "histogram20",
    """with e as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
c as (
  select cast(least(floor((l_extendedprice - lo) / (hi - lo) * 20), 19) as integer) as bin,
         count(*) as n from lineitem, e group by 1)
select cast(b as integer) as bin, round(lo + (hi - lo) / 20 * b, 4) as lower,
       round(lo + (hi - lo) / 20 * (b + 1), 4) as upper, coalesce(n, 0) as n,
       round(case when n > 0 then log10(n) end, 6) as log10_n
from e, range(20) r(b) left join c on c.bin = b""",
)
def histogram20(spark, sf_dir):
    out = P.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20)
    return out.select(
        "bin", rounded("lower", 4), rounded("upper", 4), "n", rounded("log10_n")
    )


@query(
    "pattern_share",
    r"select round(avg(regexp_matches(text, '\n')::integer), 6) as share from documents",
)
def pattern_share(spark, sf_dir):
    return P.share_matching(table(spark, sf_dir, "documents"), "text", r"\n").select(
        rounded("share")
    )


EVENT_TYPES = {
    "event_id": "bigint",
    "ts": "timestamp_ntz",
    "user_id": "bigint",
    "event_type": "string",
    "value": "double",
    "props": "string",
}


@query(
    "column_profile",
    " union all ".join(
        f"select '{c}' as column, '{t}' as type, count({c}) as non_null from events"
        for c, t in EVENT_TYPES.items()
    ),
)
def column_profile(spark, sf_dir):
    return P.column_profile(table(spark, sf_dir, "events"))


WORDS_SQL = f"with w as (select unnest({word_list('text')}) as word from documents)\n"


@query(
    "word_freq",
    WORDS_SQL + "select word, count(*) as n from w group by 1 order by n desc, word limit 200",
)
def word_freq(spark, sf_dir):
    return P.word_counts(spread(table(spark, sf_dir, "documents")), "text", 200)


@query(
    "frequent_words",
    WORDS_SQL + "select word, count(*) as n from w group by 1 order by n desc, word limit 100",
)
def frequent_words(spark, sf_dir):
    return FQ.frequent_words(spread(table(spark, sf_dir, "documents")), "text", 100)


@query(
    "word_freq_without_stop_words",
    WORDS_SQL
    + f"""select word, count(*) as n from w where word not in {in_list(STOP_WORDS)}
group by 1 order by n desc, word limit 200""",
)
def word_freq_without_stop_words(spark, sf_dir):
    return P.word_counts(spread(table(spark, sf_dir, "documents")), "text", 200, STOP_WORDS)


@query(
    "corpus_length",
    f"""select length(string_agg(text, ' ')) as characters,
       sum(len({word_list('text')}))::bigint as words from documents""",
)
def corpus_length(spark, sf_dir):
    return P.corpus_length(spread(table(spark, sf_dir, "documents")), "text")


@query(
    "daily_distinct_users",
    """select cast(ts as date) as day, count(distinct user_id) as users from events group by 1""",
)
def daily_distinct_users(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.groupBy(F.to_date("ts").alias("day")).agg(
        F.count_distinct("user_id").alias("users")
    )

"""Tables, profiles, time, samples and joins."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from postloom.functions import dates as D
from postloom.functions import fixed
from postloom.functions import topics as T
from postloom.functions.nested import anchor_label, joined_items
from postloom.operators import clean as K
from postloom.operators import joins as J
from postloom.operators import profile as P
from postloom.operators import sampling as L
from postloom.operators import timeseries as TS


def test_entity_lists(spark):
    df = spark.createDataFrame(
        [(1, [("a",), ("b",)]), (2, []), (3, None)], "id int, tags array<struct<text:string>>"
    )
    found = [r[0] for r in df.orderBy("id").select(joined_items(F.col("tags"), "text")).collect()]
    assert found == ["a,b", None, None]


@pytest.mark.parametrize("markup, label", [('<a href="x">Web</a>', "Web"), ("none", None), ("><", ""), (None, None)])
def test_anchor(one, markup, label):
    assert one(anchor_label, markup) == label


def test_missing_values(spark):
    df = spark.createDataFrame([("", None, 1), (None, "x", None)], "a string, b string, n int")
    filled = K.fill_missing(K.blank_to_missing(df)).collect()
    assert [tuple(r) for r in filled] == [("none", "none", 1), ("none", "x", None)]


def test_length_limit_counts_characters(spark):
    df = spark.createDataFrame([("🧐" * 330,), ("a" * 331,), (None,)], "t string")
    assert K.not_too_long(df, "t").count() == 1


def test_row_counts(spark):
    before, a = K.counted(spark.range(10).toDF("x"), "a")
    after, b = K.counted(before.where("x < 9"), "b")
    after.write.format("noop").mode("overwrite").save()
    with pytest.raises(ValueError):
        K.same_row_count(a, b)
    with pytest.raises(Exception, match="expected 20 labels, found 10"):
        K.expect_label_count(spark.range(10).toDF("label"), "label").collect()


def test_topics(spark):
    df = spark.createDataFrame([(1, "Flu flu"), (2, "no"), (3, None)], "id int, t string")
    rows = df.orderBy("id").select(
        T.topic_hits(F.col("t"), "(?iu)flu", fixed.NO_TOPIC).alias("hits"),
        T.topic_hits(F.col("t"), "(?iu)flu").alias("plain_hits"),
        T.topic_hits(F.col("t"), "(?iu)flu", None).alias("null_hits"),
        T.topic_count(F.col("t"), "(?iu)flu").alias("n"),
    )
    assert [tuple(r) for r in rows.collect()] == [
        ("Flu,flu", "Flu,flu", "Flu,flu", 2), ("N/a", "", None, 0), (None, None, None, None)
    ]


TOPIC_TEXTS = [
    "COVID-19 is usa a american America USA united states bioweapons bio weapon biological weapon",
    "Jordan Sather Jorden Sathar QAnon qanon q anon, boiled ginger gingerginger Stomach EMPTY ſtomach",
    "5G 5g 5 g 5g5g & telephone network phone ſignals signal radiation causes; China chineſe",
]


def test_fast_topics_find_the_same(spark):
    df = spark.createDataFrame([(t,) for t in TOPIC_TEXTS], "t string")
    for name, pattern in fixed.TOPICS.items():
        fast = T.topic_hits(F.col("t"), fixed.FAST_TOPICS[name])
        pairs = df.select(T.topic_hits(F.col("t"), pattern).alias("a"), fast.alias("b")).collect()
        assert all(r["a"] == r["b"] for r in pairs), name
        if name not in ("newline", "flu", "silver"):
            assert any(r["a"] for r in pairs), name


def test_counts_with_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("none",)], "v string")
    assert [tuple(r) for r in P.value_counts(df, "v", 2).collect()] == [("a", 2), ("b", 1)]
    assert P.value_counts(df, "v", keep_null=True).count() == 4
    assert P.value_counts(df, "v", skip_missing=True).count() == 2
    assert P.distinct_counts(df).first()["distinct_values"] == 4
    assert P.duplicate_count(df, "v").first()["duplicates"] == 1


def test_histogram_of_one_value(spark):
    rows = P.histogram(spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double"), "v").orderBy("bin").collect()
    assert len(rows) == 20 and rows[0]["n"] == 2 and sum(r["n"] for r in rows) == 2


def test_top_k_is_not_a_full_sort(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet")
    assert "TakeOrderedAndProject" in plan_of(P.value_counts(rows, "lang", 3))


def test_exact_sample_is_ranked_in_many_tasks(spark, data):
    plan = plan_of(L.exact_sample(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", 10))
    assert "TakeOrderedAndProject" not in plan and "hashpartitioning(_lead" in plan


TIMES = ["10:00:00", "10:15:00", "10:15:00.000001", "10:59:59", "12:00:00"]


@pytest.mark.parametrize("right", [False, True])
def test_buckets_like_pandas(spark, right):
    stamps = [pd.Timestamp(f"2024-03-01 {t}") for t in TIMES]
    df = spark.createDataFrame([(s.to_pydatetime(),) for s in stamps], "ts timestamp_ntz")
    found = {r["bucket"]: r["n"] for r in TS.dense_counts(df, "ts", "15 minutes", right_closed=right).collect()}
    side = "right" if right else "left"
    wanted = pd.Series(1, index=stamps).resample("15min", label=side, closed=side).count()
    assert found == {k.to_pydatetime(): v for k, v in wanted.items()}


def test_gaps(spark):
    stamps = ["2024-03-01 10:00:00", "2024-03-01 10:45:00", "2024-03-01 23:50:00", "2024-03-03 00:20:00"]
    df = spark.createDataFrame([(dt.datetime.fromisoformat(s),) for s in stamps], "ts timestamp_ntz")
    rows = TS.gaps(df, "ts", "15 minutes", min_buckets=3).orderBy("gap_start").collect()
    assert [(str(r["gap_start"]), r["buckets"]) for r in rows] == [
        ("2024-03-01 11:00:00", 51),
        ("2024-03-02 00:00:00", 97),
    ]


def test_local_time_edges(spark):
    rows = [(dt.datetime(2020, 3, 8, 2, 30),), (dt.datetime(2020, 11, 1, 1, 30),), (dt.datetime(2020, 7, 1, 5, 0),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    utc = [r[0] for r in df.select(D.local_to_utc(F.col("ts").cast("timestamp")).cast("timestamp_ntz")).collect()]
    assert utc == [
        dt.datetime(2020, 3, 8, 9, 59, 59, 999999),
        dt.datetime(2020, 11, 1, 8, 30),
        dt.datetime(2020, 7, 1, 12, 0),
    ]


def test_platform_time(one):
    found = one(lambda c: D.platform_time(c).cast("timestamp_ntz"), "Wed May 27 10:00:00 +0200 2020")
    assert found == dt.datetime(2020, 5, 27, 8, 0)
    assert one(D.platform_time, "not a time") is None


def test_days(one, spark):
    assert one(D.day_of_path, "dailies/2020-05-27/x_2020-05-27.json") == dt.date(2020, 5, 27)
    assert one(D.day_of_path, "nothing") is None
    assert one(D.day_of_text, "2020_05_27") == dt.date(2020, 5, 27)
    ends = spark.sql("select date'2015-12-30' as a, date'2016-01-02' as b")
    assert ends.select(D.days_between(F.col("a"), F.col("b"))).count() == 4


def test_day_slice_reaches_the_scan(spark, data):
    rows = spark.read.parquet(f"{data}/events.parquet").where(D.on_day(F.col("ts"), "2024-01-05"))
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in plan_of(rows)


def test_samples(spark):
    df = spark.range(5000).toDF("id")
    a = L.exact_sample(df.repartition(3), "id", 300).collect()
    b = L.exact_sample(df.repartition(7), "id", 300).collect()
    assert len(a) == 300 and sorted(a) == sorted(b)
    assert sorted(L.exact_sample(df, "id", 300, seed=9).collect()) != sorted(a)
    assert L.exact_sample(df, "id", 10_000).count() == 5000
    assert 300 < L.bernoulli(df, "id", 0.1).count() < 700
    assert L.bernoulli(df, "id", 1.0).count() == 5000


def test_points_keep_their_rows(spark):
    points = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double")
    posts = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "k string, v int, t string")
    rows = J.attach_posts(points, posts, "k", F.col("v"), ["v", "t"]).orderBy("k").collect()
    assert [(r["k"], r["t"]) for r in rows] == [("a", "new"), ("b", None)]


def test_sentiment(spark):
    posts = spark.createDataFrame([(1, "Good good bad"), (2, "nothing"), (3, None)], "id int, t string")
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -1.0)], "word string, valence double")
    rows = {r["id"]: r["sentiment"] for r in J.sentiment_scores(posts, lexicon, "id", "t").collect()}
    assert rows == pytest.approx({1: 3 / (9 + 15) ** 0.5, 2: 0.0, 3: 0.0})


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, v int, t string")
    assert sorted(r["t"] for r in K.latest_per_key(df, "k", F.col("v")).collect()) == ["b", "c"]


def test_latest_per_key_with_null_order(spark):
    """A row without an order value is a row; of equal ones the same is picked every time."""
    rows = [(1, None, "a"), (2, None, "b"), (2, 3, "c"), (3, 5, "d"), (3, 5, "e")]
    df = spark.createDataFrame(rows, "k int, v int, t string")
    got = [
        sorted((r["k"], r["t"]) for r in K.latest_per_key(x, "k", F.col("v")).collect())
        for x in (df, df.repartition(5), df.orderBy(F.desc("t")))
    ]
    assert got[0][:2] == [(1, "a"), (2, "c")] and got[0] == got[1] == got[2]
    points = spark.createDataFrame([(1, 0.5)], "k int, x double")
    assert J.attach_posts(points, df, "k", F.col("v"), ["v", "t"]).first()["t"] == "a"


def test_null_text_is_no_retweet(spark):
    from postloom.streaming import capture

    df = spark.createDataFrame([(1, None), (2, "RT @a b"), (3, "c")], "id int, text string")
    assert [sorted(r["id"] for r in f(df).collect()) for f in (K.not_retweets, capture.original)] == [[1, 3]] * 2


def test_no_partitionless_window_over_values(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet")
    assert "Window" not in plan_of(P.value_shares(rows, "lang"))


def test_dense_series_in_runs(spark, monkeypatch):
    monkeypatch.setattr(TS, "RUN_BUCKETS", 7)
    for kind in ("timestamp_ntz", "timestamp"):
        df = spark.createDataFrame(
            [(dt.datetime(2024, 3, 1, 10),), (dt.datetime(2024, 3, 3, 4, 20),)], f"ts {kind}"
        )
        rows = TS.dense_counts(df, "ts", "1 hour").orderBy("bucket").collect()
        assert [r["n"] for r in rows] == [1] + [0] * 41 + [1]
        assert TS.dense_counts(df.limit(0), "ts", "1 hour").collect() == []


def test_distinct_counts_of_long_and_null_values(spark):
    long = "x" * 100
    rows = [(long,), (long,), (long + "y",), (None,), ("a",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert P.distinct_counts(df).first()["distinct_values"] == 5
    assert P.approx_distinct_counts(df).first()["t"] == 5

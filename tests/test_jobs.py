"""Sources, day jobs and streams on temporary folders."""

import datetime as dt
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom import schemas
from postloom.operators import clean as K
from postloom.plans import days as PD
from postloom.plans import stages
from postloom.sources import posts as SP
from postloom.sources import warehouse as SW
from postloom.streaming import capture as S
from postloom.streaming import windows as W


def raw_line(i, **more):
    return {
        "created_at": f"Wed May {20 + i % 2} 10:00:00 +0000 2020",
        "id_str": str(9007199254740993 + i),
        "full_text": f"text {i}",
        "lang": "en",
        "source": '<a href="x">Web App</a>',
        "is_quote_status": False,
        "retweet_count": i,
        "favorite_count": 0,
        "user": {"id_str": f"u{i}", "name": "N", "verified": True},
        "entities": {"hashtags": [{"text": "a"}, {"text": "b"}], "urls": [], "symbols": []},
        **more,
    }


def write_raw(path, lines):
    path.mkdir()
    with gzip.open(path / "day.json.gz", "wt") as out:
        for line in lines:
            out.write((line if isinstance(line, str) else json.dumps(line)) + "\n")


def test_ingest(spark, tmp_path):
    lines = [raw_line(i) for i in range(6)] + ["{broken", raw_line(7, created_at="nonsense")]
    write_raw(tmp_path / "raw", lines)
    target = str(tmp_path / "clean")
    assert stages.ingest(spark, str(tmp_path / "raw"), target) == 6
    rows = SP.read_days(spark, target, ["2020-05-20"])
    assert rows.columns == [*schemas.CLEAN_COLUMNS, "day"] and rows.count() == 3
    assert "9007199254740993" in [r["id_str"] for r in rows.collect()]
    assert spark.read.parquet(f"{target}_quarantine").count() == 2
    # A second run gives the same table.
    assert stages.ingest(spark, str(tmp_path / "raw"), target) == 6
    assert SP.read_days(spark, target).count() == 6


def test_day_reads_prune_partitions(spark, tmp_path):
    from conftest import plan_of

    rows = spark.range(10).select("id", F.expr("date_add(date'2024-01-01', cast(id % 2 as int))").alias("day"))
    SP.write_days(rows, str(tmp_path / "t"))
    plan = plan_of(SP.read_days(spark, str(tmp_path / "t"), ["2024-01-01"]))
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [(day" in plan or "PartitionFilters: [day" in plan


def test_rich_flattening(spark, tmp_path):
    write_raw(tmp_path / "raw", [raw_line(1, quoted_status_permalink={"url": "q"}), raw_line(2)])
    rows = K.fill_missing(K.flatten_posts(SP.read_raw_posts(spark, str(tmp_path / "raw")))).orderBy("id_str").collect()
    assert rows[0]["hashtags"] == "a,b" and rows[0]["urls"] == "none" and rows[0]["user_mentions"] == "none"
    assert rows[0]["tweet_source"] == "Web App" and rows[0]["user_name"] == "N"
    assert [r["quoted_status_url"] for r in rows] == ["q", "none"]
    assert rows[0]["user_followers_count"] is None


def test_split_and_column_json(spark, tmp_path):
    (tmp_path / "split.json").write_text(
        json.dumps({"columns": ["id", "tweet"], "index": [0, 1], "data": [["1", "a"], ["2", "b"]]})
    )
    (tmp_path / "columns.json").write_text(
        json.dumps({"id": {"0": "1", "1": "2"}, "tweet": {"0": "a", "1": "b"}})
    )
    want = [("1", "a"), ("2", "b")]
    kinds = ["string", "string"]
    split = SP.read_split_json(spark, str(tmp_path / "split.json"), ["id", "tweet"], kinds)
    columns = SP.read_columns_json(spark, str(tmp_path / "columns.json"), ["id", "tweet"], kinds)
    assert sorted(map(tuple, split.collect())) == want
    assert sorted(map(tuple, columns.collect())) == want


def test_id_list(spark, tmp_path):
    with gzip.open(tmp_path / "ids.tsv.gz", "wt") as out:
        out.write("tweet_id\tdate\n9007199254740993\tx\n2\ty\n")
    SP.write_ids(SP.read_ids(spark, str(tmp_path / "ids.tsv.gz")), str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["2", "9007199254740993"]


def test_warehouse(spark, tmp_path):
    name = SW.table_of_day("wh", "2024-01-02")
    assert SW.load_once(spark.sql("select 'en' as lang, 1 as x"), name, str(tmp_path / "w"))
    assert not SW.load_once(spark.sql("select 'en' as lang, 2 as x"), name)
    assert SW.table_names(spark, "wh") == ["wh_2024_01_02"]
    assert [r["x"] for r in SW.english_rows(spark, name).collect()] == [1]
    assert SW.table_days(spark, "wh").first()["day"] == dt.date(2024, 1, 2)


def test_day_runner(spark, tmp_path):
    source = spark.range(40).select(
        "id", F.expr("date_add(date'2024-01-01', cast(id % 4 as int))").alias("day")
    )
    target, status = str(tmp_path / "t"), str(tmp_path / "s")

    def work(df):
        return df.where("id >= 4 or day < date'2024-01-04'")

    run = lambda n: PD.run_days(spark, source, "step", work, target, status, n)
    assert run(2) == ["2024-01-04", "2024-01-03"]
    assert run(None) == ["2024-01-02", "2024-01-01"]
    assert run(None) == []
    assert spark.read.parquet(target).count() == 39
    assert PD.finished_days(spark, status, "step").count() == 4
    assert PD.finished_days(spark, status, "other").count() == 0


def test_rerun_empties_days(spark, tmp_path):
    source = spark.range(40).select(
        "id", F.expr("date_add(date'2024-01-01', cast(id % 2 as int))").alias("day")
    )
    target = str(tmp_path / "t")
    run = lambda status, work: PD.run_days(
        spark, source, "step", work, target, str(tmp_path / status)
    )
    rows = lambda: {str(r["day"]): r["count"] for r in SP.read_days(spark, target).groupBy("day").count().collect()}
    run("a", lambda df: df)
    assert rows() == {"2024-01-01": 20, "2024-01-02": 20}
    run("b", lambda df: df.where("day > date'2024-01-01'"))
    assert rows() == {"2024-01-02": 20}
    days = run("c", lambda df: df.where("id < 0"))
    assert days == ["2024-01-02", "2024-01-01"]
    status = spark.read.parquet(str(tmp_path / "c"))
    assert [r["rows"] for r in status.collect()] == [0, 0]


def test_quarantine_keeps_all_runs(spark, tmp_path):
    target = str(tmp_path / "clean")
    for k in (1, 2):
        write_raw(tmp_path / f"raw{k}", [raw_line(k), raw_line(10 + k, created_at="nonsense")])
    for k in (1, 2, 2):
        stages.ingest(spark, str(tmp_path / f"raw{k}"), target)
    kept = spark.read.parquet(f"{target}_quarantine").collect()
    assert sorted(r["id_str"] for r in kept) == sorted(raw_line(10 + k)["id_str"] for k in (1, 2))
    assert all('"user"' in r["record"] for r in kept)


def test_listed_days_and_failures(spark):
    paths = ["d/2024-01-01/2024-01-01_a.json", "d/2024-01-02/first_2024-01-02_a.json", "d/readme"]
    days = sorted(r["day"].isoformat() for r in PD.listed_days(spark, paths).collect())
    assert days == ["2024-01-01", "2024-01-02"]

    def work(day):
        if day == "b":
            raise RuntimeError("no network")

    assert PD.run_each_day(["a", "b", "c"], work) == {
        "a": "done", "b": "failed: RuntimeError: no network", "c": "done",
    }


def feed_rows():
    def post(i, text, lang="en", long=None, retweet=None):
        user = {"id_str": f"u{i}", "screen_name": f"s{i}", "name": "N"}
        return {
            "created_at": f"2024-01-01T00:00:{i:02d}Z", "id_str": str(i), "text": text, "lang": lang,
            "user": user, "extended_tweet": long and {"full_text": long},
            "retweeted_status": retweet and {"id_str": "x"}, "reply_count": 0, "retweet_count": 1, "favorite_count": 2,
        }

    return [
        post(1, "covid19 here"), post(2, "RT @x covid19"), post(3, "covid19 short", long="covid19 and more"),
        post(4, "covid19 fr", lang="fr"), post(5, "other"), post(6, "COVID19 again", retweet=True),
    ]


@pytest.fixture
def feed_folder(tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    for i, row in enumerate(feed_rows()):
        (folder / f"{i}.json").write_text(json.dumps(row) + "\n")
    return str(folder)


def captured(df):
    return S.capture_columns(S.tracked(S.original(df), ["covid19"]))


def test_stream_equals_batch(spark, feed_folder, tmp_path):
    live = S.file_stream(spark, feed_folder, schemas.STREAM_POST, "json", files_per_batch=2)
    S.append_stream(captured(live), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = captured(spark.read.schema(schemas.STREAM_POST).json(feed_folder))
    out = spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))
    assert out.columns == schemas.CAPTURE_COLUMNS
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))
    assert sorted(r["tweet"] for r in out.collect()) == ["covid19 and more", "covid19 here"]
    # A restart from the same checkpoint adds nothing twice.
    S.append_stream(captured(live), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.schema(batch.schema).parquet(str(tmp_path / "out")).count() == 2


def test_stream_cap_and_csv(spark, feed_folder, tmp_path):
    live = S.file_stream(spark, feed_folder, schemas.STREAM_POST, "json", files_per_batch=1)
    short = S.capture_columns_short(live)
    S.append_stream(short, str(tmp_path / "out"), str(tmp_path / "ck"), "csv", cap=4).awaitTermination()
    back = SP.read_csv(spark, str(tmp_path / "out"), short.schema)
    assert back.count() == 4


def test_malformed_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "{x")], "id int, _corrupt_record string")
    good, bad = S.split_malformed(df)
    assert good.count() == 1 and bad.first()[0] == "{x"


def test_progress():
    said = []
    progress = S.Progress(100, said.append)
    for n in (60, 60, 200):
        event = type("E", (), {"progress": type("P", (), {"numInputRows": n})})
        progress.onQueryProgress(event)
    assert said == ["rows so far: 120", "rows so far: 320"]


def test_late_rows(spark, tmp_path):
    """A row whose window was already emitted is not counted again."""
    folder = tmp_path / "in"
    folder.mkdir()
    batches = [["10:01", "10:02"], ["12:00"], ["12:01"], ["10:03", "12:05"]]
    n = 0
    for i, batch in enumerate(batches):
        rows = []
        for t in batch:
            rows.append({"id": n, "ts": f"2024-01-01T{t}:00Z"})
            n += 1
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    live = S.file_stream(spark, str(folder), "id int, ts timestamp", "json", files_per_batch=1)
    counts = W.tumbling_counts(W.with_event_time(live, "ts", "30 minutes"), "ts", "1 hour")
    S.append_stream(counts, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.schema(counts.schema).parquet(str(tmp_path / "out")).collect()
    assert [r["n"] for r in rows] == [2]


def test_lines_that_do_not_parse_are_kept_whole(spark):
    lines = ['{"a": 1, "b": "x"}', '{"a": 2', "", None, '{"b": null}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    kind = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    good, bad = S.split_malformed(S.parse_lines(df, kind))
    assert {tuple(r) for r in good.collect()} == {(1, "x"), (None, None)}
    assert sorted(r[0] for r in bad.collect()) == ["", "", '{"a": 2']


def test_narrative_job_keeps_repeated_and_empty_posts(spark, tmp_path):
    rows = [("n1", "1", "good day"), ("n2", "1", "good day"), ("n2", "2", None), ("n2", "1", "bad")]
    df = spark.createDataFrame(rows, "label string, id string, tweet string")
    df.write.partitionBy("label").json(str(tmp_path / "in"))
    lexicon = spark.createDataFrame([("good", 1.0), ("bad", -1.0)], "word string, valence double")
    stages.narrative_job(spark, str(tmp_path / "in"), lexicon, str(tmp_path / "out"))
    found = spark.read.json(str(tmp_path / "out")).collect()
    score = {(r["narrative"], r["id"], r["tweet"]): r["sentiment"] for r in found}
    assert score == {
        ("label=n1", "1", "good day"): 0.25,
        ("label=n2", "1", "good day"): 0.25,
        ("label=n2", "2", None): 0.0,
        ("label=n2", "1", "bad"): -0.25,
    }


def test_gap_runs_on_a_stream(spark, tmp_path):
    """Rows in several batches, some late: as the batch form finds gaps, per key, after a restart too."""
    from datetime import datetime, timedelta

    from postloom.operators import timeseries
    from postloom.streaming import capture, windows

    at = lambda minutes: datetime(2024, 5, 1) + timedelta(minutes=minutes)
    batches = [
        [("a", 1), ("a", 20), ("b", 3), ("a", 130)],
        [("a", 65), ("a", 118), ("b", 125), ("b", 131)],  # late, within the delay
        [("a", 400), ("b", 410), ("a", 4)],
        [("a", 31), ("b", 700), ("a", 690)],  # 31 is later than the delay, and left out
        [("a", 2000), ("c", 1990), ("b", 2010)],
    ]
    schema = "key string, ts timestamp"
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for k, rows in enumerate(batches):
        part = spark.createDataFrame([(key, at(m)) for key, m in rows], schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        found = windows.gap_runs(windows.with_event_time(stream, "ts", "90 minutes"), "ts", 900, "key")
        capture.append_stream(found, out, checkpoint).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    kept = [(key, m) for rows in batches for key, m in rows if m != 31 and m < 2010 - 90 - 15]
    expected = []
    for key in "abc":
        rows = spark.createDataFrame([(at(m),) for k, m in kept if k == key], "ts timestamp")
        expected += [(key, *r) for r in timeseries.gaps(rows, "ts", "15 minutes").collect()]
    assert got == sorted(expected) and len(got) == 7

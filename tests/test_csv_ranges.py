"""CSV with newlines in texts, cut into ranges, against Spark's reader of whole files."""

import random
from contextlib import contextmanager

import pytest

from postloom.sources.csv_ranges import read_csv_ranges
from postloom.sources.posts import read_csv, write_csv

SCHEMA = "id long, text string, kind string"


@contextmanager
def splits_of(spark, size):
    names = {"spark.sql.files.maxPartitionBytes": f"{size}b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts(seed):
    draw = random.Random(seed)
    parts = ["a", '"', "\n", "\r\n", ",", "word ", "é", '""', "\n\n", "\\", '\\"']
    for k in range(300):
        n = draw.choice([0, 1, 5, 40, 400 if k % 50 == 0 else 3])
        yield (k, "".join(draw.choices(parts, k=n)) if k % 17 else None, "x")
    # longer than many ranges, which lie inside it
    yield (1000, '"quoted"\n' * 900 + '"' + "\n" * 700 + "end", "y")


@pytest.mark.parametrize("seed, size", [(1, 211), (2, 1500)])
def test_equal_to_the_reader_of_whole_files(spark, tmp_path, seed, size):
    path = str(tmp_path / "posts")
    given = spark.createDataFrame(list(texts(seed)), SCHEMA)
    write_csv(given.coalesce(2), path)
    with splits_of(spark, size):
        found = read_csv_ranges(spark, path, given.schema)
        assert found.rdd.getNumPartitions() > 8
        assert rows(found) == rows(read_csv(spark, path, given.schema))


def test_texts_come_back_whole(spark, tmp_path):
    path = str(tmp_path / "posts")
    kept = [(k, t, "z") for k, t in enumerate(['  a\n"b"  ', "\n", "x,y\n\nz\t", 'end"', None, "é\n"])]
    write_csv(spark.createDataFrame(kept, SCHEMA).coalesce(1), path)
    with splits_of(spark, 5):
        assert rows(read_csv_ranges(spark, path, SCHEMA)) == sorted(kept, key=repr)


@pytest.mark.parametrize(
    "content",
    [
        b"id,text,kind\n",  # a header only
        b"",
        b'id,text,kind\r\n1,"a\nb",x\r\n2,c,y\r\n',  # lines of another system
        b'id,text,kind\n\n1,"a\n\nb",x\n\n\n2,c,y',  # blank lines, no last newline
        b'"id","the\ntext\nhere",kind\n1,"a",x\n',  # a header of several lines
        b'id,text,kind\n1,"""a""\n""b""",x\n2,"",y\n3,,z\n',
        b'id,text,kind\nno,"a\nb",x\n2\n3,c,d,e\n',  # fields that don't parse, too few, too many
    ],
)
def test_odd_files(spark, tmp_path, content):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_bytes(content)
    with splits_of(spark, 8):
        assert rows(read_csv_ranges(spark, str(tmp_path), SCHEMA)) == rows(
            read_csv(spark, str(tmp_path), SCHEMA)
        )


def test_newlines_in_texts_stay(spark, tmp_path):
    """The reader of whole files makes them \\n in files whose lines end in \\r\\n."""
    (tmp_path / "a.csv").write_bytes(b'id,text,kind\r\n1,"a\r\nb\r\n",x\r\n')
    with splits_of(spark, 4):
        assert rows(read_csv_ranges(spark, str(tmp_path), SCHEMA)) == [(1, "a\r\nb\r\n", "x")]


def test_record_that_never_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,kind\n1,a,x\n2,"b\nc\nd\n')
    (tmp_path / "b.csv").write_text("id,text,kind\n3,c,z\n")
    with splits_of(spark, 6):
        found = rows(read_csv_ranges(spark, str(tmp_path), SCHEMA))
    assert {r[0] for r in found} == {1, 2, 3} and len(found) == 3


def test_other_splits_than_before_fail(spark, tmp_path):
    path = str(tmp_path / "posts")
    write_csv(spark.createDataFrame(list(texts(3)), SCHEMA).coalesce(1), path)
    with splits_of(spark, 1500):
        read_csv_ranges(spark, path, SCHEMA)
        found = read_csv_ranges(spark, path, SCHEMA)
        with splits_of(spark, 700), pytest.raises(Exception, match="splits have changed"):
            found.collect()

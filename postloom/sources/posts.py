"""Reading and writing posts: JSON lines, id lists, day tables, labelled files, CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom import schemas


def read_raw_posts(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str] | None = None,
    schema: T.StructType = schemas.RAW_POST,
    partitions: int | None = None,
) -> DataFrame:
    """JSON-lines posts; gzip is read as is.

    Unparsable lines keep their text in ``_corrupt_record``. A gzip file is one split,
    so give ``partitions`` when few large ones are read.
    """
    raw = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    if columns is not None:
        raw = raw.select(*columns)
    return raw.repartition(partitions) if partitions else raw


def write_json(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.mode("overwrite").option("compression", compression).json(path)


def read_ids(spark: SparkSession, path: str | list[str], column: str = "tweet_id") -> DataFrame:
    """One column of a tab-separated list with a header.

    Columns are found by name from the header, all as text, so ids keep their digits.
    """
    return (
        spark.read.option("sep", "\t").option("header", True).csv(path).select(column)
    )


def write_ids(df: DataFrame, path: str, column: str = "tweet_id") -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_days(df: DataFrame, path: str, day: Column | None = None) -> None:
    """Replace the days present in ``df`` and leave all others.

    The rebalance step lets AQE split a large day over several tasks and merge small
    ones, so neither a hot day nor many tiny files come out.
    """
    out = df if day is None else df.withColumn("day", day)
    (
        out.hint("rebalance", F.col("day"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def read_days(spark: SparkSession, path: str, days: Sequence[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    if days is None:
        return table
    return table.where(F.col("day").isin([F.lit(d).cast("date") for d in days]))


def read_labelled(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All files one folder below ``root`` in one scan; the folder name is the label."""
    label = F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/[^/]+$", 1)
    return spark.read.schema(schema).json(f"{root}/*/*").withColumn("narrative", label)


def read_split_json(
    spark: SparkSession, path: str, names: Sequence[str], kinds: Sequence[str]
) -> DataFrame:
    """A ``{"columns": [...], "data": [[...], ...]}`` document, one row per data entry.

    Such a file is a single value and therefore one task; stage large ones as lines.
    """
    doc = spark.read.schema("columns array<string>, data array<array<string>>").option(
        "multiLine", True
    ).json(path)
    rows = doc.select("columns", F.explode("data").alias("row"))
    place = [F.array_position("columns", F.lit(n)).cast("int") for n in names]
    return rows.select(
        *[
            F.try_element_at("row", p).try_cast(k).alias(n)
            for n, k, p in zip(names, kinds, place, strict=True)
        ]
    )


def read_columns_json(
    spark: SparkSession, path: str, names: Sequence[str], kinds: Sequence[str]
) -> DataFrame:
    """A ``{"name": {"0": value, ...}, ...}`` document, one row per index."""
    schema = ", ".join(f"`{n}` map<string,string>" for n in names)
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    keys = doc.select("*", F.explode(F.map_keys(names[0])).alias("_key"))
    return keys.select(
        *[
            F.try_element_at(F.col(f"`{n}`"), F.col("_key")).try_cast(k).alias(n)
            for n, k in zip(names, kinds, strict=True)
        ]
    )


def write_csv(df: DataFrame, path: str) -> None:
    """With header. Arrays are written as JSON text; white space at a text's ends stays."""
    arrays = {f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    out = df.select(*[F.to_json(c).alias(c) if c in arrays else F.col(c) for c in df.columns])
    (
        out.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Files with header and newlines in texts, one task each; ``csv_ranges`` splits large ones."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Any frame as Parquet (in place of a pickled frame)."""
    df.write.mode(mode).parquet(path)


def drop_days(spark: SparkSession, path: str, days: list, day: str = "day") -> None:
    """Removes the partitions of some days, on any file system Spark writes to."""
    for value in days:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{day}={value}")
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(folder):
            system.delete(folder, True)

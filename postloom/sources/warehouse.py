"""Named tables of the session catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_of_day(prefix: str, day: str) -> str:
    """Table names take no hyphens."""
    return f"{prefix}_{day.replace('-', '_')}"


def load_once(df: DataFrame, table: str, path: str | None = None) -> bool:
    """Write a new table; leave an existing one as it is. True when it was written."""
    if df.sparkSession.catalog.tableExists(table):
        return False
    writer = df.write.mode("ignore").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return True


def table_names(spark: SparkSession, prefix: str = "") -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefix))


def table_days(spark: SparkSession, prefix: str) -> DataFrame:
    """Days that already have a table."""
    names = spark.sql(f"show tables like '{prefix}_*'")
    day = F.replace(F.substring("tableName", len(prefix) + 2, 10), F.lit("_"), F.lit("-"))
    return names.select(F.try_to_date(day).alias("day")).where("day is not null")


def english_rows(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql("select * from identifier(:t) where lang = 'en'", args={"t": table})


def drop_table(spark: SparkSession, table: str) -> None:
    """Takes the name out of the catalog; rows written to a path of their own stay there."""
    spark.sql("drop table if exists identifier(:t)", args={"t": table})

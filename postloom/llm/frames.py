"""Tables in the shared folder, key filters, running sums and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.session import shared_folder

# Bits of a key filter: 2**24 bits are at most 2**18 rows of 16 bytes, whatever the data.
FILTER_BITS = 24


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows once to the shared folder and reads them back.

    Cuts lineage and survives lost executors; unlike ``checkpoint()`` the plan runs once.
    """
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def text_column(df: DataFrame, column: str = "text") -> Column:
    """The column as text, NULL as empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- key filters -----------------------------------------------------------------


def _place(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - FILTER_BITS)


def key_filter(keys: DataFrame, column: str) -> DataFrame:
    """One bit per hashed key, 64 to a row: at most 2**(FILTER_BITS - 6) rows for any input."""
    bit = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    return (
        keys.select(_place(F.col(column)).alias("_place"))
        .groupBy(F.shiftright("_place", 6).alias("_row"))
        .agg(F.bit_or(bit).alias("_bits"))
    )


def with_hit(df: DataFrame, column: str, bits: DataFrame, name: str) -> DataFrame:
    """Adds whether a row's key may be among those of the filter: never a false "no".

    A broadcast of bounded size, so texts are not shuffled to find the few rows to work on.
    False hits are rows that get the exact look-up for nothing.
    """
    row, place = f"{name}_row", _place(F.col(column))
    bits = F.broadcast(bits.select(F.col("_row").alias(row), F.col("_bits").alias(f"{name}_bits")))
    bit = F.getbit(F.col(f"{name}_bits"), place.bitwiseAND(F.lit(63)).cast("int"))
    return (
        df.withColumn(row, F.shiftright(place, 6))
        .join(bits, row, "left")
        .withColumn(name, F.coalesce(bit, F.lit(0)) == 1)
        .drop(row, f"{name}_bits")
    )


# ---- running sums ------------------------------------------------------------------


def running_start(df: DataFrame, order: str, value: str, name: str, width: int = 1024) -> DataFrame:
    """Adds the sum of ``value`` over all rows of smaller ``order`` (a long, each once).

    Two levels: windows inside blocks of ``width`` neighbours, then one over the sums of
    the blocks, so the only ordered single task sees a row per block.
    """
    block = F.expr(f"`{order}` div {width}")
    df = df.withColumn("_block", block)
    sums = df.groupBy("_block").agg(F.sum(value).alias("_sum"))
    over = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_block", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(sums, "_block")
        .withColumn(name, (F.col("_base") + F.col("_in")).cast("long"))
        .drop("_block", "_base", "_in")
    )


# ---- connected components ------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node reachable.

    Alternating large and small stars: each round links every neighbour of a node to the
    node's smallest neighbour, first among larger, then among smaller nodes. Rounds grow
    with the logarithm of the largest component. The smallest neighbour is a map-side
    aggregate and joined back, so a hub never has its neighbours gathered in one place.
    Rounds end when a round changes nothing; running out of rounds is an error.
    """
    now = store(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u <> v")
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), "m")
        large = large.distinct().withColumnRenamed("m", "v").filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
            F.col("m").alias("v"),
        )
        after = store(small.distinct(), "edges")
        seen = _mark(after)
        now, done, mark = after, seen == mark, seen
        if done:
            break
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select("root", "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number and digest of the edges; exclusive or, since sums of 64-bit ids overflow."""
    row = edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))
    ).first()
    return tuple(row)

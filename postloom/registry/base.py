"""Registration of queries with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.session import spread, use_utc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(make: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(use_utc(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column: str, digits: int = 6) -> Column:
    return F.round(F.col(column), digits).alias(column)


# ---- helpers that write the checking SQL ---------------------------------------


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rx(expression: str, pattern: str, replacement: str) -> str:
    """Global regexp_replace; patterns here hold no lookaround."""
    pattern = pattern.replace("(?iu)", "(?i)").replace(")++", ")+")
    replacement = replacement.replace("$", "\\")
    return (
        f"regexp_replace({expression}, {text_literal(pattern)}, {text_literal(replacement)}, 'g')"
    )


def swap(expression: str, old: str, new: str) -> str:
    return f"replace({expression}, {text_literal(old)}, {text_literal(new)})"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(text_literal(v) for v in values) + ")"


# ---- posts for the text queries -------------------------------------------------
# Each document becomes a post: its whole text between the parts a post may hold, filled
# from the document's own columns. Entries are (is a column, value).
POST_PARTS = [
    (False, "RT @"),
    (True, "source"),
    (False, ": "),
    (True, "text"),
    (False, "\n\n#coronavirus, #COVID_19 #"),
    (True, "lang"),
    (False, "tag, corona virus Covid-19 covid SARS-CoV-2 🧐👍 10:30:45 pic.twitter.com/a"),
    (True, "doc_id"),
    (False, " https://youtu.be/x"),
    (True, "doc_id"),
    (False, " https://www.youtube.com/watch?v="),
    (True, "doc_id"),
    (False, " http://"),
    (True, "lang"),
    (False, ".example.org/"),
    (True, "n_chars"),
    (False, " www.example.net/"),
    (True, "doc_id"),
    (False, " see example.org end. I can't, ain't they've cannot go it's 5 p.m. on 10/2020 (12 / 2021) "),
    (False, "5- 30 “well-known” ’s … the Flu from China and a bio weapon"),
]


def post_text() -> Column:
    return F.concat(
        *[F.col(v).cast("string") if is_column else F.lit(v) for is_column, v in POST_PARTS]
    )


POST_SQL = "concat(" + ", ".join(
    f"cast({v} as varchar)" if is_column else text_literal(v) for is_column, v in POST_PARTS
) + ")"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "lang", post_text().alias("post"))

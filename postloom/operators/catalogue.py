"""Posts against a catalogue of topics of any length."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from postloom.functions.literals import fold, required_literals

# Characters of literals that one task's automaton holds, some 100 bytes each.
BLOCK_CHARS = 4 * 1024 * 1024


def catalogue_literals(catalogue: DataFrame) -> DataFrame:
    """(topic, pattern, literal) of a (topic, pattern) table, worked out in tasks.

    Several patterns of a topic become one. A row for each literal that the pattern's matches
    may hold; a pattern without any has empty text, and is tried on every post.
    """
    listed = F.sort_array(F.collect_set("pattern"))
    joined = F.concat(F.lit("(?:"), F.array_join("p", ")|(?:"), F.lit(")"))
    one = (
        catalogue.where("topic is not null and pattern is not null")
        .groupBy("topic")
        .agg(listed.alias("p"))
        .select("topic", F.when(F.size("p") == 1, F.col("p")[0]).otherwise(joined).alias("pattern"))
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [required_literals(p) or [""] for p in batch.column("pattern").to_pylist()]
            rows = pa.array([i for i, words in enumerate(found) for _ in words], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("topic").take(rows),
                    batch.column("pattern").take(rows),
                    pa.array([w for words in found for w in words], pa.string()),
                ],
                names=["topic", "pattern", "literal"],
            )

    kind = catalogue.schema["topic"].dataType.simpleString()
    return one.mapInArrow(read, f"topic {kind}, pattern string, literal string")


def tag_topics(
    df: DataFrame, text: str, catalogue: DataFrame, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per post and matching topic of a (topic, pattern) table.

    The catalogue is dealt into blocks by the length of its literals, one for up to some
    300,000 patterns, and each task builds the automaton of its block. It passes on the posts
    that hold a literal of a pattern, once for each such topic, and the pattern itself decides,
    as ``rlike`` does. The posts are read once; every block sees each post. Nothing of the
    catalogue but its length comes to the driver.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = catalogue_literals(catalogue)
    size = words.agg(F.sum(F.length("literal") + 1)).first()[0] or 0
    blocks = -(-size // block_chars)
    if not blocks:
        return df.withColumn("topic", F.lit(None).cast(catalogue.schema["topic"].dataType)).limit(0)
    plain = [f.name for f in df.schema if not isinstance(f.dataType, MapType)]
    # a task for every block and part of the posts
    cell = lambda block, part: (F.col(block) * tasks + F.col(part)).cast("int")
    posts = (
        df.where(F.col(text).isNotNull())
        .select(
            F.struct(*df.columns).alias("post"),
            F.pmod(F.xxhash64(*plain), F.lit(tasks)).alias("part"),
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        )
        .select(cell("block", "part").alias("cell"), "post")
    )
    heads = (
        words.withColumn("block", F.pmod(F.xxhash64("topic"), F.lit(blocks)))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
        .select(cell("block", "part").alias("cell"), F.struct("topic", "pattern", "literal").alias("head"))
    )
    both = heads.unionByName(posts, allowMissingColumns=True)
    # the automaton's literals come first in every task
    dealt = both.repartitionById(blocks * tasks, F.col("cell")).sortWithinPartitions(
        F.col("head").isNull()
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        topics: dict[str, tuple[int, object]] = {}
        names: list = []
        known: dict[str, set[int]] = {}
        machine = None
        for batch in batches:
            heads = batch.column("head")
            for head in heads.drop_null().to_pylist():
                topic = head["topic"]
                if topic not in topics:
                    topics[topic] = len(names)
                    names.append((topic, head["pattern"]))
                known.setdefault(head["literal"], set()).add(topics[topic])
            own = heads.is_null()
            posts = batch.column("post").filter(own)
            if not len(posts) or not known:
                continue
            if machine is None:
                machine = ahocorasick.Automaton()
                for literal, found in known.items():
                    if literal:
                        machine.add_word(literal, tuple(found))
                machine.make_automaton()
            always = known.get("", set())
            rows, ends, hits = [], [0], []
            for i, value in enumerate(posts.field(text).to_pylist()):
                found = set(always)
                if len(machine):
                    for _, some in machine.iter(fold(value)):
                        found.update(some)
                if found:
                    rows.append(i)
                    hits += sorted(found)
                    ends.append(len(hits))
            pairs = pa.StructArray.from_arrays(
                [
                    pa.array([names[h][0] for h in hits], topic_kind),
                    pa.array([names[h][1] for h in hits], pa.string()),
                ],
                names=["topic", "pattern"],
            )
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays(
                [posts.take(pa.array(rows, pa.int32())), lists], names=["post", "found"]
            )

    topic_kind = to_arrow_type(catalogue.schema["topic"].dataType)
    pair = StructType(
        [
            StructField("topic", catalogue.schema["topic"].dataType),
            StructField("pattern", StringType()),
        ]
    )
    schema = StructType(
        [StructField("post", StructType(df.schema.fields)), StructField("found", ArrayType(pair))]
    )
    found = dealt.select("head", "post").mapInArrow(search, schema)
    value = F.col(f"post.`{text}`")
    hit = F.filter("found", lambda pair: F.rlike(value, pair["pattern"]))
    return found.select("post", F.explode(hit).alias("hit")).select(
        "post.*", F.col("hit.topic").alias("topic")
    )

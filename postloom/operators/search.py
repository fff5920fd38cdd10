"""Nearest posts per centroid by cosine distance, and how many carry its label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from postloom.functions import fixed
from postloom.functions.vectors import cosine_distance
from postloom.operators.blocks import BROADCAST_BYTES, matrix
from postloom.session import store

# Pivots, at most this many and this many bytes: all of a usual set of centroids.
PIVOTS = 2048
# Centroids that one task compares its posts with.
BLOCK_ROWS = 4096
# Parts into which the posts near one pivot are dealt, at least.
LEAST_PARTS = 8
# Distances closer than this count as equal, so the id decides.
DIGITS = 12
# Rounding of lengths between unit vectors, whose squares are exact to some 1e-16.
SLACK = 1e-7


def nearest(
    posts: DataFrame,
    centroids: DataFrame,
    k: int = fixed.PRECISION_K,
    post_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    pivots: int = PIVOTS,
) -> DataFrame:
    """(narrative, rank, post id, label, distance) of the ``k`` closest posts.

    The centroids are a table of blocks, each around a pivot, and only the pivots are copied to
    the executors: some of the centroids, or all where they are few. In one scan every task
    measures its posts against the pivots. A post goes to a block unless the task has seen ``k``
    posts so much closer to its pivot that, by the triangle inequality, they are closer to all
    centroids of the block. Where a pivot is the only centroid of its block, these are the
    task's own best ``k`` and few besides. Blocks meet their posts in parts, each keeps the best
    ``k`` per centroid, and those are ranked per centroid.
    """
    table = _blocks(centroids, pivots)
    if table is None:
        return _ranked(_met(posts, centroids.limit(0), None, k, post_id, label, vector), k, post_id)
    return _ranked(_met(posts, *table, k, post_id, label, vector), k, post_id)


def _blocks(centroids: DataFrame, pivots: int) -> tuple[DataFrame, dict] | None:
    """(label, centroid, block, chunk) and the pivots with their blocks' radius and chunks."""
    spark = centroids.sparkSession
    table = store(centroids.select("label", "centroid").where("centroid is not null"), "centroids")
    width = table.select(F.max(F.size("centroid"))).first()[0]
    if not width:
        return None
    most = max(1, min(pivots, BROADCAST_BYTES // (8 * width)))
    some = table.orderBy(F.xxhash64("centroid"), "label").limit(most).collect()
    units = unit_rows(np.array([r["centroid"] for r in some], dtype=np.float64))
    units = units[np.isfinite(units).all(axis=1)]
    if not len(units):
        return None
    shared = spark.sparkContext.broadcast(units)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = matrix_of_units(batch.column("centroid"))
            fine = np.isfinite(own).all(axis=1)  # a zero centroid is near nothing
            apart = lengths_between(own[fine], pivots)
            block = apart.argmin(axis=1)
            kept = batch.filter(pa.array(fine))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(block, pa.int32()), pa.array(apart[np.arange(len(block)), block])],
                names=["label", "centroid", "block", "apart"],
            )

    kind = table.schema["label"].dataType.simpleString()
    schema = f"label {kind}, centroid array<double>, block int, apart double"
    dealt = table.withColumn("centroid", F.col("centroid").cast("array<double>"))
    dealt = dealt.mapInArrow(assign, schema)
    counts = dealt.groupBy("block").agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("chunks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    known = counts.orderBy("block").limit(most).collect()  # a row for each pivot at most
    used = [r["block"] for r in known]
    chunk = F.pmod(F.xxhash64("label"), F.col("chunks")).cast("int")
    dealt = dealt.join(counts.select("block", "chunks"), "block")
    info = {
        "units": units[used],
        "blocks": np.array(used, np.int32),
        "radius": np.array([r["radius"] for r in known]),
        "chunks": np.array([r["chunks"] for r in known], np.int32),
    }
    return dealt.select("label", "centroid", "block", chunk.alias("chunk")), info


def near_blocks(posts: DataFrame, info: dict, k: int, post_id: str, label: str, vector: str) -> DataFrame:
    """(block, chunks, post, label, v): the posts that may be among a block's best, by block."""
    shared = posts.sparkSession.sparkContext.broadcast(info)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = shared.value
        blocks = len(info["blocks"])
        best = np.full((blocks, k), np.inf)  # lengths to the pivot, of this task's posts
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = lengths_between(matrix_of_units(batch.column("v")), info["units"])
            apart = np.where(np.isfinite(apart), apart, np.inf)
            rows = min(k, len(apart))
            closest = np.partition(apart, rows - 1, axis=0)[:rows]
            best = np.partition(np.concatenate([best, closest.T], axis=1), k - 1, axis=1)[:, :k]
            limit = best.max(axis=1) + 2 * info["radius"] + SLACK
            row, block = np.nonzero((apart <= limit) & np.isfinite(apart))
            for at in range(0, len(row), 4096):
                r, b = row[at : at + 4096], block[at : at + 4096]
                part = batch.take(pa.array(r))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(info["blocks"][b]),
                        pa.array(info["chunks"][b]),
                        *(part.column(c) for c in ("post", "label", "v")),
                    ],
                    names=["block", "chunks", "post", "label", "v"],
                )

    asked = posts.where(F.col(vector).isNotNull() & F.col(post_id).isNotNull()).select(
        F.col(post_id).alias("post"),
        F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
    )
    kinds = [posts.schema[c].dataType.simpleString() for c in (post_id, label)]
    schema = f"block int, chunks int, post {kinds[0]}, label {kinds[1]}, v array<double>"
    return asked.mapInArrow(near, schema)


def _met(posts, centroids, info, k, post_id, label, vector) -> DataFrame:
    """(narrative, part, post, label, distance): the best ``k`` of every centroid in each part."""
    spark = posts.sparkSession
    kinds = {
        "narrative": centroids.schema["label"].dataType,
        "post": posts.schema[post_id].dataType,
        "label": posts.schema[label].dataType,
    }
    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items())
    schema += ", distance double, part int"
    if info is None:
        return spark.createDataFrame([], schema)
    found = near_blocks(posts, info, k, post_id, label, vector)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(LEAST_PARTS, -(-4 * tasks // len(info["blocks"])))
    # no cell is split over tasks; a block's centroids come before its posts
    cells = ["block", "chunk", "part"]
    sides = centroids.select(
        "block",
        "chunk",
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.struct("label", F.col("centroid").alias("v")).alias("head"),
    ).unionByName(
        found.select(
            "block",
            F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
            F.pmod(F.xxhash64("post"), F.lit(parts)).cast("int").alias("part"),
            F.struct("post", "label", "v").alias("post"),
        ),
        allowMissingColumns=True,
    )
    dealt = sides.repartition(*cells).sortWithinPartitions(*cells, F.col("head").isNull())
    arrow = {c: to_arrow_type(t) for c, t in kinds.items()}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, names, units, kept, limits = None, [], [], [], np.empty(0)

        def result():
            for name, (distance, post, own) in zip(names, kept):
                n = len(distance)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * n, type=arrow["narrative"]),
                        pa.array(post, type=arrow["post"]),
                        pa.array(own, type=arrow["label"]),
                        pa.array(distance, type=pa.float64()),
                        pa.array([cell[2]] * n, type=pa.int32()),
                    ],
                    names=["narrative", "post", "label", "distance", "part"],
                )

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("block", "chunk", "part")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if a == z:
                    continue
                now = tuple(key[a].tolist())
                if now != cell:
                    yield from result()
                    cell, names, units, kept, limits = now, [], [], [], np.empty(0)
                part = batch.slice(a, z - a)
                heads = part.column("head").drop_null()
                if len(heads):
                    names = names + heads.field("label").to_pylist()
                    units.append(matrix_of_units(heads.field("v")))
                    kept = [([], [], []) for _ in names]
                    limits = np.full(len(names), np.inf)
                own = part.column("post").filter(part.column("head").is_null())
                if not len(own) or not names:
                    continue
                if len(units) > 1:
                    units = [np.concatenate(units)]
                post, label = own.field("post"), own.field("label")
                distances = np.round(1.0 - matrix_of_units(own.field("v")) @ units[0].T, DIGITS)
                close = distances <= limits
                for c in np.flatnonzero(close.any(axis=0)):
                    at = np.flatnonzero(close[:, c])
                    if len(at) > 4 * k:
                        edge = np.partition(distances[at, c], k - 1)[k - 1]
                        at = at[distances[at, c] <= edge]
                    where = pa.array(at)
                    old = kept[c]
                    merged = sorted(
                        zip(
                            old[0] + distances[at, c].tolist(),
                            old[1] + post.take(where).to_pylist(),
                            old[2] + label.take(where).to_pylist(),
                            strict=True,
                        ),
                        key=lambda r: (r[0], r[1]),
                    )[:k]
                    kept[c] = tuple(map(list, zip(*merged, strict=True)))
                    if len(merged) == k:
                        limits[c] = merged[-1][0]
        yield from result()

    return dealt.mapInArrow(meet, schema)


def _ranked(found: DataFrame, k: int, post_id: str) -> DataFrame:
    order = W.partitionBy("narrative").orderBy("distance", "post")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("narrative", "rank", F.col("post").alias(post_id), "label", "distance")


def lengths_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors, for which the triangle inequality holds."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def unit_rows(values: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(values, axis=1, keepdims=True)
    return np.divide(values, lengths, where=lengths > 0, out=np.full_like(values, np.nan))


def matrix_of_units(column: pa.Array) -> np.ndarray:
    """Rows scaled to length one. A zero vector has no direction: NaN, never close."""
    return unit_rows(matrix(column))


def distances_to_own(posts: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """Each post with the distance to the centroid of its own label.

    The centroids are a stored table, so Spark knows their bytes before it plans: below its
    broadcast bound the posts are not shuffled, beyond it AQE splits the posts of a hot label.
    """
    own = store(centroids.select("label", "centroid"), "own-centroids")
    return posts.join(own, "label").withColumn(
        "distance", cosine_distance(F.col(vector), F.col("centroid"))
    ).drop("centroid")


def with_match(hits: DataFrame) -> DataFrame:
    same = F.col("narrative") == F.col("label")
    return hits.withColumn("match", F.coalesce(same, F.lit(False)))


def precision(hits: DataFrame, k: int = fixed.PRECISION_K) -> DataFrame:
    """Share of the k closest posts that carry the centroid's own label."""
    found = F.sum(F.col("match").cast("int"))
    return with_match(hits).groupBy("narrative").agg(
        found.alias("hits"), (found / F.lit(k)).alias("precision")
    )


def mean_precision(precisions: DataFrame) -> DataFrame:
    return precisions.agg(F.avg("precision").alias("mean_precision"))

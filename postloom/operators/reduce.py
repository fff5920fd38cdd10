"""Two-dimensional projection by a truncated SVD without centring.

The SVD is randomised: a block of a few directions more than components asked for is drawn at
random, and refined by passes over the vectors. A pass gives, for the block V and the vectors A,
the triangle of the QR decomposition of A V, merged from the tasks' own triangles in a tree, and
A' A V, summed by position. The triangle's SVD gives the best directions within the block, the
other product how far they are from true ones, and the block of the next pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import fixed
from postloom.operators.blocks import matrix
from postloom.operators.sampling import bernoulli
from postloom.session import store

# Directions beyond the components asked for; a vector no wider than the block is solved exactly.
OVERSAMPLING = 62
# A component is settled when A' A v differs from its multiple of v by this share of the largest.
TOLERANCE = 1e-9
PASSES = 40
# Tasks whose triangles are merged at once.
TREE = 64
MODEL_SCHEMA = "component int, singular_value double, weights array<double>"


def gram_rows(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(i, row): the sum of outer products of all vectors, one row per position.

    Each task sends one matrix, whatever the number of its vectors.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                block = matrix(batch.column("v"))
                total = block.T @ block if total is None else total + block.T @ block
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), type=pa.int32()), pa.array(list(total))],
                names=["i", "row"],
            )

    parts = rows.mapInArrow(partial, "i int, row array<double>")
    summed = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row"))
    return summed.select("i", vector_to_array("row").alias("row"))


def block_pass(df: DataFrame, block: np.ndarray, vector: str = "embedding") -> DataFrame:
    """(i, row): for each position a row of A' A V, and for -1, -2, ... the rows of a triangle R
    with R' R = (A V)' (A V). No row is wider than the block.
    """
    shared = df.sparkSession.sparkContext.broadcast(block)
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v"))
    columns = block.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        triangle, total = np.zeros((0, columns)), None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"))
                y = x @ v
                triangle = np.linalg.qr(np.concatenate([triangle, y]), mode="r")
                total = x.T @ y if total is None else total + x.T @ y
        if total is not None:
            task = TaskContext.get().partitionId()
            rows = np.concatenate([total, triangle])
            place = np.concatenate([np.arange(len(total)), -1 - np.arange(len(triangle))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(place, pa.int32()),
                    pa.array(np.full(len(rows), task), pa.int32()),
                    pa.array(list(rows), pa.list_(pa.float64())),
                ],
                names=["i", "task", "row"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for group in batch.column("task").unique().to_pylist():
                own = batch.filter(pc.equal(batch.column("task"), group))
                before = held.get(group, np.zeros((0, columns)))
                held[group] = np.linalg.qr(np.concatenate([before, matrix(own.column("row"))]), mode="r")
        for group, triangle in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(-1 - np.arange(len(triangle)), pa.int32()),
                    pa.array([group] * len(triangle), pa.int32()),
                    pa.array(list(triangle), pa.list_(pa.float64())),
                ],
                names=["i", "task", "row"],
            )

    schema = "i int, task int, row array<double>"
    parts = store(rows.mapInArrow(partial, schema), "svd-pass")
    triangles = parts.where("i < 0")
    tasks = 1 + (parts.agg(F.max("task")).first()[0] or 0)
    while tasks > 1:
        tasks = -(-tasks // TREE)
        triangles = triangles.withColumn("task", F.expr(f"cast(task div {TREE} as int)"))
        triangles = triangles.repartition(tasks, "task").mapInArrow(merge, schema)
    sums = parts.where("i >= 0").groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row"))
    return sums.select("i", vector_to_array("row").alias("row")).unionByName(triangles.select("i", "row"))


def truncated_svd(
    df: DataFrame, components: int, vector: str = "embedding", seed: int = fixed.SEED,
    oversampling: int = OVERSAMPLING, tolerance: float = TOLERANCE, passes: int = PASSES,
) -> tuple[np.ndarray, np.ndarray]:
    """Largest singular values and their right vectors, as columns.

    The driver holds blocks of ``components + oversampling`` columns and a row per position.
    It stops when all components are settled, at the latest after ``passes`` passes.
    """
    width = df.where(F.col(vector).isNotNull()).agg(F.max(F.size(vector))).first()[0]
    if not width:
        raise ValueError("no vectors to fit")
    columns = min(width, components + oversampling)
    if columns == width:
        block = np.eye(width)
    else:
        draw = np.random.default_rng([seed, width])
        block = np.linalg.qr(draw.standard_normal((width, columns)))[0]
    for _ in range(passes):
        rows = block_pass(df, block, vector).toArrow()
        place = rows["i"].to_numpy()
        values = matrix(rows["row"].combine_chunks())
        product = np.zeros((width, columns))
        product[place[place >= 0]] = values[place >= 0]
        triangle = values[place < 0][np.argsort(-place[place < 0])]
        _, sizes, turn = np.linalg.svd(triangle)
        sizes = np.append(sizes, np.zeros(columns - len(sizes)))[:columns]
        found, back = block @ turn.T, product @ turn.T
        wanted = slice(0, min(components, columns))
        off = np.linalg.norm(back[:, wanted] - found[:, wanted] * sizes[wanted] ** 2, axis=0)
        if columns == width or (off <= tolerance * max(sizes[0] ** 2, 1e-300)).all():
            break
        # the next block spans what this one became, and the best directions so far
        kept = np.concatenate([found[:, wanted], back[:, : columns - min(components, columns)]], axis=1)
        block = np.linalg.qr(kept)[0]
    return sizes[wanted], found[:, wanted]


def fit_svd(
    df: DataFrame,
    vector: str = "embedding",
    key: str = "tweet_id",
    components: int = 2,
    fraction: float = fixed.SVD_FRACTION,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Model table (component, singular_value, weights) from a seeded sample of rows.

    The largest weight of each component is positive, so repeated fits agree.
    """
    kept = df if fraction >= 1 else bernoulli(df, key, fraction, seed)
    values, vectors = truncated_svd(kept, components, vector, seed)
    rows = []
    for i, (value, weights) in enumerate(zip(values, vectors.T, strict=True)):
        weights = weights * np.sign(weights[np.argmax(np.abs(weights))])
        rows.append((i, float(value), weights.tolist()))
    return df.sparkSession.createDataFrame(rows, MODEL_SCHEMA)


def load_or_fit(spark: SparkSession, path: str, df: DataFrame, version: str, **options) -> DataFrame:
    """The stored model of ``version`` and these options (seed, fraction and the like);
    fitted and stored when there is none yet.
    """
    chosen = {"seed": fixed.SEED, "fraction": fixed.SVD_FRACTION, **options}
    named = "/".join(f"{k}={chosen[k]}" for k in sorted(chosen))
    place = f"{path}/version={version}/{named}"
    try:
        return spark.read.schema(MODEL_SCHEMA).parquet(place)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    fit_svd(df, **options).coalesce(1).write.mode("overwrite").parquet(place)
    return spark.read.schema(MODEL_SCHEMA).parquet(place)


def project(df: DataFrame, model: DataFrame, vector: str = "embedding", names=("x", "y")) -> DataFrame:
    """``df`` without its vector, with one coordinate per component. No shuffle.

    ``names`` has a name for each component of the model.
    """
    rows = model.orderBy("component").limit(len(names) + 1).collect()
    if len(rows) != len(names):
        raise ValueError(f"{len(names)} names, but not as many components")
    weights = df.sparkSession.sparkContext.broadcast(np.array([r["weights"] for r in rows]).T)
    others = [f for f in df.schema if f.name != vector]
    kept = [f.name for f in others]

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = matrix(batch.column(vector)) @ weights.value
                columns = [batch.column(c) for c in kept]
                columns += [pa.array(points[:, i]) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [f"{n} double" for n in names]
    )
    return df.where(F.col(vector).isNotNull()).select(*kept, vector).mapInArrow(transform, schema)

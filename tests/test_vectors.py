"""Vector operators against numpy and pandas."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from postloom.functions.vectors import cosine_distance, fold, widen
from postloom.operators import centroid_days as CD
from postloom.operators import centroids as C
from postloom.operators import encode as V
from postloom.operators import reduce as R
from postloom.operators import search as S
from postloom.plans import stages
from postloom.registry import models


@pytest.fixture(scope="module")
def vectors(spark, data):
    return spark.read.parquet(f"{data}/embeddings.parquet").cache()


@pytest.fixture(scope="module")
def frame(vectors):
    return vectors.toPandas()


def as_dict(centroids):
    return {r["label"]: r["centroid"] for r in centroids.collect()}


def by_label(frame, function):
    return {
        label: function(np.array(group["embedding"].tolist(), dtype=np.float64))
        for label, group in frame.groupby("label")
    }


def test_mean_std(vectors, frame):
    for found, function in [
        (C.mean_centroids(vectors), lambda m: m.mean(axis=0)),
        (C.std_centroids(vectors), lambda m: m.std(axis=0, ddof=1)),
    ]:
        found, wanted = as_dict(found), by_label(frame, function)
        assert found.keys() == wanted.keys()
        for label in wanted:
            np.testing.assert_allclose(found[label], wanted[label], atol=1e-12)


def test_std_of_one_row_is_null(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "label int, embedding array<double>")
    assert as_dict(C.std_centroids(one)) == {1: None}


@pytest.mark.parametrize("bracket_rows", [100, 10**9])
def test_median(vectors, frame, bracket_rows):
    found = as_dict(C.median_centroids(vectors, bracket_rows=bracket_rows))
    wanted = by_label(frame, lambda m: np.median(m, axis=0))
    assert found.keys() == wanted.keys()
    for label in wanted:
        np.testing.assert_array_equal(found[label], wanted[label])


def test_median_with_a_hot_label(spark):
    """A sample places the brackets; ties, a rare label and a hot label stay exact."""
    rng = np.random.default_rng(3)
    hot = rng.normal(size=(9000, 3)).astype(np.float32)
    hot[:4000, 1] = 0.25
    hot[:, 2] = np.round(hot[:, 2])
    rare = rng.normal(size=(4, 3)).astype(np.float32)
    rows = [("hot", v.tolist()) for v in hot] + [("rare", v.tolist()) for v in rare]
    df = spark.createDataFrame(rows, "label string, embedding array<float>").repartition(4)
    found = as_dict(C.median_centroids(df, bracket_rows=1500))
    np.testing.assert_array_equal(found["hot"], np.median(hot.astype(float), axis=0))
    np.testing.assert_array_equal(found["rare"], np.median(rare.astype(float), axis=0))


def test_median_of_many_labels(spark):
    """Most labels are in no sample; an empty table has no medians."""
    rng = np.random.default_rng(5)
    rows = [(int(k) // 2, v.tolist()) for k, v in enumerate(rng.normal(size=(6000, 2)))]
    df = spark.createDataFrame(rows, "label int, embedding array<double>").repartition(4)
    found = as_dict(C.median_centroids(df, bracket_rows=500))
    assert len(found) == 3000
    for label in range(0, 3000, 500):
        pair = np.array([rows[2 * label][1], rows[2 * label + 1][1]])
        np.testing.assert_array_equal(found[label], np.median(pair, axis=0))
    assert as_dict(C.median_centroids(df.limit(0))) == {}


def brute_nearest(frame, centroids, k):
    matrix = np.array(frame["embedding"].tolist(), dtype=np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    out = {}
    for label, c in centroids.items():
        d = np.round(1 - matrix @ (np.array(c) / np.linalg.norm(c)), 12)
        order = sorted(range(len(d)), key=lambda i: (d[i], frame["vec_id"][i]))[:k]
        out[label] = [int(frame["vec_id"][i]) for i in order]
    return out


def test_nearest(vectors, frame):
    means = C.mean_centroids(vectors)
    hits = S.nearest(vectors.repartition(5), means, 7).orderBy("narrative", "rank").collect()
    found = {}
    for r in hits:
        found.setdefault(r["narrative"], []).append(r["vec_id"])
    assert found == brute_nearest(frame, as_dict(means), 7)


def test_nearest_in_blocks(vectors, frame, monkeypatch):
    """More centroids than one broadcast may hold: several passes, same rows."""
    monkeypatch.setattr(S, "BROADCAST_BYTES", 8 * 64 * 3)
    means = C.mean_centroids(vectors)
    hits = S.nearest(vectors, means, 5).orderBy("narrative", "rank").collect()
    found = {}
    for r in hits:
        found.setdefault(r["narrative"], []).append(r["vec_id"])
    assert found == brute_nearest(frame, as_dict(means), 5)


@pytest.mark.parametrize("pivots, block_rows", [(2048, 4096), (40, 7), (1, 100)])
def test_nearest_of_many_centroids(spark, monkeypatch, pivots, block_rows):
    """One scan of the posts, however many blocks; hits equal to brute force."""
    monkeypatch.setattr(S, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(8)
    hubs = rng.normal(size=(30, 12))
    around = lambda n: hubs[rng.integers(30, size=n)] + rng.normal(size=(n, 12)) * 0.05
    posts = [(i, i % 3, v.tolist()) for i, v in enumerate(around(2500))]
    middles = [(f"c{i}", v.tolist()) for i, v in enumerate(around(600))]
    df = spark.createDataFrame(posts, "vec_id long, label int, embedding array<double>").repartition(6)
    centres = spark.createDataFrame([*middles, ("zero", [0.0] * 12), ("none", None)], "label string, centroid array<double>")
    hits = S.nearest(df, centres, 4, pivots=pivots)
    found = {}
    for r in hits.orderBy("narrative", "rank").collect():
        found.setdefault(r["narrative"], []).append(r["vec_id"])
    assert found == brute_nearest(df.toPandas(), dict(middles), 4)
    assert plan_of(hits).count("Scan ExistingRDD") <= 2


def test_blocks_are_skipped(spark):
    """Posts far from a block's pivot are not sent to it."""
    rng = np.random.default_rng(9)
    hubs = rng.normal(size=(20, 16))
    near = lambda n: (hubs[rng.integers(20, size=n)] + rng.normal(size=(n, 16)) * 0.01).tolist()
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(near(4000))], "vec_id long, label int, embedding array<double>").coalesce(2)
    centres = spark.createDataFrame(list(enumerate(near(500))), "label int, centroid array<double>")
    _, info = S._blocks(centres, 100)
    assert 20 <= len(info["blocks"]) <= 100 and info["chunks"].max() == 1
    sent = S.near_blocks(df, info, 3, "vec_id", "label", "embedding").count()
    assert 3 * len(info["blocks"]) <= sent < 0.15 * 4000 * len(info["blocks"])


def test_nearest_zero_vector_and_ties(spark):
    rows = [(1, 0, [0.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 1, [2.0, 0.0]), (4, 1, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    centre = spark.createDataFrame([(0, [1.0, 0.0])], "label int, centroid array<double>")
    hits = S.with_match(S.nearest(df, centre, 10)).orderBy("rank").collect()
    assert [(r["vec_id"], r["match"]) for r in hits] == [(2, True), (3, False), (4, False)]
    assert S.precision(S.nearest(df, centre, 2), 2).first()["precision"] == 0.5


def test_cosine_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    found = [r[0] for r in df.select(cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert found[0] == pytest.approx(1 - 1 / np.sqrt(2)) and found[1] is None


def test_svd(vectors, frame):
    model = R.fit_svd(vectors.withColumnRenamed("vec_id", "tweet_id"), fraction=1.0).orderBy("component").collect()
    matrix = np.array(frame["embedding"].tolist(), dtype=np.float64)
    _, s, vt = np.linalg.svd(matrix, full_matrices=False)
    for i, row in enumerate(model):
        assert row["singular_value"] == pytest.approx(s[i], rel=1e-9)
        assert abs(np.dot(row["weights"], vt[i])) == pytest.approx(1, abs=1e-9)
        assert max(row["weights"], key=abs) > 0


def test_project_and_model_reuse(spark, vectors, tmp_path):
    named = vectors.withColumnRenamed("vec_id", "tweet_id")
    first = R.load_or_fit(spark, str(tmp_path / "m"), named, "a", fraction=1.0).collect()
    again = R.load_or_fit(spark, str(tmp_path / "m"), named.limit(5), "a", fraction=1.0)
    assert again.orderBy("component").collect() == sorted(first, key=lambda r: r["component"])
    points = {r["tweet_id"]: (r["x"], r["y"]) for r in R.project(named, again).collect()}
    weights = np.array([r["weights"] for r in again.orderBy("component").collect()])
    row = named.first()
    np.testing.assert_allclose(points[row["tweet_id"]], weights @ np.array(row["embedding"]), atol=1e-12)


def test_widen_and_fold(spark, vectors):
    wide = vectors.select("vec_id", *widen(F.col("embedding"), 64))
    back = wide.select("vec_id", fold([f"embed_{i + 1}" for i in range(64)]).alias("embedding"))
    assert back.exceptAll(vectors.select("vec_id", "embedding")).count() == 0


def test_encode_hashing(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "id int, t string")
    rows = {r["id"]: np.array(r["embedding"]) for r in V.encode_hashing(df, "t", width=32).collect()}
    assert set(rows) == {1, 2} and rows[1].sum() == 3 and sorted(rows[1])[-2:] == [1, 2]
    only_a = rows[1] - rows[2]
    assert sorted(only_a)[-1] == 2
    model = V.fit_weights(df, "t", 32)
    weighted = {r["id"]: np.array(r["embedding"]) for r in V.encode_hashing(df, "t", model, 32).collect()}
    assert weighted[2].sum() == 0 and weighted[1].sum() == pytest.approx(2 * np.log(3 / 2))


def test_encode_with_loads_once_per_worker(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(200)], "id int, t string").coalesce(1)

    def factory():
        calls = []

        def encode(texts):
            calls.append(len(texts))
            return np.array([[len(t), len(calls), max(calls)] for t in texts])

        return encode

    rows = V.encode_with(df, "id", "t", factory, batch_size=64).collect()
    assert len(rows) == 200 and all(r["embedding"][0] == r["id"] for r in rows)
    assert max(r["embedding"][1] for r in rows) == 4 and max(r["embedding"][2] for r in rows) == 64


def test_task_functions_need_no_package_on_the_executor(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps(S.matrix_of_units))
    code = (
        "import pickle, pyarrow as pa; f = pickle.load(open('f', 'rb'));"
        "print(f(pa.array([[3.0, 4.0]])).tolist())"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.strip() == "[[0.6, 0.8]]", done.stderr


def wide_frame(spark, values, slices):
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "tweet_id long, embedding array<double>").repartition(slices)


def decaying(rows, width, seed, power):
    draw = np.random.default_rng(seed)
    n = min(rows, width)
    left = np.linalg.qr(draw.standard_normal((rows, n)))[0]
    right = np.linalg.qr(draw.standard_normal((width, n)))[0]
    return (left * (100.0 / np.arange(1, n + 1) ** power)) @ right.T


@pytest.mark.parametrize("rows, width, power", [(300, 700, 1.0), (40, 20_000, 0.5), (900, 120, 0.3), (3, 200, 1.0)])
def test_svd_of_any_width(spark, monkeypatch, rows, width, power):
    """Vectors far wider than the block, more tasks than the tree merges at once."""
    monkeypatch.setattr(R, "TREE", 3)
    values = decaying(rows, width, 3, power)
    df = wide_frame(spark, values, 13)
    sizes, vectors = R.truncated_svd(df, 2, seed=1)
    _, s, vt = np.linalg.svd(values, full_matrices=False)
    assert np.allclose(sizes, s[:2], rtol=1e-10)
    for k in range(2):
        assert abs(abs(vectors[:, k] @ vt[k]) - 1) < 1e-9
    model = R.fit_svd(df, fraction=1.0, seed=2).orderBy("component").collect()
    assert np.allclose([r["singular_value"] for r in model], s[:2], rtol=1e-10)
    assert all(max(r["weights"], key=abs) > 0 for r in model)


def test_svd_collects_nothing_wider_than_its_block(spark):
    df = wide_frame(spark, decaying(50, 500, 1, 1.0), 4)
    rows = R.block_pass(df, np.eye(500)[:, :6]).collect()
    assert {len(r["row"]) for r in rows} == {6}
    assert sorted(r["i"] for r in rows) == sorted([*range(500), *range(-6, 0)])


def test_svd_of_zeros_and_nothing(spark):
    zeros = wide_frame(spark, np.zeros((5, 90)), 2)
    sizes, _ = R.truncated_svd(zeros, 2)
    assert sizes.tolist() == [0, 0]
    with pytest.raises(ValueError):
        R.truncated_svd(zeros.limit(0), 2)


def test_centroids_kept_up_by_day(spark, tmp_path):
    """Days come one by one, one is rerun, one is emptied; merged states equal the whole."""
    rng = np.random.default_rng(11)
    start = date(2024, 3, 1)
    rows = [
        (start + timedelta(int(k) % 5), "abc"[int(k) % 3], (rng.normal(size=4) * 1e-3 + 1e6).tolist())
        for k in rng.integers(1000, size=400)
    ]
    rows += [(start, "one", [1.0, 2.0, 3.0, 4.0]), (start + timedelta(6), "gone", [0.0] * 4), (None, "a", [9.0] * 4)]
    df = spark.createDataFrame(rows, "day date, label string, embedding array<double>").repartition(3)
    path = str(tmp_path / "states")
    days = [start + timedelta(d) for d in range(7)]
    CD.update_days(df.where("label <> 'b'"), path, days[:3])
    CD.update_days(df, path, days[5:])
    wanted = spark.createDataFrame([(d,) for d in days], "day date")
    assert {r["day"] for r in CD.days_to_do(wanted, path).collect()} == set(days[3:5])
    for d in days[:5]:
        CD.update_days(df, path, [d])
    CD.update_days(df.where("label <> 'gone'"), path, [days[6]])
    assert CD.days_to_do(wanted, path).count() == 0

    def check(found, kept):
        found = {r["label"]: r for r in found.collect()}
        groups = {}
        for _, label, v in kept:
            groups.setdefault(label, []).append(v)
        assert found.keys() == groups.keys()
        for label, values in groups.items():
            m = np.array(values)
            assert found[label]["n"] == len(m)
            np.testing.assert_allclose(found[label]["mean"], m.mean(axis=0), rtol=1e-12)
            if len(m) == 1:
                assert found[label]["std"] is None
            else:
                np.testing.assert_allclose(found[label]["std"], m.std(axis=0, ddof=1), rtol=1e-6)

    kept = [r for r in rows if r[0] and r[1] != "gone"]
    check(CD.centroids_of_days(spark, path), kept)
    check(CD.centroids_of_days(spark, path, days[1], days[2]), [r for r in kept if days[1] <= r[0] <= days[2]])
    plan = plan_of(CD.centroids_of_days(spark, path, days[1], days[2]))
    assert "PartitionFilters: [isnotnull(day" in plan


def test_distances_to_own_without_shuffle(spark, data):
    """The stored centroids are broadcast by their bytes; the posts stay where they are."""
    posts = spark.read.parquet(f"{data}/embeddings.parquet")
    own = S.distances_to_own(posts, C.mean_centroids(posts))
    plan = plan_of(own)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert own.count() == posts.count()


def test_posts_are_encoded_once(spark):
    """Fitting a model, projecting and joining the posts reads stored vectors; no text is cleaned twice."""
    start = datetime(2024, 1, 1)
    texts = [("en", f"word{i} and {i % 3}") for i in range(6)] + [("de", "ein Wort"), ("en", None), ("en", "")]
    posts = spark.createDataFrame(
        [(str(i), start, lang, text) for i, (lang, text) in enumerate(texts)],
        "id_str string, created_at timestamp_ntz, lang string, full_text string",
    )
    seen, plans = spark.sparkContext.accumulator(0), []

    def encode(rows):
        def count(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        out = V.encode_hashing(rows, "normalized_tweet", width=4).drop("normalized_tweet")
        plans.append(plan_of(out))
        return out.mapInPandas(count, out.schema)

    vectors = stages.vectors_of(posts, encode)
    points = stages.points_of(vectors, R.fit_svd(vectors, fraction=1.0), posts).collect()
    kept = [(str(i), texts[i][1]) for i in (0, 1, 2, 3, 4, 5, 8)]
    assert sorted((r["tweet_id"], r["tweet"]) for r in points) == kept
    assert seen.value == 7
    assert plans[0].count("regexp_extract_all") == 1


def test_weights_are_compared_a_row_per_document(spark, tmp_path):
    """Vectors meet whole: no rows per position are joined, and each text is split once a frame."""

    def run(*rows):
        folder = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        return models.encode_idf(spark, folder)

    once = run((1, "a b a"), (2, "b"), (3, ""), (4, None), (5, "c"))
    assert sorted(once.collect()) == [(1, 3, True), (2, 1, True), (3, 0, True), (5, 1, True)]
    # every count vector of an id meets every weighted one; rows without an id meet none
    again = {r["doc_id"]: r["tokens"] for r in run((1, "a"), (1, "b c"), (2, "d"), (None, "e")).collect()}
    assert again == {1: 6, 2: 1}
    plan = plan_of(once).split("== Initial Plan ==")[-1]
    assert plan.count("split(text") == 1
    assert "posexplode" not in plan.split("SortMergeJoin")[1].split("BroadcastExchange")[0]

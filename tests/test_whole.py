"""Operators on more rows than the small tables have: nothing is left out."""

import numpy as np
from pyspark.sql import functions as F

from assize.operators import negatives, rubrics, sampling
from assize.plans import queries as core


def clustered(spark, n, clusters, width=64, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    v = centres[np.arange(n) % clusters] + rng.normal(0, 0.8, (n, width))
    return v.astype(np.float32), [(i, x.tolist(), i % clusters) for i, x in enumerate(v.astype(np.float32))]


def test_mmr_sample_sees_every_row_of_a_cluster(spark, tmp_path):
    v, rows = clustered(spark, 1600, 2)
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = core.QUERIES["mmr_sample"](spark, str(tmp_path)).toPandas()
    x = core._nearest(spark, str(tmp_path)).select("id", "cluster", "distance", F.xxhash64("id", F.lit(42)).alias("u")).toPandas()
    takes = {r.cluster: r["take"] for r in core._takes(spark, str(tmp_path)).collect()}
    for c, take in takes.items():
        own = x[x.cluster == c].sort_values(["distance", "id"]).id.tolist()
        near = own[: max(1, take // 4)]
        rest = x[x.id.isin(own[len(near) :])].sort_values(["u", "id"]).id.tolist()
        want = sampling.mmr(v.astype(float), near, rest, take - len(near))
        assert len(rest) > 200 and set(got[got.cluster == c].id) == {*near, *want}


def test_diverse_sample_gives_all_it_is_asked_for(spark):
    _, rows = clustered(spark, 700, 1, width=4)
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>, cluster int").withColumn("distance", F.rand(3))
    got = sampling.diverse_sample(df, spark.createDataFrame([(0, 600)], "cluster int, take int"), candidates=200)
    assert got.count() == 600 == got.select("id").distinct().count()


def test_swap_share_of_long_texts(spark):
    df = spark.createDataFrame([(n, " ".join(f"w{k}" for k in range(n))) for n in (2, 29, 30, 60, 200)], "id int, target string")
    for r in df.select("id", "target", negatives.swap_share(F.col("target"), F.col("id"), 2).alias("x")).collect():
        a, b = r.target.split(), r.x.split()
        # k swaps that don't undo each other move k + 1 words
        assert sorted(a) == sorted(b) and sum(x != y for x, y in zip(a, b)) == max(1, int(0.3 * r.id)) + 1


def test_retrieval_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(40)], "id bigint, embedding array<float>")
    want = sorted(map(tuple, rubrics.retrieve_top_k(items, items, 3).collect()))
    monkeypatch.setattr(rubrics, "MOST_QUERIES", 16)
    got = sorted(map(tuple, rubrics.retrieve_top_k(items, items, 3).collect()))
    assert got == want and len(got) == 120


def test_retrieval_of_more_queries_than_are_held_at_once(spark):
    items = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(2)], "id bigint, embedding array<float>")
    queries = spark.range(4_100).select("id", F.array(F.cos("id"), F.sin("id")).cast("array<float>").alias("embedding"))
    assert rubrics.retrieve_top_k(queries, items, 1).count() == 4_100

"""Clusters of vectors and varied samples from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assize.functions.vectors import l2_normalise, mean_vector

#: Centres that may be broadcast at once: clusters are chosen, not grown with the data.
MOST_CENTRES = 10_000
#: Vectors of one cluster's candidates that a task holds for the greedy selection.
MOST_CANDIDATES = 20_000


def centroids(df: DataFrame, label: str, vector: str, width: int) -> DataFrame:
    """(cluster, centre): each label's mean vector."""
    return df.groupBy(F.col(label).alias("cluster")).agg(mean_vector(F.col(vector), width).alias("centre"))


def assign_nearest(df: DataFrame, centres: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds cluster and distance (L2, squared) of the nearest centre; ties go to the lower cluster, a null vector has nulls.

    The centres are broadcast as a matrix and multiplied with batches of rows; no row is shuffled.
    """
    rows = centres.orderBy("cluster").limit(MOST_CENTRES + 1).collect()
    if not 0 < len(rows) <= MOST_CENTRES:
        raise ValueError(f"{len(rows)} centres: between 1 and {MOST_CENTRES} can be held")
    held = df.sparkSession.sparkContext.broadcast((np.array([r.cluster for r in rows]), np.array([r.centre for r in rows], float)))
    kept = [c for c in df.columns if c not in ("cluster", "distance")]
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", cluster {dict(centres.dtypes)['cluster']}, distance double"

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, c = held.value
        for b in batches:
            own, far = np.zeros(len(b), np.int64), np.full(len(b), np.nan)
            full = np.nonzero(b[vector].notna().to_numpy())[0]
            for at in np.array_split(full, max(1, -(-len(full) * len(c) // 4_000_000))):
                x = np.array(b[vector].iloc[at].tolist(), float).reshape(len(at), c.shape[1])
                # rounded, so that equal distances tie in spite of the order of sums
                own[at] = np.argmin(np.round((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 12), axis=1)
                far[at] = ((x - c[own[at]]) ** 2).sum(1)
            cluster = pd.Series(names[own].astype(object), index=b.index).where(~np.isnan(far), None)
            yield b[kept].assign(cluster=cluster, distance=pd.Series(far, index=b.index).astype(object).where(~np.isnan(far), None))

    return df.select(*kept).mapInPandas(assign, schema)


def choose_k(df: DataFrame, ks: tuple[int, ...] = (3, 4, 5, 7, 10), vector: str = "embedding", seed: int = 42, max_iter: int = 100):
    """k-means for each k on normalised vectors; the model with the best cosine silhouette, as (k, model, scores).

    The silhouette is over all rows: its closed form needs no pairs.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    v = df.select(array_to_vector(l2_normalise(F.col(vector))).alias("features")).cache()
    try:
        n = v.count()
        best, scores = None, {}
        for k in ks:
            if k >= n:
                continue
            model = KMeans(k=k, seed=seed, maxIter=max_iter).fit(v)
            predicted = model.transform(v)
            if predicted.select("prediction").distinct().count() < 2:
                continue
            scores[k] = ClusteringEvaluator(distanceMeasure="cosine").evaluate(predicted)
            if best is None or scores[k] > scores[best[0]]:
                best = (k, model)
        if best is None:
            raise ValueError("no k gives two clusters")
        return best[0], best[1], scores
    finally:
        v.unpersist()


def silhouette(df: DataFrame, label: str = "label", vector: str = "embedding") -> float:
    """Mean cosine silhouette of given labels, over all rows."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    v = df.select(array_to_vector(l2_normalise(F.col(vector))).alias("features"), F.col(label).cast("int").alias("prediction"))
    return ClusteringEvaluator(distanceMeasure="cosine").evaluate(v)


def allocate(sizes: DataFrame, total: int) -> DataFrame:
    """(cluster, n, take): max(1, floor(share * (total - clusters))) each, in the order of the clusters; the last gets the rest.

    ``sizes`` has a row (cluster, n) for each of the chosen clusters. ``total`` must be at least their number.
    """
    k = sizes.count()
    if total < k:
        raise ValueError(f"{total} samples can't cover {k} clusters")
    all_ = Window.partitionBy()  # one row for each cluster
    order = Window.orderBy("cluster")
    base = F.greatest(F.lit(1), F.floor(F.col("n") / F.sum("n").over(all_) * (total - k)).cast("int"))
    s = sizes.withColumn("_b", base).withColumn("_r", F.row_number().over(order))
    rest = F.greatest(F.lit(0), F.lit(total) - F.sum("_b").over(all_))
    return s.select("cluster", "n", (F.col("_b") + F.when(F.col("_r") == k, rest).otherwise(0)).cast("int").alias("take"))


def nearest_rows(df: DataFrame, n: Column | int, group: str = "cluster", distance: str = "distance", id: str = "id") -> DataFrame:
    """The n rows of each group with the least distance (ties by id), with their rank; hot groups are thinned in parts first."""
    n = F.lit(n) if isinstance(n, int) else n
    part = Window.partitionBy(group, F.pmod(F.xxhash64(id), F.lit(64))).orderBy(distance, id)
    out = df.withColumn("_p", F.row_number().over(part)).where(F.col("_p") <= n).drop("_p")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(distance, id))).where(F.col("rank") <= n)


def mmr(vectors: np.ndarray, start: list[int], candidates: list[int], n: int, weight: float = 0.7) -> list[int]:
    """Greedy choice of n candidates by ``weight * cos(c, mean of chosen) - (1 - weight) * max cos(c, chosen)``; ties to the earlier."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    chosen, left = list(start), list(candidates)
    out: list[int] = []
    total = vectors[chosen].sum(0) if chosen else None
    nearest = (unit[left] @ unit[chosen].T).max(1) if chosen and left else np.full(len(left), -np.inf)
    while left and len(out) < n:
        mean = total / len(chosen) if chosen else vectors[left].mean(0)
        like = unit[left] @ (mean / max(np.linalg.norm(mean), 1e-12))
        score = weight * like - (1 - weight) * nearest if chosen else like
        i = int(np.argmax(score))
        pick = left.pop(i)
        nearest = np.maximum(np.delete(nearest, i), unit[left] @ unit[pick]) if left else nearest
        total = vectors[pick] + (total if total is not None else 0)
        chosen.append(pick)
        out.append(pick)
    return out


def diverse_sample(df: DataFrame, takes: DataFrame, vector: str = "embedding", id: str = "id", diversity: float = 0.75, candidates: int = 200, weight: float = 0.7) -> DataFrame:
    """(cluster, id, how): of each cluster its share nearest to the centre, the rest chosen greedily for difference.

    ``df`` has id, vector, cluster, distance; ``takes`` has cluster, take. The greedy part looks at ``candidates`` rows
    of a cluster, or at as many as it has to choose if these are more, picked by a hash among the rows that aren't near
    ones, and only these reach a task. Fewer rows than ``take`` come out only of a cluster that has fewer.
    """
    if candidates > MOST_CANDIDATES:
        raise ValueError(f"at most {MOST_CANDIDATES} candidates fit a task")
    rows = df.join(F.broadcast(takes.select("cluster", "take")), "cluster")  # one row for each of the chosen clusters
    close = F.greatest(F.lit(1), F.floor(F.col("take") * (1 - diversity)).cast("int"))
    near = nearest_rows(rows.withColumn("_close", close), F.col("_close"), id=id).select("cluster", id, vector, "take", F.lit(True).alias("near"), F.lit(0).cast("bigint").alias("u"), "rank")
    rest = rows.join(near.select(id), id, "left_anti").withColumn("u", F.xxhash64(id, F.lit(42)))
    rest = nearest_rows(rest.withColumn("_limit", F.greatest(F.lit(candidates), F.col("take") - close)), F.col("_limit"), distance="u", id=id).select("cluster", id, vector, "take", F.lit(False).alias("near"), "u", "rank")

    def choose(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["near", "rank"], ascending=[False, True]).reset_index(drop=True)
        v = np.array(b[vector].tolist(), float)
        first = np.nonzero(b["near"].to_numpy())[0].tolist()
        more = mmr(v, first, np.nonzero(~b["near"].to_numpy())[0].tolist(), max(0, int(b["take"].iloc[0]) - len(first)), weight)
        return pd.DataFrame({"cluster": b["cluster"].iloc[0], "id": b[id].iloc[[*first, *more]].to_numpy(), "how": ["near"] * len(first) + ["diverse"] * len(more)})

    return near.unionByName(rest).groupBy("cluster").applyInPandas(choose, "cluster int, id bigint, how string")


def dendrogram(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All merges of average linkage on cosine distance, by nearest-neighbour chains: pairs of row numbers and their heights, rising.

    Average linkage is reducible, so that merging along chains gives the same tree as merging the least distance first.
    """
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    n = len(unit)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    pairs, heights, chain = [], [], []
    while len(pairs) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        i = chain[-1]
        j = int(np.argmin(d[i]))
        if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
            j = chain[-2]
        if len(chain) < 2 or j != chain[-2]:
            chain.append(j)
            continue
        del chain[-2:]
        pairs.append((i, j))
        heights.append(d[i, j])
        i, j = min(i, j), max(i, j)
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i], d[i, i] = row, row, np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
    order = np.argsort(heights, kind="stable")
    return np.array(pairs, np.int64).reshape(-1, 2)[order], np.array(heights)[order]


def cut(pairs: np.ndarray, n: int, merges: int) -> np.ndarray:
    """Labels of n rows after the first ``merges`` of a dendrogram's merges."""
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs[:merges]:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


def average_linkage(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of agglomerative clustering with average linkage on cosine distance, merging while the least one is below ``threshold``."""
    pairs, heights = dendrogram(vectors)
    return cut(pairs, len(vectors), int((heights < threshold).sum()))


def agglomerate(df: DataFrame, thresholds: tuple[float, ...], group: str = "block", id: str = "id", vector: str = "embedding", least: int = 3, most: int = 2_000) -> DataFrame:
    """(block, id, label, threshold): average-linkage clusters within each block of at most ``most`` rows, which are refused beyond.

    Of the thresholds the one with the best silhouette counts among those with two or more clusters of ``least`` rows or
    more; where there is none, the merging goes on to max(2, n // 3) clusters.
    """

    def fit(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        if len(b) > most:
            raise ValueError(f"block {key[0]} has {len(b)} rows; split it below {most}")
        b = b.sort_values(id)
        v = np.array(b[vector].tolist(), float)
        best, score, at = None, -1.0, None
        pairs, heights = dendrogram(v)
        for t in thresholds:
            labels = cut(pairs, len(v), int((heights < t).sum()))
            n = np.bincount(labels)
            if len(n) > 1 and n.min() >= least and (s := exact_silhouette(v, labels)) > score:
                best, score, at = labels, s, t
        if best is None:
            best = cut(pairs, len(v), max(0, len(v) - max(2, len(v) // 3)))
        return pd.DataFrame({"block": b[group].to_numpy(), "id": b[id].to_numpy(), "label": best.astype(np.int32), "threshold": np.nan if at is None else at})

    kind = dict(df.dtypes)[group]
    return df.select(group, id, vector).groupBy(group).applyInPandas(fit, f"block {kind}, id bigint, label int, threshold double")


def exact_silhouette(vectors: np.ndarray, labels: np.ndarray) -> float:
    """Mean cosine silhouette of the rows of one block."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    d = 1 - unit @ unit.T
    n = np.bincount(labels)
    sums = np.stack([d[:, labels == k].sum(1) for k in range(len(n))], 1)
    own = n[labels]
    a = np.where(own > 1, sums[np.arange(len(d)), labels] / np.maximum(own - 1, 1), 0.0)
    other = sums / n
    other[np.arange(len(d)), labels] = np.inf
    b = other.min(1)
    return float(np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0).mean())


def stub_model(width: int = 64):
    """A model of hashed words, in place of an embedding model."""
    import zlib

    def vectors(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                out[i, h % width] += 1 if h & 65536 else -1
        return out

    return vectors


def stub_vectors(df: DataFrame, text: str, width: int = 64, name: str = "embedding") -> DataFrame:
    """Adds deterministic unit vectors of hashed words, in place of an embedding model; zero for null texts."""
    from assize.operators.completion import embed

    return embed(df.withColumn(text, F.coalesce(text, F.lit(""))), text, lambda: stub_model(width), width, name=name)

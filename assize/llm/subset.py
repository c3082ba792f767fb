"""A varied subset of a given size: mini-batch k-means on text vectors, square-root quotas for clusters, equal ones for sources."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assize.llm.answers import words
from assize.plans.lineage import settle

#: Clusters, and mini-batches: the first two are 1 / 2^(BATCHES - 1) of the rows each, every further one is twice as large.
CLUSTERS, BATCHES = 64, 6
HASHED, WIDTH = 1 << 13, 64
#: Rows, in expectation, on which the first centres are chosen; all passes after that are over all rows.
INIT_ROWS = 4_000
#: Vectors are summed as whole numbers in this unit, so that sums don't depend on their order.
UNIT = 1 << 20
#: Share of the mean squared distance of centres below which two clusters are one group of similar records.
CLOSE = 0.15
_SALTS = 32


class _Index(dict):
    def __missing__(self, w: str) -> int:
        i = zlib.crc32(w.encode("utf-8", "surrogatepass")) % HASHED
        if len(self) < 1 << 20:
            self[w] = i
        return i


def text_vectors(texts: list[str | None], index: _Index | None = None) -> np.ndarray:
    """Unit vectors of log word counts, hashed and projected on WIDTH fixed random directions; zero without words."""
    index = _Index() if index is None else index
    directions = np.random.default_rng(20).choice(np.array([-1, 1], np.float32), (HASHED, WIDTH))
    out = np.zeros((len(texts), WIDTH), np.float32)
    for i, t in enumerate(texts):
        at, n = np.unique([index[w] for w in words(t or "")], return_counts=True)
        if len(at):
            v = np.log1p(n).astype(np.float32) @ directions[at.astype(np.int64)]
            out[i] = v / (np.linalg.norm(v) + 1e-9)
    return out


def vectors(records: DataFrame) -> DataFrame:
    """(id, source, v) of each distinct id of ``records`` (id, source, text)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _Index()
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "source": b["source"], "v": list(text_vectors(b["text"].tolist(), index))})

    r = records.select(F.col("id").cast("bigint").alias("id"), "source", "text").where(F.col("id").isNotNull())
    return r.mapInPandas(make, "id bigint, source string, v array<float>").dropDuplicates(["id"])


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), np.float64).reshape(len(v), WIDTH)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def _first_centres(x: np.ndarray, k: int) -> np.ndarray:
    """k-means++ on the rows given."""
    rng = np.random.default_rng(7)
    chosen = [x[rng.integers(len(x))]]
    d = ((x - chosen[0]) ** 2).sum(1)
    while len(chosen) < k and d.max() > 1e-12:
        chosen.append(x[rng.choice(len(x), p=d / d.sum())])
        d = np.minimum(d, ((x - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def _sums(df: DataFrame, centres: np.ndarray | None, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the vectors nearest to each centre (or of all): tasks send sums, which are added exactly."""
    k = 1 if centres is None else len(centres)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros(k, np.int64), np.zeros((k, WIDTH), np.int64)
        for b in batches:
            if len(b):
                v = _matrix(b["v"])
                own = np.zeros(len(v), np.int64) if centres is None else _nearest(v - mean, centres)
                n += np.bincount(own, minlength=k)
                np.add.at(s, own, np.rint(v * UNIT).astype(np.int64))
        hit = np.nonzero(n)[0]
        yield pd.DataFrame({"c": np.repeat(hit, WIDTH + 1), "at": np.tile(np.arange(WIDTH + 1), len(hit)), "x": np.column_stack([n[hit], s[hit]]).ravel()})

    n, s = np.zeros(k, np.int64), np.zeros((k, WIDTH))
    for r in df.select("v").mapInPandas(add, "c int, at int, x bigint").groupBy("c", "at").agg(F.sum("x").alias("x")).collect():  # k * (WIDTH + 1) rows
        if r["at"] == 0:
            n[r.c] = r.x
        else:
            s[r.c, r["at"] - 1] = r.x / UNIT
    return n, s - n[:, None] * mean


def mini_batch_k_means(made: DataFrame, k: int = CLUSTERS, batches: int = BATCHES) -> tuple[np.ndarray, np.ndarray]:
    """Mean of all vectors, and centres of the vectors less the mean.

    Each row is in one of ``batches`` fixed mini-batches by a hash of its id. A batch moves each centre to its own mean by a
    step that shrinks with the centre's count. Nothing depends on how rows are partitioned; what reaches the driver has k
    rows, whatever the number of rows or tasks.
    """
    zero = np.zeros(WIDTH)
    n, s = _sums(made, None, zero)
    if not n[0]:
        return zero, np.zeros((0, WIDTH))
    mean = s[0] / n[0]
    u = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    rows = made.where(u < min(1.0, INIT_ROWS / n[0])).select("id", "v").toPandas().sort_values("id")
    if not len(rows):
        rows = made.select("id", "v").orderBy("id").limit(INIT_ROWS).toPandas()
    centres = _first_centres(_matrix(rows["v"]) - mean, k)
    seen = np.zeros(len(centres))
    part = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << (batches - 1)))
    for j in range(batches):
        low, high = (0 if j == 0 else 1 << (j - 1)), 1 << j
        m, s = _sums(made.where((part >= low) & (part < high)), centres, mean)
        hit = m > 0
        seen[hit] += m[hit]
        centres[hit] += (s[hit] - m[hit, None] * centres[hit]) / seen[hit, None]
    return mean, centres


def quotas(sizes: np.ndarray, n: float, power: float) -> np.ndarray:
    """Real quotas proportional to size**power, none above its size, in sum n (or all rows); unused slots go to the others."""
    sizes = np.asarray(sizes, float)
    n = min(n, sizes.sum())
    want = np.where(sizes > 0, sizes**power, 0.0)
    out, open_ = np.zeros(len(sizes)), sizes > 0
    while open_.any():
        share = want * open_ * (n - out[~open_].sum()) / (want * open_).sum()
        over = open_ & (share >= sizes - 1e-12)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = sizes[over]
        open_ &= ~over
    return out


def _whole(real: np.ndarray, sizes: np.ndarray, n: int, order: np.ndarray) -> np.ndarray:
    """Whole quotas of sum n: rounding carries on along ``order``, so that neighbours share what is less than a slot."""
    out = np.floor(real + 1e-9).astype(np.int64)
    rest = np.cumsum((real - out)[order])
    out[order] += np.diff(np.floor(np.concatenate([[0.0], rest]) + 0.5)).astype(np.int64)
    out = np.minimum(out, sizes)
    while (gap := n - out.sum()) != 0:
        score = np.where(out < sizes, real - out, -np.inf) if gap > 0 else np.where(out > 0, out - real, -np.inf)
        out[int(np.argmax(score))] += 1 if gap > 0 else -1
    return out


def merge_close(centres: np.ndarray, share: float = CLOSE) -> np.ndarray:
    """Group number of each centre: centres closer than ``share`` of the mean squared distance are one group, chains among them."""
    group = np.arange(len(centres))
    if len(centres) > 1:
        d = ((centres[:, None] - centres[None]) ** 2).sum(2)
        near = share * d.sum() / (len(centres) * (len(centres) - 1))
        for i, j in zip(*np.nonzero(np.triu(d <= near, 1))):
            group[group == group[j]] = group[i]
    return np.unique(group, return_inverse=True)[1]


def allocate(cells: np.ndarray, n: int, order: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Slots of each (cluster, source) cell, n in sum (or all rows).

    Groups of clusters (by default each its own) get square-root quotas, and so their clusters of these; sources are drawn
    towards equal ones; no cell gets more than its rows.
    """
    cells = np.asarray(cells, np.int64)
    n = min(n, int(cells.sum()))
    sizes = cells.sum(1)
    group = np.arange(len(cells)) if group is None else group
    real = np.zeros(len(cells))
    for g, share in enumerate(quotas(np.bincount(group, sizes), n, 0.5)):
        own = group == g
        real[own] = quotas(sizes[own], share, 0.5)
    rows = _whole(real, sizes, n, order)
    columns = quotas(cells.sum(0), n, 0.0)
    w = np.sqrt(cells.astype(float))
    for _ in range(60):
        w *= (columns / np.maximum(w.sum(0), 1e-12))[None, :]
        w = np.minimum(w, cells)
        w *= (rows / np.maximum(w.sum(1), 1e-12))[:, None]
        w = np.minimum(w, cells)
    out = np.minimum(np.floor(w + 1e-9).astype(np.int64), cells)
    for c in order:
        while out[c].sum() > rows[c]:
            out[c, int(np.argmax(np.where(out[c] > 0, out[c] - w[c], -np.inf)))] -= 1
        while out[c].sum() < rows[c]:
            lack = columns - out.sum(0)
            out[c, int(np.argmax(np.where(out[c] < cells[c], lack + 1e-3 * (w[c] - out[c]), -np.inf)))] += 1
    return out


def _chain(centres: np.ndarray) -> np.ndarray:
    """Clusters in an order in which neighbours are alike."""
    left, out = set(range(1, len(centres))), [0]
    while left:
        near = min(left, key=lambda i: (((centres[i] - centres[out[-1]]) ** 2).sum(), i))
        left.remove(near)
        out.append(near)
    return np.array(out[: len(centres)], np.int64)


def varied_subsets(records: DataFrame, limits: list[tuple[str, int]], k: int = CLUSTERS) -> DataFrame:
    """(limit_name, id, source, cluster): for each limit exactly that many distinct ids, or all if there are fewer.

    ``records`` has id, source, text; null ids are no rows, a null source is a group of its own, null and empty texts have
    the zero vector. Exact copies of a text come last in their cell. Rows delivered again count once; ties go by a hash of
    the id; an empty table gives no rows.
    """
    spark = records.sparkSession
    made = settle(vectors(records), "vectors")
    mean, centres = mini_batch_k_means(made, k)
    schema = "limit_name string, id bigint, source string, cluster int"
    if not len(centres):
        return spark.createDataFrame([], schema)
    number = {r.source: i for i, r in enumerate(made.select("source").distinct().orderBy("source").collect())}  # a row for each source

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            src = [s if isinstance(s, str) else None for s in b["source"]]
            yield pd.DataFrame({"id": b["id"], "source": src, "cluster": _nearest(_matrix(b["v"]) - mean, centres).astype(np.int32), "slot": np.array([number[s] for s in src], np.int32), "copy": b["copy"]})

    rows = made.withColumn("copy", F.xxhash64("v")).mapInPandas(assign, "id bigint, source string, cluster int, slot int, copy bigint")
    # copies are told in two steps: a text that a third of all rows have is never one task's
    parts = Window.partitionBy("copy", F.pmod(F.xxhash64("id"), F.lit(_SALTS))).orderBy("id")
    rows = settle(rows.withColumn("again", F.row_number().over(parts) > 1), "clusters")
    cells = np.zeros((len(centres), len(number)), np.int64)
    for r in rows.groupBy("cluster", "slot").count().collect():  # k * sources rows at most
        cells[r.cluster, r.slot] = r["count"]
    order, group = _chain(centres), merge_close(centres)
    plan = []
    for name, n in limits:
        take = allocate(cells, n, order, group)
        plan += [(name, int(c), int(s), int(take[c, s])) for c, s in zip(*np.nonzero(take))]
    if not plan:
        return spark.createDataFrame([], schema)
    leading = rows.where(~F.col("again")).withColumn("again", F.row_number().over(Window.partitionBy("copy").orderBy("id")) > 1)  # _SALTS rows a copy
    rows = rows.where("again").unionByName(leading).drop("copy").withColumn("u", F.xxhash64("id", F.lit(11)))
    takes = F.broadcast(spark.createDataFrame(plan, "limit_name string, cluster int, slot int, take int"))
    rows = rows.join(takes, ["cluster", "slot"]).withColumn("salt", F.pmod("u", F.lit(_SALTS)))
    cell = ["limit_name", "cluster", "slot"]
    for keys in ([*cell, "salt"], cell):  # a hot cell is thinned in parts before its last ranking
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("again", "u", "id"))).where("r <= take")
    return rows.select("limit_name", "id", "source", "cluster")


def coverage_report(records: DataFrame, subset: DataFrame, k: int = CLUSTERS) -> DataFrame:
    """Per limit_name of ``subset`` (limit_name, id) what it covers of ``records`` (id, source, text), beside a random draw of its size.

    n, clusters of the table and those hit, sources and those hit, the largest cluster's and the largest source's share of the
    subset; ``random_`` columns are the values that a random draw has in expectation (in largest shares: the table's own).
    """
    made = settle(vectors(records), "vectors")
    mean, centres = mini_batch_k_means(made, k)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "source": b["source"], "cluster": _nearest(_matrix(b["v"]) - mean, centres).astype(np.int32)})

    rows = settle(made.mapInPandas(assign, "id bigint, source string, cluster int"), "assigned")
    n = subset.groupBy("limit_name").agg(F.count(F.lit(1)).alias("n"))
    out = n
    for what in ("cluster", "source"):
        all_ = rows.groupBy(what).agg(F.count(F.lit(1)).alias("size")).withColumn("share", F.col("size") / F.sum("size").over(Window.partitionBy()))  # one row for each
        drawn = n.join(F.broadcast(all_.agg(F.collect_list("share").alias("shares"))))
        expected = drawn.select(
            "limit_name", F.size("shares").alias(f"{what}s"), F.array_max("shares").alias(f"random_largest_{what}"),
            F.aggregate("shares", F.lit(0.0), lambda s, p: s + 1 - F.pow(1 - p, F.col("n"))).alias(f"random_{what}s_hit"),
        )
        hit = subset.join(rows.select("id", F.col(what).alias("_what")), "id").groupBy("limit_name", "_what").count()
        hit = hit.groupBy("limit_name").agg(F.count(F.lit(1)).alias(f"{what}s_hit"), F.max("count").alias("_most"))
        out = out.join(expected, "limit_name").join(hit, "limit_name").withColumn(f"largest_{what}", F.round(F.col("_most") / F.col("n"), 4)).drop("_most")
        out = out.withColumns({c: F.round(c, 4) for c in (f"random_largest_{what}", f"random_{what}s_hit")})
    return out

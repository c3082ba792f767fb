"""Filling containers of a fixed capacity with items, solved on the histogram of lengths.

Shallow combinations of lengths that fill a container up to a small window get repeat counts by non-negative least squares
against the histogram; these are rounded, and what is left is packed greedily, again length by length. The plan's size
depends on the capacity only; items take their places in it by their ordinal among those of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assize.llm.tokens import TOKENIZERS, VOCABULARY, count_tokens

#: Tokens that a combination may leave free, lengths per combination, and combinations at most.
SLACK, DEPTH, COMBINATIONS = 2, 6, 40_000
ITERATIONS = 400
#: Items of one ordinal bucket, so that no length is numbered in one task.
BUCKET_ROWS = 500_000


def combinations(histogram: np.ndarray, slack: int = SLACK, depth: int = DEPTH, most: int = COMBINATIONS) -> list[tuple[int, ...]]:
    """Combinations of up to ``depth`` present lengths, falling, with sums within ``slack`` of the capacity.

    The first lengths are taken from the histogram's quantiles, finer for fewer lengths; the last one closes the gap.
    """
    cap = len(histogram) - 1
    present = np.nonzero(histogram)[0]
    present = present[present > 0]
    if not len(present):
        return []
    mass = np.repeat(present, np.minimum(histogram[present], 1 + histogram[present] * 4096 // max(1, histogram.sum())))
    out: set[tuple[int, ...]] = set()
    have = histogram > 0
    for d in range(1, depth + 1):
        budget = most // depth
        grid = np.unique(np.quantile(mass, np.linspace(0, 1, max(2, int(budget ** (1 / max(1, d - 1))))), method="nearest")) if d > 2 else present
        level: set[tuple[int, ...]] = set()

        def grow(head: tuple[int, ...], total: int, d: int = d, grid: np.ndarray = grid, level: set = level, budget: int = budget) -> None:
            if len(level) >= budget:
                return
            if len(head) == d - 1:
                for rest in range(cap - total, max(0, cap - total - slack - 1), -1):
                    if 0 < rest <= cap and have[rest] and (not head or rest <= head[-1]):
                        level.add((*head, rest))
                        return
                return
            for x in grid[::-1]:
                if total + x < cap and (not head or x <= head[-1]):
                    grow((*head, int(x)), total + int(x))

        grow((), 0)
        out |= level
    return sorted(out, reverse=True)


def non_negative_least_squares(rows: np.ndarray, cols: np.ndarray, h: np.ndarray, n: int, iterations: int = ITERATIONS) -> np.ndarray:
    """min |Ax - h| over x >= 0, A having a 1 at each (row, col) given; accelerated projected gradients."""
    m = len(h)
    times = lambda x: np.bincount(rows, x[cols], m)
    back = lambda y: np.bincount(cols, y[rows], n)
    v = np.ones(n)
    for _ in range(20):
        v = back(times(v))
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (np.linalg.norm(back(times(v))) * 1.02 + 1e-12)
    x = z = np.zeros(n)
    t = 1.0
    for _ in range(iterations):
        new = np.maximum(0, z - step * back(times(z) - h))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def pack_histogram(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; all items of ``histogram`` (index: length, up to the capacity) find a place."""
    cap = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...], times: int) -> None:
        lengths, many = np.unique(pattern, return_counts=True)
        times = int(min(times, (left[lengths] // many).min()))
        if times > 0:
            left[lengths] -= times * many
            plan.append((pattern, times))

    combos = combinations(left)
    if combos:
        cols = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
        x = non_negative_least_squares(np.concatenate([np.array(c) for c in combos]), cols, left.astype(float), len(combos))
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.5:
                break
            use(combos[i], int(np.floor(x[i] + 1e-9)) or 1)
    present = [int(x) for x in np.nonzero(left)[0]]
    while present:
        pattern, room = [], cap
        spare = {x: int(left[x]) for x in present}
        i = len(present) - 1
        while i >= 0 and room > 0:
            i = int(np.searchsorted(present, room, side="right")) - 1 if present[i] > room else i
            if i < 0:
                break
            x = present[i]
            k = min(spare[x], room // x)
            if k > 0:
                pattern += [x] * k
                spare[x] -= k
                room -= k * x
            i -= 1
        use(tuple(pattern), 1 << 60)
        present = [x for x in present if left[x] > 0]
    return plan


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length, from which ordinal on items go to which first container, so many to each."""
    cursor: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    base = 1
    for pattern, times in plan:
        for x, many in zip(*np.unique(pattern, return_counts=True)):
            at = cursor.get(int(x), 0)
            out.setdefault(int(x), []).append((at, base, int(many)))
            cursor[int(x)] = at + times * int(many)
        base += times
    return {x: tuple(np.array(c) for c in zip(*v)) for x, v in out.items()}


def token_sizes(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of each distinct doc_id, exactly counted over whole texts; 0 for null and empty ones."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": count_tokens(b["text"].tolist(), folder, vocabulary)})

    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    return d.mapInPandas(count, "doc_id bigint, tokens bigint").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """Containers for ``sizes`` (doc_id, tokens): doc_id, piece, first_token, tokens, container_id.

    Only an item above the capacity is split: into full pieces and a rest. Items without tokens take no room and go to
    container 0. No container holds more than the capacity; containers count from 1; an empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("a container needs room for a token")
    items = sizes.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("tokens") / capacity) - 1).cast("int"))).alias("piece"))
    items = items.select("doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("first_token"), F.least(F.col("tokens") - F.col("piece").cast("bigint") * capacity, F.lit(capacity)).cast("int").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("n").count().collect():  # capacity + 1 rows at most
        histogram[r.n] = r["count"]
    slots = _slots(pack_histogram(histogram))
    buckets = max(1, int(-(-histogram.max() // BUCKET_ROWS)))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = items.groupBy("n", "bucket").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("n", "bucket").orderBy("doc_id", "piece")
    numbered = items.withColumn("k", F.row_number().over(within) - 1).join(offsets, ["n", "bucket"]).withColumn("ordinal", F.col("k") + F.col("offset"))
    held = sizes.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.zeros(len(b), np.int64)
            n, ordinal = b["n"].to_numpy(), b["ordinal"].to_numpy()
            for x in np.unique(n):
                if x > 0:
                    m = n == x
                    begin, base, many = held.value[int(x)]
                    i = np.searchsorted(begin, ordinal[m], side="right") - 1
                    at[m] = base[i] + (ordinal[m] - begin[i]) // many[i]
            yield pd.DataFrame({"doc_id": b["doc_id"], "piece": b["piece"], "first_token": b["first_token"], "tokens": b["n"], "container_id": at})

    return numbered.select("doc_id", "piece", "first_token", "n", "ordinal").mapInPandas(place, "doc_id bigint, piece int, first_token bigint, tokens int, container_id bigint")


def fill_report(packed: DataFrame) -> DataFrame:
    """Per limit_name and capacity: containers, tokens, the least number of containers there could be, and the filled share."""
    g = packed.where("tokens > 0").groupBy("limit_name", "capacity").agg(F.max("container_id").alias("n_containers"), F.sum("tokens").alias("tokens"))
    return g.withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("filled", F.round(F.col("tokens") / (F.col("n_containers") * F.col("capacity")), 6))

"""All pairs of records whose sets of word runs are at least ``threshold`` alike (Jaccard), by pigeonring filtering.

Two sets of a and b runs are alike iff their Hamming distance is within the budget ``(1-t)/(1+t) * (a+b)``. Each set is a
ring of ``SEGMENTS`` segments, one for each part of the hash space, and each segment of a pair has a share of the budget in
proportion to its own size. If all segments' differences stay within the budget in sum, there is a segment from which on every
chain of 1, 2, .. all segments stays within its shares (pigeonring principle; an empty segment is never needed as the first).

1. The first segment of such a chain is within its own share, so that its two parts have as many runs in common as prefix
   filtering needs: an inverted index over each segment's rarest runs finds all pairs with such a segment.
2. In the join, chains of 1 to ``CHAIN`` segments are tested with parity maps, whose differences never exceed the true ones.
3. Pairs that are left go round the ring from the segments where they met, with exact differences, and end as soon as no
   start is left. A chain that closes the ring is the full Hamming check.

No pair above the threshold is lost, and exact copies are one set from the start.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assize.llm.answers import words
from assize.plans.lineage import settle

#: Segments of the ring (a power of two: the upper bits of a run tell its segment), and how many of them a posting carries maps of.
SEGMENTS, CHAIN = 8, 2
#: Cells of the count sketch that orders runs by rarity, 1 MB on the driver. It tells runs apart whose counts differ by more
#: than about (runs of all sets) / CELLS; any order finds the same pairs.
CELLS = 1 << 20
#: Bits of the map of runs seen more than once, 8 MB: a run known to be in one set only can't be shared. It thins the index
#: while there are fewer than about 2 * SEEN different runs, and lets all pass beyond.
SEEN = 1 << 26
#: Postings of a run from which on they are compared in blocks, and blocks on a side at most.
HOT_POSTINGS, MOST_BLOCKS = 4096, 64

#: A list of set ids (8 bytes each) is broadcast up to so many, and joined by exchange beyond.
BROADCAST_ROWS = 1_000_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_CACHE_WORDS = 1 << 20


class _Hashes(dict):
    """Hash of each word; frequent ones are kept."""

    def __missing__(self, w: str) -> int:
        b = w.encode("utf-8", "surrogatepass")
        h = (zlib.crc32(b) << 32) | (zlib.crc32(b, 0x9747B28C) ^ zlib.adler32(b))
        if len(self) < _CACHE_WORDS:
            self[w] = h
        return h


def run_hashes(text: str | None, n: int, cache: _Hashes) -> np.ndarray:
    """The distinct hashes of a text's runs of n words; empty where it has fewer words."""
    ws = words(text or "")
    if len(ws) < n:
        return np.empty(0, np.uint64)
    h = np.array([cache[w] for w in ws], np.uint64)
    x = np.zeros(len(ws) - n + 1, np.uint64)
    for k in range(n):
        x = (x ^ h[k : len(h) - n + 1 + k]) * _M1
        x ^= x >> np.uint64(29)
        x *= _M2
        x ^= x >> np.uint64(32)
    return np.unique(x)


def record_sets(records: DataFrame, id: str, text: str, n: int = 3) -> DataFrame:
    """(id, set_id, runs) of each distinct id with at least one run; copies share a set_id."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Hashes()
        for b in batches:
            ids, sets, runs = [], [], []
            for i, t in zip(b["id"], b["text"]):
                r = run_hashes(t, n, cache)
                if len(r):
                    ids.append(i)
                    runs.append(r.view(np.int64))
                    k = np.arange(1, len(r) + 1, dtype=np.uint64)
                    sets.append(int(((r ^ (r >> np.uint64(31))) * (_M3 + k * np.uint64(2))).sum(dtype=np.uint64).view(np.int64)))
            yield pd.DataFrame({"id": np.array(ids, np.int64), "set_id": np.array(sets, np.int64), "runs": pd.Series(runs, dtype=object)})

    r = records.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    return r.mapInPandas(make, "id bigint, set_id bigint, runs array<bigint>")


def _sketch(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all sets: the log of each cell's count in a byte, and the map of runs seen more than once.

    Tasks' counts are folded one by one: a merging task holds one sketch, whatever the number of tasks.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(CELLS, np.int64)
        once, more = np.zeros(SEEN // 8, np.uint8), np.zeros(SEEN // 8, np.uint8)
        some = False
        for b in batches:
            if not len(b):
                continue
            some = True
            r = np.concatenate(b["runs"].to_numpy()).view(np.uint64)
            cells += np.bincount((r >> np.uint64(40)).astype(np.int64) & (CELLS - 1), minlength=CELLS)
            at, seen = np.unique(r & np.uint64(SEEN - 1), return_counts=True)
            byte, bit = (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            again = (seen > 1) | ((once[byte] & bit) > 0)
            np.bitwise_or.at(more, byte[again], bit[again])
            np.bitwise_or.at(once, byte, bit)
        for k in range(64 if some else 0):
            part = lambda a, k=k: zlib.compress(a[k * (len(a) // 64) : (k + 1) * (len(a) // 64)].tobytes(), 1)
            yield pd.DataFrame({"k": [k], "cells": [part(cells.astype(np.int32))], "once": [part(once)], "more": [part(more)]})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = lambda x, t: np.frombuffer(zlib.decompress(x), t)
        held: dict[int, tuple] = {}
        for b in batches:
            for k, c, o, m in zip(b["k"], b["cells"], b["once"], b["more"]):
                cells, once, more = held.get(k, (0, np.uint8(0), np.uint8(0)))
                o = load(o, np.uint8)
                held[k] = (cells + load(c, np.int32).astype(np.int64), once | o, more | load(m, np.uint8) | (once & o))
        for k, (cells, _, more) in held.items():
            yield pd.DataFrame({"k": [k], "cells": [zlib.compress(np.minimum(255, np.log1p(cells) * 8).astype(np.uint8).tobytes(), 1)], "more": [zlib.compress(more.tobytes(), 1)]})

    parts = sets.select("runs").mapInPandas(count, "k int, cells binary, once binary, more binary")
    got = parts.repartition(max(1, min(64, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "k").mapInPandas(fold, "k int, cells binary, more binary")
    rows = sorted((r.k, r.cells, r.more) for r in got.collect())  # 64 rows of fixed size
    if not rows:
        return np.zeros(CELLS, np.uint8), np.zeros(SEEN // 8, np.uint8)
    join = lambda i: np.frombuffer(b"".join(zlib.decompress(r[i]) for r in rows), np.uint8)
    return join(1), join(2)


def _blocks(rank: np.ndarray) -> np.ndarray:
    """Of each cell, the blocks that a run in it is compared in: more than one where its count stands out from the usual load."""
    n = np.expm1(rank.astype(float) / 8)
    return np.clip(np.ceil((n - 2 * np.median(n)) / HOT_POSTINGS), 1, MOST_BLOCKS).astype(np.int64)


def segment_of(runs: np.ndarray) -> np.ndarray:
    """The segment of each run; runs in rising order are in the order of their segments."""
    return (runs >> np.uint64(65 - SEGMENTS.bit_length())).astype(np.int64)


_CHAIN_FIELDS = [(f"n{j}", "smallint") for j in range(CHAIN)] + [(f"c{j}", "bigint") for j in range(CHAIN)]


def _postings(sets: DataFrame, threshold: float) -> DataFrame:
    """(key, part, seg, at, set_id, size, n0.., c0..): the rarest runs of each segment (seg: its bit), with their place in its order.

    n and c are the sizes and parity maps of the segment and those after it. ``key`` is the run; a hot run's postings are
    in parts, and each goes to the key of every pair of parts that its own is in (``part`` is above MOST_BLOCKS if the other is
    another part).
    """
    rank, more = _sketch(sets)
    held = sets.sparkSession.sparkContext.broadcast((rank, more, _blocks(rank)))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank, more, blocks = held.value
        done: set[int] = set()  # copies within the task; those of other tasks go after the exchange
        for b in batches:
            b = b[~b["set_id"].isin(done)].drop_duplicates("set_id")
            if not len(b):
                continue
            done.update(b["set_id"].tolist())
            sid = b["set_id"].to_numpy()
            a = b["runs"].map(len).to_numpy()
            r = np.concatenate(b["runs"].to_numpy()).view(np.uint64)
            doc = np.repeat(np.arange(len(a)), a)
            part = doc * SEGMENTS + segment_of(r)
            cell = (r >> np.uint64(40)).astype(np.int64) & (CELLS - 1)
            order = np.lexsort((r, rank[cell], part))
            size = np.bincount(part, minlength=len(a) * SEGMENTS)
            begin = np.cumsum(size) - size
            full = np.nonzero(size)[0]
            maps = np.zeros(len(size), np.uint64)
            maps[full] = np.bitwise_xor.reduceat(np.uint64(1) << (r[order] & np.uint64(63)), begin[full])
            at = np.arange(len(r)) - begin[part[order]]
            # the partner's part has at least t*n runs and shares at least t/(1+t)*(n+m) of them
            first = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
            use = at < first[part[order]]
            order, at = order[use], at[use]
            low = r[order] & np.uint64(SEEN - 1)
            shared = (more[(low >> np.uint64(3)).astype(np.int64)] & (np.uint8(1) << (low & np.uint64(7)).astype(np.uint8))) > 0
            order, at = order[shared], at[shared]
            times = blocks[cell[order]]
            own = (sid[doc[order]].view(np.uint64) * _M2 >> np.uint64(33)).astype(np.int64) % times
            order, at, own = np.repeat(order, times), np.repeat(at, times), np.repeat(own, times)
            other = np.arange(len(order)) - np.repeat(np.cumsum(times) - times, times)
            key = r[order] ^ (np.where(np.repeat(times, times) > 1, np.minimum(own, other) * MOST_BLOCKS + np.maximum(own, other) + 1, 0).astype(np.uint64) * _M3)
            d, seg = doc[order], part[order] % SEGMENTS
            out = {"key": key.view(np.int64), "part": (own + (own != other) * MOST_BLOCKS).astype(np.int16), "seg": (1 << seg).astype(np.int16), "at": at.astype(np.int32), "set_id": sid[d], "size": a[d].astype(np.int32)}
            for j in range(CHAIN):
                p = d * SEGMENTS + (seg + j) % SEGMENTS
                out[f"n{j}"], out[f"c{j}"] = np.minimum(size[p], 32767).astype(np.int16), maps[p].view(np.int64)
            yield pd.DataFrame(out)[["key", "part", "seg", "at", "set_id", "size", *(f for f, _ in _CHAIN_FIELDS)]]

    return sets.select("set_id", "runs").mapInPandas(post, "key bigint, part smallint, seg smallint, at int, set_id bigint, size int, " + ", ".join(f"{f} {t}" for f, t in _CHAIN_FIELDS))


def _meeting(sets: DataFrame, threshold: float) -> tuple[DataFrame, list]:
    """Pairs of postings of one run in places that allow for enough common runs, and the tests of chains of 1 .. CHAIN segments."""
    # copies of a set from several tasks meet where their runs meet, after the one exchange that the join needs anyway
    p = _postings(sets, threshold).repartition("key").dropDuplicates(["key", "set_id"])
    x, y = p.alias("x"), p.alias("y")
    a, b = F.col("x.size"), F.col("y.size")
    share = F.lit((1 - threshold) / (1 + threshold))
    first = (a < b) | ((a == b) & (F.col("x.set_id") < F.col("y.set_id")))
    # tests name the same columns of both sides, so that one exchange serves both
    once = ((F.col("x.part") != F.col("y.part")) | (F.col("x.part") < MOST_BLOCKS)) & (F.col("x.seg").bitwiseAND(F.col("y.seg")) != 0)
    # the smallest size that is stored stands for all larger ones: these are left to the exact differences
    n = [F.when((F.col(f"x.n{j}") < 32767) & (F.col(f"y.n{j}") < 32767), F.col(f"x.n{j}").cast("int") + F.col(f"y.n{j}").cast("int")).otherwise(F.lit(1 << 30)) for j in range(CHAIN)]
    need = F.lit(threshold / (1 + threshold)) * n[0] - F.lit(1e-9)
    # runs before the shared one aren't shared where it is the segment's first: what is left must do
    places = (n[0] == 1 << 30) | ((F.col("x.n0") - F.col("x.at") >= need) & (F.col("y.n0") - F.col("y.at") >= need))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & first & once & (b * F.lit(threshold) <= a + F.lit(1e-9)) & places)
    tests, differs, budget = [], F.lit(0), F.lit(0.0)
    for j in range(CHAIN):
        differs = differs + F.bit_count(F.col(f"x.c{j}").bitwiseXOR(F.col(f"y.c{j}")))
        budget = budget + n[j] * share
        tests.append(differs <= budget + F.lit(1e-9))
    return met, tests


def ring_walk(a: list[np.ndarray], b: list[np.ndarray], starts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Round the ring with exact differences: per pair its Hamming distance, or -1 if no start is left, and the segments compared.

    ``a`` and ``b`` are rising runs, ``starts`` has a bit for each segment where a chain may begin. A chain that breaks at its
    l-th segment rules out the starts within it. All open pairs of a batch take their next segment at once.
    """
    share = (1 - threshold) / (1 + threshold)
    edge = np.arange(SEGMENTS + 1)

    def flat(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in xs], np.int64)
        v = np.concatenate(xs).view(np.uint64) if n.sum() else np.empty(0, np.uint64)
        size = np.bincount(np.repeat(np.arange(len(xs)), n) * SEGMENTS + segment_of(v), minlength=len(xs) * SEGMENTS)
        return v, np.concatenate([[0], np.cumsum(size)])

    (va, oa), (vb, ob) = flat(a), flat(b)
    bits = (starts[:, None] >> edge[None, :-1]) & 1
    following = np.full((len(starts), 2 * SEGMENTS + 1), -1, np.int64)  # the next start from a place on
    for k in range(SEGMENTS - 1, -1, -1):
        following[:, k] = np.where(bits[:, k] > 0, k, following[:, k + 1])
    start = following[:, 0].copy()
    length, differs, budget, steps = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.zeros(len(start)), np.zeros(len(start), np.int64)
    out = np.full(len(start), -1, np.int64)
    open_ = np.nonzero(start >= 0)[0]
    while len(open_):
        at = open_ * SEGMENTS + (start[open_] + length[open_]) % SEGMENTS
        la, lb = oa[at + 1] - oa[at], ob[at + 1] - ob[at]
        pick = lambda v, o, n: v[np.repeat(o[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        row = np.concatenate([np.repeat(np.arange(len(at)), la), np.repeat(np.arange(len(at)), lb)])
        value = np.concatenate([pick(va, oa, la), pick(vb, ob, lb)])
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        twice = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
        common = np.bincount(row[1:][twice], minlength=len(at))
        differs[open_] += la + lb - 2 * common
        budget[open_] += (la + lb) * share
        length[open_] += 1
        steps[open_] += 1
        broken = differs[open_] > budget[open_] + 1e-9
        out[open_[~broken & (length[open_] == SEGMENTS)]] = differs[open_[~broken & (length[open_] == SEGMENTS)]]
        fail = open_[broken]
        start[fail] = following[fail, np.minimum(start[fail] + length[fail], SEGMENTS)]
        length[fail], differs[fail], budget[fail] = 0, 0, 0.0
        open_ = open_[(start[open_] >= 0) & (length[open_] < SEGMENTS)]
    return out, steps


def _checked(sets: DataFrame, met: DataFrame, tests: list, threshold: float) -> DataFrame:
    """(a, b, differs, steps, size) of the pairs that pass the tests in the join: their exact distance, or -1."""
    for t in tests:
        met = met.where(t)
    pairs = met.select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b"), F.col("x.seg").cast("int").alias("s"))
    pairs = settle(pairs.groupBy("a", "b").agg(F.bit_or("s").alias("starts")), "candidates")
    named = settle(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "named")
    if named.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    held = settle(sets.join(named, "set_id", "left_semi").dropDuplicates(["set_id"]), "held")
    both = pairs.join(held.select(F.col("set_id").alias("a"), F.col("runs").alias("ra")), "a").join(held.select(F.col("set_id").alias("b"), F.col("runs").alias("rb")), "b")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ra, rb = b["ra"].tolist(), b["rb"].tolist()
            differs, steps = ring_walk(ra, rb, b["starts"].to_numpy(), threshold)
            size = np.array([len(x) + len(y) for x, y in zip(ra, rb)], np.int64)
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "differs": differs, "steps": steps, "size": size})

    return both.select("a", "b", "starts", "ra", "rb").mapInPandas(walk, "a bigint, b bigint, differs bigint, steps bigint, size bigint")


def similar_sets(sets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b, common, similarity) of all pairs of different sets (set_id, runs) that are at least ``threshold`` alike."""
    got = _checked(sets, *_meeting(sets, threshold), threshold).where("differs >= 0")
    common, either = (F.col("size") - F.col("differs")) / 2, (F.col("size") + F.col("differs")) / 2
    return got.select("a", "b", common.cast("bigint").alias("common"), (common / either).alias("similarity"))


def chain_report(sets: DataFrame, threshold: float = 0.5) -> dict[str, int]:
    """How many pairs each step ends: met on a run, ended by chains of 1 .. CHAIN maps, by exact chains, by the closed ring, and kept."""
    met, tests = _meeting(sets, threshold)
    passed = [F.lit(True)]
    for t in tests:
        passed.append(passed[-1] & t)
    n = met.agg(*[F.count_if(p).alias(f"p{j}") for j, p in enumerate(passed)]).first()
    out = {"met on a run": n[0], **{f"ended by a chain of {j} maps": n[j - 1] - n[j] for j in range(1, CHAIN + 1)}}
    walked = _checked(sets, met, tests, threshold)
    early = (F.col("differs") < 0) & (F.col("steps") < SEGMENTS)
    got = walked.agg(F.count(F.lit(1)), F.count_if(early), F.count_if((F.col("differs") < 0) & ~early), F.count_if(F.col("differs") >= 0), F.sum("steps")).first()
    return out | dict(zip(("different pairs left", "ended by an exact chain before the ring was closed", "ended later", "kept", "segments compared"), got))


def near_duplicates(records: DataFrame, id: str = "id", text: str = "text", threshold: float = 0.5, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """Members (id, set_id) and links between sets (a, b, common, similarity) of at least ``threshold``.

    A record with fewer than n words has no runs and is in no set; null ids and texts likewise. Ids delivered again count
    once where their text is the same; an empty table gives empty results; further columns are ignored.
    """
    made = settle(record_sets(records, id, text, n), "sets")
    return made.select("id", "set_id").distinct(), similar_sets(made.select("set_id", "runs"), threshold)


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b, similarity) of all pairs of records, copies among them, id_a < id_b.

    A set of very many copies is paired in blocks of its members, so that no task makes all pairs of a hot set.
    """
    m = members
    across = links.join(m.select(F.col("set_id").alias("a"), F.col("id").alias("i")), "a").join(m.select(F.col("set_id").alias("b"), F.col("id").alias("j")), "b").select("i", "j", "similarity")
    blocks = F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("n") / HOT_POSTINGS)).cast("int")
    several = settle(m.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("set_id", blocks.alias("blocks")), "several")
    c = m.join(several, "set_id").withColumn("p", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    c = c.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("set_id", "id", "p", F.least("p", "q").alias("k"), F.greatest("p", "q").alias("l"))
    side = lambda n: c.select("set_id", "k", "l", F.col("p").alias(f"p{n}"), F.col("id").alias(n))
    copies = side("i").join(side("j"), ["set_id", "k", "l"]).where("i < j and (pi <> pj or k = l)").select("i", "j", F.lit(1.0).alias("similarity"))
    both = across.unionByName(copies).where("i <> j")
    return both.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"), "similarity").dropDuplicates(["id_a", "id_b"])


def group_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per record (id, group_id, n_links): its connected group, named by the group's least id, and its set's links.

    Large-star/small-star contraction on the links between sets; each round is a table in the shared folder.
    """
    least = members.groupBy("set_id").agg(F.min("id").alias("name"))
    named = links.join(least.select(F.col("set_id").alias("a"), F.col("name").alias("u")), "a").join(least.select(F.col("set_id").alias("b"), F.col("name").alias("v")), "b").select("u", "v")
    edges = settle(named, "edges")
    degree = edges.select(F.explode(F.array("u", "v")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_links"))
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table of its own: only a join right after its exchanges can be split at run time where a hub has very many links
        lows = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lows")
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        down = settle(down, "down")
        low = settle(down.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = settle(small.distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    root = edges.groupBy("u").agg(F.min("v").alias("root"))
    r = least.join(root, least["name"] == root["u"], "left").join(degree, "name", "left")
    r = r.select("set_id", F.coalesce("root", "name").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    return members.join(r, "set_id").select("id", "group_id", "n_links").dropDuplicates(["id"])

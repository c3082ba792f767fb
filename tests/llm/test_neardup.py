import itertools
import random

import pytest

pytest.importorskip("assize.llm")
from assize.llm.answers import words  # noqa: E402
from assize.llm import neardup  # noqa: E402
from assize.llm.neardup import chain_report, expand_pairs, group_of, near_duplicates, record_sets, ring_walk  # noqa: E402


def edited(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        i = rng.randrange(len(ws))
        op = rng.randrange(3)
        if op == 0:
            ws[i] = f"x{rng.randrange(10**6)}"
        elif op == 1:
            ws.insert(i, f"y{rng.randrange(10**6)}")
        elif len(ws) > 12:
            j = rng.randrange(len(ws))
            ws[i:i], ws[j : j + 3] = ws[j : j + 3], []
    return ws


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(150)]
    out = []
    for _ in range(n):
        base = rng.choice(out)[0] if out and rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randrange(5, 70))]
        out.append((edited(rng, base, rng.randrange(6)) if len(base) > 3 else base, ""))
    return [" ".join(w) for w, _ in out]


def brute(texts, t):
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, x in texts if x is not None and (w := words(x)) is not None}
    return {(a, b) for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2) if x and y and len(x & y) >= t * len(x | y) - 1e-9}


@pytest.mark.parametrize(("seed", "t"), [(1, 0.5), (2, 0.5), (3, 0.8), (4, 0.35)])
def test_pairs_against_brute_force(spark, seed, t):
    texts = list(enumerate(corpus(seed)))
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in texts], "id bigint, text string, set_id string, size int")
    got = {(r.id_a, r.id_b) for r in expand_pairs(*near_duplicates(df, threshold=t)).collect()}
    assert got == brute(texts, t)


def test_edges(spark):
    long = " ".join(f"l{i}" for i in range(30_000))
    data = [(1, None), (2, ""), (3, "one two"), (4, "one two"), (5, "a b c d"), (5, "a b c d"), (6, "A, b. C - d!"), (None, "a b c d"), (7, long), (8, long + " end")]
    df = spark.createDataFrame(data, "id bigint, text string")
    pairs = {(r.id_a, r.id_b) for r in expand_pairs(*near_duplicates(df)).collect()}
    assert pairs == {(5, 6), (7, 8)}
    members, links = near_duplicates(df)
    groups = {r.id: r.group_id for r in group_of(members, links).collect()}
    assert groups == {5: 5, 6: 5, 7: 7, 8: 7}
    assert expand_pairs(*near_duplicates(df.limit(0))).count() == 0
    assert group_of(*near_duplicates(df.limit(0))).count() == 0


def test_hot_copies_are_one_set(spark):
    df = spark.createDataFrame([(i, "the same words in every copy of it" if i % 3 else f"unique {i} words {i} here {i}") for i in range(150)], "id bigint, text string")
    members, links = near_duplicates(df)
    assert links.count() == 0
    assert members.groupBy("set_id").count().where("count > 1").count() == 1
    assert expand_pairs(members, links).count() == 100 * 99 // 2


def test_groups_are_connected_components(spark):
    texts = list(enumerate(corpus(9, 150)))
    members, links = near_duplicates(spark.createDataFrame(texts, "id bigint, text string"))
    got = {r.id: r.group_id for r in group_of(members, links).collect()}
    parent = {i: i for i in got}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute(texts, 0.5):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {i: root(i) for i in got}


def test_hot_runs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_POSTINGS", 5)
    rng = random.Random(4)
    texts = list(enumerate([" ".join(["always", "the", "same", "three", "words", *(rng.choice("abc") for _ in range(rng.randrange(3)))]) for _ in range(60)] + corpus(6, 60)))
    df = spark.createDataFrame(texts, "id bigint, text string")
    got = expand_pairs(*near_duplicates(df))
    rows = [(r.id_a, r.id_b) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(texts, 0.5)


def test_counts_of_very_many_small_tasks(spark):
    df = spark.createDataFrame(list(enumerate(corpus(2, 400))), "id bigint, text string")
    sets = record_sets(df, "id", "text").select("runs")
    one, many = neardup._sketch(sets.coalesce(1)), neardup._sketch(sets.repartition(300))
    assert (one[0] == many[0]).all() and (one[1] == many[1]).all()


def test_ring_walk_gives_the_exact_distance_or_ends(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = [], []
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**64, rng.integers(1, 60), dtype=np.uint64))
        keep = x[rng.random(len(x)) < rng.choice([0.5, 0.8, 1.0])]
        a.append(x.view(np.int64))
        b.append(np.unique(np.concatenate([keep, rng.integers(0, 2**64, rng.integers(0, 20), dtype=np.uint64)])).view(np.int64))
    differs, steps = ring_walk(a, b, np.full(len(a), (1 << neardup.SEGMENTS) - 1), 0.5)
    for x, y, d, s in zip(a, b, differs, steps):
        true = len(set(x) ^ set(y))
        assert d == (true if 3 * true <= len(x) + len(y) else -1) and 0 < s <= 2 * neardup.SEGMENTS


def test_chains_end_pairs_before_the_ring_is_closed(spark):
    df = spark.createDataFrame(list(enumerate(corpus(11, 300))), "id bigint, text string")
    n = chain_report(record_sets(df, "id", "text").select("set_id", "runs"))
    assert n["ended by a chain of 1 maps"] > 0 and n["ended by a chain of 2 maps"] > 0
    assert n["different pairs left"] == n["kept"] + n["ended by an exact chain before the ring was closed"] + n["ended later"]

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("assize.llm")
from assize.llm import subset as S  # noqa: E402
from assize.llm import tokens as T  # noqa: E402
from assize.llm.packing import non_negative_least_squares, pack, pack_histogram, token_sizes  # noqa: E402


@given(st.integers(1, 60), st.lists(st.integers(0, 60), max_size=80))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_item_within_capacity(capacity, sizes):
    h = np.zeros(capacity + 1, np.int64)
    for s in sizes:
        if s <= capacity:
            h[s] += 1
    placed = np.zeros(capacity + 1, np.int64)
    for pattern, times in pack_histogram(h):
        assert sum(pattern) <= capacity and times > 0
        for x in pattern:
            placed[x] += times
    h[0] = 0
    assert (placed == h).all()


def test_plan_is_tight():
    rng = np.random.default_rng(1)
    sizes = np.clip(rng.lognormal(5.3, 0.8, 20_000).astype(int), 1, 1024)
    n = sum(t for _, t in pack_histogram(np.bincount(sizes, minlength=1025)))
    assert n <= -(-sizes.sum() // 1024) * 1.01


def test_non_negative_least_squares():
    # x0 + x1 = 5, x1 + x2 = 3, x2 = 1 -> 3, 2, 1
    x = non_negative_least_squares(np.array([0, 0, 1, 1, 2]), np.array([0, 1, 1, 2, 2]), np.array([5.0, 3.0, 1.0]), 3, 3000)
    assert np.allclose(x, [3, 2, 1], atol=1e-2)


def test_containers(spark):
    df = spark.createDataFrame([(1, 0), (2, 3), (3, 7), (4, 25), (5, 10), (6, 3), (7, 20)], "doc_id bigint, tokens bigint")
    got = pack(df, 10).toPandas()
    assert got.groupby("container_id").tokens.sum().drop(0).max() <= 10
    assert got.groupby("doc_id").tokens.sum().to_dict() == {1: 0, 2: 3, 3: 7, 4: 25, 5: 10, 6: 3, 7: 20}
    assert set(got.groupby("doc_id").size()[lambda s: s > 1].index) == {4, 7}
    four = got[got.doc_id == 4].sort_values("piece")
    assert four.tokens.tolist() == [10, 10, 5] and four.first_token.tolist() == [0, 10, 20]
    assert got.container_id.max() == 7 and (got[got.doc_id == 1].container_id == 0).all()
    assert pack(df.limit(0), 10).count() == 0


def test_sizes_count_each_document_once(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "hello world <|endoftext|>", 1), (3, "hello world <|endoftext|>", 1), (None, "x", 1), (4, "word " * 20_000, 1)], "doc_id bigint, text string, tokens int")
    got = {r.doc_id: r.tokens for r in token_sizes(df).collect()}
    assert got == {1: 0, 2: 0, 3: int(T.count_tokens(["hello world <|endoftext|>"])[0]), 4: int(T.count_tokens(["word " * 20_000])[0])}


def test_token_features():
    x = dict(zip(T.FEATURES, T.text_features([None, "", "Ab 12, déjà\nЖ"])[2]))
    assert x["bytes"] == 16 and x["digits"] == 2 and x["upper"] == 1 and x["latin1_letters"] == 2 and x["cyrillic"] == 1
    assert x["words"] == 3 and x["numbers"] == 1 and x["capital_words"] == 1 and x["breaks"] == 1 and x["one"] == 1
    assert (T.text_features([None, ""]) == 0).all()


def test_estimates(spark, tiny):
    t = spark.read.parquet(f"{tiny}/traces.parquet").selectExpr("id", "lower(lang) lang", "r1_raw_sft text", "1 tokens")
    models = T.token_models(t)
    got = {r.id: r.tokens for r in T.estimate_tokens(t.unionByName(t), models).collect()}
    rows = t.dropDuplicates(["id"]).collect()
    true = dict(zip([r.id for r in rows], T.count_tokens([r.text for r in rows])))
    assert set(got) == set(true)
    assert abs(sum(got.values()) / sum(true.values()) - 1) < 0.05
    assert T.estimate_tokens(t.limit(0), models).count() == 0 and T.token_models(t.limit(0)) == {}
    none = spark.createDataFrame([(1, None, None), (2, None, ""), (3, "xx", "some text")], "id bigint, lang string, text string")
    got = {r.id: r.tokens for r in T.estimate_tokens(none, models).collect()}
    assert got[1] == got[2] == 0 and got[3] > 0


@given(st.lists(st.lists(st.integers(0, 40), min_size=3, max_size=3), min_size=1, max_size=8), st.integers(0, 200))
@settings(max_examples=80, deadline=None)
def test_slots(cells, n):
    cells = np.array(cells)
    take = S.allocate(cells, n, np.arange(len(cells)))
    assert take.sum() == min(n, cells.sum()) and (take <= cells).all() and (take >= 0).all()


def test_quotas_redistribute():
    assert np.allclose(S.quotas(np.array([1, 100, 100]), 21, 0.0), [1, 10, 10])
    assert np.allclose(S.quotas(np.array([4, 16]), 3, 0.5), [1, 2])
    assert S.quotas(np.array([2, 3]), 10, 0.5).sum() == 5


def test_subset_covers_rare_groups(spark):
    hot = [(i, "big", f"the same long story about ships and harbours number {i % 7}") for i in range(600)]
    rare = [(1000 + i, "small", f"Völlig anderes Thema über Gärten und Bäume {i}") for i in range(12)]
    other = [(2000 + i, None, f"una receta de pan con harina y agua {i}") for i in range(30)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in hot + rare + other + hot[:50]], "id bigint, source string, text string, v string, cluster int")
    got = S.varied_subsets(df, [("a", 12), ("b", 700), ("c", 0)], k=6).toPandas()
    a = got[got.limit_name == "a"]
    assert len(a) == 12 == a.id.nunique() and set(a.source.fillna("-")) == {"big", "small", "-"}
    assert (a.source == "big").sum() <= 9
    assert len(got[got.limit_name == "b"]) == 642 and "c" not in set(got.limit_name)
    assert S.varied_subsets(df.limit(0), [("a", 5)]).count() == 0


def test_subset_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "s", ""), (3, "s", "word " * 50_000), (None, "s", "x"), (4, "s", "same"), (5, "s", "same")], "id bigint, source string, text string")
    got = S.varied_subsets(df, [("a", 3), ("z", 99)], k=3).toPandas()
    assert got[got.limit_name == "a"].id.nunique() == 3
    assert sorted(got[got.limit_name == "z"].id) == [1, 2, 3, 4, 5]


def test_subset_is_the_same_however_rows_are_partitioned(spark):
    rows = [(i, f"s{i % 3}", f"text {i % 17} about thing {i % 5} and {i % 7}" if i % 3 else "") for i in range(600)]  # a third are empty
    df = spark.createDataFrame(rows, "id bigint, source string, text string")
    a, b = (S.varied_subsets(x, [("a", 40)], k=8).toPandas().sort_values("id") for x in (df.coalesce(1), df.repartition(13)))
    assert a["id"].tolist() == b["id"].tolist() and len(a) == 40
    assert (a["id"] % 3 == 0).sum() < 40 / 3
    r = S.coverage_report(df, S.varied_subsets(df, [("a", 40)], k=8), k=8).first()
    assert r.n == 40 and r.clusters_hit >= r.random_clusters_hit - 0.01 and r.largest_cluster < r.random_largest_cluster


def test_more_sources_than_slots(spark):
    df = spark.createDataFrame([(i, f"s{i % 700}", f"text {i} words {i * 7 % 31}") for i in range(1400)], "id bigint, source string, text string")
    got = S.varied_subsets(df, [("a", 700)], k=4).toPandas()
    assert len(got) == 700 and got["source"].nunique() > 500

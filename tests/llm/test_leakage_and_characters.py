import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("assize.llm")
from assize.llm.charmaps import lookalikes, undo  # noqa: E402
from assize.llm.codepoints import deviations, normalised  # noqa: E402
from assize.llm.leakage import WuManber, leak_report, leaked_passages, normal_words  # noqa: E402


def brute(doc, items, m):
    d = normal_words(doc)
    grams = {tuple(d[i : i + m]) for i in range(len(d) - m + 1)}
    return {k for k, t in items if any(tuple(normal_words(t)[i : i + m]) in grams for i in range(len(normal_words(t)) - m + 1))}


@given(st.integers(0, 10**6), st.integers(2, 6))
@settings(max_examples=60, deadline=None)
def test_search_against_brute_force(seed, m):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcde")
    items = [(k, " ".join(word() for _ in range(rng.randrange(0, 14)))) for k in range(5)]
    doc = " ".join(word() for _ in range(rng.randrange(0, 60)))
    assert WuManber(items, m).search(doc) == brute(doc, items, m)


def test_search_tables_stay_small():
    import pickle

    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(20_000)}" for _ in range(100_000))
    engine = WuManber([(1, text), (2, text[:5_000])])
    assert len(pickle.dumps(engine)) < 8 * len(text)
    assert engine.search(" ".join(text.split()[70_000:70_012])) == {1}
    assert engine.search(" ".join(text.split()[100:113])) == {1, 2}


def test_leaks_through_case_markup_and_deviations(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu."
    docs = [
        (1, "Say: ALPHA **beta** gamma,\n delta - epsilon <b>zeta</b> eta theta iota kappa (lambda) mu"),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"),
        (3, "alphа be​ta gａmma delta epsilon zeta eta theta iota kappa lambda mu"),
        (4, None), (5, ""), (1, "Say: ALPHA **beta** gamma,\n delta - epsilon <b>zeta</b> eta theta iota kappa (lambda) mu"),
        (6, "filler " * 50_000 + item),
    ]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(7, item, "b"), (8, "too short", "b"), (9, None, "b"), (10, item, "c")], "item_id bigint, text string, benchmark string")
    for chars in (8_000_000, 20):
        got = leaked_passages(d, i, block_chars=chars)
        assert {tuple(r) for r in got.collect()} == {(x, y) for x in (1, 3, 6) for y in (7, 10)}
    assert {(r.item_id, r.n_docs) for r in leak_report(got, i).collect()} == {(7, 3), (8, 0), (9, 0), (10, 3)}
    assert leaked_passages(d.limit(0), i).count() == 0 and leaked_passages(d, i.limit(0)).count() == 0


CASES = {
    1: ("Ｆｕｌｌ，width １２", "Full,width 12", {"fullwidth"}),
    2: ("café ậ й", "café ậ й", {"combining"}),
    3: ("ze​ro wi‍dth﻿", "zero width", {"zero_width"}),
    4: ("a b c d", "a b c d", {"nbsp"}),
    5: ("раgе whiсh νacuum пoмогает", "page which vacuum помогает", {"lookalike"}),
    6: ("α=2, Δt and β-test, x², ½, № 5 – “so” naïve №", "α=2, Δt and β-test, x², ½, № 5 – “so” naïve №", set()),
    7: ("Обычный русский текст без примеси, оса и нос.", "Обычный русский текст без примеси, оса и нос.", set()),
    8: ("verӓndert", "verändert", {"combining", "lookalike"}),
    9: (None, None, set()),
    10: ("", "", set()),
    11: ("plain ascii", "plain ascii", set()),
    12: ("the соре of it", "the cope of it", {"lookalike"}),
    13: ("́alone", unicodedata.normalize("NFC", "́alone"), {"combining"}),
}


def test_characters(spark):
    rows = [(i, t, "clash") for i, (t, _, _) in CASES.items()]
    d = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, runs string")
    found = {}
    for r in deviations(d).collect():
        found.setdefault(r.doc_id, set()).add(r.variant)
    assert found == {i: v for i, (_, _, v) in CASES.items() if v}
    got = {r.doc_id: r.text for r in normalised(d).collect()}
    assert got == {i: w for i, (_, w, _) in CASES.items()}
    for i, (t, w, _) in CASES.items():
        if t is not None:
            assert undo(t) == w and undo(undo(t)) == undo(t)
    assert deviations(d.limit(0)).count() == 0 and normalised(d.limit(0)).count() == 0


def test_operator_and_function_agree_on_random_text(spark):
    rng = random.Random(3)
    alphabet = "abcegopxyzACEKо" + "".join(c for c, _ in lookalikes())[:60] + "бвгджΔβ" + "̣́̈​‍   Ａｂ１， .-12é½"
    texts = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for i in range(400)]
    texts.append((400, "long сat " * 20_000))
    got = {r.doc_id: r.text for r in normalised(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    bad = [(t, got[i], undo(t)) for i, t in texts if got[i] != undo(t)]
    assert not bad, bad[:3]

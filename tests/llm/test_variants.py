import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.names import NameReader, agreement, levenshtein
from ledgerloom.llm import variants
from ledgerloom.llm.variants import distances, orders, pivot_keys, radius, reach_keys, resolve_names, swaps_allowed, variant_pairs, with_swaps, within_radius

TRADES = ["CONSULTING", "CONSTRUCTION", "MARINE", "LABORATORIES", "GROUP", "HOLDINGS", "SUSAN", "MARGARET", "ANNE"]


@pytest.mark.parametrize("typed,core,generics", [
    ("Belovar & Tumik Marine Group Pty Ltd", "BELOVARTUMIK", ("GROUP", "MARINE")),
    ("MARNIE GRP BELOVAR-TUMIK P/L (Head Office)", "BELOVARTUMIK", ("GROUP", "MARINE")),
    ("Belovar, Pty Ltd Labs Hldgs - Accounts", "BELOVAR", ("HOLDINGS", "LABORATORIES")),
    ("belovar cons. (pty) ltd [NSW]", "BELOVAR", ("CONSTRUCTION|CONSULTING",)),
    ("Ms Belovar, Sue", "BELOVAR", ("SUSAN",)),
    ("Marine Group", "GROUPMARINE", ()),
    ("---", "", ()),
])
def test_reading(typed, core, generics):
    x = NameReader(TRADES).parse(typed)
    assert (x.core, tuple("|".join(sorted(g.split("|"))) for g in x.generics)) == (core, generics)


def test_agreement():
    assert agreement(("MARINE",), ("GROUP", "MARINE")) == 1
    assert agreement(("MARINE",), ("CONSULTING",)) is None
    assert agreement(("CONSTRUCTION|CONSULTING",), ("CONSULTING",)) == 1
    assert agreement((), ("MARINE",)) == 0


words = st.text("ABC", min_size=1, max_size=14)


def in_reach(a, b):
    return levenshtein(a, b, 3) <= radius(len(a)) or with_swaps(a, b, 2) <= swaps_allowed(len(a))


@settings(max_examples=800, deadline=None)
@given(words, words)
def test_no_pair_in_reach_is_lost(a, b):
    if in_reach(a, b):
        assert set(reach_keys(a)) & set(pivot_keys(b))


@settings(max_examples=1500, deadline=None)
@given(st.text("ABCDEFGH", min_size=1, max_size=16), st.lists(st.tuples(st.sampled_from(["swap", "drop", "add", "change"]), st.integers(0, 99)), min_size=1, max_size=3))
def test_no_misspelling_is_lost(a, edits):
    b = a
    for what, k in edits:
        i = k % max(len(b), 1)
        b = {"swap": b[:i] + b[i + 1 : i + 2] + b[i : i + 1] + b[i + 2 :], "drop": b[:i] + b[i + 1 :], "add": b[:i] + "X" + b[i:], "change": b[:i] + "Y" + b[i + 1 :]}[what]
    if b and in_reach(a, b):
        assert set(reach_keys(a)) & set(pivot_keys(b))


def test_with_swaps():
    assert [with_swaps(*x, 3) for x in (("AB", "BA"), ("ABCD", "BADC"), ("ABC", "CA"), ("TOTSAOOT", "TOTASOSOT"), ("A", "A"), ("AAAA", "BBBBB"))] == [1, 2, 3, 2, 0, 4]


@settings(max_examples=300, deadline=None)
@given(st.text("ABCé𐐀", max_size=14), st.lists(st.text("ABCDé𐐀", max_size=20), max_size=8))
def test_distances_equal_the_textbook(pivot, cores):
    assert distances(pivot, cores).tolist() == [levenshtein(pivot, c, 99) for c in cores]


@pytest.mark.parametrize("cells", [1, 4, 9])
def test_radius_join_equals_brute_force(spark, cells):
    rng = random.Random(5)
    base = ["".join(rng.choice("ABCD") for _ in range(rng.randrange(1, 15))) for _ in range(150)] + ["A", "B", "AB", "ABC", "X" * 90, "A" * 500]
    more = [x[: len(x) // 2] + rng.choice("ABCD") + x[len(x) // 2 + 1 :] for x in base] + [x[:i] + x[i + 1 : i + 2] + x[i : i + 1] + x[i + 2 :] for x in base[:100] for i in (1, 4)] + ["AB", "C", "X" * 88, "A" * 498]
    df = lambda xs: spark.createDataFrame([(x,) for x in sorted(set(xs))], "core string")
    got = {(r.core, r.pivot, r.distance) for r in within_radius(df(more), df(base), cells).collect()}
    want = {(a, b, with_swaps(a, b, 3)) for a, b in itertools.product(set(more), set(base)) if abs(len(a) - len(b)) < 4 and in_reach(a, b)}
    assert got == want


def test_orders_of_words():
    assert orders(["A", "B", "C"]) == ["ACB", "BAC", "BCA", "CAB", "CBA"]
    assert orders(["A"]) == []
    assert len(orders(list("FACBDE"))) == 12


def names(spark, typed, official, payees=("TEST SUPPLIER",)):
    rows = [(n, True, 1) for n in official] + [(n, False, 1) for n in typed if n not in official]
    df = spark.createDataFrame(rows, "name string, official boolean, n_rows bigint")
    return resolve_names(spark, df, df.where("official"), list(payees))


def test_variants_are_linked_and_sister_firms_are_not(spark):
    core = ["Balovir", "Cedumas", "Difaker", "Gopelin", "Hurasto", "Jimoket"]
    official = [f"{c.upper()} {t} PTY LTD" for c in core for t in ("MARINE", "FREIGHT")]
    typed = ["Balovir Marine P/L", "BALVIR MARIN. PTY LTD", "Marine Balovir", "balovir freight (aust)", "Zzakkadu Marine", "ZZAKADU MARINE PL", "Test Suplier", "test supplier"]
    pairs = {frozenset((r.name_a, r.name_b)) for r in variant_pairs(names(spark, typed, official)).collect()}
    one = ["BALOVIR MARINE PTY LTD", "Balovir Marine P/L", "BALVIR MARIN. PTY LTD", "Marine Balovir"]
    want = {frozenset(p) for p in itertools.combinations(one, 2)} | {frozenset(("BALOVIR FREIGHT PTY LTD", "balovir freight (aust)")), frozenset(("Zzakkadu Marine", "ZZAKADU MARINE PL"))}
    assert pairs == want


def test_empty_table(spark):
    assert variant_pairs(names(spark, [], [])).collect() == []


def test_a_misspelling_that_is_the_core_of_another_firm(spark):
    core = ["Balovir", "Cedumas", "Difaker", "Gopelin", "Hurasto", "Jimoket"]
    official = [f"{c.upper()} {t} PTY LTD" for c in core[1:] for t in ("MARINE", "FREIGHT")] + ["BALOVIR MARINE PTY LTD", "BALOVER FREIGHT PTY LTD"]
    pairs = {(r.name_a, r.name_b) for r in variant_pairs(names(spark, ["Balover Marine P/L"], official)).collect()}
    assert pairs == {("BALOVIR MARINE PTY LTD", "Balover Marine P/L")}


def test_a_chain_of_spellings_is_one_name(spark):
    """Each spelling is in reach of the next only; none of the register is near."""
    chain = ["KADOVIMESUTARLON", "KADOVIMESUTARLXX", "KADOVIMESUTYYLXX", "KADOVIMEZZTYYLXX", "KADOVQQEZZTYYLXX", "KADWWQQEZZTYYLXX"]
    got = {r.name: r.name_id for r in names(spark, chain, ["OTHERWISE MARINE"]).collect()}
    assert len({got[c] for c in chain}) == 1


def test_short_names_and_names_of_three_words_turned_round(spark):
    pairs = {(r.name_a, r.name_b) for r in variant_pairs(names(spark, ["AB Ltd", "Vokumar Dasilet Ropamin"], ["A B PTY LTD", "ROPAMIN VOKUMAR DASILET PTY LTD"])).collect()}
    assert pairs == {("A B PTY LTD", "AB Ltd"), ("ROPAMIN VOKUMAR DASILET PTY LTD", "Vokumar Dasilet Ropamin")}


def test_a_name_of_very_many_spellings_is_shared_out(spark, monkeypatch):
    monkeypatch.setattr(variants, "HOT_NAME", 3)
    df = spark.createDataFrame([(f"n{i}", "x") for i in range(10)] + [("a", "y"), ("b", "y"), ("alone", "z")], "name string, name_id string")
    got = sorted((r.name_a, r.name_b) for r in variant_pairs(df).collect())
    assert got == sorted([*itertools.combinations(sorted(f"n{i}" for i in range(10)), 2), ("a", "b")])

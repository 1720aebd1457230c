import itertools

import numpy as np
import pandas as pd
import pytest

from ledgerloom.llm.linkage import Rules, _whole_records, match, solve


def loss(x, name, identifier, fits, misfits, r):
    up = lambda c, w: w * np.maximum(0, c - x).sum()
    return up(name, r.name) + up(identifier, r.identifier) + up(fits, r.place) + r.misplace * np.maximum(0, x - (1 - misfits)).sum() + r.prior * x.sum()


@pytest.mark.parametrize("seed", range(6))
def test_the_optimum_of_the_convex_problem(seed):
    """Against a grid over one record with two candidates."""
    rng = np.random.default_rng(seed)
    name, identifier, fits, misfits = (np.round(rng.random(2), 1) for _ in range(4))
    r = Rules(within=1e-5, inner=20_000)
    z = np.zeros(2)
    solved = solve(np.array([1, 1]), name, identifier, fits, misfits, z, z, r)
    got = solved.value
    again = solve(np.array([1, 1]), name, identifier, fits, misfits, z, z, r, (got, solved.multipliers))
    assert again.rounds <= 3 and np.abs(again.value - got).max() < 1e-3
    grid = [np.array(p) / 50 for p in itertools.product(range(51), repeat=2) if sum(p) <= 50]
    best = min(loss(p, name, identifier, fits, misfits, r) for p in grid)
    assert got.sum() <= 1 + 1e-3
    assert loss(np.clip(got, 0, 1), name, identifier, fits, misfits, r) <= best + 0.05


COLUMNS = "record string, entity string, cluster string, name double, identifier double, fits double, misfits double, x string"


def matched(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], COLUMNS).drop("x")
    return {(r.record, r.entity): r.confidence for r in match(df).collect()}


def test_places_and_identifiers_decide_between_namesakes(spark):
    got = matched(spark, [
        ("a", "e1", "c", 1.0, 0.0, 1.0, 0.0), ("a", "e2", "c", 1.0, 0.0, 0.0, 1.0),
        ("b", "e1", "d", 1.0, 0.0, 0.0, 0.0), ("b", "e2", "d", 1.0, 0.9, 0.0, 0.0),
        ("t", "e1", "t", 1.0, 0.0, 0.0, 0.0), ("t", "e2", "t", 1.0, 0.0, 0.0, 0.0),
        ("n", "e9", None, 0.0, 0.6, 0.0, 0.0), (None, "e1", "c", 1.0, 0.0, 0.0, 0.0), ("z", None, "c", 1.0, 0.0, 0.0, 0.0),
    ])
    assert got["a", "e1"] > 0.8 > 0.3 > got["a", "e2"]
    assert got["b", "e2"] > 0.8 > 0.3 > got["b", "e1"]
    assert abs(got["t", "e1"] - got["t", "e2"]) < 0.02 and got["t", "e1"] <= 0.51
    assert {k[0] for k in got} == {"a", "b", "t", "n"}


def test_transitivity_carries_a_decision_to_a_record_of_the_same_name(spark):
    rows = [(f"a{i}", e, "c", 1.0, 0.0, float(e == "e1"), float(e == "e2")) for i in range(3) for e in ("e1", "e2")]
    got = matched(spark, rows + [("open", "e1", "c", 1.0, 0.0, 0.0, 0.0), ("open", "e2", "c", 1.0, 0.0, 0.0, 0.0)])
    assert got["open", "e1"] > got["open", "e2"]


def test_a_cluster_comes_to_the_optimum_of_all_its_records(spark):
    """Two namesakes in one cluster, evidence on either side; against a grid over the values and the consensus."""
    rows = [("r1", "e1", "c", 0.9, 0.0, 1.0, 0.0), ("r2", "e1", "c", 0.2, 0.0, 0.0, 0.3)]
    r = Rules(between=1e-4, within=1e-5)
    df = spark.createDataFrame([(*x, "clash") for x in rows], COLUMNS)
    got = {x.record: x.confidence for x in match(df, r).collect()}
    one = lambda i, x: loss(np.array([x]), *(np.array([v]) for v in rows[i][3:]), r)
    grid = np.arange(101) / 100
    # the best consensus lies anywhere between the two values
    total = lambda a, b: one(0, a) + one(1, b) + r.transitivity * abs(a - b)
    best = min(total(a, b) for a in grid for b in grid)
    assert total(got["r1"], got["r2"]) <= best + 0.02


def test_places_that_do_not_fit_outweigh_a_name_that_is_not_quite_alike(spark):
    got = matched(spark, [("a", "e1", "c", 0.78, 0.0, 0.0, 0.66), ("b", "e1", "d", 1.0, 0.0, 0.0, 0.4), ("d", "e1", "f", 1.0, 0.0, 0.0, 0.57), ("i", "e1", "g", 0.78, 0.9, 0.0, 0.66)])
    assert got["a", "e1"] < 0.5 < got["b", "e1"] and got["d", "e1"] < 0.5 < got["i", "e1"]


def test_whole_records_stay_together():
    rows = pd.DataFrame({"record": np.repeat(list("abcdef"), [1, 4, 2, 9, 1, 1])})
    got = list(_whole_records(iter([rows.iloc[i : i + 3] for i in range(0, len(rows), 3)]), 4))
    assert pd.concat(got)["record"].tolist() == rows["record"].tolist()
    assert len(got) > 2 and sum(x["record"].nunique() for x in got) == 6


def test_empty_table(spark):
    assert matched(spark, []) == {}


def test_many_records_in_one_cluster(spark):
    n = 2000
    df = spark.createDataFrame(pd.DataFrame({"record": [f"r{i}" for i in range(n)], "entity": "e", "cluster": "hot", "name": 1.0, "identifier": 0.0, "fits": 0.0, "misfits": 0.0}))
    assert match(df).where("confidence > 0.9").count() == n

"""Matching records without a common key by soft logic.

Each candidate pair (record, entity) is a variable between 0 and 1.  Weighted rules become hinge losses:

* the names are alike as far as N says        -> the match holds at least N
* a partial identifier agrees as far as A     -> the match holds at least A
* a place that was mentioned fits             -> the match holds at least L
* places that were mentioned do not fit by M  -> the match holds at most 1 - M
* most pairs are no match                     -> the match is small
* exclusivity: the matches of one record sum to at most one
* transitivity: records of one name cluster match an entity alike

The sum is convex.  It is minimised by the alternating direction method of multipliers: every rule keeps a copy
of its variables, the copies are solved in closed form, averaged, and pulled together by their multipliers.
Rules within one record are solved side by side for all records of a task, until the copies agree.  The transitivity
rule couples records of different tasks through one consensus value for each (cluster, entity), an average that Spark
combines on the map side; so neither a record nor a cluster with very many rows is gathered anywhere.  Values and
multipliers are kept from round to round.  A cluster is done when its copies agree with their consensus and the
consensus stands still; later rounds touch the other clusters only.  The values of the optimum are the confidences.

Defined cases: a record without candidates matches nothing; a null record, entity or cluster takes no part; two
candidates that no rule tells apart share the confidence and neither reaches one half; an empty table gives an
empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize


@dataclass(frozen=True)
class Rules:
    """Weights of the rules; when copies count as equal; most rounds, beyond which a warning tells what is open."""

    name: float = 3.0
    identifier: float = 3.0
    place: float = 1.5
    misplace: float = 2.6
    prior: float = 0.8
    transitivity: float = 0.5
    rho: float = 1.0
    within: float = 1e-4
    inner: int = 2000
    between: float = 5e-2
    outer: int = 100


COPIES = 7  # name, identifier, place, misplace, prior, transitivity, exclusivity


def _hinge_up(v: np.ndarray, c: np.ndarray, w: float) -> np.ndarray:
    """argmin over x of w * max(0, c - x) + (x - v)^2 / 2"""
    return np.where(v + w <= c, v + w, np.maximum(v, np.minimum(c, v + w)))


def _hinge_down(v: np.ndarray, c: np.ndarray, w: float) -> np.ndarray:
    """argmin over x of w * max(0, x - c) + (x - v)^2 / 2"""
    return np.where(v - w >= c, v - w, np.minimum(v, np.maximum(c, v - w)))


def _together(v: np.ndarray, q: np.ndarray, w: float) -> tuple[np.ndarray, np.ndarray]:
    """argmin over x and y of w * |x - y| + (x - v)^2 / 2 + (y - q)^2 / 2"""
    step = np.clip((v - q) / 2, -w, w)
    return v - step, q + step


def _at_most_one(v: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """The nearest point with no negative value and a sum of at most one in each group."""
    low, high = np.zeros(n), np.zeros(n)
    np.maximum.at(high, group, np.maximum(v, 0))
    over = np.bincount(group, np.maximum(v, 0), n) > 1
    for _ in range(40):
        mid = (low + high) / 2
        above = np.bincount(group, np.maximum(v - mid[group], 0), n) > 1
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return np.maximum(v - np.where(over, high, 0)[group], 0)


@dataclass
class Solved:
    value: np.ndarray
    multipliers: np.ndarray  # copies x pairs
    shared: np.ndarray  # the copy of the consensus
    rounds: int


def solve(record: np.ndarray, name: np.ndarray, identifier: np.ndarray, fits: np.ndarray, misfits: np.ndarray, pull: np.ndarray, pulled: np.ndarray, rules: Rules, start: tuple[np.ndarray, np.ndarray] | None = None) -> Solved:
    """The values for whole records; ``pull`` is the consensus less its multiplier, where ``pulled`` is 1.

    ``start`` are values and multipliers to go on from.
    """
    _, group = np.unique(record, return_inverse=True)
    k = len(record)
    z, u = (start[0].copy(), start[1].copy()) if start else (np.full(k, 0.5), np.zeros((COPIES, k)))
    up = [(name, rules.name), (identifier, rules.identifier), (fits, rules.place)]
    down = [(1 - misfits, rules.misplace), (np.zeros(k), rules.prior)]
    shared, live, i = z.copy(), np.arange(k), 0
    while len(live) and i < rules.inner:
        # the records that are not done yet, for some rounds; those whose copies agree are left as they are
        own, (_, of) = live, np.unique(group[live], return_inverse=True)
        n, zs, us, q, together = int(of.max()) + 1, z[own], u[:, own], pull[own], pulled[own] > 0
        ups, downs = [(c[own], w / rules.rho) for c, w in up], [(c[own], w / rules.rho) for c, w in down]
        x, gap = np.zeros((COPIES, len(own))), np.zeros(len(own))
        for _ in range(20):
            i += 1
            v = zs - us
            for j, (c, w) in enumerate(ups):
                x[j] = np.where(c > 0, _hinge_up(v[j], c, w), v[j])
            for j, (c, w) in enumerate(downs, len(ups)):
                x[j] = np.where(c < 1, _hinge_down(v[j], c, w), v[j])
            near, far = _together(v[5], q, rules.transitivity / rules.rho)
            x[5] = np.where(together, near, v[5])
            x[6] = _at_most_one(v[6], of, n)
            before, zs = zs, (x + us).mean(0).clip(0, 1)
            us = us + x - zs
            gap = np.maximum(np.abs(x - zs).max(0), np.abs(zs - before))
            if gap.max() < rules.within:
                break
        z[own], u[:, own], shared[own] = zs, us, np.where(together, far, zs)
        open_ones = np.bincount(of, gap >= rules.within) > 0
        live = own[open_ones[of]]
    return Solved(z, u, shared, i)


def _whole_records(batches: Iterator[pd.DataFrame], rows: int = 5_000) -> Iterator[pd.DataFrame]:
    """Batches sorted by record, put together so that no record is parted."""
    held, n = [], 0
    for b in batches:
        while len(b):
            held.append(b)
            n += len(b)
            b = b.iloc[:0]
            if n >= rows:
                all_rows = pd.concat(held, ignore_index=True)
                last = int(np.searchsorted((all_rows["record"] == all_rows["record"].iloc[-1]).to_numpy(), True))
                if last:
                    yield all_rows.iloc[:last]
                held = [all_rows.iloc[last:]]
                n = len(held[0])
    if n:
        yield pd.concat(held, ignore_index=True)


def match(candidates: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(record, entity, confidence) for candidates with columns record, entity, cluster, name, identifier, fits, misfits.

    One row a pair; a record's rows are its candidates, which its names and identifiers bound, and name one cluster.
    """
    evidence = ["record", "entity", "cluster", "name", "identifier", "fits", "misfits"]
    state = candidates.where("record is not null and entity is not null").select(*evidence)
    state = state.withColumns({"pull": F.lit(0.0), "pulled": F.lit(0.0), "u": F.lit(0.0), "x": F.lit(0.5), "shared": F.lit(0.0), "copies": F.lit(None).cast("array<double>")})
    schema = state.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _whole_records(batches):
            b = b.reset_index(drop=True)
            num = lambda c: b[c].to_numpy(float)
            start = None if b["copies"].iloc[0] is None else (num("x"), np.stack(b["copies"].to_numpy()).T)
            got = solve(b["record"].to_numpy(), num("name"), num("identifier"), num("fits"), num("misfits"), num("pull") - num("u"), num("pulled"), rules, start)
            yield b.assign(x=got.value, shared=got.shared, copies=list(got.multipliers.T))

    done, state = None, materialize(state, "match")
    for i in range(rules.outer):
        # tasks by the number of pairs: the solver's work goes with that, not with bytes
        tasks = max(1, -(-state.count() // 5_000))
        solved = materialize(state.repartition(tasks, "record").sortWithinPartitions("record").mapInPandas(run, schema), f"match-{i}")
        mean = solved.where("cluster is not null").groupBy("cluster", "entity").agg(F.avg(F.col("shared") + F.col("u")).alias("mean"), F.count("*").alias("n")).where("n > 1").drop("n")
        joined = solved.join(mean, ["cluster", "entity"], "left")
        several = F.col("mean").isNotNull()
        moved = F.when(F.col("pulled") > 0, F.abs(F.col("mean") - F.col("pull"))).otherwise(0.0)
        rest = F.when(several, F.greatest(F.abs(F.col("shared") - F.col("mean")), moved)).otherwise(0.0)
        joined = joined.withColumns({"rest": rest, "u": F.when(several, F.col("u") + F.col("shared") - F.col("mean")).otherwise(0.0), "pull": F.when(several, F.col("mean")).otherwise(0.0), "pulled": several.cast("double")})
        still = joined.where(F.col("rest") > rules.between).select("cluster").distinct().withColumn("still", F.lit(True))
        joined = materialize(joined.join(still, "cluster", "left").select(*schema.names, F.col("still").isNotNull().alias("still")), f"consensus-{i}")
        settled = joined.where("not still").select("record", "entity", F.col("x").alias("confidence"))
        done = settled if done is None else done.unionByName(settled)
        state = joined.where("still").select(*schema.names)
        if state.isEmpty():
            return done
    warnings.warn(f"{state.select('cluster').distinct().count()} name clusters are not settled after {rules.outer} rounds", stacklevel=2)
    return done.unionByName(state.select("record", "entity", F.col("x").alias("confidence")))

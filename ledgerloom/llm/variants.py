"""Variant spellings of names, linked by metric-space partitioning.

Distinct spellings are read into a core and generic words (``names.py``).  The cores are points of a metric space
under the Levenshtein distance.  Two names are in reach of each other within a radius, where a swap of neighbouring
letters may count as one edit.  ``within_radius`` partitions the space around pivots, official cores far from each other:

* every official core belongs to the cell of its nearest pivot; the cell has an inner and an outer radius;
* a typed core x with radius r (swaps counted twice) is replicated to each cell that may hold a point in reach.  By the triangle
  inequality that needs d(x, pivot) <= d(x, nearest pivot) + 2 r, and d(x, pivot) within r of the cell's two radii;
* inside each cell an exact radius join runs with the true edit distance.  A pair is a candidate if the two keep one
  of as many segments as edits and one more (an untouched one is left) and, again by the triangle inequality, their
  distances to the pivot differ by no more than r.

Random names are all about equally far from any pivot, so a border is wide and more cells mean more copies: the
README has the measured replication.  That is why the cells are few and the work inside a cell is done by segments.

A core of several words is also tried with its words in other orders.  Of the official names in reach the typed name
takes the one whose generic words agree, at the least distance, with most words in common; a tie between different
official names links to none.  Spellings that reach no official name follow, among themselves, the most often
spelled one in reach, and the one that follows in turn, until nothing changes.

Defined cases: absent names, and texts within two edits of a known payee text, are no names; a name is what
stands there without outer blanks; equal spellings count once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.names import NameReader, agreement, generic_words, levenshtein
from ledgerloom.session import materialize

MAX_PAYEE_TEXTS = 10_000
#: Pivots, and how many cores they are chosen from; any choice is exact, a better one makes fewer copies.
CELLS, PIVOT_SAMPLE, PIVOT_LETTERS = 3, 1000, 60
#: Words of a core of which all orders are tried; of more, the sorted order and the rotations of both directions.
ALL_ORDERS = 4
#: From so many spellings on, the pairs of one name are made by several tasks.
HOT_NAME = 2000
PARSED = "name string, official boolean, n_rows bigint, core string, turned array<string>, generics string, key string"


def radius(n: int) -> int:
    """Edits allowed in a core of n letters."""
    return 1 if n < 6 else 2 if n < 12 else 3


def segments(n: int, r: int) -> list[tuple[int, int]]:
    """(start, length) of the r+1 segments of a text of length n; the later ones take what is left over."""
    k = r + 1
    short, long = n // k, n % k
    out, at = [], 0
    for i in range(k):
        size = short + (1 if i >= k - long else 0)
        out.append((at, size))
        at += size
    return out


def pivot_keys(core: str) -> list[str]:
    """Under which a point is found inside its cell: its segments, for each radius that a name in reach may have.

    A segment of a very short core may be empty; then its key is shared by all cores of that length.
    """
    n = len(core)
    radii = {radius(m) for m in range(max(n - 3, 1), n + 4) if abs(m - n) <= radius(m)}
    return [f"{r}.{n}.{i}.{core[a : a + size]}" for r in sorted(radii) for i, (a, size) in enumerate(segments(n, r))]


def reach_keys(core: str) -> list[str]:
    """The segments that a point in reach must share one of, by length and place.

    A swap of neighbours across the border of two segments spoils both.  Where such swaps and the other edits could
    spoil all segments, one that a swap back at its border restores is looked up too: the first segment if what else
    was edited lies behind it, and of three segments the last if that lies before it.
    """
    n, out = len(core), set()
    r = radius(n)

    def swapped_back(border: int, m: int, i: int, at: int, size: int) -> None:
        if 0 < border < n and 0 <= at <= n - size:
            back = core[: border - 1] + core[border] + core[border - 1] + core[border + 1 :]
            out.add(f"{r}.{m}.{i}.{back[at : at + size]}")

    for m in range(max(n - r, 1), n + r + 1):
        shift = n - m
        parts = segments(m, r)
        for i, (a, size) in enumerate(parts):
            low = max(0, a - i, a + shift - (r - i))
            high = min(n - size, a + i, a + shift + (r - i))
            out.update(f"{r}.{m}.{i}.{core[b : b + size]}" for b in range(low, high + 1))
        if abs(shift) <= (r == 2):
            swapped_back(parts[1][0], m, 0, 0, parts[0][1])
            if r == 2:
                swapped_back(parts[2][0] + shift, m, 2, parts[2][0] + shift, parts[2][1])
    return sorted(out)


def swaps_allowed(n: int) -> int:
    """Edits within which a swap of neighbours counts as one."""
    return min(radius(n), 2)


def lengthened(n: int) -> int:
    """What that comes to as a Levenshtein distance, where a swap is two edits."""
    return max(radius(n), 2 * swaps_allowed(n))


def with_swaps(a: str, b: str, most: int) -> int:
    """The edit distance in which a swap of neighbours is one edit, or ``most`` + 1 where it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i, *[0] * len(b)]
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], last[j - 2] + 1)
        if min(row) > most and min(before) > most:
            return most + 1
    return min(row[-1], most + 1)


def orders(words: Sequence[str]) -> list[str]:
    """The core in the other orders of its words."""
    if len(words) <= ALL_ORDERS:
        ways = permutations(words)
    else:
        ways = [sorted(words), *(w[i:] + w[:i] for w in (list(words), list(words)[::-1]) for i in range(len(words)))]
    return sorted({"".join(w) for w in ways} - {"".join(words)})


def distances(pivot: str, cores: Sequence[str]) -> np.ndarray:
    """The Levenshtein distances of a pivot of at most 63 letters to many cores at once, by bit-parallel columns."""
    size = np.array([len(c) for c in cores], np.int64)
    if not pivot:
        return size
    out = np.full(len(cores), len(pivot), np.int64)
    one, high = np.uint64(1), np.uint64(len(pivot) - 1)
    bits: dict[int, int] = {}
    for i, c in enumerate(pivot):
        bits[ord(c)] = bits.get(ord(c), 0) | 1 << i
    table = np.zeros(max(bits) + 2, np.uint64)
    table[list(bits)] = list(bits.values())
    order, at = np.argsort(size, kind="stable"), 0
    while at < len(order):  # cores of like lengths side by side, some millions of letters at a time
        end = at + 1
        while end < len(order) and (end - at) * size[order[end]] < 4_000_000:
            end += 1
        some = order[at:end]
        at = end
        n, width = size[some], int(size[some[-1]])
        letters = np.zeros((len(some), width), np.uint32)
        for row, i in enumerate(some):
            letters[row, : n[row]] = np.frombuffer(cores[i].encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.minimum(letters, len(table) - 1)
        plus, minus, score = np.full(len(some), (1 << len(pivot)) - 1, np.uint64), np.zeros(len(some), np.uint64), np.full(len(some), len(pivot))
        for j in range(width):
            equal = table[letters[:, j]]
            vertical = equal | minus
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up, down = minus | ~(horizontal | plus), plus & horizontal
            score = score + ((up >> high) & one).astype(np.int64) - ((down >> high) & one).astype(np.int64)
            up, down = (up << one) | one, down << one
            plus, minus = down | ~(vertical | up), up & vertical
            ends = n == j + 1
            out[some[ends]] = score[ends]
    return out


def choose_pivots(points: DataFrame, cells: int = CELLS) -> list[str]:
    """Cores far from each other out of a bounded sample, taken by a hash of the core; the first is the shortest."""
    sample = [r[0] for r in points.where(F.length("core") <= PIVOT_LETTERS).orderBy(F.xxhash64("core"), "core").limit(PIVOT_SAMPLE).select("core").collect()]
    if not sample:
        return [""]
    pivots = [min(sample, key=lambda c: (len(c), c))]
    far = distances(pivots[0], sample)
    while len(pivots) < cells and far.max() > 0:
        pivots.append(sample[int(far.argmax())])
        far = np.minimum(far, distances(pivots[-1], sample))
    return pivots


def read_names(names: DataFrame, generics: Sequence[str], payees: Sequence[str]) -> DataFrame:
    """Spellings with their core, generic words and key (core and generic words together)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = NameReader(list(generics))
        known = {x.plain for p in payees if (x := reader.parse(p))}
        for b in batches:
            out = []
            for name, official, n in zip(b["name"], b["official"], b["n_rows"]):
                x = reader.parse(name)
                if x is None or not x.core or x.plain in known or any(levenshtein(x.plain, k, 2) <= 2 for k in known if not official):
                    continue
                g = " ".join(x.generics)
                out.append((name, official, n, x.core, orders(x.words), g, f"{x.core}#{g}"))
            yield pd.DataFrame(out, columns=["name", "official", "n_rows", "core", "turned", "generics", "key"])

    return names.select("name", "official", "n_rows").mapInPandas(run, PARSED)


PLACED = "core string, cells array<struct<cell:int,ring:int>>, keys array<string>"


def _placed(cores: pd.Series, cell: list[np.ndarray], far: np.ndarray, which) -> pd.DataFrame:
    at = [[{"cell": int(c), "ring": int(far[i, c])} for c in own] for i, own in enumerate(cell)]
    return pd.DataFrame({"core": cores, "cells": at, "keys": [which(c) for c in cores]})


def _far(cores: pd.Series, pivots: Sequence[str]) -> np.ndarray:
    return np.stack([distances(p, cores.tolist()) for p in pivots], 1)


def assign(points: DataFrame, pivots: Sequence[str]) -> DataFrame:
    """Every point with its cell, the one of the nearest pivot, the distance to it (the ring), and its segments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                far = _far(b["core"], pivots)
                yield _placed(b["core"], list(far.argmin(1)[:, None]), far, pivot_keys)

    return points.select("core").mapInPandas(run, PLACED)


def replicate(cores: DataFrame, pivots: Sequence[str], inner: Sequence[int], outer: Sequence[int]) -> DataFrame:
    """Every core with all cells that may hold a point within its radius, by the triangle inequality, and its segments."""
    low, high = np.array(inner), np.array(outer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                far = _far(b["core"], pivots)
                r = np.array([lengthened(len(c)) for c in b["core"]])[:, None]
                may = (far <= far.min(1, keepdims=True) + 2 * r) & (far >= low - r) & (far <= high + r)
                yield _placed(b["core"], [np.flatnonzero(x) for x in may], far, reach_keys)

    return cores.select("core").mapInPandas(run, PLACED)


def _keyed(placed: DataFrame) -> DataFrame:
    """(core, ring, k): one row for each cell and segment, the two as one number; equal numbers of others only cost a comparison."""
    cells = placed.select("core", "keys", F.explode("cells").alias("c")).select("core", "keys", "c.cell", "c.ring")
    return cells.select("core", "cell", "ring", F.explode("keys").alias("k")).select("core", "ring", F.xxhash64("cell", "k").alias("k"))


def _spread(cores: DataFrame, name: str, rows: int = 2000) -> DataFrame:
    """The distinct cores in tasks of some thousands, however few bytes they are: each makes many keys."""
    some = materialize(cores.select("core").distinct(), name)
    return some.repartition(max(1, -(-some.count() // rows)), "core")


def within_radius(cores: DataFrame, points: DataFrame, cells: int = CELLS) -> DataFrame:
    """(core, pivot, distance): every point (named pivot) within reach of each core, exactly.

    In reach is what ``radius`` edits lead to, or ``swaps_allowed`` edits of which some swap neighbours; the
    distance counts a swap as one.
    """
    points = _spread(points, "points")
    pivots = choose_pivots(points, cells)
    placed = materialize(assign(points, pivots), "cells")
    # two numbers a cell
    at = F.get("cells", F.lit(0))
    rings = {r.cell: (r.low, r.high) for r in placed.groupBy(at["cell"].alias("cell")).agg(F.min(at["ring"]).alias("low"), F.max(at["ring"]).alias("high")).collect()}
    inner, outer = ([rings[c][i] if c in rings else none for c in range(len(pivots))] for i, none in ((0, 1 << 30), (1, -(1 << 30))))
    copies = replicate(_spread(cores, "cores"), pivots, inner, outer)
    theirs = _keyed(placed).select(F.col("core").alias("pivot"), F.col("ring").alias("other_ring"), "k")
    far = F.when(F.length("core") < 6, 2).otherwise(4)
    # exploded rows: their number says nothing of the small files they come from, so neither side may be broadcast
    found = _keyed(copies).join(theirs.hint("merge"), "k").where(F.abs(F.col("ring") - F.col("other_ring")) <= far).select("core", "pivot").distinct()
    near = found.withColumn("distance", F.levenshtein("core", "pivot", 4)).where((F.col("distance") >= 0) & (F.col("distance") <= far))
    # beyond the radius only swaps lead there, and they change no letters
    within = F.col("distance") <= F.when(F.length("core") < 6, 1).when(F.length("core") < 12, 2).otherwise(3)
    missing = lambda a, b: F.size(F.array_except(F.split(a, ""), F.split(b, "")))
    near = near.where(within | (F.greatest(missing("core", "pivot"), missing("pivot", "core")) <= far - F.col("distance")))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = []
            for x, y, edits in zip(b["core"], b["pivot"], b["distance"]):
                swapped = with_swaps(x, y, max(radius(len(x)), 2)) if edits > 1 else edits
                d.append(swapped if edits <= radius(len(x)) or swapped <= swaps_allowed(len(x)) else None)
            yield b.assign(distance=pd.array(d, "Int32")).dropna()

    return near.mapInPandas(exact, "core string, pivot string, distance int")


def _agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs of keys whose generic words agree, with the words in common and those left over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, other, g, h, d in zip(b["key"], b["other"], b["generics"], b["other_generics"], b["distance"]):
                x, y = tuple(g.split()), tuple(h.split())
                hit = agreement(x, y)
                if hit is not None:
                    out.append((key, other, d, hit, len(x) + len(y) - 2 * hit))
            yield pd.DataFrame(out, columns=["key", "other", "distance", "hit", "left"])

    return pairs.select("key", "other", "generics", "other_generics", "distance").mapInPandas(run, "key string, other string, distance int, hit int, left int")


def _forms(keys: DataFrame) -> DataFrame:
    """(core, key, generics) with the core as typed and in the other orders of its words."""
    return keys.select(F.explode(F.array_union(F.array("core"), "turned")).alias("core"), "key", "generics")


def follow(leader: DataFrame) -> DataFrame:
    """(key, leader) with every leader replaced by the one that it follows in the end; each round doubles the reach.

    Weights grow along the way, so there is no circle and the rounds end.
    """
    while True:
        above = leader.select(F.col("key").alias("leader"), F.col("leader").alias("above"))
        nxt = materialize(leader.join(above, "leader").select("key", F.col("above").alias("leader"), (F.col("above") != F.col("leader")).alias("moved")), "leaders")
        leader = nxt.select("key", "leader")
        if nxt.where("moved").isEmpty():
            return leader


def resolve_names(spark, names: DataFrame, official: DataFrame, payees: Sequence[str]) -> DataFrame:
    """(name, official, key, name_id, alike) of every spelling that names somebody.

    ``names`` has the columns name, official, n_rows, one row a spelling; ``official`` the official spellings in
    ``name``.  Spellings of one name share a ``name_id``; ``alike`` is how near the core comes to the official one.
    """
    if len(payees) > MAX_PAYEE_TEXTS:
        raise ValueError("too many payee texts for a list that goes to every task")
    parsed = materialize(read_names(names, generic_words(official, "name"), payees), "names")
    keys = materialize(parsed.groupBy("key", "core", "generics").agg(F.bool_or("official").alias("official"), F.array_distinct(F.flatten(F.collect_set("turned"))).alias("turned"), F.count("*").alias("n_spellings"), F.sum("n_rows").alias("n_rows")), "name-keys")
    pivots = keys.where("official").select("core", F.col("key").alias("other"), F.col("generics").alias("other_generics"))
    points = pivots.select("core").distinct()
    forms = _forms(keys.where("not official"))
    # a core that only others bear is searched in its radius like any other
    exact = materialize(_agreeing(forms.join(pivots, "core").select("key", "other", "generics", "other_generics", F.lit(0).alias("distance"))), "exact")
    open_forms = forms.join(exact.select("key").distinct(), "key", "left_anti")
    reach = materialize(within_radius(open_forms.select("core").distinct(), points), "reach")
    near = open_forms.join(reach, "core").join(pivots.withColumnRenamed("core", "pivot"), "pivot").select("key", "other", "generics", "other_generics", "distance")
    offers = exact.unionByName(_agreeing(near)).withColumn("rank", F.struct("distance", (-F.col("hit")).alias("hit"), "left"))
    best = offers.groupBy("key").agg(F.min("rank").alias("best"))
    alike = 1 - F.col("best.distance") / F.greatest(F.length(F.split_part("key", F.lit("#"), F.lit(1))), F.lit(1))
    tied = offers.join(best, "key").where("rank = best").groupBy("key", "best").agg(F.min("other").alias("other"), F.count_distinct("other").alias("n"))
    chosen = tied.where("n = 1").select("key", F.col("other").alias("name_id"), alike.alias("alike"))
    chosen = materialize(chosen, "chosen")
    # the rest choose pivots among themselves
    rest = materialize(keys.where("not official").join(chosen, "key", "left_anti"), "rest")
    sides = _forms(rest)
    among = within_radius(sides.select("core").distinct(), rest.select("core").distinct())
    others = rest.select(F.col("core").alias("pivot"), F.col("key").alias("other"), F.col("generics").alias("other_generics"), "n_spellings", "n_rows")
    pairs = sides.join(among, "core").join(others, "pivot").select("key", "other", "generics", "other_generics", "distance")
    both = pairs.unionByName(pairs.select(F.col("other").alias("key"), F.col("key").alias("other"), F.col("other_generics").alias("generics"), F.col("generics").alias("other_generics"), "distance"))
    weight = rest.select(F.col("key").alias("other"), F.struct("n_spellings", "n_rows", "key").alias("weight"))
    leader = _agreeing(both).select("key", "other").join(weight, "other").groupBy("key").agg(F.max("weight").getField("key").alias("leader"))
    own = follow(materialize(leader, "leaders")).select("key", F.col("leader").alias("name_id"))
    whole = F.lit(1.0).cast("double").alias("alike")
    ids = keys.where("official").select("key", F.col("key").alias("name_id"), whole).unionByName(chosen).unionByName(own.select("key", "name_id", whole))
    return parsed.join(ids, "key").select("name", "official", "key", "name_id", "alike", "n_rows")


def variant_pairs(resolved: DataFrame) -> DataFrame:
    """(name_a, name_b): all pairs of different spellings of one name, the smaller first by bytes."""
    # a name of very many spellings is shared out: each task pairs a part of them with all
    hot = resolved.groupBy("name_id").agg(F.count("*").alias("n")).where(F.col("n") > HOT_NAME).select("name_id", F.ceil(F.col("n") / HOT_NAME).cast("int").alias("parts"))
    parted = resolved.join(hot, "name_id", "left").select("name_id", "name", F.coalesce("parts", F.lit(1)).alias("parts"))
    a = parted.select("name_id", F.col("name").alias("name_a"), F.pmod(F.hash("name"), "parts").alias("part"))
    b = parted.select("name_id", F.col("name").alias("name_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["name_id", "part"]).where("name_a < name_b").select("name_a", "name_b")

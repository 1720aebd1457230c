"""Evaluation passages that leak into a corpus.

1. Documents are read as words without case, punctuation, line breaks, hyphenation, odd signs and page headers,
   each word as its number in the vocabulary of the evaluation items, 0 for all others.  The document
   frequencies of all documents are counted on the way.
2. Windows of ``WINDOW`` words are TF-IDF vectors; words in more than one document of fifty weigh nothing.  A
   distributed randomised SVD gives the latent space: subspace iteration, in which every task multiplies its
   own windows and Spark adds the products up by block of words; the driver holds words times rank numbers,
   whatever the size of the corpus.
3. A cosine search in that space: a stretch of text is a candidate for the items of which a window comes within
   ``cosine`` of one of its own.  A window whose known words make up less than ``cosine`` of its length cannot
   come that near to anything (Cauchy and Schwarz), so only stretches of other windows are projected.
4. What the weights or the space hide is a candidate too: a leak of ``least`` words has a run of unaltered ones
   (``seed_size``), so every run of that length that a document shares with an item is looked up, without loss.
5. Each candidate is aligned with the item: seeds of consecutive common words are extended by the furthest
   reaching paths over at most ``altered`` edits, the longest common subsequence in a narrow band.  A leak is a
   span of at least ``least`` words of the item that begins and ends with the item's words.

Defined cases: null, empty and short texts hold nothing; repeated documents are reported each; an empty item
set or corpus gives an empty result; an item of fewer than ``least`` words cannot leak.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize

WINDOW, STRIDE = 40, 10
#: A word weighs from one document in COMMON on, and no more than one in RARE; fewer documents than RARE count as RARE.
COMMON, RARE = 50, 1000
#: Characters of evaluation items that the driver reads at most, and words that go to every task at once; of more, one part after the other.
MAX_ITEM_LETTERS, GROUP_WORDS = 120_000_000, 100_000
#: Parts of a product that one task adds up at most.
PARTS = 64
#: Corpus windows of a task in the products.
TASK_WINDOWS = 40_000

_WORD = re.compile(r"[^\W_]+|█+")
_HEADER = re.compile(r"^[^\n]{0,80}[-–—]\s*[^\W\d_]+\.?\s+\d+\s+[^\W\d_]+\s+\d+\s*$", re.M)
_HYPHEN = re.compile(r"(?<=\w)[-‐‑¬­]\s*\n\s*(?=\w)")
_ODD = re.compile("[­​-‏ -‮⁠-⁤﻿̀-ͯ]")


def words_of(text: str) -> list[str]:
    """The words of a text as they are compared."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\n" in text:
        text = _HYPHEN.sub("", _HEADER.sub("", text))
    if not text.isascii():
        text = _ODD.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.lower())


@dataclass
class Items:
    """Evaluation items as word numbers; a bounded part of them, sent to every task."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]

    @classmethod
    def read(cls, items: DataFrame, key: str, text: str) -> list[Items]:
        """The items in groups of about GROUP_WORDS words."""
        size = items.agg(F.sum(F.length(text))).first()[0] or 0
        if size > MAX_ITEM_LETTERS:
            raise ValueError("the evaluation set is too large for the driver; split it")
        groups: list[Items] = []
        room = 0
        for k, t in items.where(F.col(text).isNotNull()).select(key, text).orderBy(key).collect():
            w = words_of(t)
            if not w:
                continue
            if room < len(w):
                groups.append(cls([], [], {}))
                room = max(GROUP_WORDS, len(w))
            own = groups[-1]
            own.ids.append(k)
            own.words.append(np.array([own.vocabulary.setdefault(x, len(own.vocabulary) + 1) for x in w], np.int32))
            room -= len(w)
        return groups


def starts(n: int) -> list[int]:
    """Where the windows of a stretch of n words begin; the last one ends with it."""
    if n <= WINDOW:
        return [0]
    out = list(range(0, n - WINDOW + 1, STRIDE))
    if out[-1] != n - WINDOW:
        out.append(n - WINDOW)
    return out


def read_words(documents: DataFrame, key: str, text: str, items: Items) -> DataFrame:
    """(key, at, words): every document of WINDOW words or more as word numbers; rows with at = -1 count documents by word."""
    vocabulary, size = items.vocabulary, len(items.vocabulary) + 1
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        counts = np.zeros(size, np.int64)
        for b in batches:
            rows, found = [], []
            column = b.column(0)
            for row, t in enumerate(b.column(1).to_pylist()):
                counts[0] += 1
                if not t:
                    continue
                ws = words_of(t)
                w = np.array([get(x, 0) for x in ws], np.int32)
                seen = np.zeros(size, bool)
                seen[w] = True
                counts[1:] += seen[1:]
                if len(w) >= WINDOW:
                    rows.append(row), found.append(w)
            if rows:
                yield _batch(column.take(pa.array(rows)), [0] * len(rows), found)
        if counts[0]:
            yield _batch(pa.nulls(1, column.type), [-1], [counts.astype(np.int32)])

    return documents.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind.simpleString()}, at int, words array<int>")


def weights(counts: np.ndarray) -> np.ndarray:
    """The weight of every word; counts[0] is the number of documents, weight[0] that of strange words."""
    total = max(int(counts[0]), RARE)
    df = np.maximum(counts, 1).astype(float)
    df[0] = 1
    out = np.clip(np.log(total / df), np.log(COMMON), np.log(RARE)) - np.log(COMMON)
    # nobody knows how rare a strange word is: it counts like the items' own words that count at all
    some = out[1:][out[1:] > 0]
    out[0] = np.median(some) if len(some) else out[0]
    return out


def with_hot_leaks(weight: np.ndarray, counts: np.ndarray, items: Items, few: int = 6) -> np.ndarray:
    """The weights, raised where an item would be lost by them.

    A passage that leaks into a great part of the corpus makes its own words common.  A window of an item that has
    no rare word left gives the full weight back to the ``few`` rarest of its words that hardly any other item has.
    """
    full = np.log(RARE / COMMON)
    seen = np.zeros(len(weight))
    for w in items.words:
        seen[np.unique(w)] += 1
    own = seen <= max(1, 0.02 * len(items.words))
    out = weight.copy()
    for w in items.words:
        for row in _windows(w):
            if weight[row[row > 0]].max(initial=0) < 0.4 * full:
                row = np.unique(row[(row > 0) & own[row]])
                out[row[np.argsort(counts[row], kind="stable")[:few]]] = full
    return out


def stretches(read: DataFrame, weight: np.ndarray, cosine: float) -> DataFrame:
    """The stretches of those windows whose known words leave room for the cosine asked for."""
    square = weight**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at, found = [], [], []
            column, lists = b.column(0), b.column(2)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for row in range(b.num_rows):
                w = flat[offsets[row] : offsets[row + 1]]
                mass = square[w]
                whole = np.concatenate([[0], np.cumsum(mass)])
                known = np.concatenate([[0], np.cumsum(np.where(w > 0, mass, 0))])
                k = known[WINDOW:] - known[:-WINDOW]
                good = (k > 0) & (k >= cosine**2 * (whole[WINDOW:] - whole[:-WINDOW]) - 1e-9)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
                last = -1
                for a, e in zip(edge[::2], edge[1::2]):  # overlapping runs of windows become one stretch
                    end = e - 1 + WINDOW
                    if a <= last:
                        found[-1] = w[at[-1] : end]
                    else:
                        rows.append(row), at.append(int(a)), found.append(w[a:end])
                    last = end
            if rows:
                yield _batch(column.take(pa.array(rows)), at, found)

    return read.where("at = 0").mapInArrow(run, read.schema)


def _batch(keys: pa.Array, at: list[int], words: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.zeros(len(words) + 1, np.int32)
    np.cumsum([len(x) for x in words], out=offsets[1:])
    return pa.RecordBatch.from_arrays([keys, pa.array(at, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(words).astype(np.int32)))], ["key", "at", "words"])


def _windows(stretch: np.ndarray) -> np.ndarray:
    """The word numbers of each window; 0 fills up what is short."""
    if len(stretch) < WINDOW:
        stretch = np.concatenate([stretch, np.zeros(WINDOW - len(stretch), np.int32)])
    return np.stack([stretch[a : a + WINDOW] for a in starts(len(stretch))])


def _project(stretch: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Latent coordinates of each window over the length of its TF-IDF vector, strange words included.

    Running sums over the stretch give all windows at once.
    """
    if len(stretch) < WINDOW:
        stretch = np.concatenate([stretch, np.zeros(WINDOW - len(stretch), np.int32)])
    a = np.array(starts(len(stretch)))
    x = weight[stretch].astype(np.float32)
    heavy = np.flatnonzero((x > 0) & (stretch > 0))
    sums = np.zeros((len(heavy) + 1, basis.shape[1]), np.float32)
    np.cumsum(x[heavy, None] * basis[stretch[heavy]], axis=0, out=sums[1:])
    latent = sums[np.searchsorted(heavy, a + WINDOW)] - sums[np.searchsorted(heavy, a)]
    mass = np.concatenate([[0.0], np.cumsum(x.astype(np.float64) ** 2)])
    return latent / np.sqrt(np.maximum(mass[a + WINDOW] - mass[a], 1e-12))[:, None].astype(np.float32)


def latent_space(found: DataFrame, items: Items, weight: np.ndarray, rank: int, rounds: int = 2, block: int = 64, seed: int = 11) -> np.ndarray:
    """An orthonormal basis (words x rank) of the strongest directions of all windows, by randomised subspace iteration.

    ``found`` gives its windows side by side, the items theirs every STRIDE words and
    weigh four times as much in all, so that what only one of them has keeps its direction in a large corpus.  Tasks send the words they touched.
    """
    spark = found.sparkSession
    size = len(weight)
    rank = min(rank, size)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, rank), dtype=np.float32))[0]
    own = np.concatenate([_windows(w) for w in items.words])
    corpus = int(found.agg(F.sum(F.ceil(F.size("words") / WINDOW))).first()[0] or 0)
    emphasis = 4 * max(1.0, corpus / len(own))
    tasks = max(1, corpus // TASK_WINDOWS)
    found = found.select("words").repartition(tasks)

    def product(windows: Iterator[np.ndarray], basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A'A times the basis, for the windows as rows of A, and which words they touch."""
        out, touched = np.zeros((size, basis.shape[1]), np.float32), np.zeros(size, bool)
        while some := list(islice(windows, 1000)):
            words = np.concatenate(some)
            row = np.repeat(np.arange(len(some)), [len(w) for w in some])
            heavy = weight[words] > 0
            words, row = words[heavy], row[heavy]
            if not len(words):
                continue
            x = weight[words].astype(np.float32)[:, None]
            rows, first = np.unique(row, return_index=True)
            y = np.add.reduceat(x * basis[words], first, axis=0)
            order = np.argsort(words, kind="stable")
            hit, first = np.unique(words[order], return_index=True)
            back = y[np.searchsorted(rows, row[order])]
            back *= x[order]
            out[hit] += np.add.reduceat(back, first, axis=0)
            touched[hit] = True
        return out, touched

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(basis)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            side_by_side = (np.asarray(w[i : i + WINDOW], np.int32) for b in batches for w in b["words"] for i in range(0, len(w), WINDOW))
            out, touched = product(side_by_side, sent.value)
            hit = np.unique(np.flatnonzero(touched) // block)
            if len(hit):
                yield pd.DataFrame({"block": hit, "x": [out[i * block : (i + 1) * block].ravel() for i in hit]})

        def add(parts: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"block": parts["block"].iloc[:1], "x": [np.sum(np.stack(parts["x"].to_numpy()), 0)]})

        parts, kind = found.mapInPandas(run, "block int, x array<float>"), "block int, x array<float>"
        while tasks > PARTS:  # of very many tasks, some are added up at a time
            tasks = -(-tasks // PARTS)
            parts = parts.groupBy("block", F.pmod(F.spark_partition_id(), F.lit(tasks))).applyInPandas(add, kind)
        sums = parts.groupBy("block").applyInPandas(add, kind).toArrow()
        z = emphasis * product(iter(own), basis)[0]
        for i, x in zip(sums.column("block").to_pylist(), sums.column("x")):
            part = x.values.to_numpy().reshape(-1, rank)
            z[i * block : i * block + len(part)] += part
        basis = np.linalg.qr(z)[0]
        sent.destroy()
    return basis


def _reach(doc: np.ndarray, item: np.ndarray, most: int) -> list[int]:
    """With e edits, e = 0..most: how many words of ``item`` the common start of both covers; it ends with an equal word.

    Furthest reaching paths by diagonal: each edit replaces, drops or adds one word.
    """
    n, m = len(doc), len(item)
    far = {0: 0}  # diagonal (doc minus item) -> item position
    best, out = 0, []

    def slide(j: int, d: int) -> tuple[int, bool]:
        start = j
        while j < m and 0 <= j + d < n and doc[j + d] == item[j]:
            j += 1
        return j, j > start

    j, moved = slide(0, 0)
    far = {0: j}
    best = j
    out.append(best)
    for e in range(1, most + 1):
        new: dict[int, int] = {}
        for d in range(-e, e + 1):
            options = [far[d] + 1] if d in far else []
            if d - 1 in far:
                options.append(far[d - 1])
            if d + 1 in far:
                options.append(far[d + 1] + 1)
            options = [x for x in options if x <= m and 0 <= x + d <= n]
            if not options:
                continue
            j, moved = slide(max(options), d)
            new[d] = j
            if moved:
                best = max(best, j)
        far = new
        out.append(best)
    return out


def seed_size(least: int, altered: int) -> int:
    """How many unaltered words in a row every span of ``least`` words with at most ``altered`` altered ones has."""
    return max(1, -(-(least - altered) // (altered + 1)))


def leaked_span(doc: np.ndarray, item: np.ndarray, least: int = WINDOW, altered: int = 3) -> int:
    """The longest span of the item's words in a row that the stretch holds with at most ``altered`` of them altered.

    A span of ``least`` words has a run of at least least / (altered + 1) unaltered ones; every such run is a seed.
    """
    seed = seed_size(least, altered)
    n, m = len(doc), len(item)
    if n < seed or m < seed:
        return 0
    # for each pair of equal words, by diagonal: the runs
    at: dict[int, list[int]] = {}
    for j, w in enumerate(item.tolist()):
        at.setdefault(w, []).append(j)
    best, done = 0, set()
    runs: dict[tuple[int, int], int] = {}
    before: dict[int, int] = {}
    d = doc.tolist()
    for i, w in enumerate(d):
        now = {}
        for j in at.get(w, ()):
            now[j] = before.get(j - 1, 0) + 1
            if now[j] >= seed:
                runs[(i - j, j - now[j] + 1)] = now[j]
        before = now
    for (diagonal, j), length in sorted(runs.items(), key=lambda x: -x[1]):
        i = j + diagonal
        ahead = _reach(doc[i + length :], item[j + length :], altered)
        back = _reach(doc[:i][::-1], item[:j][::-1], altered)
        best = max(best, length + max(ahead[a] + back[altered - a] for a in range(altered + 1)))
    return best


def _grams(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each place on; equal hashes of different words only cost an alignment."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = (out + words[at + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _may_leak(doc: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, place: np.ndarray, size: int, least: int, altered: int) -> np.ndarray:
    """Which runs of ``size`` equal words at ``at`` in the document and ``place`` in the item can lie in a leak.

    ``altered`` edits move no word by more than ``altered`` places against the run, and leave all but ``altered`` of any
    ``least`` words in a row; runs without so many equal words that near are none, so nothing is lost.
    """
    x = np.arange(size - least, least)
    here = place[:, None] + x
    inside = (here >= 0) & (here < len(item))
    word = item[np.clip(here, 0, len(item) - 1)]
    equal = np.zeros(here.shape, bool)
    for d in range(-altered, altered + 1):
        there = at[:, None] + x + d
        good = inside & (there >= begin[:, None]) & (there < end[:, None])
        equal |= good & (doc[np.clip(there, 0, len(doc) - 1)] == word)
    sums = lambda y: np.concatenate([np.zeros((len(y), 1), int), np.cumsum(y, 1)], 1)
    e, i = sums(equal), sums(inside)
    return ((e[:, least:] - e[:, :-least] >= least - altered) & (i[:, least:] - i[:, :-least] == least)).any(1)


def seeded(read: DataFrame, items: Items, schema: str, least: int, altered: int) -> DataFrame:
    """The leaks among all pairs of a document and an item that share a run of ``seed_size`` words; no cosine is known."""
    size = seed_size(least, altered)
    parts = [(_grams(w, np.arange(len(w) - size + 1), size), i) for i, w in enumerate(items.words) if len(w) >= least]
    if not parts:
        return read.sparkSession.createDataFrame([], schema)
    grams = np.concatenate([g for g, _ in parts])
    order = np.argsort(grams, kind="stable")
    of, place = np.repeat([i for _, i in parts], [len(g) for g, _ in parts])[order], np.concatenate([np.arange(len(g)) for g, _ in parts])[order]
    sent = read.sparkSession.sparkContext.broadcast((items.words, items.ids, grams[order], of, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, grams, of, place = sent.value
        joined = np.concatenate(words)
        joins = np.cumsum([0, *map(len, words)])
        some = np.zeros(1 << 20, bool)
        some[grams >> np.uint64(44)] = True
        for b in batches:
            lists = b.column(2)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            strange = np.concatenate([[0], np.cumsum(flat == 0)])
            at = np.flatnonzero(strange[size:] == strange[:-size])
            g = _grams(flat, at, size)
            keep = some[g >> np.uint64(44)]
            at, g = at[keep], g[keep]
            first, last = np.searchsorted(grams, g, "left"), np.searchsorted(grams, g, "right")
            row = np.searchsorted(offsets, at, "right") - 1
            hit = np.flatnonzero((last > first) & (at + size <= offsets[row + 1]))
            n = (last - first)[hit]
            at, row = np.repeat(at[hit], n), np.repeat(row[hit], n)
            x = np.repeat(first[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
            # of a longer run the start is enough
            begins = (at == offsets[row]) | (place[x] == 0)
            begins[~begins] = flat[at[~begins] - 1] != joined[joins[of[x[~begins]]] + place[x[~begins]] - 1]
            at, row, x = at[begins], row[begins], x[begins]
            # where in the document a span with such a run can lie, by document and item
            ranges: dict[tuple[int, int], list[list[int]]] = {}
            for i in np.unique(of[x]).tolist():
                mine = np.flatnonzero(of[x] == i)
                for some_of in np.split(mine, range(4096, len(mine), 4096)):
                    p, j, r = at[some_of], place[x[some_of]], row[some_of]
                    a, z = offsets[r], offsets[r + 1]
                    near = _may_leak(flat, p, a, z, words[i], j, size, least, altered)
                    begin = np.maximum(a, p - j - altered)[near]
                    end = np.minimum(z, p - j + len(words[i]) + altered)[near]
                    for k, u, v in zip(r[near].tolist(), begin.tolist(), end.tolist()):
                        known = ranges.setdefault((k, i), [])
                        if known and u <= known[-1][1] and v >= known[-1][0]:
                            known[-1] = [min(u, known[-1][0]), max(v, known[-1][1])]
                        else:
                            known.append([u, v])
            keys, out = b.column(0), []
            for (r, i), known in ranges.items():
                span = max(leaked_span(flat[begin:end], words[i], least, altered) for begin, end in known)
                if span >= least:
                    out.append((r, ids[i], span))
            if out:
                rows = [x[0] for x in out]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array([x[1] for x in out], kind), pa.nulls(len(out), pa.float64()), pa.array([x[2] for x in out], pa.int32())], ["key", "item", "cosine", "span"])

    kind = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(schema.split(", ")[1].split()[1])
    return read.where("at = 0").mapInArrow(run, schema)


def find_leaks(documents: DataFrame, key: str, text: str, item_table: DataFrame, item_key: str, item_text: str, *, cosine: float = 0.5, least: int = WINDOW, altered: int = 3, rank: int | None = None, checked: bool = True) -> DataFrame:
    """(key, item, cosine, span): the leaks, or with checked=False all candidates with their span.

    The cosine is null where only a run of equal words gave the leak away.
    """
    groups = Items.read(item_table, item_key, item_text)
    kind, item_kind = documents.schema[key].dataType.simpleString(), item_table.schema[item_key].dataType.simpleString()
    schema = f"key {kind}, item {item_kind}, cosine double, span int"
    out = documents.sparkSession.createDataFrame([], schema) if not groups else None
    for items in groups:
        found = _find(documents, key, text, items, schema, cosine, least, altered, rank, checked)
        out = found if out is None else out.unionByName(found)
    return out


def _find(documents: DataFrame, key: str, text: str, items: Items, schema: str, cosine: float, least: int, altered: int, rank: int | None, checked: bool) -> DataFrame:
    spark = documents.sparkSession
    read = materialize(read_words(documents, key, text, items), "words")
    # as many numbers as the evaluation vocabulary has words
    counted = read.where("at = -1").select(F.posexplode("words").alias("word", "n")).groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(items.vocabulary) + 1)
    for w, n in counted:
        counts[w] = n
    idf = with_hot_leaks(weights(counts), counts, items)
    found = materialize(stretches(read, idf, cosine), "stretches")
    space = idf.copy()
    space[0] = 0
    # one direction for every 36 words of the items: their windows then lie in the space nearly whole
    rank = rank or max(256, sum(map(len, items.words)) // 36)
    basis = latent_space(found, items, space, rank)
    own = [_windows(w) for w in items.words]
    owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
    q = np.concatenate([_project(w, idf, basis) for w in items.words])
    begins = np.searchsorted(owner, np.arange(len(own)))
    sent = spark.sparkContext.broadcast((items.words, items.ids, idf, basis, q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, ids, idf, basis, q = sent.value
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                texts = [np.asarray(w, np.int32) for w in part["words"]]
                p = [_project(w, idf, basis) for w in texts]
                of = np.repeat(np.arange(len(p)), [len(x) for x in p])
                p = np.concatenate(p)
                # no item can be nearer than the part of the window that lies in the space
                room = np.einsum("nr,nr->n", p, p) >= cosine**2
                best = np.zeros((len(texts), len(ids)), np.float32)
                if room.any():
                    near = np.maximum.reduceat(p[room] @ q.T, begins, axis=1)
                    np.maximum.at(best, of[room], near)
                out = []
                for t, i in np.argwhere(best >= cosine):
                    span = leaked_span(texts[t], words[i], least, altered)
                    if span >= least or not checked:
                        out.append((part["key"].iloc[t], ids[i], float(best[t, i]), span))
                yield pd.DataFrame(out, columns=["key", "item", "cosine", "span"])

    hits = found.repartition(F.hash("key", "at")).mapInPandas(run, schema).unionByName(seeded(read, items, schema, least, altered))
    hits = materialize(hits.groupBy("key", "item").agg(F.max("cosine").alias("cosine"), F.max("span").alias("span")), "leaks")
    sent.destroy()
    return hits

"""Rows that fail to parse, with the reason, while the valid ones load.

``parse_records`` reads one CSV record a row.  A record is parsed at minimum cost: a dynamic program over the
characters may insert or delete quotes and delimiters, quote edits weighing more than any number of delimiter
edits.  A parse without edits is the record as it stands; otherwise the cheapest edits state the reason:
``quoting`` if a quote had to be edited, else ``columns``.  Records that a scan of the grammar accepts with the
right number of cells cost nothing and skip the program; it runs for the failing ones only, in time and memory
proportional to their quotes and delimiters: runs of other signs are one step, whatever their length.  Delimiters are inserted only beside a delimiter or at the end and never
make up for a quote, so a quote edit is needed exactly where the grammar itself is broken.

``field_failures`` checks typed fields of rows that have their cells.

Defined cases: an absent cell (null, blank, NULL or null) is no failure; outer blanks of a cell do not make it
unreadable; one carriage return after the last cell is no failure; a null or empty record is one cell and fails
by ``columns``; an empty table gives an empty result.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import present

QUOTE_COST = 1 << 20
_RECORD = re.compile(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*')
_STEP = re.compile(r'[",]|[^",]+')
# states of a record being read: at the start of a cell, in a bare cell, in a quoted cell, after its closing quote
START, BARE, QUOTED, CLOSED = range(4)
KEEP, DROP, ADD_QUOTE, END_QUOTE, ADD_DELIMITER = "keep", "delete", "insert quote", "insert closing quote", "insert delimiter"


def without_return(line: str | None) -> str:
    line = line or ""
    return line[:-2] if line.endswith("\r\n") else line[:-1] if line.endswith(("\r", "\n")) else line


def cells_of(line: str) -> list[str] | None:
    """The cells of a record that the grammar accepts as it stands, else None."""
    if '"' not in line:
        return line.split(",")
    if not _RECORD.fullmatch(line):
        return None
    limit = csv.field_size_limit()
    if len(line) >= limit:
        csv.field_size_limit(len(line) + 1)
    return next(csv.reader(io.StringIO(line, newline=""), strict=True))


def min_cost_parse(line: str, width: int) -> tuple[int, int, list[tuple[int, str]]]:
    """(quote edits, delimiter edits, [(position, edit)]) of the cheapest way to read ``line`` as ``width`` cells."""
    inf = 1 << 60
    cost = np.full((4, width), inf, np.int64)
    cost[START, 0] = 0
    # where each best value comes from is kept as previous state * 8 + kind of step, for every step, state and cell

    def relax(to, state, values, source, edit, shift=0):
        """Offer ``values`` (by cell, of ``source``) to ``state``; shift 1 moves to the next cell."""
        v = values
        if shift:
            v = np.empty_like(values)
            v[0], v[1:] = inf, values[:-1]
        better = v < to[0][state]
        to[0][state][better] = v[better]
        to[1][state][better] = source * 8 + edit

    def empty():
        return np.full((4, width), inf, np.int64), np.full((4, width), -1, np.int8)

    def insert_delimiters(c, back):
        # an empty cell more, before a delimiter or at the end
        for k in range(width - 1):
            source = min((START, BARE, CLOSED), key=lambda s: c[s, k])
            if c[source, k] + 1 < c[START, k + 1]:
                c[START, k + 1] = c[source, k] + 1
                back[START, k + 1] = source

    # a run of other signs is one step: after its first sign nothing about the states changes any more
    steps = []
    for at, ch in ((m.start(), m[0][0]) for m in _STEP.finditer(line)):
        adds = None
        if ch == ",":
            adds = np.full((4, width), -1, np.int8)
            insert_delimiters(cost, adds)
        new = empty()
        if ch == '"':
            relax(new, QUOTED, cost[START], START, 0)
            relax(new, START, cost[START] + QUOTE_COST, START, 1)
            relax(new, BARE, cost[BARE] + QUOTE_COST, BARE, 1)
            relax(new, CLOSED, cost[QUOTED], QUOTED, 0)
            relax(new, QUOTED, cost[QUOTED] + QUOTE_COST, QUOTED, 1)
            relax(new, QUOTED, cost[CLOSED], CLOSED, 0)
            relax(new, CLOSED, cost[CLOSED] + QUOTE_COST, CLOSED, 1)
        elif ch == ",":
            relax(new, QUOTED, cost[QUOTED], QUOTED, 0)
            for s in (START, BARE, CLOSED):
                relax(new, START, cost[s], s, 0, shift=1)
                relax(new, START, cost[s] + 1, s, 1)  # joins two cells, whichever way the second is quoted
            relax(new, START, cost[QUOTED] + QUOTE_COST, QUOTED, 3, shift=1)
        else:
            relax(new, BARE, cost[START], START, 0)
            relax(new, BARE, cost[BARE], BARE, 0)
            relax(new, QUOTED, cost[QUOTED], QUOTED, 0)
            relax(new, QUOTED, cost[START] + QUOTE_COST, START, 2)
        steps.append((at, adds, new[1]))
        cost = new[0]
    adds = np.full((4, width), -1, np.int8)
    insert_delimiters(cost, adds)
    k = width - 1
    ends = {s: cost[s, k] + (QUOTE_COST if s == QUOTED else 0) for s in range(4)}
    state = min(ends, key=ends.get)
    total, edits = int(ends[state]), []
    if total >= inf:
        return 1, 0, [(0, "unreadable")]
    if state == QUOTED:
        edits.append((len(line), END_QUOTE))

    def undo_inserts(adds, position, state, k):
        while adds[state, k] >= 0 and state == START and k:
            edits.append((position, ADD_DELIMITER))
            state, k = int(adds[state, k]), k - 1
        return state, k

    state, k = undo_inserts(adds, len(line), state, k)
    for position, adds, back in reversed(steps):
        source, edit = divmod(int(back[state, k]), 8)
        if edit == 1:
            edits.append((position, DROP))
        elif edit == 2:
            edits.append((position, ADD_QUOTE))
        elif edit == 3:
            edits.append((position, END_QUOTE))
        if line[position] == "," and edit in (0, 3) and not (state == QUOTED and source == QUOTED):
            k -= 1
        state, k = undo_inserts(adds, position, source, k) if adds is not None else (source, k)
    return total // QUOTE_COST, total % QUOTE_COST, edits[::-1]


def describe(edits: Sequence[tuple[int, str]]) -> str:
    return "; ".join(f"{what} at {at}" for at, what in edits)


def parse_records(records: DataFrame, key: str, line: str, columns: Sequence[str]) -> DataFrame:
    """(key, reason, edits, cells): reason and edits are null for records that load, cells for those that do not."""
    width = len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            reasons, edits, cells = [], [], []
            for text in b["line"]:
                record = without_return(text)
                found = cells_of(record)
                if found is not None and len(found) == width:
                    reasons.append(None), edits.append(None), cells.append(found)
                    continue
                quotes, _, how = min_cost_parse(record, width)
                reasons.append("quoting" if quotes else "columns"), edits.append(describe(how)), cells.append(None)
            yield pd.DataFrame({"key": b["key"], "reason": reasons, "edits": edits, "cells": cells})

    kind = records.schema[key].dataType.simpleString()
    out = records.select(F.col(key).alias("key"), F.col(line).alias("line")).mapInPandas(run, f"key {kind}, reason string, edits string, cells array<string>")
    return out.select(F.col("key").alias(key), "reason", "edits", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def readable_number(c: Column) -> Column:
    """An optional minus, at most 16 digits, optionally a point and more digits; absent counts as readable."""
    return F.coalesce(present(c).rlike(r"\A-?[0-9]{1,16}(\.[0-9]+)?\z"), F.lit(True))


def readable_day(c: Column) -> Column:
    """A calendar day written YYYY-MM-DD; absent counts as readable."""
    s = present(c)
    written = s.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    return F.coalesce(written & F.when(written, F.try_to_date(s, "yyyy-MM-dd").isNotNull() & ~s.startswith("0000")), F.lit(True))


def field_failures(rows: DataFrame, key: str, numbers: Sequence[str], days: Sequence[str]) -> DataFrame:
    """(key, reason): one row for each typed field that cannot be read, named by the field."""
    bad = [F.when(~readable_number(F.col(c)), F.lit(c)) for c in numbers] + [F.when(~readable_day(F.col(c)), F.lit(c)) for c in days]
    return rows.select(key, F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("reason"))

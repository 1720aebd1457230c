import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.text import file_day, full_abn, normalize_name, notice_key, plain_number, present
from ledgerloom.operators.history import EntityHistory, build_versions, register_statements
from ledgerloom.operators.orphans import Reference, cascade, reference_gaps
from ledgerloom.operators.parse_errors import cells_of, field_failures, min_cost_parse, parse_records
from ledgerloom.operators.snapshot_diff import snapshot_diff


def values(spark, f, xs):
    return [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").orderBy("i").select(f(F.col("x")).alias("y")).collect()]


def test_notation(spark):
    assert values(spark, notice_key, ["0012", "CN 12", "cn12-a01", " 12 - A3 ", "12-A0", "other", "NULL", "", None, "000"]) == ["12", "12", "12-A1", "12-A3", "12-A0", "other", None, None, None, "0"]
    assert values(spark, present, [" a ", "\t\n", "NULL", "null", "Null", None]) == ["a", None, None, None, "Null", None]
    assert values(spark, plain_number, ["1.50", "1.00", "10", "100.", "x0.0", None, "-2.0"]) == ["1.5", "1", "10", "100.", "x0.0", None, "-2"]
    assert values(spark, full_abn, ["12 345 678 901", "ABN 12345678901", "1234567890", None]) == ["12345678901", "12345678901", None, None]
    assert values(spark, file_day, ["a_20230102_x.csv", "a_20230102.xml", "none", None]) == ["2023-01-02", "2023-01-02", None, None]
    assert values(spark, normalize_name, ["Ab-c, (d)", "###", None]) == ["AB C D", "", None]


# histories

STATE = "abn string, day string, loaded int, status string, name string, extra string"
DAYS = ["d1", "d2", "d3", "d4"]


def versions(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], STATE)
    return {(r.abn, r.valid_from, r.valid_to): (r.status, r.name) for r in build_versions(df, DAYS, "abn", ["status", "name"]).collect()}


def test_versions(spark):
    rows = [
        ("gap", "d1", 1, "A", "N"), ("gap", "d3", 1, "A", "N"),
        ("null", "d1", 1, "A", None), ("null", "d2", 1, None, "N"), ("null", "d3", 1, "A", "N"), ("null", "d4", 1, "A", "M"),
        ("last", "d1", 1, "A", "N"), ("last", "d1", 2, "B", None), ("last", "d1", 2, "B", None),
        (None, "d1", 1, "A", "N"), ("noday", None, 1, "A", "N"),
    ]
    end = "9999-12-31"
    assert versions(spark, rows) == {("gap", "d1", "d2"): ("A", "N"), ("gap", "d3", "d4"): ("A", "N"), ("null", "d1", "d4"): ("A", "N"), ("null", "d4", end): ("A", "M"), ("last", "d1", "d2"): ("B", "N")}
    assert versions(spark, []) == {}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(DAYS), st.integers(1, 3), st.sampled_from(["A", "B", None]), st.sampled_from(["N", "M", None])), max_size=14))
def test_versions_equal_brute_force(spark, rows):
    want = {}
    for abn in "ab":
        run = None
        for k, d in enumerate(DAYS):
            own = [r for r in rows if r[0] == abn and r[1] == d]
            if not own:
                run = None
                continue
            last = lambda i: max(((r[2], r[i]) for r in own if r[i] is not None), default=(0, None))[1]
            s = [last(3), last(4)]
            if run and all(x is None or y is None or x == y for x, y in zip(run[2], s)):
                run[1], run[2] = k, [x if x is not None else y for x, y in zip(run[2], s)]
            else:
                run = [k, k, s]
                want.setdefault(abn, []).append(run)
    flat = {(abn, DAYS[r[0]], [*DAYS[1:], "9999-12-31"][r[1]]): tuple(r[2]) for abn, rs in want.items() for r in rs}
    assert versions(spark, rows) == flat


def test_late_rows_rebuild_only_their_chains(spark, tmp_path):
    early = [(f"e{i}", d, 1, "A", "N", "x") for i in range(40) for d in DAYS]
    late = [("e3", "d2", 9, "B", "N", "x"), ("new", "d1", 9, "A", "N", "x")]
    first, raw = spark.createDataFrame(early, STATE), spark.createDataFrame(early + late, STATE)
    h = EntityHistory(spark, f"file://{tmp_path}/h", "abn", ["status", "name"])
    h.load(first, DAYS)
    dirs = h.store.manifest()["dirs"]
    h.apply(spark.createDataFrame(late, STATE), DAYS)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(h.read()) == key(build_versions(raw, DAYS, "abn", ["status", "name"]))
    same = [b for b, d in h.store.manifest()["dirs"].items() if dirs.get(b) == d]
    assert 0 < len(same) < len(dirs) and h.store.version == 2
    h.apply(spark.createDataFrame(late, STATE), DAYS)
    assert key(h.read()) == key(build_versions(raw, DAYS, "abn", ["status", "name"]))


def test_a_new_snapshot_touches_only_what_it_moves(spark, tmp_path):
    old = [(f"e{i}", d, 1, "A", "N" if i != 4 else None, "x") for i in range(60) for d in DAYS]
    day = [(f"e{i}", "d5", 1, "B" if i == 1 else "A", "N", "x") for i in range(60) if i != 2] + [("fresh", "d5", 1, "A", "N", "x"), ("e3", "d2", 9, "B", "N", "x")]
    h = EntityHistory(spark, f"file://{tmp_path}/h", "abn", ["status", "name"], least_buckets=64)
    h.load(spark.createDataFrame(old, STATE), DAYS)
    dirs = h.store.manifest()["dirs"]
    key = lambda df: sorted(map(str, df.collect()))
    h.apply(spark.createDataFrame(day, STATE), [*DAYS, "d5"])
    assert key(h.read()) == key(build_versions(spark.createDataFrame(old + day, STATE), [*DAYS, "d5"], "abn", ["status", "name"]))
    changed = {b for b, d in h.store.manifest()["dirs"].items() if dirs.get(b) != d}
    assert 0 < len(changed) <= 5  # e1, e2, e3, e4 and fresh
    more = [("e7", "d7", 1, "C", "N", "x"), ("e8", "d6", 1, "A", "N", "x")]
    h.apply(spark.createDataFrame(more, STATE), [*DAYS, "d5", "d6", "d7"])
    assert key(h.read()) == key(build_versions(spark.createDataFrame(old + day + more, STATE), [*DAYS, "d5", "d6", "d7"], "abn", ["status", "name"]))
    between = [("e7", "d55", 1, "C", "N", "x")]
    h.apply(spark.createDataFrame(between, STATE), [*DAYS, "d5", "d55", "d6", "d7"])
    assert key(h.read()) == key(build_versions(spark.createDataFrame(old + day + more + between, STATE), [*DAYS, "d5", "d55", "d6", "d7"], "abn", ["status", "name"]))


def test_register_statements(spark):
    rows = [("12 345 678 901", "act ", "2020-01-02", "Ab & Cd  Pty. Ltd.", "main", dt.datetime(2023, 1, 1), "register_20230101_1.xml"), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "abn string, abn_status string, abn_status_from_date string, entity_name string, name_type string, _loaded_at timestamp_ntz, _source_file string")
    r = register_statements(df).collect()
    assert (r[0].abn, r[0].day, r[0].status, r[0].status_date, r[0].main_name) == ("12345678901", "2023-01-01", "ACT", "20200102", "ABCDPTYLTD")
    assert r[1].abn is None and r[1].main_name is None


# differences


def test_snapshot_diff(spark):
    rows = [("d1", "same", "a"), ("d2", "same", "a"), ("d2", "same", "a"), ("d1", "gone", "a"), ("d2", "new", None), ("d1", "part", "a"), ("d1", "part", "b"), ("d2", "part", "a"), ("d1", "null", None), ("d2", "null", ""), ("d1", None, "a"), (None, "x", "a"), ("d3", "gone", "a")]
    df = spark.createDataFrame(rows, "delivery string, cnid string, v string").withColumn("side", F.lit(1))
    got = {(r.delivery, r.cnid, r.change) for r in snapshot_diff(df, "cnid", "delivery", ["v"]).collect()}
    d3 = {("d3", k, "removed") for k in ("same", "new", "part", "null")} | {("d3", "gone", "added")}
    assert got == {("d2", "gone", "removed"), ("d2", "new", "added"), ("d2", "part", "changed"), ("d2", "null", "changed")} | d3
    assert snapshot_diff(df.limit(0), "cnid", "delivery", ["v"]).collect() == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["d1", "d2", "d3"]), st.sampled_from("kmn"), st.sampled_from(["a", "b", None])), max_size=14))
def test_snapshot_diff_equals_brute_force(spark, rows):
    days = sorted({r[0] for r in rows})
    contents = lambda d, k: {r[2] for r in rows if r[:2] == (d, k)}
    want = set()
    for before, now in zip(days, days[1:]):
        for k in "kmn":
            x, y = contents(before, k), contents(now, k)
            if x != y:
                want.add((now, k, "added" if not x else "removed" if not y else "changed"))
    df = spark.createDataFrame(rows, "delivery string, cnid string, v string").withColumns({"day": F.lit("clash"), "key": F.lit("clash")})
    assert {tuple(r) for r in snapshot_diff(df, "cnid", "delivery", ["v"]).collect()} == want


# orphans


def test_gaps(spark):
    refs = spark.createDataFrame([("a", "d2"), ("b", "d2"), ("c", "d2"), ("d", "d2"), ("a", "d0"), (None, "d2"), ("z", "d9")], "abn string, day string")
    held = spark.createDataFrame([("a", "d1"), ("b", "d0"), ("c", "d3"), ("a", "d1"), (None, "d1")], "abn string, snapshot string")
    got = {(r.abn, r.day): r.kind for r in reference_gaps(refs, held, "abn").collect()}
    assert got == {("b", "d2"): "deleted", ("c", "d2"): "later", ("d", "d2"): "missing", ("a", "d0"): "later", ("z", "d9"): "missing"}


def test_cascade_down_a_chain(spark):
    t = spark.createDataFrame([(i, i, i - 1 if i else 99) for i in range(6)] + [(10, 10, None), (11, 11, 10), (12, 10, 10)], "row_id bigint, k bigint, up bigint")
    r = {x.row_id: (x.level, x.via) for x in cascade({"t": t}, [Reference("t", ("up",), "t", ("k",))]).collect()}
    assert r == {i: (i, "t.up") for i in range(6)}
    assert cascade({"t": t.limit(0)}, [Reference("t", ("up",), "t", ("k",))]).collect() == []


def test_cascade_three_levels_down_a_graph_of_tables(spark):
    """A line hangs on a notice, a notice on a supplier and an amendment on its notice; one row is orphaned by two references."""
    suppliers = spark.createDataFrame([(1, "s1")], "row_id bigint, s string")
    notices = spark.createDataFrame([(1, "n1", "s1", None), (2, "n2", "lost", None), (3, "n3", "s1", "n2"), (4, "n4", "s1", "n3"), (5, "n5", "lost", "gone"), (6, "n6", None, "n1")], "row_id bigint, n string, s string, base string")
    lines = spark.createDataFrame([(1, "n4", "a"), (2, "n1", "b"), (3, None, "c"), (4, "n9", "d")], "row_id bigint, n string, note string")
    refs = [Reference("notices", ("s",), "suppliers", ("s",)), Reference("notices", ("base",), "notices", ("n",)), Reference("lines", ("n",), "notices", ("n",))]
    got = {(x.table, x.row_id): (x.level, x.vias, x.note) for x in cascade({"suppliers": suppliers, "notices": notices, "lines": lines}, refs, carry=("note",)).collect()}
    assert got == {
        ("notices", 2): (0, ["notices.s"], None), ("notices", 5): (0, ["notices.base", "notices.s"], None), ("notices", 3): (1, ["notices.base"], None), ("notices", 4): (2, ["notices.base"], None),
        ("lines", 1): (3, ["lines.n"], "a"), ("lines", 4): (0, ["lines.n"], "d"),
    }


def test_cascade_over_a_cycle_ends(spark):
    t = spark.createDataFrame([(1, 1, 9, 2), (2, 2, None, 1)], "row_id bigint, k bigint, lost bigint, up bigint")
    refs = [Reference("t", ("lost",), "t", ("k",)), Reference("t", ("up",), "t", ("k",))]
    assert {(x.row_id, x.level) for x in cascade({"t": t}, refs).collect()} == {(1, 0), (2, 1)}


# parsing

cell = st.text('a",\n ', max_size=6)


def quoted(c):
    return '"' + c.replace('"', '""') + '"'


@settings(max_examples=300, deadline=None)
@given(st.lists(cell, min_size=3, max_size=3))
def test_well_formed_records_cost_nothing(cells):
    line = ",".join(map(quoted, cells))
    assert cells_of(line) == cells
    assert min_cost_parse(line, 3) == (0, 0, [])


@settings(max_examples=400, deadline=None)
@given(st.text('a",', max_size=12), st.integers(1, 4))
def test_the_cheapest_edits_tell_the_reason(line, width):
    quotes, delimiters, edits = min_cost_parse(line, width)
    found = cells_of(line)
    assert (quotes > 0) == (found is None)
    if found is not None:
        assert delimiters == abs(len(found) - width)
    out, shift = list(line), 0
    for at, what in edits:
        if what == "delete":
            out.pop(at + shift)
            shift -= 1
        else:
            out.insert(at + shift, "," if "delimiter" in what else '"')
            shift += 1
    if quotes == 0 or not any(w == "insert quote" for _, w in edits):
        assert len(edits) == quotes + delimiters


def test_parse_records(spark):
    rows = [(1, "a,b,c"), (2, 'a,"b\nb",c\r'), (3, 'a,"b,c'), (4, 'a,"b" x,c'), (5, 'a,b"b,c'), (6, "a,b"), (7, ""), (8, None), (9, 'a,"b ""q""",c'), (10, "x" * 300_000 + ",b,c"), (11, '"' + "y" * 3000)]
    df = spark.createDataFrame(rows, "line_id bigint, line string").withColumn("key", F.lit("clash"))
    got = {r.line_id: (r.reason, r.b) for r in parse_records(df, "line_id", "line", ["a", "b", "c"]).collect()}
    assert got == {1: (None, "b"), 2: (None, "b\nb"), 3: ("quoting", None), 4: ("quoting", None), 5: ("quoting", None), 6: ("columns", None), 7: ("columns", None), 8: ("columns", None), 9: (None, 'b "q"'), 10: (None, "b"), 11: ("quoting", None)}
    assert parse_records(df.limit(0), "line_id", "line", ["a"]).collect() == []


@pytest.mark.parametrize("v,d,bad", [
    ("1", "2020-02-29", []), (" 1.5 ", " 2020-01-01", []), ("-0.1", None, []), ("NULL", "null", []), ("1.", "2021-02-29", ["v", "d"]), ("1,000", "2020-1-01", ["v", "d"]), ("12345678901234567", "0000-00-00", ["v", "d"]),
    ("1234567890123456.123", "20-01-01", ["d"]), ("+1", "2020-01-01T00:00:00", ["v", "d"]), ("1e5", "2020-13-01", ["v", "d"]), ("１", "", ["v"]),
])
def test_field_failures(spark, v, d, bad):
    df = spark.createDataFrame([(1, v, d)], "k bigint, v string, d string")
    assert [r.reason for r in field_failures(df, "k", ["v"], ["d"]).collect()] == bad

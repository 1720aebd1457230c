"""Loads and histories over every delivery and extract, on four small ones."""

import datetime as dt

import pytest

from ledgerloom.queries import engine

COLUMNS = (*engine.TEXT_COLUMNS, "cnid")
STATES = [{"1": "a", "2": "a", "3": "a"}, {"1": "b", "2": "a"}, {"1": "b", "3": "c", "4": "a"}, {"1": "a", "4": "a", "5": "a"}]
ENTITY = ["ACT", "CAN", "CAN", "ACT"]
RUN = [dt.datetime(2024, n, 1) for n in (1, 2, 3, 4)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    home, rows, register = str(tmp_path_factory.mktemp("small")), [], []
    for n, state in enumerate(STATES, 1):
        at = dt.datetime(2023, n, 2)
        for k, v in state.items():
            r = dict.fromkeys(COLUMNS) | {"cnid": k, "value": "5", "suppliername": "S", "supplierabn": "12345678901", "description": v, "publishdate": f"2023-0{n}-01"}
            r["publishdate"] = "2023-01-01" if v == "a" else r["publishdate"] if v == "c" else "2023-01-02"
            rows.append((*[r[c] for c in COLUMNS], at, f"notices_full_20230{n}01_c1.csv", len(rows)))
        register.append(("12345678901", ENTITY[n - 1], "20200101", "PRV", "Private", "S", "MAIN", "NSW", "2000", at, f"register_20230{n}01_1.xml"))
    text = lambda cs: ", ".join(f"{c} string" for c in cs)
    more = ", _loaded_at timestamp_ntz, _source_file string"
    spark.createDataFrame(rows, text(COLUMNS) + more + ", row_id bigint").write.parquet(f"{home}/raw_contract_data.parquet")
    spark.createDataFrame(register, text(engine.REGISTER_COLUMNS) + more).write.parquet(f"{home}/raw_abr_entity.parquet")
    spark.createDataFrame([], "normalized_name string, category string, reason string").write.parquet(f"{home}/known_non_suppliers.parquet")
    return home


def query(spark, small, name, *columns):
    return sorted(tuple(r) for r in engine.QUERIES[name](spark, small).select(*columns).collect())


def test_loads(spark, small):
    state = ("cnid", "description", "_loaded_at")
    assert query(spark, small, "delta_merge", *state) == [("1", "a", RUN[3]), ("4", "a", RUN[2]), ("5", "a", RUN[3])]
    assert query(spark, small, "full_load", *state) == [("1", "a", RUN[3]), ("4", "a", RUN[3]), ("5", "a", RUN[3])]
    # published before the watermark: what the third and fourth delivery say of 1, 4 and 5
    assert query(spark, small, "incremental_load", *state) == [("1", "b", RUN[1]), ("2", "a", RUN[0]), ("3", "c", RUN[2])]
    assert query(spark, small, "prune_missing", "cnid", "_removed_at") == [("2", RUN[2]), ("3", RUN[1]), ("3", RUN[3])]


def test_changes(spark, small):
    assert query(spark, small, "cdc_merge", "contract_id", "loaded_at", "_merged_at") == [("1", RUN[3], RUN[3]), ("4", RUN[2], RUN[2]), ("5", RUN[3], RUN[3])]


def test_history(spark, small):
    assert query(spark, small, "scd2_history", "valid_from", "abr_abn_status", "valid_to", "is_current") == [(RUN[0], "ACT", RUN[1], False), (RUN[1], "CAN", RUN[3], False), (RUN[3], "ACT", None, True)]

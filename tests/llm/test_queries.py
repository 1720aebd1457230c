"""The registered queries on the smallest tables: SQL where there is some, columns and invariants for the rest."""

import os

import pytest

from ledgerloom.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_best_rows_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"create view raw_contract_data as select * from read_parquet('{DATA}/raw_contract_data.parquet')")
    got = sorted((r.delivery, r.cnid, r.row_id) for r in queries.p5_found(spark, DATA).collect())
    assert got == sorted(db.execute(queries.ORACLE["p5_found"]).fetchall()) and got


def test_columns_and_keys(spark):
    p3 = queries.p3_found(spark, DATA)
    assert dict(p3.dtypes) == {"supplierid": "string", "abn": "string"}
    rows = p3.collect()
    assert len({r.supplierid for r in rows}) == len(rows) and all(len(r.abn) == 11 for r in rows)
    pairs = queries.p7_found(spark, DATA).collect()
    assert all(r.name_a.encode() < r.name_b.encode() for r in pairs) and len(set(pairs)) == len(pairs)
    ids = queries.p8_ids(spark, DATA)
    assert dict(ids.dtypes) == {"doc_id": "bigint", "ids": "array<int>"} and ids.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert dict(queries.p9_found(spark, DATA).dtypes) == {"doc_id": "bigint", "item_id": "bigint"}
    langs = queries.p10_found(spark, DATA)
    assert dict(langs.dtypes) == {"doc_id": "bigint", "lang": "string"} and langs.distinct().count() == langs.count()


def test_identifiers_cut_at_one_end_or_with_one_slip(spark):
    from pyspark.sql import functions as F

    from ledgerloom.llm.queries import _by_identifier, _one_edit_away

    away = set(spark.createDataFrame([("102",)], "n string").select(_one_edit_away(F.col("n"))).first()[0])
    assert away == {a + b + c for a in "0123456789" for b in "0123456789" for c in "0123456789" if sum(x != y for x, y in zip(a + b + c, "102")) == 1} | {"012", "120"}
    entities = spark.createDataFrame([("12345678901",), ("12345699999",), ("98765432109",)], "entity string")
    stated = [("cut", "345678901"), ("both", "123456"), ("digit", "12345678911"), ("swap", "12345687901"), ("known", "98765432109"), ("two", "12355678911"), ("short", "12345"), (None, "345678901")]
    rows = spark.createDataFrame(stated, "record string, stated string").where("record is not null")
    got = {(r.record, r.entity): round(r.identifier, 3) for r in _by_identifier(rows, entities).collect()}
    assert got == {("cut", "12345678901"): 0.9, ("both", "12345678901"): 0.3, ("both", "12345699999"): 0.3, ("digit", "12345678901"): 0.9, ("swap", "12345678901"): 0.9}
    assert _by_identifier(rows.limit(0), entities).collect() == []


def test_survivors_need_no_estimate(spark, tmp_path, monkeypatch):
    """More files than the source model takes: the order alone decides, and is that of SQL."""
    from ledgerloom.llm import fusion

    duckdb = pytest.importorskip("duckdb")
    schema = spark.read.parquet(f"{DATA}/raw_contract_data.parquet").schema
    rows = []
    for i in range(2001):  # each file says notice i and repeats a part of notice i + 1
        for k, (cnid, value) in enumerate([(f"CN{i}", "1.50"), (f"0{i + 1}", ["0", "-2", "1" * 17, None][i % 4])]):
            row = dict.fromkeys(schema.names) | {"cnid": cnid, "value": value, "category": ["x", "", "NULL"][i % 3], "row_id": 10 * i + k, "_source_file": f"notices_20240131_{i}.csv"}
            rows.append(tuple(row[c] for c in schema.names))
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/raw_contract_data.parquet")
    monkeypatch.setattr(fusion, "fuse", lambda *a, **k: pytest.fail("an estimate that decides nothing"))
    db = duckdb.connect()
    db.execute(f"create view raw_contract_data as select * from read_parquet('{tmp_path}/raw_contract_data.parquet/*.parquet')")
    got = sorted((r.delivery, r.cnid, r.row_id) for r in queries.p5_found(spark, str(tmp_path)).collect())
    assert got == sorted(db.execute(queries.ORACLE["p5_found"]).fetchall()) and len(got) == 2000


def test_the_proposal_stands_beside_the_survivor(spark):
    got = queries.p5_proposed(spark, DATA).collect()
    found = {(r.delivery, r.cnid): r.row_id for r in queries.p5_found(spark, DATA).collect()}
    assert {(r.delivery, r.cnid): r.row_id for r in got} == found and len(got) == len(found)
    assert 0 < sum(r.row_id == r.proposed for r in got) < len(got)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(queries.p5_proposed(spark, DATA).collect()) == sorted(got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
